"""Neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import neighbours


def frame(spark, vectors, ids=None):
    rows = [(int(i), v) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def brute(vectors, ids, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:k]
    return [(int(ids[i]), scores[i]) for i in order]


@pytest.mark.parametrize("axis", [2, 3])
def test_hilbert_steps_to_a_neighbour_each_time(axis):
    cells = np.stack(np.meshgrid(*[np.arange(8)] * axis, indexing="ij"), -1).reshape(-1, axis)
    keys = neighbours.hilbert_keys(cells, 3)
    along = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(8**axis)) and (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_windows_hold_most_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 16))).astype(np.float32) * rng.uniform(0.5, 2, (2000, 1)).astype(np.float32)
    ids = rng.permutation(2000)
    got = {}
    for r in neighbours.nearest(frame(spark, vectors.tolist(), ids), F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    assert len(got) == 100
    hit = 0
    for at in np.flatnonzero(ids % 20 == 0):
        found = [got[ids[at]][k] for k in range(1, 21)]
        exact = brute(vectors.astype(float), ids, at, 20)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and ids[at] not in [f[0] for f in found]
        hit += len({f[0] for f in found} & {e[0] for e in exact})
    assert hit / 2000 >= 0.9


def test_odd_vectors(spark):
    vectors = [[1.0, 0.0], [0.5, 0.5], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 0.0, 0.0], [], [1.0, 0.0], [-1.0, 0.0], [0.5, 0.5]]
    df = frame(spark, vectors).withColumn("id", F.lit("clash")).withColumn("score", F.lit(0))
    df = df.unionByName(df.filter("vec_id = 9"))
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 2 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert got[0] == [(1, 9, 1.0), (2, 1, 0.5), (3, 11, 0.5), (4, 10, -1.0)]
    assert set(got) == {0, 10}
    assert neighbours.nearest(df.filter("false"), F.col("id") % 2 == 0).count() == 0


def test_equal_vectors_rank_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 32)
    vectors = [[1.0, 0.5, 0.25]] * 400 + np.random.default_rng(0).normal(size=(200, 3)).tolist()
    found = neighbours.nearest(frame(spark, vectors), F.col("id") == 300, k=5).orderBy("rank").collect()
    exact = brute(np.array(vectors, np.float32).astype(float), np.arange(600), 300, 5)
    assert [r["score"] for r in found] == [s for _, s in exact]
