"""Nearest neighbours by inner product along shifted Hilbert curves.

Vectors are lengthened by one coordinate that gives all the same norm, so that the
largest inner product is the smallest distance, and projected at random to a few
dimensions. In each of several orderings the projections are shifted and ranked
along a Hilbert curve: Spark sorts the keys by range. A query looks at the tiles of
the ranking next to its own place, and what it finds in all orderings is merged and
ranked again by the inner product itself.

How far a query looks is measured, not assumed: for at most ``SAMPLE`` queries the
exact neighbours are found among all rows, and the window is the smallest that
holds ``RECALL`` of them. Every row is in every ordering; nothing is dropped.

Cases: vectors that are null, zero, of another length than most, or that hold null
or non-finite numbers take no part, neither as query nor as candidate; equal vectors
rank by id, and a query looks from the first of its equals on; rows repeated with
the same id count once for a query (the best of them); null ids take no part; with
fewer candidates than ``k`` all are told; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import with_running_total
from maskloom.sources.scratch import settled

ORDERINGS, DIMENSIONS, BITS = 3, 6, 8
TILE = 8192  # ranks in a tile
CHUNK = 32  # query tiles that meet a tile in one group
SAMPLE, RECALL = 256, 0.95
SEED = 42


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cell numbers along the Hilbert curve through all cells."""
    x = [c.copy() for c in cells.astype(np.uint64).T]
    side = np.uint64(1 << (bits - 1))
    q = side
    while q > 1:
        low = q - np.uint64(1)
        for i in range(len(x)):
            inverted = (x[i] & q) != 0
            swapped = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
        q >>= np.uint64(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = side
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | (((axis ^ turn) >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)


def _matrix(packed: pd.Series | pa.Array, dim: int) -> np.ndarray:
    values = packed.to_pylist() if isinstance(packed, pa.Array) else packed
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vec, norm2) with vectors as packed doubles, and their length."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    norm2 = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    rows = df.select(F.col(id_col).alias("id"), vector.alias("v"), norm2.alias("norm2")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            packed = pa.array([row.tobytes() for row in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], ["id", "vec", "norm2"])

    kind = rows.schema["id"].dataType.simpleString()
    return settled(rows.filter(F.size("v") == dim).mapInArrow(pack, f"id {kind}, vec binary, norm2 double")), dim


def _projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim + 1, ORDERINGS * DIMENSIONS))


def _with_keys(entries: DataFrame, dim: int, most: float) -> DataFrame:
    """``entries`` (id, vec, norm2, is_row) with an array ``keys``: their place along the curve of each ordering."""
    axes = _projections(dim)

    def project(batches: Iterator[pa.RecordBatch], stats: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        shifts = np.random.default_rng(SEED + 1).random(ORDERINGS * DIMENSIONS)
        for batch in batches:
            vectors, is_row = _matrix(batch.column(1), dim), batch.column(3).to_numpy(zero_copy_only=False)
            added = np.sqrt(np.maximum(most - batch.column(2).to_numpy(), 0)) * is_row
            on_axes = np.hstack([vectors, added[:, None]]) @ axes
            if stats is None:
                sums = pa.array([on_axes.sum(axis=0).tolist()]), pa.array([(on_axes**2).sum(axis=0).tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), *sums], ["n", "s", "s2"])
                continue
            even = 1 / (1 + np.exp(-1.7 * (on_axes - stats[0]) / stats[1]))
            cells = ((even + shifts) * (1 << (BITS - 1))).astype(np.int64)
            keys = np.stack([hilbert_keys(cells[:, i : i + DIMENSIONS], BITS) for i in range(0, cells.shape[1], DIMENSIONS)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    n_axes = ORDERINGS * DIMENSIONS
    sums = entries.filter("is_row").mapInArrow(lambda b: project(b, None), "n bigint, s array<double>, s2 array<double>")
    row = sums.agg(F.sum("n"), *[F.sum(F.get(c, F.lit(i))) for c in ("s", "s2") for i in range(n_axes)]).first()
    n = max(row[0] or 0, 1)
    mean = np.array([x or 0.0 for x in row[1 : 1 + n_axes]]) / n
    spread = np.sqrt(np.maximum(np.array([x or 0.0 for x in row[1 + n_axes :]]) / n - mean**2, 1e-18))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(lambda b: project(b, (mean, spread)), f"{schema}, keys array<bigint>")


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` nearest rows of each query but for its own id; ties to the smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    margin = 1e-9 * (np.abs(rows).max(initial=0) ** 2 * rows.shape[1] + 1)
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        rough = part @ rows.T
        for i, near in enumerate(rough):
            own = row_ids == query_ids[start + i]
            near[own] = -np.inf
            m = len(near) - int(own.sum())
            if m <= 0:
                continue
            cut = np.partition(near, len(near) - min(k, m))[len(near) - min(k, m)]
            at = np.flatnonzero(near >= cut - margin)
            # Summed in one order, so that equal vectors get equal scores wherever they lie.
            score = (rows[at] * part[i]).sum(axis=1)
            order = np.lexsort((row_ids[at], -score))
            ids, first = np.unique(row_ids[at][order], return_index=True)
            kept = order[np.sort(first)][:k]
            out[0].append(np.full(len(kept), query_ids[start + i]))
            out[1].append(row_ids[at][kept])
            out[2].append(score[kept])
    return out


def _table(found: tuple[list, list, list]) -> pd.DataFrame:
    columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "id", "score"), columns, strict=True)))


FOUND = "query_id bigint, id bigint, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query among what all tiles gave."""
    each = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """(query_id, id, score, rank) of a bounded list of (id, packed vector), among all rows."""
    ids = np.array([i for i, _ in queries], np.int64)
    vectors = _matrix(pd.Series([v for _, v in queries]), dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _best(vectors, ids, _matrix(batch.column(1), dim), batch.column(0).to_numpy(), k)
            yield pa.RecordBatch.from_pandas(_table(found), preserve_index=False)

    return _ranked(rows.select("id", "vec").mapInArrow(scan, FOUND), k)


def _window(places: DataFrame, rows: DataFrame, dim: int, k: int) -> int:
    """Tiles on either side that hold ``RECALL`` of the true neighbours of a sample of queries."""
    chosen = rows.join(places.filter("NOT is_row AND s = 0").select("id"), "id", "left_semi").dropDuplicates(["id"])
    sample = chosen.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return 0
    truth = settled(exact_neighbours(rows, [(row["id"], row["vec"]) for row in sample], dim, k))
    at = places.filter("NOT is_row").select(F.col("id").alias("query_id"), "s", F.col("tile").alias("from")).distinct()
    to = places.filter("is_row").groupBy("id", "s").agg(F.min("tile").alias("tile"))
    # At most SAMPLE x k rows.
    far = F.broadcast(truth).join(at, "query_id").join(to, ["id", "s"]).groupBy("query_id", "id").agg(F.min(F.abs(F.col("tile") - F.col("from"))).alias("far"))
    distances = np.sort([row["far"] for row in far.collect()])
    return int(distances[min(len(distances) - 1, int(np.ceil(RECALL * len(distances))))]) if len(distances) else 0


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row for which ``is_query`` holds (on column ``id``)."""
    rows, dim = usable(df, id_col, vector_col)
    rows = settled(rows.withColumn("id", F.col("id").cast("bigint")))
    most = rows.agg(F.max("norm2")).first()[0] or 0.0
    entries = rows.withColumn("is_row", F.lit(True)).unionByName(rows.filter(is_query).dropDuplicates(["id"]).withColumn("is_row", F.lit(False)))
    keyed = settled(_with_keys(entries, dim, most))
    along = settled(keyed.select("id", "is_row", F.posexplode("keys").alias("s", "key")))
    # A query stands before the rows of its key and is no row itself.
    ranked = with_running_total(along, "s", ["key", "is_row", "id"], F.col("is_row").cast("int"), name="place")
    places = settled(ranked.select("id", "is_row", "s", F.floor(F.col("place") / TILE).alias("tile")))
    window = _window(places, rows, dim, k)
    last = places.filter("is_row").agg(F.max("tile")).first()[0] or 0
    own = F.least(F.col("tile"), F.lit(last))
    reach = F.sequence(F.greatest(own - window, F.lit(0)), F.least(own + window, F.lit(last)))
    chunk = F.floor(F.col("tile") / CHUNK)
    vectors = keyed.select("id", "is_row", "vec")
    asked = places.filter("NOT is_row").join(vectors.filter("NOT is_row").drop("is_row"), "id")
    asked = asked.select(F.col("s").alias("q_s"), F.explode(reach).alias("q_tile"), chunk.alias("q_chunk"), F.col("id").alias("query_id"), F.col("vec").alias("q_vec"))
    chunks = F.sequence(F.floor(F.greatest(F.col("tile") - window, F.lit(0)) / CHUNK), F.floor((F.col("tile") + window) / CHUNK))
    held = places.filter("is_row").distinct().join(vectors.filter("is_row").drop("is_row").dropDuplicates(), "id").select("s", "tile", F.explode(chunks).alias("chunk"), "id", "vec")

    def meet(queries: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(tile):
            return _table(([], [], []))
        return _table(_best(_matrix(queries["q_vec"], dim), queries["query_id"].to_numpy(), _matrix(tile["vec"], dim), tile["id"].to_numpy(), k))

    groups = held.groupBy("s", "tile", "chunk")
    found = asked.groupBy("q_s", "q_tile", "q_chunk").cogroup(groups).applyInPandas(meet, FOUND)
    return _ranked(found, k).select("query_id", "rank", "id", "score")
