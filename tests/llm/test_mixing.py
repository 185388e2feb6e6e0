"""Targets, flow and draw of a mix."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from maskloom.llm import mixing
from maskloom.sources.scratch import settled


def test_targets_share_the_excess_until_none_is_above():
    sizes, weights = [100, 1000, 10, 0], [3, 1, 2, 3]
    targets = mixing.weighted_targets(sizes, weights)
    assert targets[0] == 200 and targets[2] == 20 and targets[3] == 0
    assert sum(targets) == pytest.approx(1.5 * sum(sizes)) and targets[1] == pytest.approx(1445)
    assert mixing.weighted_targets([], []) == []


def brute_flow(offers, serves, quotas, repeats):
    """Most words served, and the least cost of that, over all whole routings."""
    choices = [list(itertools.product(*[range(quotas[q] + 1) for q in s])) for s in serves]
    best = (0, 0)
    for pick in itertools.product(*choices):
        used, got = [sum(x) for x in pick], Counter()
        for s, x in zip(serves, pick, strict=True):
            for q, n in zip(s, x, strict=True):
                got[q] += n
        if any(u > o * repeats for u, o in zip(used, offers, strict=True)) or any(got[q] > n for q, n in enumerate(quotas)):
            continue
        cost = sum(k * min(max(u - k * o, 0), o) for u, o in zip(used, offers, strict=True) for k in range(repeats))
        best = max(best, (sum(used), -cost))
    return best


@pytest.mark.parametrize(
    "offers, serves, quotas",
    [([3, 2], [[0], [0, 1]], [4, 3]), ([1, 2, 2], [[0, 1], [1], [0]], [3, 3]), ([2, 2], [[0, 1], [0, 1]], [3, 4]), ([4], [[]], [2]), ([0, 2], [[0], [0]], [3])],
)
def test_flow_is_the_largest_and_cheapest(offers, serves, quotas):
    flow = mixing.least_cost_flow(offers, serves, quotas, 2)
    used = [sum(f.values()) for f in flow]
    cost = sum(k * min(max(u - k * o, 0), o) for u, o in zip(used, offers, strict=True) for k in range(2))
    assert (sum(used), -cost) == brute_flow(offers, serves, quotas, 2)


def test_mix_by_source(odd_documents):
    got = mixing.mix_by_source(odd_documents).collect()
    docs = odd_documents.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d["doc_id"], size(d["text"])) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size(d["text"])
    names = sorted(n for n in sizes if n is not None) + [None]
    targets = dict(zip(names, mixing.weighted_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
        source = next(n for n in names if sizes[n] == r["source_size"])
        assert r["target"] == pytest.approx(targets[source])
        taken[source] += r["taken"]
    # The one very long text is as large as all others together; without it the mix would miss by a word or two.
    for name in names:
        largest = max(size(d["text"]) for d in docs if d["source"] == name)
        assert abs(taken[name] - targets[name]) <= largest / 2


def test_mix_comes_near_and_is_the_same_again(spark):
    rows = spark.range(3000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(500)) + 1).alias("size"), F.array(F.concat(F.lit("s"), F.col("id") % 3)).alias("members"))
    rows = settled(rows)
    total = rows.agg(F.sum("size")).first()[0]
    quotas = {"s0": total / 10, "s1": total / 3, "s2": total / 2}
    first, second = (sorted(map(tuple, mixing.mix(r, quotas).select("id", "copies").collect())) for r in (rows, settled(rows.repartition(7))))
    assert first == second
    taken = mixing.mix(rows, quotas).groupBy(F.col("members")[0].alias("s")).agg(F.sum(F.col("copies") * F.col("size")).alias("n"))
    for r in taken.collect():
        assert abs(r["n"] - quotas[r["s"]]) <= 10


def test_overlapping_sources_serve_each_other(spark):
    rows = [(i, 10, ["a"]) for i in range(20)] + [(100 + i, 10, ["a", "b"]) for i in range(20)] + [(200 + i, 10, ["b", None]) for i in range(5)]
    df = settled(spark.createDataFrame(rows, "id bigint, size bigint, members array<string>"))
    got = mixing.mix(df, {"a": 200, "b": 250, None: 0}).collect()
    served = Counter(q for r in got for q in r["drawn_for"] for _ in range(r["size"]))
    assert served == {"a": 200, "b": 250} and all(r["copies"] == 1 for r in got)


@pytest.mark.parametrize("few", [0, 20_000])
def test_no_document_that_fits_is_left(spark, monkeypatch, few):
    """Long documents at the cut leave room for more than 100,000 words, and the next may be as long."""
    monkeypatch.setattr(mixing, "FEW", few, raising=False)
    sizes = [(i, 400_000 + i, ["s"]) for i in range(20)] + [(100 + i, 997 + i % 7, ["s"]) for i in range(600)]
    rows = settled(spark.createDataFrame(sizes, "id bigint, size bigint, members array<string>"))
    short = []
    for quota in (1_300_000, 2_950_000, 5_170_000):
        got = mixing.mix(rows, {"s": quota}, repeats=1).collect()
        assert len(got) == len(sizes)
        left = quota - sum(r["copies"] * r["size"] for r in got)
        assert left >= 0
        short += [left - r["size"] for r in got if not r["copies"] and r["size"] <= left]
    assert not short


def test_mix_empty(no_documents):
    assert mixing.mix_by_source(no_documents).count() == 0


def test_plan_needs_no_python_workers(spark, monkeypatch):
    """What the driver tells is part of the plan: rows dealt out by Spark's Python side start workers that stay on."""

    def forbidden(*_, **__):
        raise AssertionError("rows go through Python workers")

    rows = settled(spark.range(40).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "if(id % 3 = 0, NULL, concat('s', id % 3)) AS source"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", forbidden)
    got = mixing.mix_by_source(rows).collect()
    assert len(got) == 40 and sum(r["taken"] for r in got) > 0
    assert mixing.mix_by_source(rows.filter("false")).count() == 0
