"""Fill-in-the-middle against a brute-force version, and the rank index against its offsets."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import infill


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(mark in text for mark in infill.MARKERS) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["\n", "\n\n\n", "a\nb", "no end\n", "has <M> inside\nb\n", "<", "<S\n<P\n<M\n<\n<<\n", "P>\nS>\n<<P\n", "x" * 100_000, "é\n" * 50_000, "\x00\r\n \n"]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100)])
def test_against_brute_force(spark, odd_documents, rate, spm):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD * 4)], "doc_id bigint, text string")
    docs = odd_documents.unionByName(odd, allowMissingColumns=True)
    got = infill.fill_in_middle(docs, rate=rate, spm=spm).withColumn("again", infill.restored())
    want = Counter(expected(d["doc_id"], d["text"], rate, spm) for d in docs.collect())
    rows = got.collect()
    assert Counter(tuple(r)[:-1] for r in rows) == want
    assert Counter(r["again"] for r in rows) == Counter(d["text"] or "" for d in docs.collect())


def test_other_markers_and_names(spark):
    df = spark.createDataFrame([("a", "one\ntwo\nthree\n"), ("b", "<P>\n")], "key string, body string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = infill.fill_in_middle(df, "key", "body", markers=marks).withColumn("again", infill.restored(markers=marks))
    assert {r["again"] for r in got.collect()} == {"one\ntwo\nthree\n", "<P>\n"}
    assert got.filter(F.col("form") == "plain").count() == 0


def test_empty(no_documents):
    assert infill.fill_in_middle(no_documents).count() == 0


@pytest.mark.parametrize("error", [1, 8, 1 << 14])
def test_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(error)
    for steps in (rng.integers(1, 50, 5000), np.r_[np.ones(3000, int), 10**6, np.full(500, 7)], [1], np.full(1000, 9)):
        offsets = np.concatenate([[0], np.cumsum(steps)])
        index = infill.RankIndex.fit(offsets, error)
        assert (index.offset(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residual).max() <= error + 1
    assert len(index.first) == 1
