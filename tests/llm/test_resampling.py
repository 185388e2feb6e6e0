"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maskloom.llm import resampling

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text, least, most, buckets):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(WORD, lower)
    runs = [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % buckets for run in runs]


def expected(docs, target, runs, buckets, least_words, percent):
    bags = [(doc_id, *features(text, *runs, buckets)) for doc_id, text in docs]
    s, t = Counter(), Counter()
    for _, _, bag in bags:
        s.update(bag)
    for text in target:
        t.update(features(text, *runs, buckets)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in s}
    rows = []
    for doc_id, n_words, bag in bags:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bag)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n_words, len(bag), weight, score))
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = able[: len(able) * percent // 100]
    undrawn = [r for r in rows if r[1] < least_words] + able[len(drawn) :]
    return Counter([(r[0], *r[2:], i) for i, r in enumerate(drawn, 1)] + [(r[0], *r[2:], None) for r in undrawn])


@pytest.mark.parametrize(("runs", "buckets", "percent"), [((1, 1), 10_000, 10), ((1, 3), 70_000, 50), ((2, 2), 100, 100)])
def test_against_brute_force(spark, odd_documents, runs, buckets, percent):
    extra = [(2000, "word " * 5 + "é" * 3000 + " " + "z" * 5000 + " end é\x01 1 \x012"), (2001, "A1b2 ¿Qué? naïve-Ünï \x85 \xa0x")]
    docs = odd_documents.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    target = [(1, "alpha beta gamma delta, Qué"), (2, None), (3, "epsilon. x1 alpha beta"), (4, "z" * 5000 + " end")]
    aim = spark.createDataFrame(target, "item_id bigint, text string")
    got = resampling.resample_to_target(docs, aim, runs=runs, buckets=buckets, percent=percent)
    want = expected([(d["doc_id"], d["text"]) for d in docs.collect()], [t for _, t in target], runs, buckets, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == want


def test_empty_tables(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample_to_target(no_documents, none).count() == 0
    got = resampling.resample_to_target(odd_documents, none, percent=100)
    assert got.count() == odd_documents.count()


def test_crc_of_joined_strings():
    tables = resampling._zero_steps()
    first, second = [b"", b"a", b"abc", b"x" * 1000], [b"z" * 70_000, b"", b"de", b"\xff\x00"]
    crc = lambda strings: np.array([zlib.crc32(s) for s in strings], np.uint32)
    got = resampling.joined_crc(crc(first), crc(second), np.array([len(s) for s in second]), tables)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, second, strict=True)]
