"""Exact and near duplicates against brute force."""

import hashlib
import string
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from maskloom.llm import exact, simhash
from maskloom.llm.common import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_exact_duplicates(odd_documents):
    groups = defaultdict(list)
    for doc_id, text in rows_of(odd_documents, "doc_id", "text"):
        groups[hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()].append(doc_id)
    got = rows_of(exact.exact_duplicates(odd_documents), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter((r[4], r[0]) for r in got) == Counter((sha, i) for sha, ids in groups.items() for i in ids)
    for sha, ids in groups.items():
        mine = [r for r in got if r[4] == sha]
        assert {r[1] for r in mine} == {max(i for i in ids if i is not None)} and {r[2] for r in mine} == {len(ids)}
        assert [r[0] == r[1] for r in mine if r[3]] == [True]


def test_dropping_exact_duplicates_keeps_all_columns(odd_documents):
    kept = exact.drop_exact_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [(t or "").translate(LOWER) for (t,) in rows_of(kept, "text")]
    assert Counter(texts) == Counter({(t or "").translate(LOWER) for (t,) in rows_of(odd_documents, "text")})


def test_exact_empty(no_documents):
    assert exact.exact_duplicates(no_documents).count() == 0 and exact.drop_exact_duplicates(no_documents).count() == 0


def test_the_filter_misses_no_repetition_and_few_rows_pass_in_vain(spark):
    n = 40_000
    hashes = spark.range(n).selectExpr("xxhash64(id) AS h").unionByName(spark.range(500).selectExpr("xxhash64(id) AS h")).repartition(5)
    maybe = exact.repeat_filter(hashes, n + 500)
    passed = Counter(h for (h,) in rows_of(hashes.filter(maybe("h")), "h"))
    repeated = {h for (h,) in rows_of(spark.range(500).selectExpr("xxhash64(id) AS h"), "h")}
    assert all(passed[h] == 2 for h in repeated)
    assert len(passed) < 500 + 0.05 * n


def fingerprint(text, words):
    tokens = (text or "").translate(LOWER).encode().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, distance):
    """The smallest id that each (id, fingerprint) reaches."""
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(pairs))]


def test_near_duplicates(odd_documents):
    docs = rows_of(odd_documents, "doc_id", "text")
    pairs = [(i, fingerprint(t, 4)) for i, t in docs]
    want = Counter((i, fp, c) for (i, fp), c in zip(pairs, brute_components(pairs, 4), strict=True))
    got = rows_of(simhash.near_duplicates(odd_documents), "doc_id", "fp", "component_id")
    assert Counter((i, fp % (1 << 64), c) for i, fp, c in got) == want
    assert len({c for _, _, c in got}) < len({i for i, _, _ in got})


def test_dropping_near_duplicates_keeps_one_of_each(odd_documents):
    docs = odd_documents.filter("doc_id IS NOT NULL")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    heads = {c for (c,) in rows_of(simhash.near_duplicates(docs), "component_id")}
    assert {i for (i,) in rows_of(kept, "doc_id")} == heads


def test_near_empty(no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0 and simhash.drop_near_duplicates(no_documents).count() == 0


@given(st.integers(0, 2**32), st.integers(1, 8))
@settings(max_examples=40, deadline=None)
def test_a_chain_starts_somewhere_on_the_ring(seed, distance):
    """Two fingerprints within the distance meet in the bucket of some segment, and pass its chain."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, dtype=np.uint64)
    flips = rng.choice(64, rng.integers(0, distance + 1), replace=False)
    b = a ^ np.uint64(sum(1 << int(i) for i in flips))
    masks = simhash.segments(distance)
    assert sum(masks) == 2**64 - 1
    found = [s for s, m in enumerate(masks) if (a ^ b) & np.uint64(m) == 0 and (a == b or simhash._forest(np.array([a, b]), s, distance)[0])]
    assert found
    far = a ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, distance + 1, replace=False)))
    assert not any(simhash._forest(np.array([a, far]), s, distance)[0] for s in range(len(masks)) if (a ^ far) & np.uint64(masks[s]) == 0)


def test_large_buckets_are_dealt_out_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6)
    fps = sorted({int(c) ^ sum(1 << int(i) for i in rng.choice(40, rng.integers(0, 5), replace=False)) for c in centre for _ in range(60)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    found = dict(rows_of(components(simhash.hamming_links(nodes, 4), "x", "y"), "node", "root"))
    want = brute_components([(f, f) for f in fps], 4)
    assert [found.get(f, f) for f in fps] == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b"), "node", "root"))
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}


def shingles(text, words=5):
    tokens = (text or "").translate(LOWER).encode().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def similar_copies(spark, seed=0):
    """Texts with copies in which some words are others: (id, text), and the similarity of any two."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(40):
        words = [f"w{n}" for n in rng.integers(0, 5000, rng.integers(60, 400))]
        for share in (0, 0.005, 0.01, 0.02, 0.1):
            changed = [f"x{n}" if rng.random() < share else w for n, w in enumerate(words)]
            rows.append((len(rows), " ".join(changed)))
    sets = [shingles(t) for _, t in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])


def test_similar_texts_meet_and_others_do_not(spark):
    df, similarity = similar_copies(spark)
    group = dict(rows_of(simhash.similar_groups(df), "id", "component_id"))
    pairs = [(a, b, similarity(a, b)) for a in range(200) for b in range(a)]
    close = [(a, b) for a, b, s in pairs if s >= 0.85]
    assert sum(group[a] == group[b] for a, b in close) >= 0.98 * len(close) and len(close) > 100
    assert not any(group[a] == group[b] for a, b, s in pairs if s < 0.3)
    kept = rows_of(simhash.drop_similar(df), "doc_id")
    assert {i for (i,) in kept} == set(group.values())


def test_similar_groups_of_odd_documents(odd_documents, no_documents):
    found = simhash.similar_groups(odd_documents)
    assert found.count() == odd_documents.count()
    kept = simhash.drop_similar(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [(t or "").translate(LOWER).split() for (t,) in rows_of(kept, "text")]
    assert sum(not t for t in texts) == 1  # all texts without a word are alike
    assert simhash.similar_groups(no_documents).count() == 0 and simhash.drop_similar(no_documents).count() == 0


def test_similar_links_are_exact(spark):
    """Pairs of 0.8 or more meet, others stay apart unless a chain of links reaches them; short texts too."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(60):
        words = [f"g{group}w{n}" for n in range(rng.integers(8, 60))]
        rows.append(" ".join(words))
        rows += [" ".join([*words[:-cut], *(f"x{group}y{cut}z{n}" for n in range(cut))]) for cut in (1, 2, 3, 5)]
        rows.append(" ".join(words[:-1]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    sets, parent = [shingles(t) for t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert dict(rows_of(simhash.similar_groups(df), "id", "component_id")) == {i: root(i) for i in range(len(rows))}


def test_large_components_are_dealt_out_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPREAD", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    body = [f"w{n}" for n in range(120)]
    rows = [" ".join(body[: 100 + i % 20] + [f"t{i}"]) for i in range(60)] + [" ".join(body[60:] + [f"u{i}"] * 9) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    group = dict(rows_of(simhash.similar_groups(df), "id", "component_id"))
    assert {group[i] for i in range(60)} == {0} and {group[60 + i] for i in range(5)} == {60}


def test_repeated_passages_do_not_link(spark):
    passage = " ".join(f"p{n}" for n in range(14))
    rows = [" ".join([passage] * 10 + [f"own{i}n{n}" for n in range(104)]) for i in range(10)]
    rows += [" ".join(["same"] * 64 + [f"other{i}n{n}" for n in range(54)]) for i in range(10)]
    group = dict(rows_of(simhash.similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")), "id", "component_id"))
    assert group == {i: i for i in range(20)}
