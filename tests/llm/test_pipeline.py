"""The stages of the pipeline against brute force, and its shape."""

import inspect
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_duplicates import LOWER, brute_components, fingerprint, shingles
from test_packing import check_places
from tokenizers import Tokenizer

import corpus_pipeline
from maskloom.llm import mixing, packing, quality, simhash
from maskloom.llm.common import ARROW_BYTES, BATCH_BYTES
from maskloom.sources.scratch import settled

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what comes out of the last."""
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(settled(stage(spark, tables[-1], SF)))
    return [t.toPandas() for t in tables]


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "best-fit packing",
    ]
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]


def test_all_but_the_last_return_documents(stages):
    assert all(list(t.columns) == list(stages[0].columns) for t in stages[:5])
    assert all(len(t) for t in stages)


def test_quality_keeps_what_the_sample_holds(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.resample(docs, labels).toPandas().set_index("doc_id")
    assert set(stages[1]["doc_id"]) == set(scored.index[scored["kept"]])
    told = labels.toPandas().set_index("doc_id")["quality"].dropna()
    good = told.index[told == 1]
    assert scored.loc[[i for i in good if i in scored.index], "kept"].mean() > 0.97


def test_exact_copies_leave_the_largest_id(stages):
    last = {}
    for i, text in zip(stages[1]["doc_id"], stages[1]["text"], strict=True):
        key = text.translate(LOWER)
        last[key] = max(last.get(key, i), i)
    assert sorted(stages[2]["doc_id"]) == sorted(last.values())


def test_near_copies_leave_one(stages):
    before, after = stages[2], set(stages[3]["doc_id"])
    sets = {i: shingles(t) for i, t in zip(before["doc_id"], before["text"], strict=True)}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            similar = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            if similar >= 0.9:
                assert not (a in after and b in after)
    for a in ids:
        if a not in after:  # something like it stays
            assert max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in ids if b != a) >= 0.6


def test_the_mix_comes_near_its_targets(stages):
    before, after = stages[3], Counter(stages[4]["doc_id"])
    size = {i: len(t.encode().split()) for i, t in zip(before["doc_id"], before["text"], strict=True)}
    source = dict(zip(before["doc_id"], before["source"], strict=True))
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
        taken[source[i]] += n * after[i]
    names = sorted(sizes)
    targets = mixing.weighted_targets([sizes[n] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert max(after.values()) <= 2
    for name, target in zip(names, targets, strict=True):
        smallest = sorted(n for i, n in size.items() if source[i] == name)[:3]
        assert abs(taken[name] - target) <= max(sum(smallest), 0.25 * target)


def test_packing_holds_every_piece(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in zip(stages[4]["doc_id"], stages[4]["text"], strict=True):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        for k in range(0, n, 4096):
            want[(i, k // 4096, min(4096, n - k))] += 1
    rows = stages[5].to_dict("records")
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == want
    assert check_places(rows, 4096) <= int(np.ceil(stages[5]["length"].sum() / 4096)) + 1


def test_stages_take_odd_documents(spark, odd_documents):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd_documents, SF).columns == odd_documents.columns
        assert stage(spark, odd_documents.filter("false"), SF).count() == 0
    mixed = corpus_pipeline.mix(spark, odd_documents, SF)
    taken = mixing.mix_by_source(odd_documents).agg({"copies": "sum"}).first()[0]
    assert mixed.count() == taken


def test_near_copies_are_told_by_their_fingerprints(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{n}" for n in range(14))
    rows = [" ".join([passage] * 10 + [f"own{i}n{n}" for n in range(104)]) for i in range(4)]
    for group in range(12):
        words = [f"w{n}" for n in rng.integers(0, 5000, 150)]
        rows += [" ".join(f"x{n}" if rng.random() < share else w for n, w in enumerate(words)) for share in (0, 0.005, 0.02, 0.1)]
    # Far apart as sets, near by what they repeat.
    rows += [" ".join(["same"] * 300 + [f"other{i}n{n}" for n in range(54)]) for i in range(4)]
    pairs = [(i, fingerprint(t, 4)) for i, t in enumerate(rows)]
    heads = brute_components(pairs, 4)
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(rows)], "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert kept == set(heads) and len(set(heads[-4:])) == 1


@pytest.mark.parametrize("own", [None, str(1 << 20)])
def test_texts_go_to_workers_in_small_batches(spark, monkeypatch, own):
    """8 MB of text in one partition: the batches of each stage with whole texts hold 4 MB or what the session says."""
    from pyspark.sql import functions as F

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    texts = settled(spark.range(0, 800, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ten bytes "), 1000).alias("text")))
    labels = spark.range(4).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    sizes = []

    def measuring(df):
        sizes.append(texts.mapInArrow(largest, "n bigint").agg(F.max("n")).first()[0])
        return settled(df)

    for module in (packing, quality, simhash):
        monkeypatch.setattr(module, "settled", measuring)
    if own:
        spark.conf.set(ARROW_BYTES, own)
    try:
        before = spark.conf.get(ARROW_BYTES)
        for run in (lambda: quality.resample(texts, labels), lambda: simhash.near_duplicates(texts), lambda: packing.pack_documents(texts, corpus_pipeline.tokenizer("word_bpe_49k.json"))):
            sizes.clear()
            run()
            assert sizes[0] <= (int(own) if own else BATCH_BYTES) + 20_000
        assert spark.conf.get(ARROW_BYTES) == before
    finally:
        spark.conf.unset(ARROW_BYTES)
