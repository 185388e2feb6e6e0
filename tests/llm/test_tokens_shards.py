"""Token counts against the library, shards against their law."""

import random
import zlib
from collections import Counter

import public_tokenizers
import sentencepiece

from maskloom.llm import sharding, tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts(odd_documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter()
    for d in odd_documents.collect():
        text = d["text"] or ""
        n = len(library.encode(text))
        want[(d["doc_id"], len(text.encode()), n, n > 4096)] += 1
    got = tokens.token_counts(odd_documents, PATH)
    assert Counter(map(tuple, got.collect())) == want
    assert got.filter("over_limit").count() > 0


def test_token_counts_of_odd_strings():
    rng = random.Random(2)
    alphabets = ["abcdefghij .", "  ab\n\t", "éüñ中文 ", "aaaa bbb  ", "the ing tion  er", " \x00▁x", "😀🎉 ﻿z", "==--..  ", "0123456789 "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(60)] + [" " * n for n in range(60)] + ["<s>", "</s> a", "<0x41>", "ab" * 3000]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    import pandas as pd

    assert tokens._counter(PATH)(pd.Series(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_token_counts_empty(no_documents):
    assert tokens.token_counts(no_documents, PATH).count() == 0


def test_shards(odd_documents):
    got = sharding.shard(odd_documents, shards=3).collect()
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in odd_documents.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < 3


def test_a_hot_text_is_spread_and_others_stay_together(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot text', concat('text ', id % 2500, repeat(' word', int(id % 2500) % 50))) AS text")
    got = sharding.shard(df, shards=8).join(df, "doc_id").collect()
    size, shards = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        shards.setdefault(r["text"], set()).add(r["shard"])
    mean = sum(size.values()) / 8
    assert all(abs(n / mean - 1) < 0.01 for n in size.values())
    assert len(shards["hot text"]) > 1 and sum(len(s) > 1 for s in shards.values()) == 1


def test_shards_empty(no_documents):
    assert sharding.shard(no_documents).count() == 0
