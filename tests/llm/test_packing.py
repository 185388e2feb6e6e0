"""Packing: round trip of the ids, places without gaps, and optimal bins for small cases."""

import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, limit):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return len(by_sequence)


def test_pack_documents(odd_documents):
    limit, tokenizer, want = 512, Tokenizer.from_file(PATH), Counter()
    for d in odd_documents.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            want[(d["doc_id"], k // limit, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack_documents(odd_documents, PATH, limit=limit).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    bins = check_places(got, limit)
    assert bins == packing.least_bins(np.bincount([r["length"] for r in got], minlength=limit + 1), limit)


def test_pack_empty(no_documents):
    assert packing.pack_documents(no_documents, PATH).count() == 0


@pytest.mark.parametrize("text", ["It's we're 'S ''s 12a³½ªº", "a\x1cb\x85c\xa0d e", "Ünï İx ſ ΑΣ", "!?'t ...'ll--", "<|startoftext|> a", "x" * 300])
def test_ids_are_those_of_the_tokenizer(text):
    (data,) = packing._encoder(PATH)([text])
    assert np.frombuffer(data, "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def fewest_bins(lengths, limit):
    """By exhaustion."""

    @cache
    def search(rest, room):
        if not rest:
            return 0
        return min(
            (search(rest[:i] + rest[i + 1 :], room - n) if n <= room else 1 + search(rest[:i] + rest[i + 1 :], limit - n))
            for i, n in enumerate(rest)
            if i == 0 or rest[i - 1] != n
        )

    return search(tuple(sorted(lengths)), 0)


@pytest.mark.parametrize("seed", range(12))
def test_bins_are_the_fewest(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(8, 24))
    lengths = rng.integers(1, limit + 1, 9)
    plan = packing.complete_bins(np.bincount(lengths, minlength=limit + 1), limit)
    held = Counter()
    for times, filling in plan.steps:
        assert sum(n * k for n, k in filling) <= limit
        for n, k in filling:
            held[n] += times * k
    assert held == Counter(lengths.tolist())
    assert plan.bins == fewest_bins(lengths.tolist(), limit) >= packing.least_bins(np.bincount(lengths, minlength=limit + 1), limit)


def test_many_pieces_need_a_small_plan():
    lengths = np.random.default_rng(0).geometric(1 / 400, 200_000).clip(1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    plan, thousand = packing.complete_bins(counts), packing.complete_bins(counts * 1000)
    assert plan.bins == packing.least_bins(counts, 4096)
    assert thousand.bins <= packing.least_bins(counts * 1000, 4096) + 1 and len(thousand.steps) < 20_000


def test_equal_pieces_fill_sequences(spark):
    from maskloom.sources.scratch import settled

    rows = settled(spark.range(1000).selectExpr("id", "if(id < 700, 3L, 4L) AS length"))
    got = packing.pack(rows, ["id"], limit=10).collect()
    # Only 4 + 3 + 3 leaves no room: 300 of these, and the last hundred by threes.
    assert len(got) == 1000 and check_places(got, 10) == 334
