"""Repeated strings against a brute-force version, and the suffix order against sorting."""

import random
from collections import Counter

import numpy as np
import pytest

from maskloom.llm import repeats, suffixes


def expected(texts, length):
    """(size, removed, spans, kept) of each text."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] > gone[i - 1] for i in range(len(t)))
        yield len(t), sum(gone), spans, bytes(b for i, b in enumerate(t) if not gone[i])


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randint(10, 60)) for _ in range(6)] + ["ab" * 300, "x" * 700, "\x00" * 90, "\n" * 200]
    texts = [None, "", "short", "y" * 3000, "y" * 2000 + "z", "ab" * 800, "日本語" * 100]
    for _ in range(n):
        text = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages)[rng.randint(0, 9) :] + prose(rng.randint(0, 20))
        texts.append(text)
    # One passage with other text around it in a third of all rows, and copies.
    texts += [prose(5) + passages[0] + prose(5) for _ in range(n // 2)] + texts[8:12] * 3
    return texts


@pytest.mark.parametrize(("length", "hot", "memory"), [(400, 4096, 1 << 20), (64, 8, 5000), (7, 50, 1 << 20)])
def test_against_brute_force(spark, length, hot, memory):
    texts = corpus(random.Random(length), 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS row", "'k' AS kept", "2 AS id")
    got = repeats.remove_repeats(df, length=length, hot=hot, memory=memory, shard_bytes=20_000)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()}
    want = dict(enumerate(expected([(t or "").encode() for t in texts], length)))
    assert rows == want
    assert sum(r[1] for r in rows.values()) > 0


def test_odd_documents(spark, odd_documents):
    given = [(d["doc_id"], (d["text"] or "").encode()) for d in odd_documents.collect()]
    want = Counter((i, *told) for (i, _), told in zip(given, expected([t for _, t in given], 100), strict=True))
    got = repeats.remove_repeats(odd_documents, length=100).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_empty(no_documents):
    assert repeats.remove_repeats(no_documents).count() == 0


def test_a_hot_passage_is_parted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(t.encode() for t in texts)), "row bigint, text binary")
    for hot in (5, 10_000):
        starts = Counter()
        for r in repeats.repeated_strings(rows, 200, hot).collect():
            starts.update((r["row"], i) for i in range(r["first"], r["last"] + 1))
        count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        want = {(row, i) for row, t in enumerate(texts) for i in range(len(t) - 199) if count[t[i : i + 200]] > 1}
        assert set(starts) == want and len(want) > 300 * 50


@pytest.mark.parametrize("memory", [3, 40, 1 << 16])
def test_suffix_order_and_repeats(memory):
    rng = random.Random(memory)
    for _ in range(150):
        letters, n = rng.choice([1, 2, 3, 5, 20]), rng.randint(1, 200)
        numbers = np.array([rng.randrange(letters) for _ in range(n)])
        out = np.zeros(n, np.int64)
        suffixes.suffix_order(numbers, n, letters - 1, memory, out)
        held = numbers.tolist()
        assert out.tolist() == sorted(range(n), key=lambda i: held[i:])
        texts = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randint(0, n))) for _ in range(3)]
        texts.append(texts[0][3:] + b"zz")
        length = rng.choice([1, 3, 8, 17])
        text = suffixes.Text(length)
        text.add(texts)
        flags = suffixes.repeated_starts(text, length, memory)
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        at = 0
        for t in texts:
            for i in range(len(t) - length + 1):
                assert flags[at + i] == (count[t[i : i + length]] > 1)
            at += len(t) + 1


def test_a_queue_gives_tuples_in_order():
    rng = np.random.default_rng(4)
    queue, held, out, made = suffixes.Queue(50), [], [], 0
    pairs = lambda block: list(zip(block[0].tolist(), suffixes.position(block).tolist(), strict=True))
    for _ in range(200):
        least = out[-1][0] if out else 0
        n = int(rng.integers(0, 40))
        block = suffixes.tuples(least + rng.integers(0, 30, n), made + np.arange(n), 0)
        made += n
        queue.insert(block)
        held += pairs(block)
        found, run_of = queue.peek(7)
        take = int(rng.integers(0, found.shape[1] + 1))
        queue.drop(run_of[:take])
        out += pairs(found[:, :take])
    out += [pair for block in queue.drain(9) for pair in pairs(block)]
    assert sorted(out) == sorted(held) and [t[0] for t in out] == sorted(t[0] for t in out)
    assert all(a[1] < b[1] for a, b in zip(out, out[1:], strict=False) if a[0] == b[0])


def test_strings_that_repeat_within_one_text_alone(spark):
    length = 400
    texts = ["x" * 700, "y" * 401, "z" * 400, "head " + "abc" * 150, "_-" * 250 + "tail", ("q" * 20 + "r" * 60) * 6, "0123456789" * 45]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, length=length).collect()}
    assert rows == dict(enumerate(expected([t.encode() for t in texts], length)))
    assert rows[0][1] == 700 and rows[1][1] == 401 and rows[2][1] == 0
