"""Words found, counted and looked up a block at a time, held against one word at a time."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from maskloom.llm import pseudo, words

rng = random.Random(7)
LETTERS = [bytes([b]) for b in b"aAbBcC\0\xc3\x85\xa0\x1c\x1f \n\t\x0b\x0c\r"]
SAME_ENDS = [b"head%dmid" % i * j + b"0123456789abcdef" for i in range(5) for j in range(3)]
TEXTS = [b"", b" ", b" \t\r\n", b"a \0a \0 \0\0 a\0", b"x" * 16 + b" " + b"x" * 17, b"q" * 5000, "ÉÈ Straße 日本".encode()]
TEXTS += [b"".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 300))) for _ in range(200)]
TEXTS += [b" ".join(rng.choice([w, w.upper()]) for w in rng.choices(SAME_ENDS, k=60)) for _ in range(20)]
BLOCKS = [TEXTS[i : i + 25] for i in range(0, len(TEXTS), 25)] + [[], [b""]]


def split(text):
    return text.lower().split()


def test_words_of_a_block():
    for texts in BLOCKS:
        block = words.Block(texts)
        assert [block.word(i) for i in range(len(block))] == [w for text in texts for w in split(text)]
        assert block.sizes.tolist() == [len(split(text)) for text in texts]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_words_are_counted(bits, monkeypatch):
    """Of hashes with few bits many are of several words."""
    whole = words.hashed
    monkeypatch.setattr(words, "hashed", lambda keys: whole(keys) & np.uint64(2**64 - 2 ** (64 - bits)))
    monkeypatch.setattr(words, "GROUPED", 300)
    for most in (20, 1 << 19):
        counts, told = words.Counts(most), []
        for texts in BLOCKS:
            told += counts.add(texts)
        told.append(counts.told())
        got = Counter()
        for batch in told:
            named = batch.column("word").to_pylist()
            assert len(set(named)) == len(named)
            got.update(dict(zip(named, batch.column("n").to_pylist(), strict=True)))
        assert got == Counter(w for text in TEXTS for w in split(text))
        assert (len(told) > 1) == (most == 20)


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_symbols_of_words(n):
    common = Counter(w for text in TEXTS for w in split(text)).most_common(n)
    place = {w: i for i, (w, _) in enumerate(common)}
    symbols = pseudo._Symbols(list(place))
    for texts in BLOCKS:
        want = [[place.get(w, pseudo.WORDS + zlib.crc32(w[-3:]) % pseudo.RARE) for w in split(text)] for text in texts]
        assert [np.frombuffer(packed, np.uint16).tolist() for packed in symbols.of(texts).to_pylist()] == want


def test_rare_words_cost_no_call_each():
    texts, calls = [b" ".join(b"w%dx" % i for i in range(20_000))], Counter()
    symbols = pseudo._Symbols([b"w%d" % i for i in range(pseudo.WORDS)])
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        symbols.of(texts)
    finally:
        sys.setprofile(None)
    assert calls.total() < 2000


def test_a_trainer_takes_the_steps_of_adagrad():
    draw = np.random.default_rng(3)
    flat = draw.integers(0, pseudo.SYMBOLS, 2500).astype(np.uint16)
    flat[[0, 1, -2, -1]] |= pseudo.ASIDE
    weights = pseudo.new_weights()
    w, seen = ({k: v.copy() for k, v in weights.items()}, {k: np.full_like(v, 1e-4) for k, v in weights.items()})
    window = pseudo.windows_of(flat.tobytes())
    for start in range(0, len(window), pseudo.BATCH):
        for k, g in pseudo.gradients(w, window[start : start + pseudo.BATCH]).items():
            seen[k] += g * g
            w[k] -= 0.1 * g / np.sqrt(seen[k])
    batch = pseudo.pa.RecordBatch.from_arrays([pseudo.pa.array([flat.tobytes()], pseudo.pa.binary())], ["runs"])
    (told,) = pseudo._trainer(weights, 0.1)(iter([batch]))
    for name, change in zip(told.column("name").to_pylist(), told.column("change").to_pylist(), strict=True):
        assert np.array_equal(np.frombuffer(change, np.float32), (w[name] - weights[name]).reshape(-1)), name
