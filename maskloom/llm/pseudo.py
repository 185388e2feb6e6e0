"""Pseudo-likelihood of texts under a bidirectional window network.

The network sees two words to the left and two to the right and predicts the word
between, as a class and a word of that class. The vocabulary is the most frequent
words of all documents, counted in full; other words share symbols by their last
letters. Every token of every document is the middle of one window for training.
Texts are dealt out to trainers and rounds in runs of tokens; in each round trainers
start from the same weights, pass over their windows of that round, and what they
changed is averaged; the driver sees weights, never windows. Every token of every
text is then predicted from both sides, and the sum of the log-probabilities is the
score.

Cases: a null or empty text has no token and log-probability 0 (its mean is null);
rows repeated with the same id get equal scores; a null id is allowed; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import release_memory, text_blocks, whole_text
from maskloom.llm.words import Block, Counts, Endings, Places
from maskloom.sources.scratch import settled

WORDS, RARE = 768, 256  # symbols of frequent words, and of all others
CLASS = 32  # symbols in a class
DEPTH, HIDDEN = 16, 32
SIDES = (-2, -1, 1, 2)
EVERY, TRAINERS, ROUNDS, BATCH = 1, 64, 3, 1024
RUN = 256  # tokens that go to a trainer together
RATE = 0.2
STEP = 1 << 13  # weights that are changed together; it bears on speed alone
BLOCK_BYTES = 1 << 20
COUNTED = 1 << 19  # distinct words that a task holds before it passes their counts on
SYMBOLS = WORDS + RARE
PAD = SYMBOLS
AT_ONCE = 1 << 14  # tokens scored together
ASIDE = 1 << 15  # marks a symbol of a run that is only a neighbour
SEED = 42


def vocabulary(texts: DataFrame) -> list[bytes]:
    """The ``WORDS`` most frequent words of all texts, ties by bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(COUNTED)
        for batch in batches:
            for _, block in text_blocks(batch.column(0), BLOCK_BYTES):
                yield from counts.add(block)
        yield counts.told()
        release_memory()

    counted = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(row["word"]) for row in counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()]


class _Symbols:
    """Words to symbols; what is not frequent goes by its last three bytes."""

    def __init__(self, words: list[bytes]):
        self.places, self.endings = Places(words), Endings()

    def of(self, texts: list[bytes]) -> pa.Array:
        """The symbols of each text."""
        block = Block(texts)
        flat = np.empty(len(block), np.uint16)
        for part, keys in block.keys():
            symbol = self.places.of(block, part, keys)
            rare = np.flatnonzero(symbol == self.places.n)
            symbol[rare] = WORDS + self.endings.of(keys[0].take(rare), keys[2].take(rare)) % RARE
            flat[part] = symbol
        ends = np.append(0, np.cumsum(2 * block.sizes)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _scattered(values: np.ndarray) -> np.ndarray:
    h = values * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def coded(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """(id, seed, symbols) of (id, seed, text): the symbol of each token as two bytes."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _Symbols(words)
        for batch in batches:
            for start, block in text_blocks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(start, len(block))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), symbols.of(block)], ["id", "seed", "symbols"])
            release_memory()

    return rows.mapInArrow(run, f"id {kind}, seed bigint, symbols binary")


def _padded(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, as symbols, in one row with padding around each; where its tokens are; how many each text has."""
    sizes = np.array([len(text) // 2 for text in block], np.int64)
    flat = np.full(int(sizes.sum()) + 2 * len(block) + 2, PAD, np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(1, len(block) + 1), sizes)
    flat[at] = np.frombuffer(b"".join(block), np.uint16)
    return flat, at, sizes


def training_windows(rows: DataFrame, every: int = EVERY, rounds: int = ROUNDS) -> DataFrame:
    """(trainer, round, runs) from (id, seed, symbols): runs of tokens with two neighbours at each end, one in ``every`` tokens not set aside.

    A run goes to one trainer in one round, so a token is the middle of one window in all.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(1).to_numpy().view(np.uint64)
            for start, block in text_blocks(batch.column(2), BLOCK_BYTES):
                flat, at, sizes = _padded(block)
                n = -(-sizes // RUN)
                text = np.repeat(np.arange(len(block)), n)
                number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                first = at[(np.cumsum(sizes) - sizes)[text] + number * RUN] if len(text) else number
                length = np.minimum(sizes[text] - number * RUN, RUN)
                h = _scattered(number.astype(np.uint64) + seeds[start : start + len(block)][text])
                dealt = (h >> np.uint64(32)).astype(np.int64) % (TRAINERS * rounds)
                order = np.argsort(dealt, kind="stable")
                width = length[order] + 4
                place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                symbol = flat[np.repeat(first[order] - 2, width) + place]
                aside = (place < 2) | (place >= np.repeat(width - 2, width))
                if every > 1:
                    aside |= _scattered(place.astype(np.uint64) + np.repeat(h[order], width)) % np.uint64(every) != 0
                symbol[aside] |= ASIDE
                numbers, low = np.unique(dealt[order], return_index=True)
                ends = 2 * np.append(np.cumsum(width), 0)[np.append(low[1:], len(width)) - 1]
                data = symbol.astype(np.uint16).tobytes()
                packed = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(numbers) else []
                arrays = [pa.array(numbers // rounds), pa.array(numbers % rounds), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["trainer", "round", "runs"])
            release_memory()

    return rows.mapInArrow(cut, "trainer bigint, round bigint, runs binary")


def windows_of(runs: bytes) -> np.ndarray:
    """A row a window: the middle symbol, then its neighbours."""
    flat = np.frombuffer(runs, np.uint16)
    at = np.flatnonzero(flat < PAD)
    flat = flat & np.uint16(ASIDE - 1)
    out = np.empty((len(at), 1 + len(SIDES)), np.uint16)
    for i, side in enumerate((0, *SIDES)):
        out[:, i] = flat[at + side]
    return out


# --- the network -------------------------------------------------------------

Weights = dict[str, np.ndarray]


def new_weights() -> Weights:
    rng, classes = np.random.default_rng(SEED), SYMBOLS // CLASS
    shapes = {"embed": (SYMBOLS + 1, DEPTH), "inner": (len(SIDES) * DEPTH, HIDDEN), "inner0": (HIDDEN,), "group": (HIDDEN, classes), "group0": (classes,), "word": (classes, HIDDEN, CLASS), "word0": (classes, CLASS)}
    return {k: (rng.normal(size=s) * (0.1 if len(s) > 1 and not k.endswith("0") else 0)).astype(np.float32) for k, s in shapes.items()}


def _softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities; ``z`` is overwritten."""
    # The largest of a short row is found faster across rows.
    z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _runs(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Of sorted class numbers: each class and where it lies."""
    cuts = np.flatnonzero(np.diff(groups)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
        if low < high:
            yield int(groups[low]), slice(low, high)


def _parts(w: Weights) -> list[np.ndarray]:
    """The inner layer of each symbol at each side."""
    return [w["embed"] @ w["inner"][i * DEPTH : (i + 1) * DEPTH] for i in range(len(SIDES))]


def _rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values.take(at, axis=0, mode="clip")  # unchecked: faster


def gradients(w: Weights, window: np.ndarray) -> Weights:
    """Of the mean negative log-probability of the middle words."""
    g = {k: np.zeros_like(v) for k, v in w.items()}
    summed_gradients(w, window, g)
    for v in g.values():
        v /= len(window)
    return g


def summed_gradients(w: Weights, window: np.ndarray, g: Weights) -> None:
    """Those of the sum, into ``g``, which holds zeros."""
    window = _rows(window, np.argsort((window[:, 0] // CLASS).astype(np.uint8), kind="stable"))
    target, sides, n = window[:, 0].astype(np.int64), np.ascontiguousarray(window[:, 1:]), len(window)
    group, first = target // CLASS, np.arange(0, n * CLASS, CLASS)
    near = _rows(w["embed"], sides).reshape(n, -1)
    h = near @ w["inner"]
    h += w["inner0"]
    np.tanh(h, out=h)
    out = h @ w["group"]
    out += w["group0"]
    out = _softmax(out)
    out.reshape(-1)[np.arange(0, out.size, out.shape[1]) + group] -= 1
    np.matmul(h.T, out, out=g["group"])
    np.einsum("ij->j", out, out=g["group0"])  # row added to row, as by sum, in less time
    back = out @ w["group"].T
    # Each class has weights of its own; what needs none of them is done for all rows at once.
    # dot is matmul with less to do before the product, which counts for few rows.
    runs, p, below = list(_runs(group)), np.empty((n, CLASS), h.dtype), np.empty_like(back)
    for c, part in runs:
        np.dot(h[part], w["word"][c], out=p[part])
    p += _rows(w["word0"], group)
    p = _softmax(p)
    p.reshape(-1)[first + target % CLASS] -= 1
    for c, part in runs:
        mine = p[part]
        np.dot(h[part].T, mine, out=g["word"][c])
        np.add.reduce(mine, 0, None, g["word0"][c])
        np.dot(mine, w["word"][c].T, out=below[part])
    back += below
    np.multiply(h, h, out=h)
    back *= np.subtract(1, h, out=h)
    np.matmul(near.T, back, out=g["inner"])
    np.einsum("ij->j", back, out=g["inner0"])
    shares = (back @ w["inner"].T).reshape(-1, DEPTH)
    symbol = sides.reshape(-1).astype(np.uint16, copy=False)
    order = np.argsort(symbol, kind="stable")
    symbol = symbol.take(order)
    starts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
    # Two numbers at a time: a sum of complex numbers is that of both parts.
    g["embed"][symbol.take(starts)] = np.add.reduceat(_rows(shares, order).view(np.result_type(shares, np.complex64)), starts, axis=0).view(shares.dtype)


def _trainer(weights: Weights, rate: float):
    """(runs) to what one pass of Adagrad over them changes in the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All weights in one row; what ``w`` and ``g`` hold are parts of it.
        row = np.concatenate([v.reshape(-1) for v in weights.values()])
        sums, seen = np.zeros_like(row), np.full_like(row, 1e-4)
        cuts = np.cumsum([v.size for v in weights.values()])[:-1]
        w, g = ({k: part.reshape(v.shape) for (k, v), part in zip(weights.items(), np.split(whole, cuts), strict=True)} for whole in (row, sums))
        step = np.empty(STEP, row.dtype)
        held = np.zeros((0, 1 + len(SIDES)), np.uint16)
        n = 0

        def learn(window: np.ndarray) -> None:
            sums.fill(0)
            summed_gradients(w, window, g)
            for start in range(0, len(row), STEP):
                part = slice(start, start + STEP)
                mean = sums[part]
                mean /= len(window)
                by = np.multiply(mean, rate, out=step[: len(mean)])
                past = seen[part]
                past += np.square(mean, out=mean)
                by /= np.sqrt(past, out=mean)
                row[part] -= by

        for batch in batches:
            for runs in batch.column(0).to_pylist():
                held = np.concatenate([held, windows_of(runs)])
                while len(held) >= BATCH:
                    learn(held[:BATCH])
                    held, n = held[BATCH:], n + 1
        release_memory()
        if len(held):
            learn(held)
            n += 1
        if n:
            changed = [(w[k] - weights[k]).astype(np.float32).tobytes() for k in w]
            yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array(changed, pa.binary())], ["name", "change"])

    return run


def _mean_change(group: pd.DataFrame) -> pd.DataFrame:
    """The mean over the trainers that changed a weight at all; there are at most ``TRAINERS``."""
    total, n = 0.0, 0
    for change in group["change"]:
        values = np.frombuffer(change, np.float32)
        total, n = total + values, n + (values != 0)
    return pd.DataFrame({"name": [group["name"].iloc[0]], "change": [(total / np.maximum(n, 1)).astype(np.float32).tobytes()]})


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            counts += np.bincount(np.frombuffer(packed, np.uint16), minlength=SYMBOLS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), pa.array(counts)], ["symbol", "n"])


def fit(symbols: DataFrame, windows: DataFrame, rounds: int = ROUNDS) -> Weights:
    """Weights from (trainer, round, runs); they start from how frequent each symbol is."""
    w = new_weights()
    counts = np.ones(SYMBOLS)
    # A row a symbol.
    for row in symbols.select("symbols").mapInArrow(_middles, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[row["symbol"]] += row["n"]
    counts = counts.reshape(-1, CLASS)
    w["group0"] = np.log(counts.sum(axis=1) / counts.sum()).astype(np.float32)
    w["word0"] = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    for number in range(rounds):
        mine = windows.filter(F.col("round") == number).repartition(TRAINERS, "trainer").select("runs")
        changed = mine.mapInArrow(_trainer(w, RATE / (1 + number)), "name string, change binary")
        for row in changed.groupBy("name").applyInPandas(_mean_change, "name string, change binary").collect():
            w[row["name"]] = w[row["name"]] + np.frombuffer(row["change"], np.float32).reshape(w[row["name"]].shape)
    return w


def log_probabilities(w: Weights, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each token at ``at``, given its neighbours."""
    out = np.empty(len(at), np.float32)
    parts = _parts(w)  # once for all tokens
    parts[0] += w["inner0"]
    # The hidden layer lies within 1, which bounds what comes after it.
    small = all((np.abs(w[k]).sum(axis=-2) + np.abs(w[k + "0"])).max() < 60 for k in ("group", "word"))
    # Tables in place of those of one chunk, which are made anew by no other.
    h, near, z = (np.empty((min(len(at), AT_ONCE), width), parts[0].dtype) for width in (HIDDEN, HIDDEN, CLASS))
    for start in range(0, len(at), AT_ONCE):
        middle = at[start : start + AT_ONCE]
        order = np.argsort((flat.take(middle) // CLASS).astype(np.uint8), kind="stable")
        middle = middle.take(order)
        target = flat.take(middle)
        group, n = target // CLASS, len(middle)
        h, near, z = h[:n], near[:n], z[:n]
        parts[0].take(flat.take(middle + SIDES[0]), axis=0, out=h, mode="clip")
        for side, part in zip(SIDES[1:], parts[1:], strict=True):
            h += part.take(flat.take(middle + side), axis=0, out=near, mode="clip")
        np.tanh(h, out=h)
        by_class = h @ w["group"]
        by_class += w["group0"]
        score = by_class.reshape(-1).take(np.arange(0, by_class.size, by_class.shape[1]) + group)
        score -= _log_sum(by_class, small)
        for c, span in _runs(group):
            np.dot(h[span], w["word"][c], out=z[span])
        z += _rows(w["word0"], group)
        score += z.reshape(-1).take(np.arange(0, z.size, CLASS) + target % CLASS)
        score -= _log_sum(z, small)
        out[start + order] = score
    return out


def _log_sum(z: np.ndarray, small: bool) -> np.ndarray:
    """Overwrites ``z``, which needs no shift where all of it is ``small``."""
    if small:
        return np.log(np.exp(z, out=z).sum(axis=1))
    top = z.max(axis=1)
    return np.log(np.exp(np.subtract(z, top[:, None], out=z), out=z).sum(axis=1)) + top


def _scorer(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for start, block in text_blocks(batch.column(1), BLOCK_BYTES):
                flat, at, sizes = _padded(block)
                owner = np.repeat(np.arange(len(block)), sizes)
                n[start : start + len(block)] = sizes
                score[start : start + len(block)] = np.bincount(owner, log_probabilities(w, flat, at), len(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(score)], ["id", "n_tokens", "log_prob"])
            release_memory()

    return run


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob), one row for each of ``df``."""
    seed = F.xxhash64(F.col(id_col), F.lit(SEED)).alias("seed")
    rows = df.select(F.col(id_col).alias("id"), seed, whole_text(text_col).alias("text"))
    symbols = settled(coded(rows, vocabulary(rows.select("text"))))
    weights = fit(symbols, settled(training_windows(symbols, every)))
    kind = rows.schema["id"].dataType.simpleString()
    scored = symbols.select("id", "symbols").mapInArrow(_scorer(weights), f"id {kind}, n_tokens bigint, log_prob double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_prob", F.try_divide("log_prob", "n_tokens").alias("mean_log_prob"))
