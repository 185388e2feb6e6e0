"""Packing tokenised documents into sequences by bin completion.

A sequence holds at most ``limit`` tokens and a piece has at most ``limit``, so
all that matters about the pieces is how many there are of each length. That
histogram, ``limit`` numbers however large the corpus, is packed by branch and
bound: the largest piece left is completed by the fillings that no other filling
dominates, branches that waste more than a better packing could are cut, and the
best fit found is kept as incumbent. A filling is applied as often as its counts
allow at once, so the plan is small too. Spark numbers the pieces of each length
and every piece looks up its place.

Cases: a null or empty text is one piece that holds the end token alone; a null id
is an id like any other; rows repeated with the same id are packed as often as they
come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import release_memory, small_batches, whole_text, with_running_total, worker_cache
from maskloom.sources.scratch import settled

LIMIT = 4096
# Branching: fillings looked at for one sequence, and those followed in all after the first descent.
FILLINGS, NODES = 48, 6000


# --- token ids ---------------------------------------------------------------

CACHED_WORDS = 300_000
BLOCK_CHARS = 1 << 18


def _encoder(path: str):
    """Texts to bytes of little-endian ids, the same as the tokenizer's own.

    Texts of common Latin letters are cut into words here and each distinct word
    goes to the tokenizer once; all others, and those with the strings of special
    tokens, go to it whole.
    """
    import os
    import re
    import unicodedata

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    release_memory()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    of = {c: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == c) for c in "LN"}
    # What the tokenizer's own pattern tells apart.
    word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^\t-\r \x85\xa0{of['L']}{of['N']}]+")
    # Here letters are composed already and lower-casing goes letter by letter.
    odd = re.compile("[^\x00-įı-ɏ‐-‧]")
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    known = worker_cache(path)

    def learn(words: list[str]) -> None:
        """All words in one text: the last id of each is marked as a word's end."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        data, cuts = ids.tobytes(), (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            raise ValueError("the tokenizer cuts words otherwise than expected")
        known.update(zip(words, (data[a:b] for a, b in pairwise([0, *cuts])), strict=True))

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def block(texts: list[str]) -> Iterator[bytes]:
        cut = [None if odd.search(t) or any(s in t for s in special) else word.findall(t.lower()) for t in texts]
        if len(known) > CACHED_WORDS:
            known.clear()
        if new := list(set().union(*filter(None, cut)).difference(known)):
            learn(new)
        for text, words in zip(texts, cut, strict=True):
            yield whole(text) if words is None else b"".join(map(known.__getitem__, words))

    def run(texts: Iterable[str]) -> Iterator[bytes]:
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars > BLOCK_CHARS:
                yield from block(held)
                held, chars = [], 0
        yield from block(held)

    return run


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and the end token, cut where longer than ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode, end = _encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            texts = (t for low in range(0, len(batch), 256) for t in batch.column(1).slice(low, 256).to_pylist())
            for i, data in enumerate(encode(texts)):
                data += end
                for k in range(0, len(data), limit * 4):
                    part = data[k : k + limit * 4]
                    at.append(i)
                    piece.append(k // (limit * 4))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32"])
            release_memory()

    rows = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the plan ----------------------------------------------------------------

def least_bins(counts: np.ndarray, limit: int) -> int:
    """A lower bound on the sequences: pieces over half a sequence keep apart, and the rest must fit beside them."""
    lengths = np.arange(limit + 1)
    number, words = np.cumsum(counts), np.cumsum(counts * lengths)
    half, best = limit // 2, 0
    for k in range(half + 1):
        alone = int(number[limit] - number[limit - k])
        large = int(number[limit - k] - number[half])
        room = large * limit - int(words[limit - k] - words[half])
        small = int(words[half] - (words[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -((room - small) // limit)))
    return best


class _Lengths:
    """Which lengths are left, and the largest that fits: a bitmap in one integer."""

    def __init__(self, counts: np.ndarray):
        self.count = {int(n): int(c) for n, c in enumerate(counts) if n and c}
        self.bits = 0
        for n in self.count:
            self.bits |= 1 << n

    def fitting(self, room: int) -> int:
        return (self.bits & ((2 << room) - 1)).bit_length() - 1 if room > 0 else 0

    def take(self, length: int, n: int) -> None:
        left = self.count.get(length, 0) - n
        self.count[length] = left
        if left:
            self.bits |= 1 << length
        else:
            self.bits &= ~(1 << length)


Filling = tuple[tuple[int, int], ...]  # (length, how many of it)


def fillings(left: _Lengths, room: int, most: int) -> list[tuple[int, Filling]]:
    """Undominated ways to fill ``room``, with what they waste, least first; at most ``most`` are looked at.

    Only fillings that nothing can be added to, and in which no piece gives way to
    a larger one, are told; any other is dominated by one of these.
    """
    found: list[tuple[int, Filling]] = []
    seen = 0

    def spare(most_tokens: int, chosen: dict[int, int]) -> int:
        """The largest length up to ``most_tokens`` of which some are not chosen yet."""
        length = left.fitting(most_tokens)
        while length > 0 and left.count[length] == chosen.get(length, 0):
            length = left.fitting(length - 1)
        return length

    def search(room: int, top: int, chosen: dict[int, int]) -> bool:
        nonlocal seen
        length = left.fitting(min(room, top))
        if length <= 0:
            seen += 1
            if spare(room, chosen) <= 0 and not (found and any(spare(x + room, chosen) > x for x in chosen)):
                found.append((room, tuple(chosen.items())))
            return room == 0 or seen >= most
        while length > 0:
            for k in range(min(left.count[length], room // length), 0, -1):
                chosen[length] = k
                if search(room - k * length, length - 1, chosen):
                    return True
                del chosen[length]
            length = left.fitting(length - 1)
        return False

    search(room, room, {})
    return sorted(found, key=lambda f: f[0]) or [(room, ())]


@dataclass
class Plan:
    bins: int
    # (times, what one sequence holds)
    steps: list[tuple[int, Filling]] = field(default_factory=list)


def complete_bins(counts: np.ndarray, limit: int = LIMIT, nodes: int = NODES) -> Plan:
    """Packs ``counts[n]`` pieces of n tokens: depth-first, best fit first, until the bound is met or ``nodes`` are used."""
    total = int((counts * np.arange(limit + 1)).sum())
    bound, best = least_bins(counts, limit), Plan(-1)
    left, steps, used, wasted, visited = _Lengths(counts), [], 0, 0, 0
    # Of each step: what it took, and the fillings not yet tried.
    trail: list[tuple[int, Filling, int, list]] = []

    def choose(options: list) -> bool:
        nonlocal used, wasted
        while options:
            waste, lengths = options.pop(0)
            times = min(left.count[n] // k for n, k in lengths)
            if best.bins >= 0 and wasted + waste * times > (best.bins - 1) * limit - total:
                # The same filling fewer times cannot be told from this one by its bound: try it once.
                times = 1
                if wasted + waste > (best.bins - 1) * limit - total:
                    continue
            for n, k in lengths:
                left.take(n, times * k)
            used += times
            wasted += waste * times
            steps.append((times, lengths))
            trail.append((times, lengths, waste, options))
            return True
        return False

    def undo() -> list:
        nonlocal used, wasted
        times, lengths, waste, options = trail.pop()
        for n, k in lengths:
            left.take(n, -times * k)
        used -= times
        wasted -= waste * times
        steps.pop()
        return options

    def options() -> list:
        largest = left.bits.bit_length() - 1
        left.take(largest, 1)
        found = fillings(left, limit - largest, FILLINGS)
        left.take(largest, -1)
        return [(waste, tuple((Counter(dict(rest)) + Counter([largest])).items())) for waste, rest in found]

    while True:
        if not left.bits:
            if best.bins < 0 or used < best.bins:
                best = Plan(used, list(steps))
            if best.bins <= bound:
                return best
            ahead = False
        else:
            visited += best.bins >= 0  # the first descent finds the first plan, however long it is
            ahead = choose(options())
        while not ahead:
            if not trail or (best.bins >= 0 and visited > nodes):
                return best
            ahead = choose(undo())


def _places(plan: Plan) -> pd.DataFrame:
    """A row for each place of each step: pieces of ``length`` numbered from ``first`` on go to ``sequence`` on, at ``offset``."""
    numbered: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in plan.steps:
        offset = 0
        for n, k in lengths:
            for _ in range(k):
                first = numbered.get(n, 0)
                rows.append((n, first, sequence, offset))
                numbered[n] = first + times
                offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], kind="stable")


def pack(rows: DataFrame, order: list[str], limit: int = LIMIT) -> DataFrame:
    """``rows`` (settled, with ``length`` from 1 to ``limit``) with ``sequence_id`` and ``offset``.

    Pieces of one length are numbered in ``order``; only equal ones may change places between runs.
    """
    counts = np.zeros(limit + 1, np.int64)
    # At most ``limit`` rows.
    for row in rows.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    places = _places(complete_bins(counts, limit))
    # Steps use up a length each or nearly so: the table is bounded by the limit, not by the corpus.
    lookup = rows.sparkSession.sparkContext.broadcast({c: places[c].to_numpy(np.int64) for c in places})

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        t, n, k = lookup.value, length.to_numpy(np.int64), number.to_numpy(np.int64)
        at = np.searchsorted((t["length"] << 48) + t["first"], (n << 48) + k, side="right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][at] + k - t["first"][at], "offset": t["offset"][at]})

    numbered = with_running_total(rows, "length", order, name="number")
    return numbered.withColumn("place", place("length", "number")).select(*rows.columns, "place.sequence_id", "place.offset")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text."""
    with small_batches(df.sparkSession):
        rows = settled(pieces(df, tokenizer_path, id_col, text_col, limit, end_id).withColumn("h", F.xxhash64("id", "piece")))
    packed = pack(rows, ["h", "id", "piece", "ids_crc32"], limit)
    return packed.drop("h").withColumnRenamed("id", id_col)
