"""Repeated byte strings across all texts, by suffix sorting in shards, and texts without them.

Every string of ``length`` bytes that starts in two places is found, wherever the
two lie, and each byte it covers is removed.

Equal strings must meet in one shard. Of the short grams in a string, the one with
the least hash marks it: equal strings have equal marks, and neighbouring strings
mostly share one, so a text falls into pieces of strings with one mark, some two
hundred bytes apart. Pieces are counted by mark, reduced on the map side. A mark that
occurs once has nothing to tell; one whose pieces are all equal is repeated as a
whole; only where different pieces share a mark do one copy of each go on, and a piece
of a mark of its own that holds it twice, as a run of one letter does. They are
parted once more, by where the mark lies in the string, under a hash of the bytes
that all strings with the mark in that stretch have in common, so that short common
lines do not bring pieces together. What still differs under one key is packed into
shards, and each shard's suffixes are sorted with their common prefixes by external
induced sorting (``suffixes``): a string is repeated if its suffix shares ``length``
bytes with a neighbour.

A key with more than ``HOT`` different pieces, such as a passage that a third of all
texts hold with other text around it, is parted again, by stretches half as long, until
its keys are small; in stretches of one string, equal keys mean equal strings.

Cases: a null text counts as empty; texts shorter than ``length`` stay; rows repeated
with one id are rows like any other, so their texts repeat; strings within one text
and overlapping ones count; a null id stays null; an empty table gives an empty result;
further columns are not read. Texts are valid UTF-8, as Spark's strings should be;
a byte 0xFF in one acts as an end that no match crosses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import join_groups, release_memory, text_blocks, whole_text
from maskloom.llm.suffixes import MEMORY, Text, repeated_starts
from maskloom.sources.scratch import BROADCAST_BYTES, settled

GRAM = 32  # bytes of a mark, at most; a power of two
HOT = 4096
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19
PIECE = "key bigint, mark bigint, d1 bigint, d2 bigint, row bigint, first int, last int, weight bigint, twice boolean"
FOUND = "row bigint, first int, last int"


def gram_of(length: int) -> int:
    return 1 << min(GRAM, length).bit_length() - 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on; ``gram`` is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < gram:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position on."""
    least, held = h, 1
    while 2 * held <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    rest = width - held
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _digests(strings: Iterator) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


def _batch(columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "mark", "d1", "d2", "row", "first", "last", "weight", "twice"])


def _pieces(length: int):
    """Batches of (row, text) to pieces of at most as many strings as can share a mark."""
    gram = gram_of(length)
    width = length - gram + 1

    def block_pieces(rows: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
        sizes = np.array([len(text) for text in texts])
        if sizes.max(initial=0) < length:
            return None
        joined = b"".join(texts)
        h = gram_hashes(np.frombuffer(joined, np.uint8), gram)
        mark = _least_of(h, width)
        starts = np.cumsum(sizes) - sizes
        # Starts of strings, text by text.
        n = np.maximum(sizes - length + 1, 0)
        text = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[text] + place
        value = mark[begin]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (place[1:] == 0)])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(text)))
        # A mark that comes again and again goes on for longer than a mark can be seen: cut there.
        cuts = -(-counts // width)
        inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(first, cuts) + inner * width
        last = np.minimum(at + width, np.repeat(first + counts, cuts)) - 1
        # Where a string begins with its mark and is not the last, the strings after it have another one.
        begun = np.flatnonzero(h[begin] == value)
        twice = np.searchsorted(begun, last) > np.searchsorted(begun, at)
        view = memoryview(joined)
        low, high = begin[at], begin[last] + length
        d = _digests(view[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True))
        key = value[at].view(np.int64)
        return _batch([key, key, d[:, 0], d[:, 1], rows[text[at]], place[at], place[last], np.ones(len(at), np.int64), twice])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for start, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                found = block_pieces(rows[start : start + len(texts)], texts)
                if found is not None:
                    yield found
            release_memory()

    return run


def part_again(piece: bytes, mark: int, length: int, level: int) -> list[tuple[int, int, int]]:
    """(first, last, key) of the stretches of a piece's strings whose mark lies in the same part of the string."""
    import xxhash

    gram = gram_of(length)
    width = length - gram + 1
    part = -(-width // (1 << level))
    h = gram_hashes(np.frombuffer(piece, np.uint8), gram)
    marks = np.flatnonzero(h == np.uint64(mark % (1 << 64)))
    start = np.arange(len(piece) - length + 1)
    at = marks[np.searchsorted(marks, start)]
    stretch = (at - start) // part
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (stretch[1:] != stretch[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    found: list[tuple[int, int, int]] = []
    for i, j, a, q in zip(new.tolist(), last.tolist(), at[new].tolist(), stretch[new].tolist(), strict=True):
        near, far = q * part, min((q + 1) * part, width) - 1
        # The bytes of all strings whose mark lies from ``near`` to ``far`` after their start.
        key = xxhash.xxh3_64_intdigest(piece[a - near : a - far + length], seed=level * 1024 + q)
        key -= (key >> 63) << 64
        found.append((i, j, key))
    return found


def _parted(length: int, level: int):
    """Batches of (row, text, pieces) to the pieces of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            strings: list = []
            for row, text, *pieces in zip(*batch.columns, strict=True):
                data, row = text.as_buffer(), row.as_py()
                for base, end, mark, alone in zip(*(p.as_py() for p in pieces), strict=True):
                    whole = memoryview(data)[base : end + length]
                    for first, last, key in part_again(bytes(whole), mark, length, level):
                        strings.append(whole[first : last + length])
                        for column, value in zip(columns, (key, mark, row, base + first, base + last, 1 if alone else 2), strict=True):
                            column.append(value)
                if len(strings) > 1 << 16:
                    yield _told(columns, strings)
                    columns, strings = [[] for _ in range(6)], []
            if strings:
                yield _told(columns, strings)
            release_memory()

    def _told(columns: list[list], strings: list) -> pa.RecordBatch:
        d = _digests(iter(strings))
        key, mark, row, first, last, weight = columns
        # Strings of one piece have their mark in one place by now.
        return _batch([key, mark, d[:, 0], d[:, 1], row, first, last, weight, np.zeros(len(key), bool)])

    return run


def _cut_out(length: int):
    """Batches of (row, text, pieces) to (key, row, first, alone, piece) with the piece's bytes."""
    schema = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("alone", pa.bool_()), ("piece", pa.binary())])

    def told(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for row, text, *pieces in zip(*batch.columns, strict=True):
                data, row = memoryview(text.as_buffer()), row.as_py()
                for first, last, key, alone in zip(*(p.as_py() for p in pieces), strict=True):
                    held.append((key, row, first, alone, bytes(data[first : last + length])))
                if len(held) > 1 << 13:
                    yield told(held)
                    held = []
            if held:
                yield told(held)
            release_memory()

    return run


def _sorted_shard(length: int, memory: int):
    """All pieces of a partition, its shard, to (row, first, last) of the repeated strings in pieces that came once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Text(length)
        row, first, alone, size = [], [], [], []
        for batch in batches:
            # Number of bytes and four numbers a piece; the bytes themselves go to disk.
            text.add(batch.column("piece").to_pylist())
            for held, name in ((row, "row"), (first, "first"), (alone, "alone")):
                held.append(batch.column(name).to_numpy(zero_copy_only=False))
            size.append(np.diff(np.frombuffer(batch.column("piece").buffers()[1], np.int32)[batch.column("piece").offset :][: len(batch) + 1]))
        if not size:
            return
        flags = repeated_starts(text, length, memory)
        row, first, size, alone = (np.concatenate(x) for x in (row, first, size, alone))
        begin = np.cumsum(size + 1, dtype=np.int64) - size - 1
        begin, row, first, size = begin[alone], row[alone], first[alone], size[alone]
        for low in range(0, len(begin), 1 << 12):
            found = [[], [], []]
            for b, r, f, n in zip(*(x[low : low + (1 << 12)].tolist() for x in (begin, row, first, size)), strict=True):
                step = np.flatnonzero(np.diff(flags[b : b + n - length + 1], prepend=False, append=False))
                found[0] += [r] * (len(step) // 2)
                found[1].append(step[::2] + f)
                found[2].append(step[1::2] + f - 1)
            columns = [pa.array(found[0], pa.int64()), *(pa.array(np.concatenate(x), pa.int32()) for x in found[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "first", "last"])
        release_memory()

    return run


def _with_texts(rows: DataFrame, found: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Texts with arrays of what was found in each; broadcast only if their bytes, measured, are few."""
    width = 96 + 24 * F.size(column)
    size = found.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "row", how)


def _by_row(pieces: DataFrame, code: str) -> DataFrame:
    """One row a text, settled: arrays of its pieces' (first, last, code, whether it came once), a small share of the text."""
    alone = (F.col("weight") == 1).alias("alone")
    lists = pieces.groupBy("row").agg(F.collect_list(F.struct("first", "last", F.col(code).alias("code"), alone)).alias("p"))
    return settled(lists.select("row", "p.first", "p.last", "p.code", "p.alone"))


def repeated_strings(rows: DataFrame, length: int, hot: int = HOT, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """(row, first, last): strings that start at ``first`` to ``last`` of a text and are repeated. ``rows`` (row, text) is settled."""
    texts = rows.select("row", "text")
    pieces = settled(texts.mapInArrow(_pieces(length), PIECE))
    found: list[DataFrame] = []
    shards: list[DataFrame] = []
    level, digest = 0, ["key", "d1", "d2"]
    while True:
        keys = pieces.groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.sum("weight").alias("n"), F.count(F.lit(1)).alias("size"), F.max("twice").alias("twice"))
        keys = settled(keys.filter("n > 1 OR twice").selectExpr("key", "size", "low <> high OR n = 1 AS mixed"))
        kept = settled(join_groups(pieces, keys, "key", "size"))
        # Pieces of greater weight were found to be repeated when they got it.
        single = kept.filter("weight = 1")
        found.append(single.filter("NOT mixed").select("row", "first", "last"))
        place = F.min(F.struct("row", "first", "last", "mark")).alias("p")
        told = kept.filter("mixed").groupBy(*digest).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), place)
        told = settled(told.select(*digest, "weight", "copies", "size", "p.*"))
        equal = told.filter("weight > 1").select(*digest, "copies")
        found.append(join_groups(single.filter("mixed").drop("size"), equal, digest, "copies").select("row", "first", "last"))
        again = told if level == 0 else told.filter(F.col("size") > hot)
        if level:
            shards.append(told.filter(F.col("size") <= hot))
        if again.isEmpty():
            break
        level += 1
        pieces = settled(_with_texts(texts, _by_row(again, "mark"), "first").mapInArrow(_parted(length, level), PIECE))
    if shards:
        held = shards[0]
        for more in shards[1:]:
            held = held.unionByName(more)
        size = held.agg(F.sum((F.col("last") - F.col("first") + length).cast("bigint"))).first()[0] or 0
        cut = _with_texts(texts, _by_row(held, "key"), "first").mapInArrow(_cut_out(length), "key bigint, row bigint, first int, alone boolean, piece binary")
        dealt = cut.repartition(max(1, -(-size // shard_bytes)), "key")
        found.append(dealt.mapInArrow(_sorted_shard(length, memory), FOUND))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _spans(length: int):
    """Batches of (row, starts) to (row, spans): the covered bytes as maximal runs, begins and ends in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for runs in batch.column(1):
                fields = runs.values
                first, last = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                order = np.argsort(first, kind="stable")
                begin, end = first[order], np.maximum.accumulate(last[order] + length)
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                spans.append(np.stack([begin[new], end[np.append(new[1:], len(begin)) - 1]], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64()))], ["row", "spans"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_blocks(batch.column("text"), BLOCK_BYTES):
            part = batch.slice(start, len(texts))
            held: list[list] = [[], [], [], []]
            for data, spans in zip(texts, part.column("spans"), strict=True):
                edges = [0, *(spans.as_py() or ()), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(held, (len(data), len(data) - len(kept), len(edges) // 2 - 1, kept), strict=True):
                    column.append(value)
            columns = [part.column("id"), *(pa.array(x, pa.int64()) for x in held[:3]), part.column("spans"), pa.array(held[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
        release_memory()


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    hot: int = HOT,
    shard_bytes: int = SHARD_BYTES,
    memory: int = MEMORY,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept): each text's bytes without what is repeated.

    ``spans`` holds begins and ends in turn, null where there are none. ``kept`` is binary: a span may end within a character.
    """
    given = df.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("text"))
    rows = settled(given.withColumn("row", F.monotonically_increasing_id()))
    starts = repeated_strings(rows, length, hot, shard_bytes, memory).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    spans = settled(starts.mapInArrow(_spans(length), "row bigint, spans array<bigint>"))
    kind = given.schema["id"].dataType.simpleString()
    told = _with_texts(rows, spans, "spans", "left").select("id", "text", "spans")
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept binary"
    return told.mapInArrow(_without, schema).withColumnRenamed("id", id_col)
