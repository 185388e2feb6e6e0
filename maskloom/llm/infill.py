"""Fill-in-the-middle through a learned index from line ranks to offsets.

A text of n lines is cut after two of its n + 1 line boundaries; prefix, middle
and suffix are written in another order behind markers. Texts are taken in blocks.
All boundary offsets of a block, over its texts, are fitted with straight segments
that err by at most ``ERROR`` bytes, and each boundary keeps its residual in two
bytes. A cut is predicted from its rank by its segment, and the residual makes it
exact. Rows stay in their tasks.

Cases: a null text counts as empty; an empty text, or one that holds a marker,
stays plain; a null id is drawn as an empty one; rows repeated with the same id are
cut alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import text_blocks, whole_text

ERROR = 1 << 14  # bytes a prediction may be off; residuals are 16-bit
BLOCK_BYTES = 4 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"
# What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class RankIndex:
    """Offsets by rank: segments (first rank, its offset, slope) and a residual for each rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def _predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self._predict(rank) + self.residual[rank]

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """The longest segments, one after the other, whose line through their first point stays within ``error``."""
        first, base, slope = [], [], []
        start, n = 0, len(offsets)
        while start < n:
            low, high, end, step = -np.inf, np.inf, start + 1, 64
            while end < n:
                stop = min(n, end + step)
                run = np.arange(end, stop) - start
                rise = offsets[end:stop] - offsets[start]
                lows = np.maximum(low, np.maximum.accumulate((rise - error) / run))
                highs = np.minimum(high, np.minimum.accumulate((rise + error) / run))
                open_ = lows <= highs
                fits = len(run) if open_.all() else int(np.argmin(open_))
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                end += fits
                if fits < len(run):
                    break
                step *= 2
            first.append(start)
            base.append(offsets[start])
            slope.append(0.0 if end == start + 1 else (low + high) / 2)
            start = end
        index = cls(np.array(first, np.int64), np.array(base, np.int64), np.array(slope), np.empty(0, np.int16))
        residual = offsets - index._predict(np.arange(n))
        return cls(index.first, index.base, index.slope, residual.astype(np.int16 if error < (1 << 15) - 1 else np.int64))


def boundaries(joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets, in order and once each, where a line or a text of ``joined`` begins or ends."""
    breaks = np.flatnonzero(joined == ord("\n")) + 1
    return np.unique(np.concatenate([[0], breaks, ends]).astype(np.int64))


def _transformed(texts: Sequence[bytes], draws: np.ndarray, rate: int, spm: int, marks: Sequence[bytes]):
    """Per text: lines, form, characters of prefix and middle, output. ``draws`` has four numbers a text."""
    ends = np.cumsum([len(text) for text in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offsets = boundaries(joined, ends)
    index = RankIndex.fit(offsets)
    starts = np.concatenate([[0], ends[:-1]])
    zero = np.searchsorted(offsets, starts)
    n = np.searchsorted(offsets, ends) - zero
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    cut = [index.offset(zero + cuts[:, i]) for i in (0, 1)]
    chars = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80, dtype=np.int32)])
    before = [chars[at] - chars[starts] for at in cut]
    p, s, m = marks
    for row, text in enumerate(texts):
        if not text or any(mark in text for mark in marks) or draws[row, 2] % 100 >= rate:
            yield n[row], PLAIN, None, None, text
            continue
        i, j = int(cut[0][row] - starts[row]), int(cut[1][row] - starts[row])
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        told = (before[0][row], before[1][row] - before[0][row])
        if draws[row, 3] % 100 < spm:
            yield n[row], SPM, *told, b"".join((s, suffix, p, prefix, m, middle))
        else:
            yield n[row], PSM, *told, b"".join((p, prefix, s, suffix, m, middle))


_RESULT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def draws(key: Column, seed: int, count: int) -> list[Column]:
    """The first 8-digit groups of the SHA-256 of ``seed:key`` as unsigned integers."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(count)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, markers: Sequence[str] = MARKERS
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text once; ``rate`` and ``spm`` are percentages."""
    marks = [marker.encode() for marker in markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)])
            for start, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                ids = batch.column(0).slice(start, len(texts))
                rows = zip(*_transformed(texts, drawn[start : start + len(texts)], rate, spm, marks), strict=True)
                columns = [pa.array(values, field.type) for values, field in zip(rows, _RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *_RESULT.names])

    hashed = draws(F.col(id_col), seed, 4)
    given = df.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(hashed)])
    kind = given.schema["id"].dataType.simpleString()
    cut = given.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return cut.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form", markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of that form was made of."""
    p, s, m = markers
    out = F.col(output)

    def parts(head: str, next_mark: str) -> tuple[Column, Column, Column]:
        rest = F.substring(out, F.lit(len(head) + 1), F.length(out))
        tail = F.substring_index(rest, next_mark, -1)
        return F.substring_index(rest, next_mark, 1), F.substring_index(tail, m, 1), F.substring_index(tail, m, -1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == PSM, psm).when(F.col(form) == SPM, spm).otherwise(out)
