"""Exact duplicates by two passes over a Bloom filter.

The first pass sets, for two positions of each text's hash, a bit for the first
hit and another for every later one. A hash whose positions all have the second
bit may be repeated; every other text is certainly unique. The second pass looks
each row up: unique rows pass straight through, and only the others shuffle.
The filter takes 16 to 32 bits a row up to ``MAX_BITS`` (128 MB to the driver and
each executor); beyond that more unique rows shuffle, and the result is the same.

Cases: a null text counts as empty; of rows repeated with the same id and text one
is kept; a null id is smaller than any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import ascii_lower, fresh, join_groups, whole_text
from maskloom.sources.scratch import measured, settled

MAX_BITS = 1 << 30
BITS_A_ROW = 16
SLICE = 1 << 19  # bits that are merged together
SALTS = 32
FLUSH = 1 << 20
LATER = np.uint32(1 << 31)


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(bits - 1)
    return h & mask, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) & mask


def _hits(bits: int):
    """Batches of hashes to (slice, salt, hits): the positions hit, flagged where hit again."""

    def flush(held: list[np.ndarray], salt: int) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        code = (at % SLICE).astype(np.uint32) | np.where(n > 1, LATER, np.uint32(0))
        slices, first = np.unique(at // SLICE, return_index=True)
        packed = [part.tobytes() for part in np.split(code, first[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(slices.astype(np.int64)), pa.array([salt] * len(slices), pa.int32()), pa.array(packed, pa.binary())],
            ["slice", "salt", "hits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held: list[np.ndarray] = []
        for batch in batches:
            a, b = _positions(batch.column(0).to_numpy(zero_copy_only=False), bits)
            # One text counts once at a position that both of its hashes give.
            held += [a, b[a != b]]
            if sum(map(len, held)) > FLUSH:
                yield flush(held, salt)
                held = []
        if any(map(len, held)):
            yield flush(held, salt)

    return run


def _add_hits(group: pd.DataFrame) -> pd.DataFrame:
    count = np.zeros(SLICE, np.uint8)
    for hits in group["hits"]:
        code = np.frombuffer(hits, np.uint32)
        at = code & ~LATER
        count[at] = np.minimum(count[at] + 1 + (code >= LATER), 2)
    planes = np.packbits(count > 0).tobytes(), np.packbits(count > 1).tobytes()
    return pd.DataFrame({"slice": [group["slice"].iloc[0]], "once": [planes[0]], "again": [planes[1]]})


def _add_planes(group: pd.DataFrame) -> pd.DataFrame:
    once, again = np.zeros(SLICE // 8, np.uint8), np.zeros(SLICE // 8, np.uint8)
    for a, b in zip(group["once"], group["again"], strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        again |= b | (once & a)
        once |= a
    return pd.DataFrame({"slice": [group["slice"].iloc[0]], "again": [again.tobytes()]})


def repeat_filter(hashes: DataFrame, rows: int):
    """A function from a hash column to whether the hash may occur again in ``hashes`` (one bigint column)."""
    bits = SLICE
    while bits < min(rows * BITS_A_ROW, MAX_BITS):
        bits *= 2
    planes = (
        hashes.mapInArrow(_hits(bits), "slice bigint, salt int, hits binary")
        .groupBy("slice", "salt")
        .applyInPandas(_add_hits, "slice bigint, once binary, again binary")
        .groupBy("slice")
        .applyInPandas(_add_planes, "slice bigint, again binary")
    )
    # At most MAX_BITS / 8 bytes in all.
    again = np.zeros(bits // 8, np.uint8)
    for row in planes.collect():
        again[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["again"], np.uint8)
    plane = hashes.sparkSession.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        seen = np.ones(len(column), bool)
        for at in _positions(column.to_numpy(), bits):
            seen &= (plane.value[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return pd.Series(seen)

    return maybe


def digest(text: str) -> Column:
    """SHA-256 of the text with A-Z in lower case."""
    return F.sha2(ascii_lower(whole_text(text)).cast("binary"), 256)


def _groups(repeated: DataFrame) -> DataFrame:
    return settled(repeated.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each of ``df``; the largest id of equal texts stays."""
    keyed = settled(df.select(F.col(id_col).alias("id"), digest(text_col).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")))
    maybe = repeat_filter(keyed.select("h"), keyed.count())
    tagged = settled(keyed.withColumn("maybe", maybe("h")).drop("h"))
    alone = tagged.filter("NOT maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    rows = tagged.filter("maybe").select("id", "text_sha256")
    found = join_groups(rows, _groups(rows), "text_sha256", "group_size")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    # Rows repeated with the same id: one of them stays.
    first = F.row_number().over(Window.partitionBy("text_sha256", "id").orderBy("group_size"))
    winners = found.filter(same).withColumn("kept", first == 1)
    found = found.filter(~same).withColumn("kept", F.lit(False)).unionByName(winners)
    return alone.unionByName(found.select(*alone.columns)).withColumnRenamed("id", id_col)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are. Texts of unique rows never shuffle."""
    sha, h, keep = fresh(df, "_sha"), fresh(df, "_hash"), fresh(df, "_keep")
    keyed = settled(df.select(F.col(id_col).alias("id"), digest(text_col).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")))
    maybe = repeat_filter(keyed.select("h"), keyed.count())
    groups = _groups(keyed.filter(maybe("h")))
    keepers = groups.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    marked = df.withColumn(sha, digest(text_col)).withColumn(h, F.xxhash64(sha))
    alone = marked.filter(~maybe(h)).select(*df.columns)
    at = [F.col(f"l.{sha}") == F.col(f"r.{sha}"), F.col(f"l.{id_col}").eqNullSafe(F.col(f"r.{keep}"))]
    won = marked.filter(maybe(h)).alias("l").join(measured(keepers).alias("r"), at, "left_semi").dropDuplicates([sha, id_col])
    return alone.unionByName(won.select(*df.columns))
