"""Shards of near equal bytes, tokens and rows by vector bin packing.

A group is the rows of one text. Groups, largest first, go to the shard where the
dot product of the group's share of bytes, tokens and rows with what the shard has
left of them is highest. The driver places a bounded number of items: a group of
over 1/``GRAIN`` of a shard is an item of its own, split by id where it is over
1/``WHOLE`` of a shard, since else one text could not be spread; all smaller
groups are gathered by the hash of their text in ``GRAIN`` x 2 items a shard.

Cases: a null text has no bytes and is a group with the empty text; ids may be null;
rows repeated with the same id and text stay together and take different slots; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import whole_text, with_running_total
from maskloom.llm.mixing import words_in
from maskloom.sources.scratch import settled

GRAIN, WHOLE = 64, 16
ROW_BYTES = 8
DIMENSIONS = ("bytes", "tokens", "rows")
# Bytes are what the law is about; they settle where the three pull apart.
WEIGHTS = (8.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, from the items' vectors."""
    totals = np.maximum(items.sum(axis=0), 1)
    share = items / totals * np.array(WEIGHTS)
    left = np.full((shards, items.shape[1]), 1 / shards) * np.array(WEIGHTS)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = np.argmax(left @ share[i])
        left[out[i]] -= share[i]
    return out


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row for each of ``df``; slots count from 0 in every shard."""
    text = whole_text(text_col)
    rows = settled(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
            words_in(text_col).alias("words"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
        )
    )
    vector = [F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    totals = rows.agg(*vector).first()
    groups = rows.groupBy("text_hash").agg(*vector)
    # Of a shard's capacity, in the dimension where the group takes most.
    part = F.greatest(*[F.col(d) * shards / F.lit(float(max(totals[d] or 1, 1))) for d in DIMENSIONS])
    # Each dimension has fewer than shards x GRAIN groups of that size.
    large = groups.filter(part * GRAIN > 1).select("text_hash", F.ceil(F.when(part * WHOLE > 1, part * WHOLE).otherwise(1)).alias("parts")).orderBy("text_hash").collect()
    gathered = shards * GRAIN * 2
    listed, first = [], gathered
    for row in large:
        listed.append((row["text_hash"], row["parts"], first))
        first += row["parts"]
    own = F.broadcast(df.sparkSession.createDataFrame(listed, "text_hash bigint, parts bigint, first bigint"))
    item = F.coalesce(F.col("first") + F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")), F.pmod(F.xxhash64("text_hash", F.lit("item")), F.lit(gathered)))
    rows = rows.join(own, "text_hash", "left").withColumn("item", item).drop("parts", "first")
    found = rows.groupBy("item").agg(*vector).orderBy("item").collect()
    vectors = np.array([[row[d] for d in DIMENSIONS] for row in found], float).reshape(-1, len(DIMENSIONS))
    placed = [(row["item"], int(s)) for row, s in zip(found, place(vectors, shards), strict=True)]
    to = F.broadcast(df.sparkSession.createDataFrame(placed, "item bigint, shard int"))
    sharded = settled(rows.join(to, "item").withColumn("h", F.xxhash64("id", "text_hash")))
    numbered = with_running_total(sharded, "shard", ["h", "id", "text_hash"], name="slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
