"""Helpers shared by the operators: texts, running totals, hot groups, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.sources.scratch import settled

# The letters that lower-casing touches, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

# Of an Arrow batch of texts on its way to a Python worker: executor and worker hold one a task. It bears on memory alone.
BATCH_BYTES = 4 << 20

# A group is hot when it holds over 1/HOT_SHARE of the rows: there are fewer than HOT_SHARE of them, whatever the input.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache(name: str) -> dict:
    """A dict that the tasks of one Python worker share, one at a time: asking for another drops it.

    Callers bound its size.
    """
    import sys
    from types import ModuleType

    shared = sys.modules.setdefault("_maskloom_worker", ModuleType("_maskloom_worker")).__dict__
    if shared.get("_held") != name:
        shared.get("_words", {}).clear()
        shared.update(_held=name, _words={})
    return shared["_words"]


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system; Arrow and the C library keep it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside sends texts to Python workers in batches of about ``BATCH_BYTES``, unless the session has a setting of its own."""
    if spark.conf.get(ARROW_BYTES, None) is not None:
        yield
        return
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """``rows`` of the driver as a table within the plan; from plain rows Spark makes it in Python workers of another kind, which stay on."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema))


def text_blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as bytes in blocks of about ``most`` bytes, with the place of the first."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, texts.slice(start, end - start).cast(pa.binary()).to_pylist()
        start = end


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running_total(df: DataFrame, key: str, order: Sequence[str], value: Column | None = None, name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``value`` (1 by default) over the rows of the same key that come earlier in ``order``.

    Rows are range-partitioned by key and order, so a hot key fills many
    partitions; each is summed by itself, and sums per (partition, key) give its
    offset. ``df`` must be settled, and ``order`` unique within a key for the
    result to be the same in every run.
    """
    value = F.lit(1) if value is None else value
    part, share, amount = "_rt_part", "_rt_offset", "_rt_value"
    dealt = settled(
        df.withColumn(amount, value.cast("bigint"))
        .repartitionByRange(partitions(df.sparkSession), key, *order)
        .withColumn(part, F.spark_partition_id())
    )
    earlier = (Window.unboundedPreceding, -1)
    sums = dealt.groupBy(part, key).agg(F.sum(amount).alias(share))
    offsets = sums.select(
        part, key, F.coalesce(F.sum(share).over(Window.partitionBy(key).orderBy(part).rowsBetween(*earlier)), F.lit(0)).alias(share)
    )
    own = F.sum(amount).over(Window.partitionBy(part, key).orderBy(*order).rowsBetween(*earlier))
    return (
        dealt.withColumn(name, F.coalesce(own, F.lit(0)))
        .join(offsets, [part, key])
        .withColumn(name, F.col(name) + F.col(share))
        .drop(part, share, amount)
    )


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` inner-joined to their groups; ``size`` counts the rows of each group.

    Hot groups, fewer than HOT_SHARE by their definition, are broadcast and their
    rows stay where they are; all others meet by shuffle. Both sides must be settled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    heavy = groups.filter(hot)
    at_once = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.filter(~hot), key)
    return at_once.unionByName(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` is connected with.

    Large-star and small-star steps alternate until nothing changes: the number
    of rounds grows with the logarithm of the longest chain. Every round is a
    table in shared storage, so lineage stays short.
    """
    links = settled(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = settled(small.select("e.u", "e.v").filter("u <> v").distinct())
        # A star forest: every node has one link, and no root has one.
        n = small.count()
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        links = small
        if not chained and n == small.select("u").distinct().count():
            break
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
