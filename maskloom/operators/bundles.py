"""Batches of bundles: numbering, safe names, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.sources.scratch import settled


def numbered(df: DataFrame, by: str, order: str, out: str, first: int) -> DataFrame:
    """The first rows of every group by ``order``, ranked by hash bucket and then overall."""
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(256)))
    within = Window.partitionBy(by, "_bucket").orderBy(order)
    overall = Window.partitionBy(by).orderBy(order)
    short = bucketed.withColumn(out, F.row_number().over(within)).where(F.col(out) <= first)
    return short.withColumn(out, F.row_number().over(overall)).where(F.col(out) <= first).drop("_bucket")


def with_global_index(df: DataFrame, order: str, out: str = "idx") -> DataFrame:
    """Number all rows from 1 by ``order`` without sorting them in one task.

    Rows are range-partitioned and written once; each partition is numbered on its
    own and shifted by the sizes of the partitions before it.
    """
    # A hash of the row parts equal keys: they fill several partitions and keep their order in every run.
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    placed = settled(tied.repartitionByRange(order, "_tie").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(order, "_tie")
    # One row per partition, so this window and the broadcast stay small.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.withColumn("_rank", F.row_number().over(own)).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(out, F.col("_rank") + F.col("_offset")).drop("_part", "_rank", "_offset", "_tie")


def safe_name(name: Column) -> Column:
    """A name of ``[A-Za-z0-9._-]`` only; ``input`` when nothing is left."""
    joined = F.regexp_replace(F.regexp_replace(name, r"(?U)\A\s+|\s+\z", ""), r"[\r\n]", "")
    cleaned = F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9._-]+", "_"), r"\A[ .]+|[ .]+\z", "")
    return F.when(cleaned == "", F.lit("input")).otherwise(cleaned)


def bundle_names(df: DataFrame, name: str = "bundle", order: str = "bundle", out: str = "folder") -> DataFrame:
    """Add ``folder``: ``001-<safe name>`` by position in the batch."""
    indexed = with_global_index(df, order)
    number = F.col("idx").cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))
    return indexed.withColumn(out, F.concat(padded, F.lit("-"), safe_name(F.col(name))))


def archive_base(name: Column) -> Column:
    """A name without .tar.gz, .tgz, .zip or its last suffix."""
    unpacked = F.regexp_replace(name, r"(?i)(?:\.tar\.gz|\.tgz)\z", "")
    stem = F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")
    return F.when(F.rlike(name, F.lit(r"(?i)(?:\.tar\.gz|\.tgz)\z")), unpacked).otherwise(stem)


def bundle_base_name(
    df: DataFrame, name: str = "bundle", order: str = "bundle", hide_names: bool = False, out: str = "base_name"
) -> DataFrame:
    """Add ``base_name`` of the output; hidden names are numbered instead."""
    if not hide_names:
        return df.withColumn(out, archive_base(F.col(name)))
    indexed = with_global_index(df, order)
    again = F.concat(F.lit("anonymized_output__"), F.col("idx").cast("string"))
    return indexed.withColumn(out, F.when(F.col("idx") == 1, F.lit("anonymized_output")).otherwise(again))


def bundle_summary(files: DataFrame, bundle: str = "bundle", error: str = "error") -> DataFrame:
    """Per-bundle file counts and status, with the batch's totals in a row of their own.

    A file that failed by itself, with ``failed`` as its disposition, is counted and
    costs no other file. A bundle fails when any other of its rows carries an error;
    the others go on. A row without disposition stands for a bundle that could not be
    read. File counts reduce on the map side before anything is shuffled.
    """
    alone = F.col("disposition").eqNullSafe("failed")
    per_bundle = files.groupBy(bundle).agg(
        F.count("disposition").alias("n_files"),
        F.count_if(F.col("disposition") == "anonymise").alias("n_anonymised"),
        F.count_if(F.col("disposition") == "passthrough").alias("n_passthrough"),
        F.count_if(F.col("disposition") == "excluded").alias("n_excluded"),
        F.count_if(alone).alias("n_failed_files"),
        F.count_if(F.col(error).isNotNull() & ~alone).alias("n_errors"),
    )
    failed = F.col("n_errors") > 0
    totals = ["n_files", "n_anonymised", "n_passthrough", "n_excluded", "n_failed_files", "n_errors"]
    return per_bundle.rollup(bundle).agg(
        *[F.sum(c).alias(c) for c in totals],
        F.count_if(~failed).alias("n_succeeded"),
        F.count_if(failed).alias("n_failed"),
        F.count(F.lit(1)).alias("n_bundles"),
        F.grouping(bundle).cast("int").alias("is_total"),
    )
