"""Documents into lines and lines back into documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.text import line_structs
from maskloom.sources.scratch import measured, settled

CHUNK_BYTES = 256 << 20
# What is joined first: so many lines of a document, or the lines of so many bytes of a large one.
LEAF_LINES, LEAF_BYTES = 1 << 12, 1 << 18


def documents_to_lines(df: DataFrame, text: str = "text", keep: Sequence[str] = ("path",)) -> DataFrame:
    """(keep..., line_no, line, eol): one row per line, numbered from 1. Narrow: no shuffle."""
    rows = df.select(*keep, F.posexplode(line_structs(F.col(text))).alias("pos", "part"))
    return rows.select(
        *keep,
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.col("part.line").alias("line"),
        F.col("part.eol").alias("eol"),
    )


def _joined(parts: DataFrame, by: Sequence[str], order: str, text: Column) -> DataFrame:
    """The texts of a group as one, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("part"))))
    return parts.groupBy(*by).agg(pairs.alias("parts")).withColumn("text", F.array_join(F.col("parts.part"), "")).drop("parts")


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return same


def _with_offset(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``offset``, the bytes of the document before each line.

    Lines are range-partitioned, so one document may fill many partitions; each sums
    up its own lines, and sums per (partition, document) tell what came before.
    """
    dealt = settled(lines.repartitionByRange(*keys, "line_no").withColumn("_part", F.spark_partition_id()))
    earlier = (Window.unboundedPreceding, -1)
    own = F.sum("bytes").over(Window.partitionBy("_part", *keys).orderBy("line_no").rowsBetween(*earlier))
    sums = dealt.groupBy("_part", *keys).agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(*earlier))
    told = sums.select("_part", *keys, F.coalesce(before, F.lit(0)).alias("_before"))
    at = (F.col("l._part") == F.col("r._part")) & _same("l", "r", keys)
    joined = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).alias("l").join(told.alias("r"), at)
    return joined.select("l.*", (F.col("_own") + F.col("_before")).alias("offset")).drop("_own", "_part")


def lines_to_documents(
    lines: DataFrame,
    keys: Sequence[str] = ("path",),
    col: str = "line",
    chunk_lines: int | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(keys..., chunk_no, offset, text): lines with their endings, joined in order.

    A document of up to ``chunk_bytes`` bytes is one row, chunk 0, whatever its lines.
    A larger one comes in chunks; each holds the lines that begin within its stretch of
    that many bytes, and ``offset`` tells the bytes before it. Lines are joined to leaves
    and leaves to documents, so no array of lines grows with a document.

    ``chunk_lines`` chunks by a number of lines instead, (keys..., chunk_no, text), in
    one step that a stream allows too.
    """
    keys = list(keys)
    whole = F.concat(F.col(col), F.col("eol"))
    if chunk_lines is not None:
        numbered = lines.withColumn("chunk_no", F.floor((F.col("line_no") - 1) / chunk_lines).cast("bigint"))
        return _joined(numbered, [*keys, "chunk_no"], "line_no", whole).select(*keys, "chunk_no", "text")
    sized = lines.select(*keys, "line_no", whole.alias("part"), F.octet_length(whole).cast("bigint").alias("bytes"))
    totals = sized.groupBy(*keys).agg(F.sum("bytes").alias("total"))
    large = settled(totals.where(F.col("total") > chunk_bytes).select(*keys))
    zero = F.lit(0).cast("bigint")
    if large.isEmpty():
        small, big = sized, None
    else:
        # Few: their number is below the bytes of all lines over those of a chunk.
        small = sized.alias("l").join(measured(large).alias("r"), _same("l", "r", keys), "left_anti")
        big = sized.alias("l").join(measured(large).alias("r"), _same("l", "r", keys), "left_semi")
    # Both steps keep the partitions that the documents were dealt out to.
    leaf = F.floor(F.col("line_no") / LEAF_LINES).alias("leaf")
    leaves = _joined(small.repartition(*keys).select("*", leaf), [*keys, "leaf"], "line_no", F.col("part"))
    documents = _joined(leaves, keys, "leaf", F.col("text")).select(*keys, zero.alias("chunk_no"), zero.alias("offset"), "text")
    if big is None:
        return documents
    placed = _with_offset(big, keys)
    stretch = F.floor(F.col("offset") / chunk_bytes).cast("bigint").alias("chunk_no")
    leaf = F.floor(F.col("offset") / LEAF_BYTES).alias("leaf")
    cut = placed.select("*", stretch, leaf)
    leaves = _joined(cut, [*keys, "chunk_no", "leaf"], "line_no", F.col("part"))
    starts = cut.groupBy(*keys, "chunk_no").agg(F.min("offset").alias("offset"))
    chunks = _joined(leaves, [*keys, "chunk_no"], "leaf", F.col("text"))
    at = _same("l", "r", [*keys, "chunk_no"])
    told = chunks.alias("l").join(starts.alias("r"), at).select(*[f"l.{k}" for k in keys], "l.chunk_no", "r.offset", "l.text")
    return documents.unionByName(told)
