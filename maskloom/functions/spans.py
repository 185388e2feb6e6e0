"""Where the matches of a pattern lie, in code points, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.binding import let

# Running sums are taken block by block: appending copies the array so far.
BLOCK = 256


def _sums(values: Column) -> Column:
    """Running sums of a short array of bigint."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("out"))

    def add(state: Column, x: Column) -> Column:
        return F.struct((state["sum"] + x).alias("sum"), F.concat(state["out"], F.array(state["sum"] + x)).alias("out"))

    return F.aggregate(values, start, add, lambda state: state["out"])


def running_sums(values: Column) -> Column:
    """Running sums of an array of bigint of any length."""

    def blockwise(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda i: _sums(F.slice(xs, i, F.lit(BLOCK)))), joined)

    def joined(blocks: Column) -> Column:
        ends = _sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        shift = let(ends, lambda e: F.concat(F.array(F.lit(0).cast("bigint")), e))
        return F.flatten(F.zip_with(blocks, F.slice(shift, F.lit(1), F.size(blocks)), lambda b, s: F.transform(b, lambda x: x + s)))

    return let(values, blockwise)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>>: the matches of ``pattern``, leftmost first, without overlap.

    The end is exclusive. The pattern must not match the empty string.
    """

    def length(part: Column) -> Column:
        return F.length(part).cast("bigint")

    def placed(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: length(gap) + length(hit))
        return F.zip_with(
            running_sums(steps), hits, lambda end, hit: F.struct((end - length(hit)).alias("start"), end.alias("end"), hit.alias("hit"))
        )

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)
