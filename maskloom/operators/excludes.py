"""Exclude lists as tables.

A list of a few patterns is one expression (``exclude_files``). A list of thousands is
a table here: each pattern is filed under one key, an end, a beginning or three
characters that every path it matches must hold, and paths meet only the patterns
filed under keys of their own. What meets is matched in full, and the pattern that
comes last decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.globs import glob_to_java
from maskloom.sources.scratch import measured, settled

KEY, GRAM = 12, 3  # characters of an end or a beginning, at most, and of what lies between
WHOLE, END, BEGIN, WITHIN, ANY = "whole", "end", "begin", "within", "any"
_SPECIAL = re.compile(r"\[!?\]?[^\]]*\]|\*+|\?", re.DOTALL)
FILED = "idx bigint, excluded boolean, kind string, key string, java string"


def filed(glob: str) -> tuple[str, str]:
    """The kind of key a glob is filed under, and the key."""
    literals = _SPECIAL.split(glob)
    if len(literals) == 1:
        return WHOLE, glob
    begin, end, within = literals[0], literals[-1], max(literals, key=len)
    if max(len(begin), len(end)) < GRAM <= len(within):
        return WITHIN, within[-GRAM:]
    if end and len(end) >= len(begin):
        return END, end[-KEY:]
    return (BEGIN, begin[:KEY]) if begin else (ANY, "")


def pattern_table(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    """(idx, pattern) of a list in its order."""
    return spark.createDataFrame(list(enumerate(patterns)), "idx bigint, pattern string")


def _filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for idx, pattern in zip(batch["idx"], batch["pattern"], strict=True):
            clean = (pattern or "").strip()
            glob = clean.removeprefix("!")
            if glob:
                rows.append((idx, not clean.startswith("!"), *filed(glob), rf"(?s)\A/?(?:{glob_to_java(glob)})\z"))
        yield pd.DataFrame(rows, columns=["idx", "excluded", "kind", "key", "java"])


def _keys(path: Column, sizes: set[tuple[str, int]]) -> Column:
    """All keys of a path, of the kinds and sizes that the patterns are filed under."""
    rooted, base = F.concat(F.lit("/"), path), F.substring_index(path, "/", -1)
    forms = (rooted, path, base)
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    kinds = {kind for kind, _ in sizes}
    keys = [entry(WHOLE, form) for form in forms if WHOLE in kinds]
    # A form that ends with the key makes the rooted path end with it.
    keys += [entry(END, F.right(rooted, F.lit(n))) for kind, n in sorted(sizes) if kind == END]
    keys += [entry(BEGIN, F.left(form, F.lit(n))) for kind, n in sorted(sizes) if kind == BEGIN for form in forms]
    keys += [entry(ANY, F.lit("")) for _ in kinds & {ANY}]
    found = F.array(*keys) if keys else F.array().cast("array<struct<kind:string,key:string>>")
    if WITHIN in kinds:
        places = F.sequence(F.lit(1), F.greatest(F.length(rooted) - (GRAM - 1), F.lit(1)))
        found = F.concat(found, F.transform(places, lambda i: entry(WITHIN, F.substring(rooted, i, F.lit(GRAM)))))
    return F.array_distinct(found)


def exclude_by_table(df: DataFrame, patterns: DataFrame, path: str = "rel_path") -> DataFrame:
    """Add ``excluded`` by a table (idx, pattern): of the patterns that match, the last decides, and ``!`` takes back in.

    The result is that of ``exclude_files`` without defaults. Distinct paths meet the
    patterns; a key that many paths share is split by adaptive execution where the
    patterns are too many to broadcast. A null or empty pattern does not count, and a
    null path is not excluded.
    """
    table = settled(patterns.select("idx", "pattern").mapInPandas(_filed, FILED))
    # Few: one row a kind and size of key.
    sizes = {(row["kind"], row["n"]) for row in table.select("kind", F.length("key").alias("n")).distinct().collect()}
    if not sizes:
        return df.withColumn("excluded", F.lit(False))
    paths = df.select(F.col(path).alias("_path")).where(F.col("_path").isNotNull()).distinct()
    keyed = paths.select("_path", F.explode(_keys(F.col("_path"), sizes)).alias("_key")).select("_path", "_key.kind", "_key.key")
    met = keyed.join(measured(table), ["kind", "key"])
    rooted, base = F.concat(F.lit("/"), F.col("_path")), F.substring_index("_path", "/", -1)
    sound = (F.col("kind") == WHOLE) | F.rlike(rooted, F.col("java")) | F.rlike(base, F.col("java"))
    verdicts = met.where(sound).groupBy("_path").agg(F.max_by("excluded", "idx").alias("_excluded"))
    told = df.join(verdicts, F.col(path) == F.col("_path"), "left")
    return told.withColumn("excluded", F.coalesce("_excluded", F.lit(False))).drop("_path", "_excluded")
