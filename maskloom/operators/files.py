"""Which files of a bundle are excluded, rewritten or passed through."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.binding import let
from maskloom.functions.globs import DEFAULT_EXCLUDES, is_excluded
from maskloom.functions.text import is_text
from maskloom.operators.bundles import numbered
from maskloom.rules import Rule

EXCLUDED, ANONYMISE, PASSTHROUGH, FAILED = "excluded", "anonymise", "passthrough", "failed"


def _verdict(path: Column, patterns: Iterable[str], defaults: bool, case_insensitive: bool) -> Column:
    return is_excluded(path, [*(DEFAULT_EXCLUDES if defaults else ()), *patterns], case_insensitive)


def exclude_files(
    df: DataFrame,
    patterns: Iterable[str] = (),
    case_insensitive: bool = False,
    path: str = "rel_path",
    defaults: bool = True,
) -> DataFrame:
    """Add ``excluded``; the default patterns come first, the user's after."""
    return df.withColumn("excluded", _verdict(F.col(path), patterns, defaults, case_insensitive))


def included_files(df: DataFrame, patterns: Iterable[str] = (), **options) -> DataFrame:
    """Rows whose path is kept. A plain filter, so file contents are read for kept paths only."""
    return exclude_files(df, patterns, **options).where(~F.col("excluded")).drop("excluded")


def classify_files(
    df: DataFrame,
    patterns: Iterable[str] = (),
    case_insensitive: bool = False,
    path: str = "rel_path",
    content: str = "content",
    defaults: bool = True,
) -> DataFrame:
    """Add ``disposition``: exclusion is decided first, then text or binary. NULL without content."""
    verdict = _verdict(F.col(path), patterns, defaults, case_insensitive)
    by_content = let(is_text(F.col(content)), lambda text: F.when(text, F.lit(ANONYMISE)).when(~text, F.lit(PASSTHROUGH)))
    return df.withColumn("disposition", F.when(verdict, F.lit(EXCLUDED)).otherwise(by_content))


def plan_report(files: DataFrame, rules: Sequence[Rule], bundle: str = "bundle", size: str = "length") -> DataFrame:
    """Dry run: files and bytes per bundle and disposition, and the number of active rules."""
    return files.groupBy(bundle, "disposition").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(size).alias("n_bytes"),
        F.lit(sum(r.enabled for r in rules)).cast("int").alias("n_rules"),
    )


def plan_preview(files: DataFrame, k: int = 20, bundle: str = "bundle", path: str = "rel_path") -> DataFrame:
    """The first ``k`` paths to process of every bundle in path order."""
    kept = files.where(F.col("disposition") != EXCLUDED)
    return numbered(kept, bundle, path, "rank", first=k).select(bundle, "rank", path)
