"""Profiles of detections: counts, first examples, suggested rules, the report."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.operators.apply import apply_rules
from maskloom.operators.detect import DEFAULT_NAMES
from maskloom.rules import Rule, rules_from_spec
from maskloom.sources.scratch import settled

SCAN_ORDER = ("path", "line_no", "det_no", "pos")


def matches_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def files_by_kind(found: DataFrame, path: str = "path") -> DataFrame:
    return found.groupBy("kind", path).agg(F.count(F.lit(1)).alias("n"))


def _first_examples(first: DataFrame, k: int) -> DataFrame:
    """Rank (kind, masked_example, first_seen) per kind, keeping the first ``k``.

    The rank runs per kind and bucket of examples before it runs per kind, so no
    task sees more than ``k`` rows of each bucket however many examples one kind has.
    """
    bucketed = first.withColumn("bucket", F.pmod(F.xxhash64("masked_example"), F.lit(256)))
    within = Window.partitionBy("kind", "bucket").orderBy("first_seen")
    overall = Window.partitionBy("kind").orderBy("first_seen")
    short = bucketed.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= max(k, 0))
    ranked = short.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= max(k, 0))
    return ranked.select("kind", "rank", "masked_example")


def examples_by_kind(found: DataFrame, k: int = 5, order: Sequence[str] = SCAN_ORDER) -> DataFrame:
    """The first ``k`` distinct masked examples of every kind in scan order."""
    first = found.groupBy("kind", "masked_example").agg(F.min(F.struct(*order)).alias("first_seen"))
    return _first_examples(first, k)


def summarise(found: DataFrame) -> DataFrame:
    """Findings counted per (kind, path, masked_example): all a report needs, in one shuffle.

    ``seen`` is the first line and position as one number, which a hash aggregate can
    keep; a struct would have to be sorted. A kind has one detector, so ``det_no``
    does not matter to its order.
    """
    seen = F.col("line_no").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    return found.groupBy("kind", "path", "masked_example").agg(
        F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen")
    )


# The rule proposed for every kind of finding, in rank order.
SUGGESTIONS: tuple[tuple[str, dict[str, Any]], ...] = (
    (
        "email",
        {
            "description": "Mask email addresses",
            "search": r"\b([A-Za-z0-9._%+-]+)(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b",
            "trigger": "@",
            "caseSensitive": True,
            "action": {"type": "mask", "maskChar": "*", "keepFirst": 1, "keepLast": 0, "group": 1},
        },
    ),
    (
        "ipv4",
        {
            "description": "Mask IPv4 addresses",
            "search": r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b",
            "trigger": ".",
            "caseSensitive": True,
            "action": {"type": "replacement", "value": r"\1.***.***.\4"},
        },
    ),
    (
        "bearer_token",
        {
            "description": "Mask Bearer tokens",
            "search": r"\bBearer\s+\S+\b",
            "trigger": "Bearer ",
            "caseSensitive": False,
            "action": {"type": "replacement", "value": "Bearer [REDACTED]"},
        },
    ),
    (
        "kv_secret",
        {
            "description": "Mask common key/value secrets (token/api_key/secret/password)",
            "search": r"\b(api[_-]?key|token|secret|password)\s*=\s*([^\s\"']+)\b",
            "trigger": "=",
            "caseSensitive": False,
            "action": {"type": "replacement", "value": r"\1=[REDACTED]"},
        },
    ),
    (
        "card_number",
        {
            "description": "Mask probable card numbers (heuristic; consider tightening for your logs)",
            "search": r"\b(?:\d[ -]*?){13,19}\b",
            "trigger": "",
            "caseSensitive": True,
            "action": {"type": "replacement", "value": "[CARD]"},
        },
    ),
    (
        "probable_token",
        {
            "description": "Mask long probable tokens (heuristic; may cause false positives)",
            "search": r"\b[A-Za-z0-9+/=_-]{24,}\b",
            "trigger": "",
            "caseSensitive": True,
            "action": {"type": "replacement", "value": "[REDACTED_TOKEN]"},
        },
    ),
)


def suggestion_table(spark: SparkSession) -> DataFrame:
    rows = [(rank, kind, spec["description"], json.dumps(spec)) for rank, (kind, spec) in enumerate(SUGGESTIONS, 1)]
    return spark.createDataFrame(rows, "rank int, kind string, description string, rule string")


def suggest_rules(counts: DataFrame) -> DataFrame:
    """Rules for the kinds in ``counts``, one JSON rule a row, in rank order."""
    table = suggestion_table(counts.sparkSession)
    # The right side is fixed at six rows.
    chosen = counts.select("kind").distinct().join(F.broadcast(table), "kind")
    return chosen.select("rank", "kind", "description", "rule").orderBy("rank")


def suggested_rules(counts: DataFrame) -> list[Rule]:
    """The same rules as input for ``apply_rules``; collects at most six rows."""
    specs = [json.loads(row["rule"]) for row in suggest_rules(counts).collect()]
    return rules_from_spec({"version": 2, "rules": specs}, strict=True)


def profile_then_apply(lines: DataFrame, found: DataFrame, salt: str = "", col: str = "line") -> DataFrame:
    """Profile first, then apply the rules suggested for the kinds that occur."""
    rules = suggested_rules(matches_by_kind(found))
    return apply_rules(lines, rules, salt, col) if rules else lines.withColumn("line_out", F.col(col))


def profile_report(
    found: DataFrame,
    files: DataFrame,
    names: Iterable[str] = DEFAULT_NAMES,
    k: int = 5,
    generated_at: str = "",
) -> DataFrame:
    """The whole report as rows (section, kind, key, rank, n), so that no row grows with the data.

    ``files`` lists every scanned path, text or not. The text is read once: a
    summary of the findings is written to shared storage and feeds every section.
    """
    summary = settled(summarise(found))
    nothing, no_rank, no_count = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("bigint")

    def section(df: DataFrame, name: str, kind=nothing, key=nothing, rank=no_rank, n=no_count) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"),
            kind.alias("kind"),
            key.alias("key"),
            rank.cast("int").alias("rank"),
            n.cast("bigint").alias("n"),
        )

    per_file = summary.groupBy("kind", "path").agg(F.sum("n").alias("n"))
    per_kind = summary.groupBy("kind").agg(F.sum("n").alias("n"))
    first = summary.groupBy("kind", "masked_example").agg(F.min(F.struct("path", "seen")).alias("first_seen"))
    first_examples = _first_examples(first, k)
    spark = found.sparkSession
    head = spark.createDataFrame(
        [("version", "1", 0), ("generated_at", generated_at, 0)] + [("detectors", n, i) for i, n in enumerate(names, 1)],
        "section string, key string, rank int",
    ).select("section", nothing.alias("kind"), "key", "rank", no_count.alias("n"))
    scanned = files.select("path").distinct().agg(F.count(F.lit(1)).alias("n"))
    kind, n = F.col("kind"), F.col("n")
    return (
        head.unionByName(section(scanned, "files_scanned", n=n))
        .unionByName(section(per_kind, "matches_by_kind", kind, n=n))
        .unionByName(section(per_file, "files_by_kind", kind, F.col("path").cast("string"), n=n))
        .unionByName(
            section(first_examples, "masked_examples_by_kind", kind, F.col("masked_example"), F.col("rank"))
        )
        .unionByName(section(suggest_rules(per_kind), "suggested_rules", kind, F.col("rule"), F.col("rank")))
    )
