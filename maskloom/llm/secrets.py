"""Secrets: fixed patterns, and random strings told by two character Markov models.

The samples are labelled by patterns: what the patterns of secrets match is random;
runs of ``TRAIN_RUN`` or more letters, with a few digits behind them or not, and plain
numbers are ordinary; other runs, which may be either, teach nothing. Both models
count which character follows which, over all documents, backed off to how frequent
the character is, and a stretch of ``LEAST_RUN`` or more within a run is a secret when its
log-likelihood ratio is above ``threshold``, whatever path or name stands around it; of
stretches that overlap the likeliest is told. Everything is DataFrame functions; the models are one array of
128 x 128 numbers in the plan.

Cases: a null or empty text has no span; overlapping matches of different patterns
are all told, random strings in what the matches leave of a run, on both sides of
them; without any match there
is nothing to learn from and only the patterns count; rows repeated with the same
id give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.binding import let
from maskloom.functions.spans import match_spans
from maskloom.llm.common import whole_text

# The patterns, and how long a match (of assign: its value) must be.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A whole run of 20 or more from the first AKIA in it; of 24 or more hexadecimal digits.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TRAIN_RUN, LEAST_RUN = 8, 16
IN_RUN = "[A-Za-z0-9+/_-]"
RUN = rf"(?<!{IN_RUN}){IN_RUN}{{{LEAST_RUN},}}+"
ORDINARY = rf"(?<!{IN_RUN})(?={IN_RUN}{{{TRAIN_RUN}}})(?:[A-Za-z_-]++[0-9]{{0,4}}+|[0-9-]++)(?!{IN_RUN})"
THRESHOLD = 10.0
SMOOTH, BACKED = 0.5, 10.0


def _long_enough(spans: Column) -> Column:
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)


def pattern_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end, kind, hit>> of the three patterns, in order of start and kind."""

    def told(spans: Column, number: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[number]).alias("kind"), s["hit"].alias("hit")),
        )

    found = (_long_enough(match_spans(text, ASSIGN)), match_spans(text, ACCESS), match_spans(text, HEX))
    return F.array_sort(F.concat(*[told(spans, i) for i, spans in enumerate(found)]))


def _codes(run: Column) -> Column:
    return F.transform(F.split(run, ""), F.ascii)


def _pairs(run: Column) -> Column:
    """Each character with the next, as one number."""
    return let(_codes(run), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * 128 + b))


def random_part(span: Column) -> Column:
    """What of a pattern's match is the random string."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["hit"], ASSIGN, 2)).otherwise(span["hit"])


def train(rows: DataFrame, text: str, spans: str) -> list[float] | None:
    """log(random / ordinary) of each pair of characters, from texts and the spans of their patterns."""
    # A text without its matches: each is one blank.
    plain = F.reduce(F.array(*[F.lit(p) for p in (ASSIGN, ACCESS, HEX)]), F.col(text), lambda t, p: F.regexp_replace(t, p, F.lit(" ")))
    plain = F.when(F.size(spans) > 0, plain).otherwise(F.col(text))
    ordinary = F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))
    random = F.transform(spans, random_part)
    samples = F.concat(F.transform(ordinary, lambda r: F.struct(F.lit(False).alias("random"), r.alias("run"))), F.transform(random, lambda r: F.struct(F.lit(True).alias("random"), r.alias("run"))))
    pairs = rows.select(F.explode(samples).alias("s")).select("s.random", F.explode(_pairs(F.col("s.run"))).alias("pair"))
    # At most 2 x 128 x 128 rows, for each task too.
    counts = {True: [0] * 16384, False: [0] * 16384}
    for row in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["random"]][row["pair"]] = row["n"]
    if not any(counts[True]) or not any(counts[False]):
        return None
    after = {kind: [sum(n[c::128]) for c in range(128)] for kind, n in counts.items()}
    used = sum(any(n[c] for n in after.values()) for c in range(128))
    ratio = []
    for a, b in (divmod(pair, 128) for pair in range(16384)):
        p, q = (
            (n[a * 128 + b] + BACKED * (after[kind][b] + SMOOTH) / (sum(after[kind]) + SMOOTH * used)) / (sum(n[a * 128 : a * 128 + 128]) + BACKED)
            for kind, n in sorted(counts.items(), reverse=True)
        )
        ratio.append(math.log(p / q))
    return ratio


def random_spans(text: Column, base: Column, ratio: list[float], threshold: float) -> Column:
    """Stretches of runs outside ``base`` whose pairs are likelier in random strings by more than ``threshold`` nats."""
    # A constant: folded into one array when the plan is made.
    table = F.split(F.lit(",".join(f"{r:.6g}" for r in ratio)), ",").cast("array<double>")

    stretches = "array<struct<from:int,to:int>>"
    least = LEAST_RUN - 1  # pairs

    def told(s: Column) -> Column:
        return F.when(s["best"] > threshold, F.concat(s["told"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))).otherwise(s["told"])

    def state(at, begun, sum, behind, low, low_at, best, start, to, told) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip((at, begun, sum, behind, low, low_at, best, start, to, told), ("at", "begun", "sum", "behind", "low", "low_at", "best", "from", "to", "told"), strict=True)])

    def step(s: Column, v: Column) -> Column:
        """One pair more: the least sum that lies ``least`` pairs or more behind it begins the best stretch that ends here."""
        at, total, behind = s["at"] + 1, s["sum"] + v["pair"], s["behind"] + v["behind"]
        lower = (at - least >= s["begun"]) & (behind < s["low"])
        low, low_at = F.when(lower, behind).otherwise(s["low"]), F.when(lower, at - least).otherwise(s["low_at"])
        better = total - low > s["best"]
        over = (s["best"] > threshold) & (total <= s["low"])
        more = state(at, s["begun"], total, behind, low, low_at, F.when(better, total - low).otherwise(s["best"]), F.when(better, low_at).otherwise(s["from"]), F.when(better, at).otherwise(s["to"]), s["told"])
        again = state(at, at, total, behind, F.lit(float("inf")), at, F.lit(0.0), at, at, told(s))
        return F.when(over, again).otherwise(more)

    def best(run: Column) -> Column:
        ratios = F.transform(_pairs(run), lambda pair: F.coalesce(F.get(table, pair), F.lit(0.0)))
        none, zero = F.lit(0), F.lit(0.0)
        first = state(none, none, zero, zero, F.lit(float("inf")), none, zero, none, none, F.array().cast(stretches))
        # The sum before the stretch at its latest: 0 until there are as many pairs.
        pairs = let(ratios, lambda r: F.zip_with(r, F.concat(F.array_repeat(zero, least), r), lambda a, b: F.struct(a.alias("pair"), b.alias("behind"))))
        pairs = F.filter(pairs, lambda v: v["pair"].isNotNull())
        return F.aggregate(pairs, first, step, told)

    def between(r: Column) -> Column:
        """What the patterns' matches leave of a run, on all sides of them."""
        within = F.filter(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        gap = lambda start, end: F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        first = F.struct(r["start"].cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("gaps"))
        gaps = F.aggregate(
            within,
            first,
            lambda s, b: F.struct(F.greatest(s["at"], b["end"].cast("bigint")).alias("at"), F.concat(s["gaps"], gap(s["at"], b["start"])).alias("gaps")),
            lambda s: F.concat(s["gaps"], gap(s["at"], r["end"])),
        )
        long = F.filter(gaps, lambda g: g["end"] - g["start"] >= LEAST_RUN)
        part = lambda g: F.substring(r["hit"], (g["start"] - r["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))
        return F.transform(long, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), part(g).alias("hit")))

    apart = F.flatten(F.transform(match_spans(text, RUN), between))

    def cut(r: Column) -> Column:
        start, end = (lambda s: r["start"] + s["from"]), (lambda s: r["start"] + s["to"] + 1)
        return F.transform(best(r["hit"]), lambda s: F.struct(start(s).alias("start"), end(s).alias("end"), F.substring(r["hit"], s["from"] + 1, s["to"] - s["from"] + 1).alias("hit")))

    return F.flatten(F.transform(apart, cut))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, base, extra): arrays of spans by pattern and by the models, one row for each of ``df``."""
    text = whole_text(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    ratio = train(rows.withColumn("spans", pattern_spans(F.col("text"))), "text", "spans")
    rows = rows.withColumn("base", pattern_spans(F.col("text")))
    if ratio is None:
        extra = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    else:
        extra = random_spans(F.col("text"), F.col("base"), ratio, threshold)
    return rows.select(F.col("id").alias(id_col), "base", extra.alias("extra"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the pattern spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    extra = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[3]).alias("kind"), s["hit"].alias("hit")))
    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", extra))).alias("spans"),
    )
