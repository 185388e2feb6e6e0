"""Applying an ordered rule list to a text column."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.actions import rewrite, runs_on_jvm, triggered
from maskloom.functions.binding import Step, fold, let
from maskloom.functions.dialect import translate
from maskloom.functions.pyrewrite import python_step
from maskloom.functions.triggers import may_fire
from maskloom.operators.spans import with_changed_spans
from maskloom.rules import Rule, active_rules


# Lists from this length on are searched for all triggers at once, and in blocks.
LONG_LIST, BLOCK = 24, 32


def _text_step(rule: Rule, salt: str) -> Step:
    def step(text: Column) -> Column:
        changed = rewrite(text, rule, salt)
        return F.when(triggered(text, rule), changed).otherwise(text) if rule.trigger else changed

    return step


def _counting_step(place: int, rule: Rule, salt: str) -> Step:
    java = translate(rule.search, rule.flags).java

    def step(state: Column) -> Column:
        text = state["text"]

        def counted(n: Column) -> Column:
            hit = F.lit(place << 32).cast("bigint") + n
            return F.struct(
                F.when(n > 0, rewrite(text, rule, salt)).otherwise(text).alias("text"),
                F.concat(state["hits"], F.array(hit)).alias("hits"),
            )

        # A rule that is not triggered hands the state on as it is.
        return F.when(triggered(text, rule), let(F.regexp_count(text, F.lit(java)), counted)).otherwise(state)

    return step


def matches_of(hit: Column) -> Column:
    return hit.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def total_matches(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda total, hit: total + matches_of(hit))


def _fold_rules(start: Column, rules: Sequence[Rule], steps: Sequence[Step], text_of: Step) -> Column:
    """The steps of a rule list; a long one is skipped, whole or in blocks, where nothing in it can fire."""
    if len(rules) < LONG_LIST:
        return fold(start, steps)

    def block(low: int) -> Step:
        own, guard = steps[low : low + BLOCK], rules[low : low + BLOCK]
        return lambda state: F.when(may_fire(text_of(state), guard), fold(state, own)).otherwise(state)

    blocks = [block(low) for low in range(0, len(rules), BLOCK)]
    return let(start, lambda state: F.when(may_fire(text_of(state), rules), fold(state, blocks)).otherwise(state))


def rewritten_text(text: Column, rules: Sequence[Rule], salt: str = "") -> Column:
    """``text`` after all rules, each on the output of the one before, as one Column."""
    rules = active_rules(rules)
    if not all(runs_on_jvm(rule) for rule in rules):
        raise ValueError("a pattern needs Python's re: use apply_rules on the DataFrame")
    return _fold_rules(text, rules, [_text_step(rule, salt) for rule in rules], lambda state: state)


def _start(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast("array<bigint>").alias("hits"))


def with_state(df: DataFrame, rules: Sequence[Rule], salt: str, text: Column, out: str) -> DataFrame:
    """Add ``out``: the final text and the matches of every triggered rule."""
    df = df.withColumn(out, _start(text))
    for on_jvm, run in groupby(enumerate(active_rules(rules)), key=lambda placed: runs_on_jvm(placed[1])):
        if on_jvm:
            placed = list(run)
            steps = [_counting_step(place, rule, salt) for place, rule in placed]
            # A rule without a trigger is triggered by every line, and that counts here.
            guarded = all(rule.trigger for _, rule in placed)
            own = [rule for _, rule in placed] if guarded else []
            df = df.withColumn(out, _fold_rules(F.col(out), own, steps, lambda state: state["text"]))
        else:
            for place, rule in run:
                df = df.withColumn(out, python_step(F.col(out)["text"], F.col(out)["hits"], place, rule, salt))
    return df


def apply_rules(df: DataFrame, rules: Sequence[Rule], salt: str = "", col: str = "line", out: str = "line_out") -> DataFrame:
    """Add ``out``: the text of ``col`` after all rules. Narrow: no shuffle, batch or stream."""
    current = F.col(col)
    for on_jvm, run in groupby(active_rules(rules), key=runs_on_jvm):
        if on_jvm:
            df = df.withColumn(out, rewritten_text(current, list(run), salt))
        else:
            for rule in run:
                df = df.withColumn(out, python_step(current, F.array().cast("array<bigint>"), 0, rule, salt)["text"])
                current = F.col(out)
        current = F.col(out)
    return df


def rule_trigger(df: DataFrame, rule: Rule, col: str = "line", out: str = "is_triggered") -> DataFrame:
    return df.withColumn(out, F.coalesce(triggered(F.col(col), rule), F.lit(False)))


def rule_stats(df: DataFrame, rules: Sequence[Rule], salt: str = "", col: str = "line", out: str = "line_out") -> DataFrame:
    """Add ``out``, ``n_replacements``, ``triggered`` and ``by_rule`` per row."""
    rules = active_rules(rules)
    keys = F.array(*[F.lit(rule.key) for rule in rules])

    def key_of(hit: Column) -> Column:
        return F.get(keys, F.shiftright(hit, 32).cast("int"))

    def names(hits: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(hits, key_of)))

    def per_rule(matched: Column) -> Column:
        # Rules of the same key add up.
        def entry(name: Column) -> Column:
            own = F.filter(matched, lambda hit: key_of(hit) == name)
            return F.struct(name.alias("key"), total_matches(own).alias("value"))

        return F.map_from_entries(F.transform(names(matched), entry))

    def summary(state: Column) -> Column:
        hits = state["hits"]
        return F.struct(
            state["text"].alias("text"),
            total_matches(hits).alias("n"),
            names(hits).alias("triggered"),
            let(F.filter(hits, lambda hit: matches_of(hit) > 0), per_rule).alias("by_rule"),
        )

    done = with_state(df, rules, salt, F.col(col), "_state").withColumn("_state", let(F.col("_state"), summary))
    return done.select(
        *df.columns,
        F.col("_state.text").alias(out),
        F.col("_state.n").alias("n_replacements"),
        F.col("_state.triggered").alias("triggered"),
        F.col("_state.by_rule").alias("by_rule"),
    )


def rule_totals(stats: DataFrame, path: str = "path") -> DataFrame:
    """Replacements per file and rule, with totals per file and overall (``rollup``)."""
    # An outer explode: the plain one would add a filter that evaluates the rules twice.
    pairs = stats.select(F.col(path), F.explode_outer("by_rule").alias("rule", "n")).where(F.col("rule").isNotNull())
    # Sums per file and rule first: the rollup expands those, not every line's.
    pairs = pairs.groupBy(path, "rule").agg(F.sum("n").alias("n"))
    return (
        pairs.rollup(path, "rule")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def audit_lines(
    df: DataFrame, rules: Sequence[Rule], salt: str = "", col: str = "line", spans: bool = True
) -> DataFrame:
    """Changed lines only, before and after, with the changed spans of the output."""
    if all(runs_on_jvm(rule) for rule in active_rules(rules)):
        # A filter on the result would evaluate the rules twice for every line it keeps.
        kept = let(rewritten_text(F.col(col), rules, salt), lambda after: F.when(after != F.col(col), F.array(after)))
        changed = df.select("*", F.explode(kept).alias("line_out"))
    else:
        changed = apply_rules(df, rules, salt, col).where(F.col(col) != F.col("line_out"))
    return with_changed_spans(changed, rules, salt, col) if spans else changed
