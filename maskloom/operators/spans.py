"""What of a rewritten line its rules have written.

Beside the line runs a string of the same length, ``1`` under every character that a
rule has put there and ``0`` elsewhere. A rule's matches cut both at the same places:
gaps keep their marks, replacements get new ones. The spans are the runs of ``1``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.actions import runs_on_jvm, triggered, value_of
from maskloom.functions.binding import Step, fold, let
from maskloom.functions.dialect import split_at_group, translate, translate_template
from maskloom.functions.pyrewrite import match_writer
from maskloom.functions.spans import match_spans
from maskloom.rules import Redact, Replace, Rule, active_rules

MARKED = "struct<text:string,mark:string>"


def _in_common(a: Column, b: Column) -> Column:
    """How many characters two strings begin with alike."""
    alike = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when((a == "") | (b == ""), F.lit(0).cast("bigint")).otherwise(
        let(F.array_position(alike, F.lit(False)), lambda at: F.when(at > 0, at - 1).otherwise(F.size(alike).cast("bigint")))
    )


def _mark_of(mark: Column, edit: Column) -> Column:
    """Marks of a replacement: what it begins and ends with as the match did is not its own."""

    def trimmed(head: Column) -> Column:
        rest_old = F.substring(edit["hit"], head.cast("int") + 1, F.length(edit["hit"]))
        rest_new = F.substring(edit["value"], head.cast("int") + 1, F.length(edit["value"]))
        return let(_in_common(F.reverse(rest_old), F.reverse(rest_new)), lambda tail: marks(head.cast("int"), tail.cast("int")))

    def marks(head: Column, tail: Column) -> Column:
        return F.concat(
            F.substring(mark, edit["start"].cast("int") + 1, head),
            F.repeat(F.lit("1"), F.length(edit["value"]) - head - tail),
            F.substring(mark, edit["end"].cast("int") - tail + 1, tail),
        )

    return let(_in_common(edit["hit"], edit["value"]), trimmed)


def _apply_edits(state: Column, edits: Column) -> Column:
    """Text and marks after replacing [start, end) by ``value``, edits in order."""
    text, mark = state["text"], state["mark"]
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(edits, lambda e: e["end"]))

    def piece(edit: Column, before: Column) -> Column:
        gap = ((before + 1).cast("int"), (edit["start"] - before).cast("int"))
        return F.struct(
            F.concat(F.substring(text, *gap), edit["value"]).alias("text"), F.concat(F.substring(mark, *gap), _mark_of(mark, edit)).alias("mark")
        )

    def joined(pieces: Column) -> Column:
        last = F.element_at(ends, -1).cast("int") + 1

        def side(name: str, whole: Column) -> Column:
            told = F.array_join(F.transform(pieces, lambda p: p[name]), "")
            return F.concat(told, F.substring(whole, last, F.length(whole))).alias(name)

        return F.struct(side("text", text), side("mark", mark))

    return F.when(F.size(edits) > 0, let(F.zip_with(edits, F.slice(ends, F.lit(1), F.size(edits)), piece), joined)).otherwise(state)


def _template_values(text: Column, java: str, template: str) -> Column:
    """What a replacement template makes of each match."""
    parts: list[Column | str] = []
    for m in re.finditer(r"\$(\d+)|\\(.)|(.)", template, re.DOTALL):
        if m[1]:
            parts.append(F.regexp_extract_all(text, F.lit(java), F.lit(int(m[1]))))
        elif parts and isinstance(parts[-1], str):
            parts[-1] += m[2] or m[3]
        else:
            parts.append(m[2] or m[3])
    hits = F.regexp_extract_all(text, F.lit(java), F.lit(0))

    def same(part: str) -> Column:
        return F.transform(hits, lambda _: F.lit(part))

    none, whole = same(""), [same(p) if isinstance(p, str) else p for p in parts]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), whole, none)


def _edits(text: Column, rule: Rule, salt: str) -> Column:
    def edit(span: Column, value: Column) -> Column:
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["hit"].alias("hit"), value.alias("value"))

    java = translate(rule.search, rule.flags).java
    if isinstance(rule.action, Redact):
        return F.transform(match_spans(text, java), lambda s: edit(s, F.lit("")))
    if isinstance(rule.action, Replace):
        values = _template_values(text, java, translate_template(rule.action.value, rule.search, rule.flags))
        return F.zip_with(match_spans(text, java), values, edit)
    value = value_of(rule, salt)
    if not rule.action.group:
        return F.transform(match_spans(text, java), lambda s: edit(s, value(s["hit"])))
    cut = split_at_group(rule.search, rule.action.group, rule.flags)
    values = F.transform(F.regexp_extract_all(text, F.lit(cut.java), F.lit(cut.inside)), value)
    if cut.before is not None:
        values = F.zip_with(F.regexp_extract_all(text, F.lit(cut.java), F.lit(cut.before)), values, lambda a, b: F.concat(a, b))
    if cut.after is not None:
        values = F.zip_with(values, F.regexp_extract_all(text, F.lit(cut.java), F.lit(cut.after)), lambda a, b: F.concat(a, b))
    return F.zip_with(match_spans(text, cut.java), values, edit)


def _on_jvm(rule: Rule) -> bool:
    return runs_on_jvm(rule) and not translate(rule.search, rule.flags).may_be_empty


def _step(rule: Rule, salt: str) -> Step:
    def step(state: Column) -> Column:
        edited = let(_edits(state["text"], rule, salt), lambda edits: _apply_edits(state, edits))
        return F.when(triggered(state["text"], rule), edited).otherwise(state)

    return step


def _python_step(state: Column, rule: Rule, salt: str) -> Column:
    """The same for a pattern that only Python's ``re`` knows, batch by batch."""

    @F.pandas_udf(MARKED)
    def step(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        pattern, write = re.compile(rule.search, rule.flags), match_writer(rule, salt)
        out: list[tuple[str | None, str | None]] = []
        for text, mark in zip(texts, marks):
            word, line = (rule.trigger, text or "") if rule.case_sensitive else (rule.trigger.lower(), (text or "").lower())
            if text is None or word not in line:
                out.append((text, mark))
                continue
            written, marked, end = [], [], 0
            for m in pattern.finditer(text):
                old, new = m.group(), write(m)
                head = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
                tail = next((i for i, (a, b) in enumerate(zip(old[head:][::-1], new[head:][::-1])) if a != b), min(len(old), len(new)) - head)
                written += [text[end : m.start()], new]
                own = "1" * (len(new) - head - tail)
                marked += [mark[end : m.start()], mark[m.start() : m.start() + head], own, mark[m.end() - tail : m.end()]]
                end = m.end()
            out.append(("".join(written) + text[end:], "".join(marked) + mark[end:]))
        return pd.DataFrame(out, columns=["text", "mark"])

    # A UDF cannot take or be part of nested lambdas; see ``python_step``.
    return step.asNondeterministic()(F.when(state["text"].isNotNull(), state["text"]), F.when(state["mark"].isNotNull(), state["mark"]))


def with_changed_spans(df: DataFrame, rules: Sequence[Rule], salt: str = "", col: str = "line", out: str = "spans") -> DataFrame:
    """Add ``out``: array<struct<start,end>> of the rewritten ``col``, in code points, in order, none touching another.

    A null line has none. Text a rule takes out leaves no span.
    """
    text = F.col(col)
    df = df.withColumn("_marked", F.struct(text.alias("text"), F.repeat(F.lit("0"), F.length(text)).alias("mark")))
    for on_jvm, run in groupby(active_rules(rules), key=_on_jvm):
        if on_jvm:
            df = df.withColumn("_marked", fold(F.col("_marked"), [_step(rule, salt) for rule in run]))
        else:
            for rule in run:
                df = df.withColumn("_marked", _python_step(F.col("_marked"), rule, salt))
    runs = match_spans(F.col("_marked")["mark"], "1+")
    spans = F.transform(runs, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return df.withColumn(out, F.when(text.isNotNull(), spans)).drop("_marked")
