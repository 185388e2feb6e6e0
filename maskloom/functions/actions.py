"""One Column builder per rule action, plus the rewrite of matches inside a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.binding import let
from maskloom.functions.dates import compile_format, days_from_hash, is_native_format, shift_with_format
from maskloom.functions.dialect import UntranslatablePattern, split_off, translate, translate_template
from maskloom.rules import Bucketize, Compute, DateShift, Mask, Redact, Replace, Rule, SecureHash

ColumnFn = Callable[[Column], Column]

# Fixed value: texts read as a number (underscores between digits, inf, nan, outer blanks).
NUMBER_TEXT = (
    r"(?iU)\A\s*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)\s*\z"
)


def mask_value(action: Mask) -> ColumnFn:
    kept = action.keep_first + action.keep_last

    def masked(raw: Column) -> Column:
        middle = F.repeat(F.lit(action.mask_char), F.length(raw) - kept)
        parts = [middle]
        if action.keep_first:
            parts.insert(0, F.substring(raw, 1, action.keep_first))
        if action.keep_last:
            parts.append(F.right(raw, F.lit(action.keep_last)))
        return F.when(F.length(raw) <= kept, raw).otherwise(F.concat(*parts))

    return masked


def hash_value(action: SecureHash, salt: str) -> ColumnFn:
    own = salt if action.salt is None else action.salt

    def hashed(raw: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{own}:"), raw), 256)
        return F.concat(F.lit(action.prefix), F.substring(digest, 1, action.length), F.lit(action.suffix))

    return hashed


def date_value(action: DateShift, salt: str, key: str) -> ColumnFn:
    own = salt if action.salt is None else action.salt
    formats = [compile_format(f) for f in action.formats]

    def moved(raw: Column) -> Column:
        days = days_from_hash(raw, own, key, action.max_shift_days)
        # A format that parses decides, even if the shifted day cannot be written.
        tries = [shift_with_format(raw, fmt, days) for fmt in formats]
        return F.coalesce(*tries, raw)

    return moved


def bucket_value(action: Bucketize) -> ColumnFn:
    def bucketed(raw: Column) -> Column:
        number = F.when(
            F.rlike(raw, F.lit(NUMBER_TEXT)), F.regexp_replace(F.trim(raw), "_", "").try_cast("double")
        )

        def label(value: Column) -> Column:
            chosen = F.lit(action.fallback_label)
            for b in reversed(action.buckets):
                chosen = F.when(value.between(F.lit(b.min), F.lit(b.max)), F.lit(b.label)).otherwise(chosen)
            return F.when(value.isNull(), raw).otherwise(chosen)

        return let(number, label)

    return bucketed


def value_of(rule: Rule, salt: str) -> ColumnFn:
    """The computed replacement of one matched text."""
    match rule.action:
        case Mask():
            return mask_value(rule.action)
        case SecureHash():
            return hash_value(rule.action, salt)
        case DateShift():
            return date_value(rule.action, salt, rule.key)
        case Bucketize():
            return bucket_value(rule.action)
        case Compute():
            return rule.action.value
    raise TypeError(f"{type(rule.action).__name__} has no computed value")


def _weave(gaps: Column, values: Column) -> Column:
    """gap0 value0 gap1 value1 ... gapN; ``concat_ws`` skips the missing last value."""
    return F.concat_ws("", F.flatten(F.zip_with(gaps, values, lambda gap, value: F.array(gap, value))))


def rewrite_matches(text: Column, java: str, value: ColumnFn) -> Column:
    """Replace every match by ``value(match)``; the pattern never matches empty."""
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    return let(
        found,
        lambda hits: F.when(
            F.size(hits) > 0, _weave(F.split(text, java, -1), F.transform(hits, value))
        ).otherwise(text),
    )


def rewrite_groups(text: Column, rule: Rule, value: ColumnFn) -> Column:
    """Replace one group inside every match and keep the rest of the match."""
    cut = split_off(rule.search, rule.action.group, rule.flags)

    def part(index: int) -> Column:
        return F.regexp_extract_all(text, F.lit(cut.java), F.lit(index))

    def own(held: Column) -> Column:
        # Without the group, the match stays as it is.
        return F.when(held == "", held).otherwise(value(held)) if cut.optional else value(held)

    def body(inside: Column) -> Column:
        values = F.transform(inside, own)
        if cut.before is not None:
            values = F.zip_with(part(cut.before), values, lambda a, b: F.concat(a, b))
        if cut.after is not None:
            values = F.zip_with(values, part(cut.after), lambda a, b: F.concat(a, b))
        return F.when(F.size(inside) > 0, _weave(F.split(text, cut.java, -1), values)).otherwise(text)

    return let(part(cut.inside), body)


def runs_on_jvm(rule: Rule) -> bool:
    """Whether built-in functions express the rule exactly; else Python's ``re`` and ``strptime`` do."""
    try:
        pattern = translate(rule.search, rule.flags)
        if isinstance(rule.action, (Replace, Redact)):
            return True
        if isinstance(rule.action, DateShift) and not all(map(is_native_format, rule.action.formats)):
            return False
        if rule.action.group:
            split_off(rule.search, rule.action.group, rule.flags)
        return not pattern.may_be_empty
    except UntranslatablePattern:
        return False


def rewrite(text: Column, rule: Rule, salt: str) -> Column:
    """The rule's action on a line, its trigger aside."""
    pattern = translate(rule.search, rule.flags)
    match rule.action:
        case Redact():
            return F.regexp_replace(text, F.lit(pattern.java), F.lit(""))
        case Replace():
            template = translate_template(rule.action.value, rule.search, rule.flags)
            return F.regexp_replace(text, F.lit(pattern.java), F.lit(template))
    if rule.action.group:
        return rewrite_groups(text, rule, value_of(rule, salt))
    return rewrite_matches(text, pattern.java, value_of(rule, salt))


def _any_case(trigger: str) -> str:
    """Pattern of an ASCII word in any case, as lower-casing both sides would find it.

    Besides A-Z, only the Kelvin sign and the dotted capital I lower to ASCII letters,
    the latter to an ``i`` and a combining dot: it can only end the word.
    """
    letters = []
    for i, char in enumerate(trigger.lower()):
        if char == "k":
            letters.append("[kK\\u212A]")
        elif char == "i" and i == len(trigger) - 1:
            letters.append("[iI\\u0130]")
        else:
            letters.append(char if char.isalnum() else f"\\x{ord(char):02x}")
    return "(?i)" + "".join(letters)


def triggered(text: Column, rule: Rule) -> Column:
    """The guard, tested on the text as the earlier rules left it."""
    if not rule.enabled:
        return F.lit(False)
    if not rule.trigger:
        return text.isNotNull()
    if rule.case_sensitive:
        return F.contains(text, F.lit(rule.trigger))
    if rule.trigger.isascii():
        return F.rlike(text, F.lit(_any_case(rule.trigger)))
    return F.contains(F.lower(text), F.lit(rule.trigger.lower()))
