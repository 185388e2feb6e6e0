"""Date shifting by whole days, for strptime-style formats, without a UDF.

A format becomes one pattern with a group per directive. Only the calendar day
moves; the time of day is rendered back from the matched fields, so the session
time zone never matters.
"""

from __future__ import annotations

import re
from datetime import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.binding import let

# What each supported directive accepts.
_ACCEPTS = {
    "Y": r"[0-9]{4}",
    "y": r"[0-9]{2}",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "d": r"3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]",
    "j": r"36[0-6]|3[0-5][0-9]|[12][0-9]{2}|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9]",
    "H": r"2[0-3]|[01][0-9]|[0-9]",
    "I": r"1[0-2]|0[1-9]|[1-9]",
    "M": r"[0-5][0-9]|[0-9]",
    "S": r"[0-5][0-9]|[0-9]",
    "f": r"[0-9]{1,6}",
    "p": r"am|pm",
    "z": r"[+-][0-9]{2}:?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]{1,6})?)?|(?-i:Z)",
    "u": r"[1-7]",
    "w": r"[0-6]",
}
MARK = "\x01"

# English month names.
_MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
# English week-day names, Monday first.
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@dataclass(frozen=True)
class DateFormat:
    source: str
    pattern: str
    fields: tuple[str, ...]
    pieces: tuple[tuple[str, str], ...]  # ("text", literal) or ("field", directive)

    @property
    def keeps_time(self) -> bool:
        return any(f in self.fields for f in "HMSf")


def compile_format(source: str) -> DateFormat:
    pattern, fields, pieces = "", [], []
    for m in re.finditer(r"%(.)|\s+|.", source, re.DOTALL):
        directive = m[1]
        if m.group() == MARK:
            raise ValueError(f"control character in date format {source!r}")
        if directive is None or directive == "%":
            text = "%" if directive else m.group()
            pattern += r"\s+" if text.isspace() else re.sub(r"([\\.^$*+?{}\[\]|()-])", r"\\\1", text)
            pieces.append(("text", text))
            continue
        if directive in "bBaA":
            # A week-day's name, like its number, tells nothing that the date does not; it is written anew.
            names = [n[:3] if directive in "ab" else n for n in (_MONTHS if directive in "bB" else _DAYS)]
            accepts = "|".join(sorted(names, key=len, reverse=True))
        elif directive in _ACCEPTS:
            accepts = _ACCEPTS[directive]
        else:
            raise ValueError(f"unsupported date directive %{directive} in {source!r}")
        if directive in fields:
            raise ValueError(f"directive %{directive} is repeated in {source!r}")
        fields.append(directive)
        pieces.append(("field", directive))
        pattern += f"({accepts})"
    if {"H", "I"} <= set(fields) or {"Y", "y"} <= set(fields) or len({"m", "b", "B"} & set(fields)) > 1:
        raise ValueError(f"conflicting directives in {source!r}")
    pieces = _with_iso_days(pieces)
    # First way to match from the left, then it must end: no second try.
    return DateFormat(source, rf"(?iUd)\A(?>{pattern})\z", tuple(fields), tuple(pieces))


def is_native_format(source: str) -> bool:
    """Whether ``compile_format`` knows the format; one that Python does not take either is an error."""
    try:
        compile_format(source)
        return True
    except ValueError as reason:
        try:
            datetime.strptime("", source)
        except ValueError as exc:
            if "directive" in str(exc) or "stray %" in str(exc) or "redefinition" in str(exc):
                raise ValueError(f"no date format: {source!r}") from reason
        except re.error:
            raise ValueError(f"no date format: {source!r}") from reason
        return False


def _with_iso_days(pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``%Y-%m-%d`` as one piece: Spark writes it without any padding of parts."""
    iso = [("field", "Y"), ("text", "-"), ("field", "m"), ("text", "-"), ("field", "d")]
    for i in range(len(pieces) - len(iso) + 1):
        if pieces[i : i + len(iso)] == iso:
            return [*pieces[:i], ("field", "iso"), *pieces[i + len(iso) :]]
    return pieces


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _offset(text: Column) -> Column:
    """An offset as Python writes it, ``+HHMM`` with seconds and fraction where there are any; NULL for one it refuses."""
    digits = F.translate(F.substring_index(F.substring(text, 2, 20), ".", 1), ":", "")
    fraction = F.when(F.contains(text, F.lit(".")), F.rpad(F.substring_index(text, ".", -1), 6, "0")).otherwise("000000")
    seconds = F.rpad(F.substring(digits, 5, 2), 2, "0")
    # Seconds are set apart as minutes are, and an offset is less than a day.
    even = F.rlike(text, F.lit(r"\A(?:Z|[+-](?:[01][0-9]|2[0-3])(?:[0-9]{2}(?:[0-9]{2}.*)?|:[0-9]{2}(?::[0-9]{2}.*)?))\z"))
    fine = F.when(fraction != "000000", F.concat(seconds, F.lit("."), fraction)).when(seconds != "00", seconds).otherwise("")
    none = (text == "Z") | ((F.substring(digits, 1, 4) == "0000") & (fine == ""))
    written = F.when(none, F.lit("+0000")).otherwise(F.concat(F.substring(text, 1, 1), F.substring(digits, 1, 4), fine))
    return F.when(even, written)


def _month_number(text: Column, short: bool) -> Column:
    prefix = F.lower(F.substring(text, 1, 3))
    return F.array_position(F.array(*[F.lit(n[:3].lower()) for n in _MONTHS]), prefix)


def shift_with_format(raw: Column, fmt: DateFormat, days: Column) -> Column:
    """``raw`` moved by ``days`` in the same format; NULL when it does not parse."""
    # One pass of the pattern sets the fields apart. It cannot match a text that
    # starts with the mark, so a marked result tells that it did match.
    template = "".join(f"{MARK}${i}" for i in range(1, len(fmt.fields) + 1)) or MARK
    marked = F.regexp_replace(raw, F.lit(fmt.pattern), F.lit(template))
    matched = ~F.startswith(raw, F.lit(MARK))
    fields = let(marked, lambda m: F.when(matched & F.startswith(m, F.lit(MARK)), F.split(m, MARK, -1)))
    return let(fields, lambda parts: F.when(parts.isNotNull(), _shifted_fields(parts, fmt, days)))


def _shifted_fields(parts: Column, fmt: DateFormat, days: Column) -> Column:
    def field(name: str) -> Column | None:
        return F.get(parts, F.lit(fmt.fields.index(name) + 1)) if name in fmt.fields else None

    def number(name: str, default: int) -> Column:
        found = field(name)
        return F.lit(default) if found is None else F.trim(found).cast("int")

    if "y" in fmt.fields:
        short = number("y", 0)
        year = F.when(short >= 69, short + 1900).otherwise(short + 2000)
    else:
        year = number("Y", 1900)
    month = number("m", 1)
    for name in ("b", "B"):
        if name in fmt.fields:
            month = _month_number(field(name), name == "b")
    padded_year = F.lpad(year.cast("string"), 4, "0")
    if "j" in fmt.fields:
        new_year = F.concat(padded_year, F.lit("-01-01")).try_cast("date")
        day = F.date_add(new_year, number("j", 1) - 1)
    else:
        day = F.concat_ws("-", padded_year, _two(month), _two(number("d", 1))).try_cast("date")

    def render(moved: Column) -> Column:
        hour = F.lit(0)
        minute, second, fraction = F.lit("00"), F.lit("00"), F.lit("000000")
        if fmt.keeps_time:
            if "I" in fmt.fields:
                half = F.lower(field("p")) if "p" in fmt.fields else F.lit("am")
                hour = number("I", 12) % 12 + F.when(half == "pm", 12).otherwise(0)
            else:
                hour = number("H", 0)
            minute, second = _two(number("M", 0)), _two(number("S", 0))
            if "f" in fmt.fields:
                fraction = F.rpad(field("f"), 6, "0")
        twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
        names = F.array(*[F.lit(n) for n in _MONTHS])
        month_name = F.element_at(names, F.month(moved))
        day_name = F.element_at(F.array(*[F.lit(n) for n in _DAYS]), F.weekday(moved) + 1)
        rendered = {
            "Y": lambda: F.lpad(F.year(moved).cast("string"), 4, "0"),
            "y": lambda: _two(F.year(moved) % 100),
            "m": lambda: _two(F.month(moved)),
            "d": lambda: _two(F.day(moved)),
            "j": lambda: F.lpad(F.dayofyear(moved).cast("string"), 3, "0"),
            "b": lambda: F.substring(month_name, 1, 3),
            "B": lambda: month_name,
            "H": lambda: _two(hour),
            "I": lambda: _two(twelve),
            "M": lambda: minute,
            "S": lambda: second,
            "f": lambda: fraction,
            "p": lambda: F.when(hour >= 12, F.lit("PM")).otherwise(F.lit("AM")),
            "z": lambda: let(field("z"), _offset),
            "a": lambda: F.substring(day_name, 1, 3),
            "A": lambda: day_name,
            "u": lambda: (F.weekday(moved) + 1).cast("string"),
            "w": lambda: ((F.weekday(moved) + 1) % 7).cast("string"),
            "iso": lambda: moved.cast("string"),
        }
        return F.concat(*[F.lit(t) if kind == "text" else rendered[t]() for kind, t in fmt.pieces])

    # Years outside 1..9999 cannot be written back; such a match stays as it is.
    in_range = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")

    def shifted(parsed: Column) -> Column:
        moved = F.date_add(parsed, days)
        return let(moved, lambda d: F.when(d.between(*in_range), render(d)))

    return let(day, lambda d: F.when(d >= in_range[0], shifted(d)))


def days_from_hash(raw: Column, salt: str, key: str, max_shift: int) -> Column:
    """A fixed number of days in [-max_shift, max_shift] per (salt, rule, value)."""
    if max_shift == 0:
        return F.lit(0)
    digest = F.sha2(F.concat(F.lit(f"{salt}:{key}:"), raw), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (number % (2 * max_shift + 1) - max_shift).cast("int")
