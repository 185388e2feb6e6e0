"""Detectors of sensitive data: a line in, masked findings out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.binding import let
from maskloom.functions.masking import matched_card, matched_email, matched_ipv4, matched_token

# What the detectors look for.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
BEARER = r"(?iU)\bBearer\s+([A-Za-z0-9._-]{10,})\b"
KV_SECRET = r"(?iU)\b(api[_-]?key|token|secret|password)\s*=\s*([^\s\"']{8,})\b"
PROBABLE_TOKEN = r"(?U)\b[A-Za-z0-9+/=_-]{24,}\b"
CARD = r"(?U)\b(?:\d[ -]*?){13,19}\b"

FINDINGS = "array<struct<det_no:int,pos:int,detector:string,kind:string,masked_example:string>>"


def _extract(line: Column, pattern: str, group: int, guard: Column | None = None) -> Column:
    """All matches; a cheap guard keeps the pattern away from lines that cannot match."""
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
    return found if guard is None else F.when(guard, found)


def _has_digit(line: Column) -> Column:
    return F.rlike(line, F.lit(r"(?U)\d"))


def emails(line: Column) -> Column:
    return F.transform(_extract(line, EMAIL, 0, F.contains(line, F.lit("@"))), matched_email)


def ipv4s(line: Column) -> Column:
    return F.transform(_extract(line, IPV4, 0, _has_digit(line)), matched_ipv4)


def bearer_tokens(line: Column) -> Column:
    # A pattern finds the word in any case faster than lower-casing the line does.
    found = _extract(line, BEARER, 1, F.rlike(line, F.lit("(?i)bearer")))
    return F.transform(found, lambda token: F.concat(F.lit("Bearer "), matched_token(token)))


def kv_secrets(line: Column) -> Column:
    """The key never holds '=' or blanks, so the whole match splits back exactly."""

    def masked(hit: Column) -> Column:
        parts = F.split(hit, r"(?U)\s*=\s*", 2)
        return let(parts, lambda kv: F.concat(kv[0], F.lit("="), let(kv[1], matched_token)))

    return F.transform(_extract(line, KV_SECRET, 0, F.contains(line, F.lit("="))), masked)


def probable_tokens(line: Column) -> Column:
    mixed = lambda token: F.rlike(token, F.lit("[A-Za-z]")) & F.rlike(token, F.lit("[0-9]"))
    return F.transform(F.filter(_extract(line, PROBABLE_TOKEN, 0, _has_digit(line)), mixed), matched_token)


def card_numbers(line: Column) -> Column:
    digits = F.transform(_extract(line, CARD, 0, _has_digit(line)), lambda hit: F.regexp_replace(hit, r"[^0-9]", ""))
    return F.transform(F.filter(digits, lambda d: F.call_function("luhn_check", d)), matched_card)


@dataclass(frozen=True)
class Detector:
    """``find`` maps a line to its masked examples, in order."""

    name: str
    kind: str
    find: Callable[[Column], Column]


DETECTORS = (
    Detector("email", "email", emails),
    Detector("ipv4", "ipv4", ipv4s),
    Detector("token", "bearer_token", bearer_tokens),
    Detector("token", "kv_secret", kv_secrets),
    Detector("token", "probable_token", probable_tokens),
    Detector("card", "card_number", card_numbers),
)
DEFAULT_NAMES = ("email", "ipv4", "token", "card")


def select_detectors(names: Iterable[str] = DEFAULT_NAMES, extra: Iterable[Detector] = ()) -> list[Detector]:
    """Detectors of the given names in the given order; an unknown name fails."""
    pool = [*DETECTORS, *extra]
    chosen: list[Detector] = []
    for name in names:
        found = [d for d in pool if d.name == name]
        if not found:
            raise ValueError(f"unknown detector {name!r}")
        chosen += found
    return chosen


def findings(line: Column, detectors: Iterable[Detector]) -> Column:
    """array<struct<det_no, pos, detector, kind, masked_example>> of one line."""

    def entries(number: int, d: Detector) -> Column:
        return F.transform(
            d.find(line),
            lambda example, pos: F.struct(
                F.lit(number).alias("det_no"),
                pos.alias("pos"),
                F.lit(d.name).alias("detector"),
                F.lit(d.kind).alias("kind"),
                example.alias("masked_example"),
            ),
        )

    parts = [F.coalesce(entries(number, d), F.array().cast(FINDINGS)) for number, d in enumerate(detectors)]
    return F.concat(*parts)


def detections(
    df: DataFrame,
    names: Iterable[str] = DEFAULT_NAMES,
    col: str = "line",
    keep: Iterable[str] = ("path", "line_no"),
    extra: Iterable[Detector] = (),
) -> DataFrame:
    """One row per finding. The raw value stops here: only the masked example leaves."""
    found = df.select(*keep, F.explode(findings(F.col(col), select_detectors(names, extra))).alias("f"))
    return found.select(*keep, "f.*")
