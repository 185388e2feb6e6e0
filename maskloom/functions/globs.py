"""Shell-style patterns over paths. ``*`` also crosses ``/``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns for key and credential files, excluded before any user pattern.
DEFAULT_EXCLUDES = (
    "creds.localjceks",
    "creds.localjceks.sha",
    "*.jceks",
    "*.jceks.sha",
    "*.keytab",
    "krb5.conf",
    "jaas.conf",
    "*.jks",
    "*keystore*",
    "*truststore*",
    "*.p12",
    "*.pfx",
    "*.pem",
    "*.key",
    "*.crt",
    "*.cer",
    "*.der",
    "*.kdb",
)


def pattern_lines(text: str) -> list[str]:
    """Patterns from the lines of an exclude file; blanks and ``#`` lines do not count."""
    stripped = (line.strip() for line in text.splitlines())
    return [line for line in stripped if line and not line.startswith("#")]


def _java_set(body: str) -> str:
    negated = body.startswith("!")
    members = body[1:] if negated else body
    ranges = []
    i = 0
    while i < len(members):
        if i + 2 < len(members) and members[i + 1] == "-":
            low, high = members[i], members[i + 2]
            if low <= high:  # an empty range matches nothing
                ranges.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
            i += 3
        else:
            ranges.append(f"\\x{{{ord(members[i]):x}}}")
            i += 1
    if not ranges:
        return "." if negated else "(?!)"
    return ("[^" if negated else "[") + "".join(ranges) + "]"


def glob_to_java(glob: str) -> str:
    """Unanchored Java pattern of one glob."""
    out = []
    for m in re.finditer(r"\[(!?\]?[^\]]*)\]|\*+|\?|.", glob, re.DOTALL):
        text = m.group()
        if m[1]:
            out.append(_java_set(m[1]))
        elif text[0] == "*":
            out.append(".*")
        elif text == "?":
            out.append(".")
        else:
            out.append(re.sub(r"([\\.^$*+?{}\[\]|()-])", r"\\\1", text))
    return "".join(out)


def _any_matches(path: Column, globs: Sequence[str], case_insensitive: bool) -> Column:
    """Whether a glob fully matches ``/path``, ``path`` or its last component."""
    rooted = F.concat(F.lit("/"), path)
    tests: list[Column] = []
    general: list[str] = []
    literal = [] if case_insensitive else [g for g in globs if not re.search(r"[*?\[]", g)]
    if literal:
        tests += [rooted.isin(literal), path.isin(literal), F.substring_index(path, "/", -1).isin(literal)]
    for glob in globs:
        tail = glob[1:]
        if glob in literal:
            continue
        plain_tail = not re.search(r"[*?\[]", tail)
        if case_insensitive or not (glob.startswith("*") and tail):
            general.append(glob)
        elif plain_tail:
            tests.append(F.endswith(rooted, F.lit(tail)))
        elif tail.endswith("*") and not re.search(r"[*?\[]", tail[:-1]) and len(tail) > 1:
            tests.append(F.contains(rooted, F.lit(tail[:-1])))
        else:
            general.append(glob)
    if general:
        flags = "(?siu)" if case_insensitive else "(?s)"
        union = "|".join(glob_to_java(g) for g in general)
        whole = F.lit(rf"{flags}\A/?(?:{union})\z")
        # "/?" covers the path with and without its root.
        tests += [F.rlike(rooted, whole), F.rlike(F.substring_index(path, "/", -1), whole)]
    return reduce(lambda a, b: a | b, tests)


def is_excluded(path: Column, patterns: Iterable[str], case_insensitive: bool = False) -> Column:
    """Ordered patterns, the last match wins, ``!`` takes a path back in.

    Neighbours of the same sign become one test, so a long list stays a short
    expression and needs no join.
    """
    clean = [p.strip() for p in patterns if p and p.strip()]
    signed = [(p.startswith("!"), p.removeprefix("!")) for p in clean]
    signed = [(negated, glob) for negated, glob in signed if glob]
    runs = [(negated, [g for _, g in run]) for negated, run in groupby(signed, key=lambda s: s[0])]
    verdicts = [
        F.when(_any_matches(path, globs, case_insensitive), F.lit(not negated)) for negated, globs in reversed(runs)
    ]
    return F.coalesce(*verdicts, F.lit(False))
