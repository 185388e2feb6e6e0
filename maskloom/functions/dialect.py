"""Rule patterns are written in Python's ``re`` syntax; Spark runs Java's.

``translate`` rewrites the few constructs that differ and pins the flags that
make character classes, ``.``, ``^`` and ``$`` mean the same on both sides.
Anything without a Java equivalent raises ``UntranslatablePattern`` and the rule
then runs on Python's ``re`` inside an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

try:  # exact match-width bounds; absent bounds only cost speed, never results
    from re import _parser as _re_parser
except ImportError:  # pragma: no cover
    _re_parser = None


class UntranslatablePattern(ValueError):
    """The pattern is valid Python but has no equivalent on the JVM."""


_TOKEN = re.compile(
    r"""
      (?P<escape>\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}
                    |0[0-7]{0,2}|[0-3][0-7]{2}|[1-9][0-9]?|.))
    | (?P<charset>\[\^?\]?(?:\\.|[^\]\\])*\])
    | (?P<comment>\(\?\#[^)]*\))
    | (?P<flags>\(\?[aiLmsux]+\))
    | (?P<named_ref>\(\?P=\w+\))
    | (?P<conditional>\(\?\(\w+\))
    | (?P<named_group>\(\?P<\w+>)
    | (?P<plain_group>\(\?(?:<[=!]|[=!:>]|[aiLmsux]*(?:-[imsx]+)?:))
    | (?P<group>\()
    | (?P<close>\))
    | (?P<repeat>(?:[*+?]|\{(?:\d+(?:,\d*)?|,\d*)\})[?+]?)
    | (?P<alternation>\|)
    | (?P<literal>.)
    """,
    re.VERBOSE | re.DOTALL,
)
_UNICODE_SENSITIVE = re.compile(r"\\[wWdDsSbB]")


@dataclass(frozen=True)
class JvmPattern:
    source: str
    java: str
    groups: int
    may_be_empty: bool


@dataclass(frozen=True)
class GroupSplit:
    """One pattern with the text before, in and after a group captured apart."""

    java: str
    before: int | None
    inside: int
    after: int | None
    optional: bool = False  # a match may lack the group; what it holds otherwise is never empty


def _width(pattern: str, flags: int) -> tuple[int, int]:
    if _re_parser is None:  # pragma: no cover
        return 0, 1
    low, high = _re_parser.parse(pattern, flags).getwidth()
    return int(low), int(high)


def _code_point(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def _translate_escape(token: str, in_set: bool) -> str:
    head = token[1]
    if head == "Z":
        return r"\z"
    if head == "v":
        return r"\x0B"
    if head == "b" and in_set:
        return r"\x08"
    if head == "U":
        return _code_point(chr(int(token[2:], 16)))
    if head == "N":
        return _code_point(unicodedata.lookup(token[3:-1]))
    if head == "0" or (len(token) == 4 and token[1:].isdigit()):
        return _code_point(chr(int(token[1:], 8)))
    return token


def _translate_set(token: str) -> str:
    negated = token.startswith("[^")
    body = token[2:-1] if negated else token[1:-1]
    out: list[str] = []
    for part in re.finditer(r"\\(?:x..|u.{4}|U.{8}|N\{[^}]*\}|[0-7]{1,3}|.)|.", body, re.DOTALL):
        text = part.group()
        if text.startswith("\\") and len(text) > 1:
            if text[1].isdigit():
                text = _code_point(chr(int(text[1:], 8)))
            out.append(_translate_escape(text, in_set=True))
        elif text in "[]&^":
            out.append("\\" + text)
        else:
            out.append(text)
    return ("[^" if negated else "[") + "".join(out) + "]"


def _translate_token(kind: str, text: str) -> str:
    if kind == "escape":
        return _translate_escape(text, in_set=False)
    if kind == "charset":
        return _translate_set(text)
    if kind == "comment":
        return ""
    if kind in ("flags", "plain_group") and re.match(r"\(\?[a-zA-Z]*[aLx]", text):
        raise UntranslatablePattern(f"inline flag in {text!r}")
    if kind == "flags":
        kept = text.strip("(?)").replace("u", "")
        return f"(?{kept})" if kept else ""
    if kind == "plain_group":
        return text.replace("u", "")
    if kind == "named_ref":
        return f"\\k<{_java_name(text[4:-1])}>"
    if kind == "named_group":
        return f"(?<{_java_name(text[4:-1])}>"
    if kind == "conditional":
        raise UntranslatablePattern("conditional group")
    if kind == "repeat":
        return text.replace("{,", "{0,")
    if kind == "literal" and text == "{":
        return r"\{"
    return text


def _java_name(name: str) -> str:
    if not name.isascii() or "_" in name:
        raise UntranslatablePattern(f"group name {name!r}")
    return name


def _tokens(pattern: str) -> list[tuple[str, str]]:
    return [(m.lastgroup or "literal", m.group()) for m in _TOKEN.finditer(pattern)]


def _prefix(pattern: str, flags: int) -> str:
    letters = "d"
    if flags & re.IGNORECASE or _UNICODE_SENSITIVE.search(pattern) or "(?i" in pattern:
        letters += "U"
    if flags & re.IGNORECASE:
        letters += "i"
    if flags & re.MULTILINE:
        letters += "m"
    if flags & re.DOTALL:
        letters += "s"
    return f"(?{letters})"


def translate(pattern: str, flags: int = 0) -> JvmPattern:
    compiled = re.compile(pattern, flags)
    if flags & (re.ASCII | re.VERBOSE | re.LOCALE):
        raise UntranslatablePattern("ASCII, VERBOSE and LOCALE flags")
    body = "".join(_translate_token(kind, text) for kind, text in _tokens(pattern))
    return JvmPattern(
        source=pattern,
        java=_prefix(pattern, flags) + body,
        groups=compiled.groups,
        may_be_empty=_width(pattern, flags)[0] == 0,
    )


def split_at_group(pattern: str, group: int, flags: int = 0) -> GroupSplit:
    """Rewrite ``before(group)after`` as ``(before)(group)(after)``.

    Works when the group is a direct, unrepeated part of the pattern, so that it
    takes part in every match and its neighbours are plain concatenations.
    """
    translate(pattern, flags)  # raises for constructs the JVM lacks
    tokens = _tokens(pattern)
    if any(k == "named_ref" or (k == "escape" and t[1] in "123456789" and len(t) < 4) for k, t in tokens):
        raise UntranslatablePattern("back-reference next to a group action")

    depth = opened = 0
    start = end = None
    nested_first: int | None = None
    for i, (kind, _) in enumerate(tokens):
        if kind in ("group", "named_group"):
            opened += 1
            if opened == group:
                if depth:
                    raise UntranslatablePattern("nested group")
                start = i
        if kind in ("group", "named_group", "plain_group", "conditional"):
            depth += 1
        elif kind == "close":
            depth -= 1
            if start is not None and end is None and depth == 0:
                end, nested_first = i, opened
        elif kind == "alternation" and depth == 0:
            raise UntranslatablePattern("alternation around a group")
    if start is None or end is None or nested_first is None:
        raise ValueError(f"pattern has no group {group}")
    if end + 1 < len(tokens) and tokens[end + 1][0] == "repeat":
        raise UntranslatablePattern("repeated group")

    lead = ""
    body_start = 0
    while body_start < len(tokens) and tokens[body_start][0] in ("flags", "comment"):
        lead += _translate_token(*tokens[body_start])
        body_start += 1

    def piece(part: list[tuple[str, str]]) -> tuple[str, bool]:
        source = "".join(t for _, t in part)
        java = "".join(_translate_token(k, t) for k, t in part)
        return java, bool(source) and _width(source, flags)[1] > 0

    before, before_visible = piece(tokens[body_start:start])
    inside, _ = piece(tokens[start : end + 1])
    after, after_visible = piece(tokens[end + 1 :])
    return GroupSplit(
        java=f"{_prefix(pattern, flags)}{lead}({before}){inside}({after})",
        before=1 if before_visible else None,
        inside=group + 1,
        after=nested_first + 2 if after_visible else None,
    )


def split_off(pattern: str, group: int, flags: int = 0) -> GroupSplit:
    """``split_at_group``, also for a group that is optional, repeated or within others.

    Brackets around it that neither repeat nor choose are dropped, since captures are
    all they do. An optional group stays so between its neighbours. Of a group with
    ``+`` whose repeats are equally wide, all but the last belong to what is before it.
    """
    try:
        return split_at_group(pattern, group, flags)
    except UntranslatablePattern:
        pass
    translate(pattern, flags)
    tokens = _tokens(pattern)
    if any(k == "named_ref" or (k == "escape" and t[1] in "123456789" and len(t) < 4) for k, t in tokens):
        raise UntranslatablePattern("back-reference next to a group action")

    captures, opens = ("group", "named_group"), ("group", "named_group", "plain_group", "conditional")
    closed: dict[int, int] = {}
    choosing: set[int | None] = set()  # brackets, or the whole, that an alternation parts
    open_now: list[int] = []
    target, number = None, 0
    for i, (kind, _) in enumerate(tokens):
        if kind in opens:
            open_now.append(i)
            number += kind in captures
            if kind in captures and number == group:
                target, around = i, list(open_now[:-1])
        elif kind == "close":
            closed[open_now.pop()] = i
        elif kind == "alternation":
            choosing.add(open_now[-1] if open_now else None)
    if target is None:
        raise ValueError(f"pattern has no group {group}")
    repeated = lambda close: close + 1 < len(tokens) and tokens[close + 1][0] == "repeat"
    for i in around:
        if not (tokens[i][0] in captures or tokens[i][1] == "(?:") or repeated(closed[i]):
            raise UntranslatablePattern("group within a repeated or looking group")
    if choosing & {None, *around}:
        raise UntranslatablePattern("alternation around a group")

    dropped = {*around, *(closed[i] for i in around)}
    rest = lambda low, high: [tokens[i] for i in range(low, high) if i not in dropped]
    end = closed[target]
    repeat = tokens[end + 1][1] if repeated(end) else ""
    lead_end = 0
    while tokens[lead_end][0] in ("flags", "comment"):
        lead_end += 1
    before, inside, after = rest(lead_end, target), rest(target, end + 1), rest(end + 1 + bool(repeat), len(tokens))
    java = lambda part: "".join(_translate_token(k, t) for k, t in part)
    width = lambda part: _width("".join(t for _, t in part), flags) if part else (0, 0)
    held = lambda part: sum(k in captures for k, _ in part)

    narrow, wide = width(inside)
    earlier, own = java(before), java(inside)
    if repeat in ("?", "??", "?+") and narrow:
        own += repeat
    elif repeat == "+" and narrow == wide > 0 and held(inside) == 1:
        earlier += f"(?:{java(inside[1:-1])})*"
    elif repeat:
        raise UntranslatablePattern("repeated group")
    first = held(before) + 2
    return GroupSplit(
        java=f"{_prefix(pattern, flags)}{java(tokens[:lead_end])}({earlier}){own}({java(after)})",
        before=1 if width(before)[1] or repeat == "+" else None,
        inside=first,
        after=first + held(inside) if width(after)[1] else None,
        optional=repeat.startswith("?"),
    )


# Escapes a replacement template may contain.
_TEMPLATE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\"}
_TEMPLATE = re.compile(r"\\g<(?P<name>\w+)>|\\(?P<number>0[0-7]{0,2}|[0-3][0-7]{2}|[1-9][0-9]?)|\\(?P<escape>.)|(?P<char>.)", re.DOTALL)


def translate_template(template: str, pattern: str, flags: int = 0) -> str:
    """Replacement template: ``\\1`` and ``\\g<name>`` become ``$n``; the rest is literal."""
    compiled = re.compile(pattern, flags)
    out: list[str] = []
    after_reference = False

    def literal(text: str) -> None:
        for char in text:
            guard = char in "\\$" or (after_reference and len(out) and out[-1].startswith("$") and char.isdigit())
            out.append("\\" + char if guard else char)

    for m in _TEMPLATE.finditer(template):
        number = m["number"]
        if m["name"] is not None or (number and number[0] != "0" and len(number) < 3):
            name = m["name"] or number
            index = int(name) if name.isdigit() else compiled.groupindex.get(name, -1)
            if not 0 <= index <= compiled.groups:
                raise ValueError(f"replacement refers to unknown group {name!r}")
            out.append(f"${index}")
            after_reference = True
            continue
        if number:
            literal(chr(int(number, 8)))
        elif m["escape"] is not None:
            escape = m["escape"]
            if escape in _TEMPLATE_ESCAPES:
                literal(_TEMPLATE_ESCAPES[escape])
            elif escape.isascii() and escape.isalpha():
                raise ValueError(f"bad escape \\{escape} in replacement")
            else:
                literal("\\" + escape)
        else:
            literal(m["char"])
        after_reference = False
    if template.endswith("\\") and not template.endswith("\\\\"):
        raise ValueError("replacement ends in a lone backslash")
    return "".join(out)
