"""One search for many triggers.

The triggers of a long rule list are merged into one pattern, a tree of their common
beginnings in which a character chooses its branch by halves. A line that holds none
of them is left as it is by every rule: no rule fires first, so none writes anything
that another could fire on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.dialect import UntranslatablePattern, translate
from maskloom.rules import Rule

# The characters that an atom of a trigger stands for.
Atom = frozenset[str]
_WIDE = 6  # branches that are tried one after the other


def _atoms(trigger: str, case_sensitive: bool) -> list[Atom]:
    """A trigger's characters; in any case they are those that lower to the same ones.

    Besides A-Z, the Kelvin sign lowers to k, and the dotted capital I to an i with a
    combining dot: it can only end a trigger.
    """
    if case_sensitive:
        return [frozenset(char) for char in trigger]
    lower = trigger.lower()
    more = {"k": "K"}
    found = [frozenset({char, char.upper()} | set(more.get(char, ""))) for char in lower]
    if lower.endswith("i"):
        found[-1] |= {"İ"}
    return found


def _class(chars: Iterable[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(char):x}}}" for char in sorted(chars)) + "]"


def _branches(tree: dict[Atom, dict]) -> str:
    """A pattern of the tree's paths; an empty tree ends a trigger and needs nothing more."""
    if not tree:
        return ""
    atoms = sorted(tree, key=lambda atom: min(atom))

    def choice(part: Sequence[Atom]) -> str:
        if len(part) <= _WIDE:
            return "|".join(_class(atom) + (f"(?:{_branches(tree[atom])})" if tree[atom] else "") for atom in part)
        halves = part[: len(part) // 2], part[len(part) // 2 :]
        return "|".join(f"(?={_class(set().union(*half))})(?:{choice(half)})" for half in halves)

    return choice(atoms)


def trigger_pattern(rules: Sequence[Rule]) -> str | None:
    """A pattern that finds any of the rules' triggers, as far as it holds them."""
    tree: dict[Atom, dict] = {}
    ends: set[tuple[Atom, ...]] = set()
    for rule in sorted(filter(_in_pattern, rules), key=lambda rule: len(rule.trigger)):
        atoms = tuple(_atoms(rule.trigger, rule.case_sensitive))
        # A shorter trigger that begins this one finds it too.
        if any(atoms[:n] in ends for n in range(1, len(atoms) + 1)):
            continue
        ends.add(atoms)
        node = tree
        for atom in atoms:
            node = node.setdefault(atom, {})
    return _branches(tree) or None


def _in_pattern(rule: Rule) -> bool:
    return bool(rule.trigger) and (rule.case_sensitive or rule.trigger.isascii())


def may_fire(text: Column, rules: Sequence[Rule]) -> Column | None:
    """Whether any rule may change the text or is triggered by it; None where that needs as much work as the rules."""
    found: list[Column] = []
    pattern = trigger_pattern(rules)
    if pattern:
        found.append(F.rlike(text, F.lit(pattern)))
    lowered = sorted({rule.trigger.lower() for rule in rules if rule.trigger and not _in_pattern(rule)})
    if lowered:
        found.append(F.exists(F.array(*map(F.lit, lowered)), lambda trigger: F.contains(F.lower(text), trigger)))
    for rule in rules:
        if not rule.trigger:
            try:
                found.append(F.rlike(text, F.lit(translate(rule.search, rule.flags).java)))
            except UntranslatablePattern:
                return None
    result = found[0]
    for one in found[1:]:
        result = result | one
    return result
