"""Rules whose pattern has no JVM equivalent, run batch by batch through Arrow."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.rules import Bucketize, DateShift, Mask, Redact, Replace, Rule, SecureHash

# ``hits`` has one number per triggered rule: its place in the list * 2^32 + its matches.
STATE = "struct<text:string,hits:array<bigint>>"


def _masked(raw: str, action: Mask) -> str:
    hidden = len(raw) - action.keep_first - action.keep_last
    return raw if hidden <= 0 else raw[: action.keep_first] + action.mask_char * hidden + raw[len(raw) - action.keep_last :]


def _digest(*parts: str) -> str:
    return hashlib.sha256(":".join(parts).encode("utf-8", "replace")).hexdigest()


def _bucketed(raw: str, action: Bucketize) -> str:
    try:
        number = float(raw)
    except ValueError:
        return raw
    return next((b.label for b in action.buckets if b.min <= number <= b.max), action.fallback_label)


def _shifted(raw: str, action: DateShift, salt: str, key: str) -> str:
    span = 2 * action.max_shift_days + 1
    days = int(_digest(salt, key, raw)[:8], 16) % span - action.max_shift_days
    for fmt in action.formats:
        try:
            moment = datetime.strptime(raw, fmt)
        except ValueError:
            continue
        if not any(t in fmt for t in ("%H", "%M", "%S", "%f")):
            moment = moment.replace(hour=0)
        try:
            return (moment + timedelta(days=days)).strftime(fmt)
        except OverflowError:
            return raw
    return raw


def match_writer(rule: Rule, salt: str) -> Callable[[re.Match], str]:
    action = rule.action
    own_salt = getattr(action, "salt", None)
    own_salt = salt if own_salt is None else own_salt

    def value(raw: str) -> str:
        match action:
            case Mask():
                return _masked(raw, action)
            case SecureHash():
                return f"{action.prefix}{_digest(own_salt, raw)[: action.length]}{action.suffix}"
            case Bucketize():
                return _bucketed(raw, action)
            case DateShift():
                return _shifted(raw, action, own_salt, rule.key)
        raise TypeError(f"{type(action).__name__} needs a pattern that runs on the JVM")

    def write(m: re.Match) -> str:
        if isinstance(action, Redact):
            return ""
        if isinstance(action, Replace):
            return m.expand(action.value)
        low, high = m.span(action.group)
        if low == high:  # unmatched or empty group: nothing to rewrite
            return m.group()
        whole, base = m.group(), m.start()
        return whole[: low - base] + value(m.group(action.group)) + whole[high - base :]

    return write


def python_step(text: Column, hits: Column, place: int, rule: Rule, salt: str) -> Column:
    """State after one rule."""

    @F.pandas_udf(STATE)
    def step(lines: pd.Series, counts: pd.Series) -> pd.DataFrame:
        pattern = re.compile(rule.search, rule.flags)
        write = match_writer(rule, salt)
        texts, hits = [], []
        for text, before in zip(lines, counts):
            hit = [] if before is None else [int(n) for n in before]
            if text is not None:
                line, word = (text, rule.trigger) if rule.case_sensitive else (text.lower(), rule.trigger.lower())
                if word in line:
                    text, count = pattern.subn(write, text)
                    hit.append((place << 32) + count)
            texts.append(text)
            hits.append(hit)
        return pd.DataFrame({"text": texts, "hits": hits})

    # Read twice and marked non-deterministic, so that the optimizer leaves the
    # lambdas below and above in projections of their own: a UDF cannot take or be
    # part of nested lambdas.
    return step.asNondeterministic()(F.when(text.isNotNull(), text), hits)
