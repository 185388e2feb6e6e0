"""Masked examples: what a report may show of a sensitive value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.binding import let

OUTER_BLANKS = r"(?U)\A\s+|\s+\z"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, F.lit(OUTER_BLANKS), F.lit(""))


def mask_email(value: Column) -> Column:
    """``j***@domain``; ``[EMAIL]`` without @ or domain, ``***@domain`` without local part."""

    def masked(v: Column) -> Column:
        local = strip(F.substring_index(v, "@", 1))
        domain = strip(F.substring(v, F.instr(v, "@") + 1, F.length(v)))
        return F.when(~F.contains(v, F.lit("@")) | (domain == ""), F.lit("[EMAIL]")).otherwise(
            F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)
        )

    return let(strip(value), masked)


def mask_ipv4(value: Column) -> Column:
    """``a.***.***.d``; anything that is not four groups of one to three digits is ``[IP]``."""
    four = r"(?U)\A(\d{1,3})\.\d{1,3}\.\d{1,3}\.(\d{1,3})\z"
    return let(strip(value), lambda v: F.when(F.rlike(v, F.lit(four)), matched_ipv4(v)).otherwise(F.lit("[IP]")))


def mask_token(value: Column) -> Column:
    """First three and last four characters; short values vanish."""
    return let(strip(value), matched_token)


def mask_card(value: Column) -> Column:
    """The last four digits."""
    return let(
        F.regexp_replace(value, r"[^0-9]", ""),
        lambda d: F.when(F.length(d) < 4, F.lit("****")).otherwise(matched_card(d)),
    )


# The same masks for values a detector has just matched: no outer blanks, right shape.


def matched_email(email: Column) -> Column:
    return F.concat(F.substring(email, 1, 1), F.lit("***@"), F.substring_index(email, "@", -1))


def matched_ipv4(address: Column) -> Column:
    return F.concat(F.substring_index(address, ".", 1), F.lit(".***.***."), F.substring_index(address, ".", -1))


def matched_token(token: Column) -> Column:
    return F.when(F.length(token) <= 8, F.lit("***")).otherwise(
        F.concat(F.substring(token, 1, 3), F.lit("-***"), F.right(token, F.lit(4)))
    )


def matched_card(digits: Column) -> Column:
    return F.concat(F.lit("**** **** **** "), F.right(digits, F.lit(4)))
