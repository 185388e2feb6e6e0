"""Parts of file names: suffixes, safety, extensions, stand-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.binding import let

# Characters no component may hold.
INVALID_CHARS = r'[<>:"/\\|?*\x00-\x1F]'
# Device names no component may be called.
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{port}{i}" for port in ("COM", "LPT") for i in range(1, 10)))
MAX_LENGTH = 200
OUTER_BLANKS = r"(?U)\A\s+|\s+\z"
# Leading dots belong to the stem; a trailing dot means there are no suffixes.
SUFFIXES = r"(?s)\A\.*[^.]+(\..*[^.])\z"


def suffixes_of(name: Column) -> Column:
    """All suffixes joined (``.tar.gz``), or the empty string."""
    return F.regexp_extract(name, SUFFIXES, 1)


def stem_of(name: Column) -> Column:
    return let(suffixes_of(name), lambda ext: F.substring(name, F.lit(1), F.length(name) - F.length(ext)))


def sanitised_extension(ext: Column) -> Column:
    """Bad characters become ``_``, trailing blanks and dots go, the leading dot stays."""
    cleaned = F.regexp_replace(F.regexp_replace(ext, INVALID_CHARS, "_"), r"[ .]+\z", "")
    return let(
        cleaned,
        lambda c: F.when((c == "") | F.startswith(c, F.lit(".")), c).otherwise(
            F.concat(F.lit("."), F.regexp_replace(c, r"\A\.+", ""))
        ),
    )


def is_safe_component(name: Column) -> Column:
    """Usable as a file or folder name on common systems."""
    base = F.upper(F.substring_index(name, ".", 1))
    return F.coalesce(
        (name != "")
        & ~name.isin(".", "..")
        & ~F.rlike(name, F.lit(OUTER_BLANKS))
        & ~F.rlike(name, F.lit(INVALID_CHARS))
        & ~F.endswith(name, F.lit("."))
        & (F.length(name) <= MAX_LENGTH)
        & ~base.isin(*DEVICE_NAMES),
        F.lit(False),
    )


def stand_in(prefix: str, source: Column, salt: str) -> Column:
    """``d_`` or ``f_`` and 16 digits of the salted hash."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), source), 256)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 16))


def retry_name(name: Column, source: Column, attempt: Column) -> Column:
    """The name to try at ``attempt``: as it is (0), with a hash of the path (1), then counted (2, 3, ...)."""
    digest = F.substring(F.sha1(source), 1, 8)
    count = F.when(attempt >= 2, F.concat(F.lit("__"), attempt.cast("string"))).otherwise("")

    def marked(stem: Column) -> Column:
        return F.concat(F.when(stem == "", F.lit("item")).otherwise(stem), F.lit("__"), digest, count, suffixes_of(name))

    full = marked(stem_of(name))
    bare = F.concat(F.lit("item__"), digest, count, suffixes_of(name))
    tried = let(full, lambda f: F.when(is_safe_component(f), f).otherwise(bare))
    return F.when(attempt == 0, name).otherwise(tried)
