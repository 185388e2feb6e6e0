"""Bytes and text: telling text from binary, decoding, cutting into lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.binding import let

SNIFF_BYTES = 8192
LINE_BREAK = r"\r\n|\n|\r"

# Leading bytes of PDF, PNG, JPEG, GIF (two), ZIP, gzip, Parquet and Avro files.
SIGNATURES = (
    b"%PDF-",
    b"\x89PNG\r\n\x1a\n",
    b"\xff\xd8\xff",
    b"GIF87a",
    b"GIF89a",
    b"PK\x03\x04",
    b"\x1f\x8b",
    b"PAR1",
    b"Obj\x01",
)
# Control bytes other than tab, line feed, form feed and carriage return.
SUSPICIOUS = r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]"


def is_text(content: Column) -> Column:
    """Whether the first 8 KB look like text: no known signature, no NUL, few control bytes."""

    def decide(head: Column) -> Column:
        signed = reduce(lambda a, b: a | b, [F.startswith(head, F.lit(bytearray(s))) for s in SIGNATURES])
        has_nul = F.contains(head, F.lit(bytearray(b"\x00")))
        control = F.regexp_count(F.decode(head, "ISO-8859-1"), F.lit(SUSPICIOUS))
        return F.when(F.octet_length(head) == 0, True).otherwise(
            ~signed & ~has_nul & ~(control.cast("double") / F.octet_length(head) > 0.30)
        )

    return let(F.substring(content, 1, SNIFF_BYTES), decide)


def decode_text(content: Column) -> Column:
    """UTF-8 if all of it is valid, else Latin-1, decided on the whole value."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def line_structs(text: Column) -> Column:
    """array<struct<line, eol>>: a final line break does not open another line."""
    # Most text breaks at line feeds only, which needs no pattern.
    return F.when(F.contains(text, F.lit("\r")), _lines_of_any_break(text)).otherwise(_lines_of_feeds(text))


def _line(line: Column, eol: Column) -> Column:
    return F.struct(line.alias("line"), eol.alias("eol"))


def _lines_of_feeds(text: Column) -> Column:
    def lines(pieces: Column) -> Column:
        feeds = F.size(pieces) - 1
        kept = F.when(text == "", F.array().cast("array<string>")).when(
            F.endswith(text, F.lit("\n")), F.slice(pieces, F.lit(1), feeds)
        ).otherwise(pieces)
        return F.transform(kept, lambda line, i: _line(line, F.when(i < feeds, F.lit("\n")).otherwise(F.lit(""))))

    return let(F.split(text, "\n", -1), lines)


def _lines_of_any_break(text: Column) -> Column:
    breaks = F.regexp_extract_all(text, F.lit(LINE_BREAK), F.lit(0))
    pairs = F.zip_with(
        F.split(text, LINE_BREAK, -1), breaks, lambda line, eol: _line(line, F.coalesce(eol, F.lit("")))
    )
    return F.filter(pairs, lambda p: (p["line"] != "") | (p["eol"] != ""))
