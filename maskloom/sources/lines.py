"""Lines of text files of any size.

The files are listed, excluded by path, and told text from binary by their first
bytes; only then are contents read. Files of up to ``WHOLE_BYTES`` are read whole by
the tasks they are dealt out to, many to a task; larger ones by Spark's text source,
which splits a file over many tasks. What that source passes over, names that begin
with ``.`` or ``_``, and what it would unpack by its name is read record by record. A
file whose bytes are not all there when it is read is kept apart with an error; the
others go on.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions.globs import DEFAULT_EXCLUDES, is_excluded
from maskloom.functions.text import SNIFF_BYTES, decode_text, is_text, line_structs
from maskloom.operators.files import ANONYMISE, EXCLUDED, FAILED, PASSTHROUGH
from maskloom.sources.scratch import measured, settled
from maskloom.sources.trees import hidden_texts, with_head, with_whole

HIDDEN = r"(^|/)[._]"
# Suffixes that make Spark's text source unpack a file, whatever it holds.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$"
UNREAD = "unreadable: its bytes were not all there when it was read"
# Files of up to so many bytes are read whole: the text source takes one file for as costly as 4 MB, and a task for a few of them.
WHOLE_BYTES = 4 << 20


def dispositions(files: DataFrame, exclude: Iterable[str] = (), any_case: bool = False, defaults: bool = True) -> DataFrame:
    """(bundle, rel_path, location, length, error, open_end, marked, disposition), settled; ``marked`` files begin with a byte-order mark. Excluded files are never opened.

    A file that cannot be opened failed, with an ``error``; a source that cannot be listed has an ``error`` and no disposition.
    """
    patterns = [*(DEFAULT_EXCLUDES if defaults else ()), *exclude]
    out = is_excluded(F.col("rel_path"), patterns, any_case) if patterns else F.lit(False)
    sound = files.where("error IS NULL").withColumn("excluded", out)
    kept = with_head(sound.where(~F.col("excluded")), SNIFF_BYTES)
    by_head = F.when(F.col("error").isNotNull(), F.lit(FAILED)).when(is_text(F.col("head")), F.lit(ANONYMISE)).otherwise(F.lit(PASSTHROUGH))
    columns = ["bundle", "rel_path", "location", "length", "error"]
    mark = F.coalesce(F.startswith("head", F.lit(bytearray(b"\xef\xbb\xbf"))), F.lit(False)).alias("marked")
    told = kept.select(*columns, "open_end", mark, by_head.alias("disposition"))
    unread = (F.lit(False).alias("open_end"), F.lit(False).alias("marked"))
    told = told.unionByName(sound.where("excluded").select(*columns, *unread, F.lit(EXCLUDED).alias("disposition")))
    broken = files.where("error IS NOT NULL").select(*columns, *unread, F.lit(None).cast("string").alias("disposition"))
    return settled(told.unionByName(broken))


def _location() -> Column:
    """A file's plain path from Spark's escaped one."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "/")


def _records(spark: SparkSession, files: DataFrame, roots: Sequence[str], excluded: Column | None) -> DataFrame:
    """(location, block, seq, value) of files above ``WHOLE_BYTES``: what lies between line feeds, in order within a block."""
    passed_over = files.where(F.col("rel_path").rlike(HIDDEN) | F.col("location").rlike(PACKED))
    hidden = hidden_texts(passed_over).withColumn("block", F.lit(0).cast("bigint"))
    if not roots:
        return hidden
    raw = (
        # What cannot be read leaves no record; its bytes are then missed.
        spark.read.options(lineSep="\n", recursiveFileLookup=True, ignoreCorruptFiles=True, ignoreMissingFiles=True).text(list(roots))
        # A filter on path and size alone is applied to the listing: the source does not open what it rules out.
        .where(~_location().rlike(PACKED) & (F.col("_metadata.file_size") > WHOLE_BYTES) & (F.lit(True) if excluded is None else ~excluded))
        .select(
            _location().alias("location"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").cast("binary").alias("value"),
        )
    )
    return raw.join(measured(files.select("location")), "location", "left_semi").unionByName(hidden)


def lines_of_pieces(pieces: DataFrame, keep: Sequence[str] = ("bundle", "rel_path")) -> DataFrame:
    """(keep..., line_no, line, eol) of text files in settled pieces (keep..., piece_no, content) that end at line feeds."""
    text = F.col("content").cast("string")
    parts = line_structs(F.decode("content", "ISO-8859-1"))
    sizes = pieces.select(*keep, "piece_no", F.size(parts).alias("n"), F.is_valid_utf8(text).alias("utf8"))
    whole = Window.partitionBy(*keep)
    before = whole.orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row a piece.
    placed = settled(sizes.select(*keep, "piece_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.bool_and("utf8").over(whole).alias("utf8")))
    decoded = F.when(F.col("utf8"), text).otherwise(F.decode("content", "ISO-8859-1"))
    joined = pieces.join(measured(placed), [*keep, "piece_no"]).select(*keep, "lines_before", F.posexplode(line_structs(decoded)).alias("pos", "part"))
    return joined.select(*keep, (F.col("lines_before") + F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("part.line").alias("line"), F.col("part.eol").alias("eol"))


def excluded_below(roots: Sequence[str], patterns: Sequence[str], any_case: bool = False) -> Column | None:
    """Whether the source's own path, below its root, is excluded."""
    if not patterns:
        return None
    tops = "|".join(f"\\Q{root.rstrip('/')}\\E" for root in sorted(roots, key=len, reverse=True))
    return is_excluded(F.regexp_replace(_location(), f"^(?:{tops})/", ""), patterns, any_case)


@dataclass(frozen=True)
class ReadLines:
    """``lines`` (keep..., line_no, line, eol); ``failed`` (keep..., location, error); ``counts`` (keep..., n_lines) of the files read, settled."""

    lines: DataFrame
    failed: DataFrame
    counts: DataFrame


def lines_of(
    spark: SparkSession, files: DataFrame, roots: Sequence[str], excluded: Column | None = None, keep: Sequence[str] = ("bundle", "rel_path")
) -> DataFrame:
    """(keep..., line_no, line, eol) of the listed files, all of them text, below ``roots``; one that cannot be read is an error."""
    read = read_listed(spark, files, roots, excluded, keep)
    bad = read.failed.first()
    if bad is not None:
        raise OSError(f"{bad['error']}: {bad['location']}")
    return read.lines


def read_listed(
    spark: SparkSession, files: DataFrame, roots: Sequence[str], excluded: Column | None = None, keep: Sequence[str] = ("bundle", "rel_path")
) -> ReadLines:
    """The lines of the listed files, all of them text, below ``roots``, and the files of which bytes are missing.

    ``files`` must be settled. A leading byte-order mark is no part of a line. Lines end at ``\\n``, ``\\r\\n`` or ``\\r``.
    """
    small = _read_whole(files.where(F.col("length") <= WHOLE_BYTES), keep)
    large = files.where(F.col("length") > WHOLE_BYTES)
    if large.isEmpty():
        return small
    split = _read_split(spark, large, roots, excluded, keep)
    return ReadLines(small.lines.unionByName(split.lines), small.failed.unionByName(split.failed), small.counts.unionByName(split.counts))


def _read_whole(files: DataFrame, keep: Sequence[str]) -> ReadLines:
    """Every file in one row: it is opened to be checked, and again where its lines are used."""
    listed = list(dict.fromkeys([*keep, "location"]))
    unmarked = F.when(F.col("marked"), F.substring("content", 4, WHOLE_BYTES)).otherwise(F.col("content"))
    whole = F.coalesce(F.octet_length("content") == F.col("length"), F.lit(False))

    def texts(files: DataFrame) -> DataFrame:
        return with_whole(files.select(*listed, "length", "marked")).select(*listed, whole.alias("sound"), decode_text(unmarked).alias("text"))

    checked = settled(texts(files).select(*listed, F.when(F.col("sound"), F.size(line_structs(F.col("text")))).cast("bigint").alias("n_lines"), "sound"))
    failed = checked.where("NOT sound").select(*listed, F.lit(UNREAD).alias("error"))
    sound = files.join(failed.select("location"), "location", "left_anti")
    told = texts(sound).where("sound").select(*keep, F.posexplode(line_structs(F.col("text"))).alias("pos", "part"))
    lines = told.select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("part.line").alias("line"), F.col("part.eol").alias("eol"))
    return ReadLines(lines, failed, checked.where("sound").select(*keep, "n_lines"))


def _read_split(spark: SparkSession, files: DataFrame, roots: Sequence[str], excluded: Column | None, keep: Sequence[str]) -> ReadLines:
    """Files that are split over many tasks.

    Spark reads the blocks of a file in order, so a record's place follows from the sizes of the
    blocks before it; lone ``\\r`` are counted within those blocks that have any.
    """
    records = _records(spark, files, roots, excluded)
    text = F.col("value").cast("string")
    # The last record of a file ends in a break or not; every other one does.
    inner = F.regexp_count(F.regexp_replace(F.decode("value", "ISO-8859-1"), "\\r\\z", ""), F.lit("\\r"))
    blocks = settled(
        records.groupBy("location", "block").agg(
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.count(F.lit(1)).alias("n_records"),
            F.sum(inner).alias("n_inner"),
            F.bool_and(F.is_valid_utf8(text)).alias("utf8"),
            F.sum((F.octet_length("value") + 1).cast("bigint")).alias("n_bytes"),
        )
    )
    by_file = blocks.groupBy("location").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n_records") + F.col("n_inner")).alias("n_lines"))
    # The last record may lack its line feed, and the source leaves out a byte-order mark.
    beyond = F.coalesce("n_bytes", F.lit(0)) - F.when(F.coalesce("n_lines", F.lit(0)) > 0, F.col("open_end").cast("bigint")).otherwise(0) - F.col("length")
    sound = (beyond == 0) | (F.col("marked") & (beyond == -3))
    listed = list(dict.fromkeys([*keep, "location"]))
    checked = settled(files.select(*listed, "length", "open_end", "marked").join(by_file, "location", "left").select(*listed, "n_lines", sound.alias("sound")))
    files = files.join(checked.where("NOT sound").select("location"), "location", "left_anti")
    in_file = Window.partitionBy("location")
    before = in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        "location",
        "block",
        "first_seq",
        "n_inner",
        F.coalesce(F.sum(F.col("n_records") + F.col("n_inner")).over(before), F.lit(0)).alias("lines_before"),
        (F.max("block").over(in_file) == F.col("block")).alias("last_block"),
        "last_seq",
        F.bool_and("utf8").over(in_file).alias("utf8"),
    )
    named = settled(placed.join(measured(files.select("location", "open_end", *keep)), "location"))
    joined = records.join(measured(named), ["location", "block"])
    content = F.when(F.col("utf8"), text).otherwise(F.decode("value", "ISO-8859-1"))
    ended = F.when((F.col("seq") == F.col("last_seq")) & F.col("last_block") & F.col("open_end"), content).otherwise(F.concat(content, F.lit("\n")))
    columns = [*keep, "location", "block", "seq", "n_inner", "lines_before", "first_seq"]
    parts = joined.select(*columns, inner.alias("own_inner"), line_structs(ended).alias("parts"))
    plain = parts.where("n_inner = 0").withColumn("inner_before", F.lit(0).cast("bigint"))
    earlier = Window.partitionBy("location", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.where("n_inner > 0").withColumn("inner_before", F.coalesce(F.sum("own_inner").over(earlier), F.lit(0)))
    told = plain.unionByName(cut).select("*", F.posexplode("parts").alias("pos", "part"))
    line_no = F.col("lines_before") + F.col("seq") - F.col("first_seq") + F.col("inner_before") + F.col("pos") + 1
    lines = told.select(*keep, line_no.cast("bigint").alias("line_no"), F.col("part.line").alias("line"), F.col("part.eol").alias("eol"))
    failed = checked.where("NOT sound").select(*listed, F.lit(UNREAD).alias("error"))
    counts = checked.where("sound").select(*keep, F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return ReadLines(lines, failed, counts)
