"""Directory trees as files and lines; lines as a published table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.globs import DEFAULT_EXCLUDES
from maskloom.functions.text import decode_text, is_text
from maskloom.operators.apply import apply_rules
from maskloom.operators.documents import documents_to_lines
from maskloom.operators.files import ANONYMISE
from maskloom.rules import Rule
from maskloom.sources.lines import dispositions, excluded_below, lines_of
from maskloom.sources.publish import attempt, resolve, write_manifest
from maskloom.sources.trees import catalogue, is_local, list_files, local_path, with_content


def read_files(spark: SparkSession, path: str, bundle: str | None = None, complete: bool = True) -> DataFrame:
    """(bundle, rel_path, length, content) of all files at or below ``path``.

    ``rel_path`` starts below the root. ``content`` is only read where a later step
    uses it. ``complete`` adds the empty and hidden files Spark's file source passes
    over, and drops what it reaches through symbolic links.
    """
    root, single = qualified(spark, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring("path", F.lit(root.rfind("/") + 2 if single else len(root) + 2), F.length("path"))
    files = found.select(below.alias("rel_path"), "length", "content")
    if complete and not single:
        listed = list_files(spark, root)
        passed_over = listed.join(files.select("rel_path"), "rel_path", "left_anti")
        if is_local(root):
            files = files.join(listed.select("rel_path"), "rel_path", "left_semi")
        files = files.unionByName(with_content(passed_over, root))
    name = root.rsplit("/", 1)[-1] if bundle is None else bundle
    return files.select(F.lit(name).alias("bundle"), "rel_path", "length", "content")


def qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path as Spark's sources spell it, and whether it is a single file."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(location):
        raise FileNotFoundError(path)
    return store.makeQualified(location).toString(), store.getFileStatus(location).isFile()


def lines_of_files(files: DataFrame, keep: Sequence[str] = ("bundle", "rel_path")) -> DataFrame:
    """Lines of the text files among (keep..., content)."""
    texts = files.where(is_text(F.col("content"))).select(*keep, decode_text(F.col("content")).alias("text"))
    return documents_to_lines(texts, "text", keep)


def read_lines(spark: SparkSession, path: str, exclude: Iterable[str] = (), defaults: bool = False) -> DataFrame:
    """(bundle, rel_path, line_no, line, eol) of a directory tree or a single file; files may have any size."""
    root, single = qualified(spark, path)
    exclude = list(exclude)
    found = dispositions(catalogue(spark, [(root.rsplit("/", 1)[-1], root)]), exclude, defaults=defaults)
    texts = found.where(F.col("disposition") == ANONYMISE)
    plain = local_path(root) if is_local(root) else root
    patterns = [*(DEFAULT_EXCLUDES if defaults else ()), *exclude]
    excluded = None if single else excluded_below([plain], patterns)
    return lines_of(spark, texts, [root], excluded)


def read_large_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line, eol) of the text files below ``path``."""
    root, single = qualified(spark, path)
    folder = root.rsplit("/", 1)[0] if single else root
    return read_lines(spark, path).select(F.concat(F.lit(f"{folder}/"), "rel_path").alias("path"), "line_no", "line", "eol")


LINES = "rel_path string, line_no bigint, line string, eol string, bundle string"


def write_anonymised(
    lines: DataFrame,
    rules: Sequence[Rule],
    target: str,
    salt: str = "",
    passthrough: DataFrame | None = None,
    partitions: int | None = None,
    replace: bool = False,
) -> None:
    """Rewrite lines and publish them and the untouched files at ``target``, in whole or not at all.

    An output that is there already is an error unless it is to be replaced.
    """
    spark = lines.sparkSession
    with attempt(spark, target, replace) as folder:
        write_parts(lines, rules, folder, salt, passthrough, partitions)
        seal(spark, folder, ["lines", *(["files"] if passthrough is not None else [])])


def write_parts(
    lines: DataFrame, rules: Sequence[Rule], folder: str, salt: str = "", passthrough: DataFrame | None = None, partitions: int | None = None
) -> None:
    """The parts ``lines`` and ``files`` of an output below ``folder``.

    The tasks that hold the lines write them, sorted by path, in one folder per
    bundle; a file's lines lie together as they were read. ``partitions`` deals them
    out anew by (bundle, rel_path, line_no) first, where they do not or where
    readers of a few large bundles wrote many small files.
    """
    order = ["bundle", "rel_path", "line_no"]
    kept = lines.select(*order, "line", "eol")
    # Range partitioning samples its input, so the rules run after it, not twice.
    placed = kept.repartitionByRange(partitions, *order) if partitions else kept
    done = apply_rules(placed.sortWithinPartitions(*order), rules, salt, "line", "line")
    done.write.mode("errorifexists").partitionBy("bundle").parquet(f"{folder}/lines")
    if passthrough is not None:
        # Contents are written by the tasks that read them: moving them would gain nothing.
        order = ["bundle", "rel_path", *(["piece_no"] if "piece_no" in passthrough.columns else [])]
        files = passthrough.select(*order, "content").sortWithinPartitions(*order)
        files.write.mode("errorifexists").parquet(f"{folder}/files")


def seal(spark: SparkSession, folder: str, parts: Sequence[str]) -> DataFrame:
    """The manifest of an attempt, with a table of its parts; nothing is written after it."""
    spark.createDataFrame([(part,) for part in parts], "part string").coalesce(1).write.parquet(f"{folder}/complete")
    return write_manifest(spark, folder, list(parts))


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """(bundle, rel_path, line_no, line, eol) of a whole output; bundle names stay text, whatever they look like."""
    return spark.read.schema(LINES).parquet(f"{resolve(spark, target)}/lines").select("bundle", "rel_path", "line_no", "line", "eol")
