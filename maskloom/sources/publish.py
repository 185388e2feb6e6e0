"""Outputs that are there in whole or not at all.

An output is written to an attempt, a hidden folder beside its target. Its manifest
names every part file with its rows, the bytes of its text and a checksum, and is
written last. One rename makes the attempt the target. A run that ends before it
leaves only an attempt behind, which no reader looks at, and an output it was to
replace stays readable all the while: it is moved aside just before the rename, and
readers that find no target in between take it from there. ``recover`` finishes or
undoes what such a run left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT, ASIDE = ".attempt-", ".replaced-"
MANIFEST = "part string, path string, bundle string, rows bigint, text_bytes bigint, checksum bigint"


class NotPublished(FileNotFoundError):
    """There is no whole output at this place."""


def _hadoop(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _exists(spark: SparkSession, path: str) -> bool:
    store, location = _hadoop(spark, path)
    return store.exists(location)


def _delete(spark: SparkSession, path: str) -> None:
    store, location = _hadoop(spark, path)
    store.delete(location, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """An atomic rename that never lands on or in something that is there."""
    jvm = spark._jvm
    _, location = _hadoop(spark, old)
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    strict = jvm.java.lang.reflect.Array.newInstance(kind, 0)  # no option to overwrite
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(location.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(location, jvm.org.apache.hadoop.fs.Path(new), strict)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Puts ``old`` in the place of ``new``, within an attempt that nobody reads yet."""
    _delete(spark, new)
    _rename(spark, old, new)


def _siblings(spark: SparkSession, target: str, mark: str) -> list[str]:
    """The attempts at, or earlier outputs of, one target; the latest last."""
    store, location = _hadoop(spark, target)
    if not store.exists(location.getParent()):
        return []
    start = f".{location.getName()}{mark}"
    found = [s for s in store.listStatus(location.getParent()) if s.getPath().getName().startswith(start)]
    return [s.getPath().toString() for s in sorted(found, key=lambda s: s.getModificationTime())]


def _beside(spark: SparkSession, target: str, mark: str) -> str:
    _, location = _hadoop(spark, target)
    parent = location.getParent().toString().rstrip("/")
    return f"{parent}/.{location.getName()}{mark}{uuid.uuid4().hex}"


def row_sum(*columns: Column) -> Column:
    """A number of 32 bits from the row's text; the sum over rows does not depend on their order."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _told(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """The manifest's rows of one part, counted from what lies in its files."""
    written = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/{part}")
    file = F.regexp_extract(F.col("_metadata.file_path"), f"/({part}/.*)$", 1)
    # Binary columns are counted, not summed up as text.
    columns = [F.col(c) for c, kind in written.dtypes if kind != "binary"]
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in written.dtypes if kind in ("string", "binary")]
    rows = written.select(file.alias("path"), sum(sizes, F.lit(0).cast("bigint")).alias("size"), row_sum(*columns).alias("code"))
    counted = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").cast("bigint").alias("text_bytes"), F.sum("code").alias("checksum")
    )
    plain = F.col("path")
    for _ in range(2):  # the folder's own escapes within the location's
        plain = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    bundle = F.nullif(F.regexp_extract(plain, r"(?s)^[^/]*/bundle=(.*)/[^/]*$", 1), F.lit(""))
    return counted.select(F.lit(part).alias("part"), "path", bundle.alias("bundle"), "rows", "text_bytes", "checksum")


def write_manifest(spark: SparkSession, folder: str, parts: list[str]) -> DataFrame:
    told = spark.createDataFrame([], MANIFEST)
    for part in parts:
        told = told.unionByName(_told(spark, folder, part))
    told.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


@contextmanager
def attempt(spark: SparkSession, target: str, replace: bool = False) -> Iterator[str]:
    """A folder to write parts into, which becomes ``target`` when the block ends well; it must hold its manifest then."""
    if _exists(spark, target) and not replace:
        raise FileExistsError(f"published already: {target}")
    folder = _beside(spark, target, ATTEMPT)
    try:
        yield folder
        commit(spark, folder, target, replace)
    except BaseException:
        _delete(spark, folder)
        raise


def commit(spark: SparkSession, folder: str, target: str, replace: bool = False) -> None:
    if not _exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise NotPublished(f"no manifest: {folder}")
    aside = None
    if replace and _exists(spark, target):
        aside = _beside(spark, target, ASIDE)
        _rename(spark, target, aside)
    _rename(spark, folder, target)
    if aside:
        _delete(spark, aside)


def resolve(spark: SparkSession, target: str) -> str:
    """The folder of the whole output: the target, or what is just being replaced by a new one."""
    for folder in [target, *reversed(_siblings(spark, target, ASIDE))]:
        if _exists(spark, f"{folder}/manifest/_SUCCESS"):
            return folder
    raise NotPublished(f"nothing is published at {target}")


def recover(spark: SparkSession, target: str) -> str | None:
    """Puts a place in order after a run that was ended, while no other one writes there.

    An output that was moved aside for one that never came is put back; attempts and
    outputs that were replaced are deleted. Returns the folder of the output, if any.
    """
    aside = _siblings(spark, target, ASIDE)
    if not _exists(spark, target) and aside:
        _rename(spark, aside.pop(), target)
    for folder in [*aside, *_siblings(spark, target, ATTEMPT)]:
        _delete(spark, folder)
    return target if _exists(spark, target) else None


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """(part, path, bundle, rows, text_bytes, checksum) of a whole output, a row a part file."""
    return spark.read.schema(MANIFEST).parquet(f"{resolve(spark, target)}/manifest")


def damages(spark: SparkSession, target: str) -> DataFrame:
    """(part, path, damage): files that are missing, changed or not in the manifest. Empty for a sound output."""
    folder = resolve(spark, target)
    listed = manifest(spark, target)
    parts = [row["part"] for row in listed.select("part").distinct().collect()]  # two or three
    found = spark.createDataFrame([], MANIFEST)
    for part in parts:
        found = found.unionByName(_told(spark, folder, part))
    both = listed.alias("m").join(found.alias("f"), ["part", "path"], "full_outer")
    same = F.lit(True)
    for column in ("rows", "text_bytes", "checksum"):
        same = same & F.col(f"m.{column}").eqNullSafe(F.col(f"f.{column}"))
    damage = F.when(F.col("f.rows").isNull(), F.lit("missing")).when(F.col("m.rows").isNull(), F.lit("not listed")).when(~same, F.lit("changed"))
    return both.select("part", "path", damage.alias("damage")).where("damage IS NOT NULL")
