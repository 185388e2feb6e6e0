"""Complete listings of directory trees, and what Spark's sources leave out.

Spark's file sources pass over empty files and names that begin with ``.`` or
``_``, and follow symbolic links on local storage. A listing made by tasks, one
level of folders at a time, knows every regular file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.sources.scratch import settled

ENTRIES = "rel_path string, is_dir boolean, length bigint"
BATCH_ROWS = 10_000
BATCH_BYTES = 16 << 20
OPENED_FILES, OPENED_BYTES = 4096, 64 << 20  # what a task opens and reads, where there are enough tasks


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file:")


def local_path(root: str) -> str:
    return "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root


def _local_entries(root: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    try:
        with os.scandir(os.path.join(root, folder) if folder else root) as found:
            for entry in found:
                if entry.is_symlink():
                    continue
                rel_path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir():
                    yield rel_path, True, 0
                elif entry.is_file():
                    yield rel_path, False, entry.stat().st_size
    except OSError:  # an unreadable folder is left out, like its contents
        return


def _remote_store(root: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    return store, base.rstrip("/")


def _remote_entries(root: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    from pyarrow import fs

    store, base = _remote_store(root)
    for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
        yield info.path[len(base) + 1 :], info.type == fs.FileType.Directory, info.size or 0


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, length) of every regular file below ``root``; links are not followed."""
    local = is_local(root)
    base = local_path(root).rstrip("/") if local else root.rstrip("/")
    entries_of = _local_entries if local else _remote_entries

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, bool, int]] = []
        for batch in batches:
            for folder in batch["rel_path"]:
                for entry in entries_of(base, folder):
                    rows.append(entry)
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=["rel_path", "is_dir", "length"])
                        rows = []
        yield pd.DataFrame(rows, columns=["rel_path", "is_dir", "length"])

    folders = spark.createDataFrame([("",)], "rel_path string")
    levels: list[DataFrame] = []
    while True:  # once per level of the tree
        level = settled(folders.mapInPandas(expand, ENTRIES))
        levels.append(level.where(~F.col("is_dir")).select("rel_path", "length"))
        folders = level.where("is_dir").select("rel_path")
        if folders.isEmpty():
            break
        folders = folders.repartition("rel_path")
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files


def opened(location: str) -> BinaryIO:
    """A readable, seekable file on local or remote storage."""
    if is_local(location):
        return open(local_path(location), "rb")
    store, path = _remote_store(location)
    return store.open_input_file(path)


CATALOGUE = "bundle string, rel_path string, location string, length bigint, error string"
FOUND = f"{CATALOGUE}, is_dir boolean"


def _entries_or_error(root: str, folder: str) -> Iterator[tuple[str, str, bool, int, str | None]]:
    """(rel_path, location, is_dir, length, error) below one folder; a root may be a single file."""
    base = local_path(root).rstrip("/") if is_local(root) else root.rstrip("/")
    try:
        if not folder and is_local(root):
            if os.path.isfile(base):
                yield base.rsplit("/", 1)[-1], base, False, os.path.getsize(base), None
                return
            os.listdir(base)
        for rel_path, is_dir, length in (_local_entries if is_local(root) else _remote_entries)(base, folder):
            yield rel_path, f"{base}/{rel_path}", is_dir, length, None
    except OSError as exc:
        yield folder, base, False, 0, f"unreadable: {type(exc).__name__}"


def catalogue(spark: SparkSession, sources: Iterable[tuple[str, str]]) -> DataFrame:
    """(bundle, rel_path, location, length, error) of every regular file below all (bundle, root), settled.

    Tasks list the folders of all roots together, one level after the other. A root
    that cannot be read is a row with ``error``.
    """
    columns = ["bundle", "rel_path", "location", "length", "error", "is_dir"]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for bundle, root, folder in zip(batch["bundle"], batch["root"], batch["rel_path"]):
                for rel_path, location, is_dir, length, error in _entries_or_error(root, folder):
                    rows.append((bundle, rel_path, location, length, error, is_dir))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    roots = spark.createDataFrame([(bundle, root) for bundle, root in sources], "bundle string, root string")
    folders = roots.withColumn("rel_path", F.lit(""))
    found: DataFrame | None = None
    while True:  # once per level of the trees
        level = settled(folders.repartition("bundle", "rel_path").mapInPandas(expand, FOUND))
        files = level.where(~F.col("is_dir")).drop("is_dir")
        found = files if found is None else found.unionByName(files)
        below = level.where("is_dir").select("bundle", "rel_path")
        if below.isEmpty():
            return settled(found)
        folders = below.join(F.broadcast(roots), "bundle").select("bundle", "root", "rel_path")


def with_head(files: DataFrame, size: int) -> DataFrame:
    """Add ``head``, the first bytes of every listed file, and ``open_end``, whether its last line has no line feed.

    A file that cannot be opened gets an ``error``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told: list[tuple[bytes | None, bool, str | None]] = []
            for location, length in zip(batch["location"], batch["length"]):
                try:
                    with opened(location) as file:
                        head = file.read(size)
                        file.seek(max(0, int(length) - 1))
                        told.append((head, file.read(1) not in (b"", b"\n"), None))
                except OSError as exc:
                    told.append((None, False, f"unreadable: {type(exc).__name__}"))
            heads, ends, errors = zip(*told) if told else ((), (), ())
            yield batch.assign(error=errors, head=heads, open_end=ends)

    columns = ["bundle", "rel_path", "location", "length"]
    return _dealt(files.select(*columns), size).mapInPandas(read, f"{CATALOGUE}, head binary, open_end boolean")


def _dealt(files: DataFrame, most: int) -> DataFrame:
    """Opening is slow and uneven: settled files dealt out by their number and the bytes to read, up to ``most`` of each.

    The rows that name them are too small to tell how many tasks they are worth.
    """
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.least(F.col("length"), F.lit(most))), F.lit(0))).first()
    tasks = max(n // OPENED_FILES, size // OPENED_BYTES, min(n, files.sparkSession.sparkContext.defaultParallelism), 1)
    return files.repartition(int(tasks), "location")


def with_whole(files: DataFrame) -> DataFrame:
    """Add ``content``: all bytes of every listed file, null where it cannot be read. One that grew comes with a byte more than listed."""
    columns = files.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents: list[bytes | None] = []
            start = held = 0
            for location, length in zip(batch["location"], batch["length"]):
                try:
                    with opened(location) as file:
                        contents.append(file.read(int(length) + 1))
                except OSError:
                    contents.append(None)
                held += int(length)
                if held >= BATCH_BYTES:
                    yield batch.iloc[start : start + len(contents)].assign(content=contents)
                    start, held, contents = start + len(contents), 0, []
            yield batch.iloc[start:].assign(content=pd.Series(contents, dtype="object", index=batch.index[start:]))

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    return _dealt(files, 1 << 62).select(*columns).mapInPandas(read, f"{kinds}, content binary")


def pieces(files: DataFrame, size: int = 64 << 20) -> DataFrame:
    """(bundle, rel_path, piece_no, content): whole files of any length in pieces of bounded size, each read by itself.

    A piece that cannot be read, or is shorter than listed, has no content.
    """
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0).cast("bigint"))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                wanted = min(size, row.length - row.piece_no * size)
                try:
                    with opened(row.location) as file:
                        file.seek(row.piece_no * size)
                        content = file.read(size)
                except OSError:
                    content = None
                if content is None or len(content) < wanted:
                    content = None
                yield pd.DataFrame({"bundle": [row.bundle], "rel_path": [row.rel_path], "piece_no": [row.piece_no], "content": [content]})

    dealt = files.select("bundle", "rel_path", "location", "length", number.alias("piece_no")).repartition("location", "piece_no")
    return dealt.mapInPandas(read, "bundle string, rel_path string, piece_no bigint, content binary")


def hidden_texts(files: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(location, value, seq): records between line feeds of files that Spark's sources pass over, as bytes.

    What cannot be read of a file is missing: the caller compares the bytes with the listing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for location in batch["location"]:
                rows, held, seq = [], 0, 0
                try:
                    with opened(location) as file:
                        for record in _records(file):
                            rows.append((location, record.removesuffix(b"\n"), seq))
                            held, seq = held + len(record), seq + 1
                            if held > size:
                                yield pd.DataFrame(rows, columns=["location", "value", "seq"])
                                rows, held = [], 0
                except OSError:
                    pass
                yield pd.DataFrame(rows, columns=["location", "value", "seq"])

    return files.select("location").mapInPandas(read, "location string, value binary, seq bigint")


def _records(file: BinaryIO) -> Iterator[bytes]:
    held = b""
    while chunk := file.read(1 << 20):
        *whole, held = (held + chunk).split(b"\n")
        yield from (record + b"\n" for record in whole)
    if held:
        yield held


def created(location: str) -> BinaryIO:
    """A new file for writing, on local or remote storage."""
    if is_local(location):
        os.makedirs(os.path.dirname(local_path(location)), exist_ok=True)
        return open(local_path(location), "wb")
    store, path = _remote_store(location)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, length, content) of listed files, read by the tasks that hold their rows."""
    base = root.rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["rel_path", "length", "content"]
        rows: list[tuple[str, int, bytes]] = []
        size = 0
        for batch in batches:
            for rel_path, length in zip(batch["rel_path"], batch["length"]):
                with opened(f"{base}/{rel_path}") as file:
                    rows.append((rel_path, int(length), file.read()))
                size += int(length)
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return files.select("rel_path", "length").mapInPandas(read, "rel_path string, length bigint, content binary")
