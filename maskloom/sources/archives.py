"""Archive members as rows."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame

from maskloom.sources.scratch import measured, settled
from maskloom.sources.trees import opened

MEMBERS = "bundle string, rel_path string, content binary, error string"
COLUMNS = ["bundle", "rel_path", "content", "error"]
BATCH_BYTES = 16 << 20
BATCH_ROWS = 1000
# A row cannot hold more than this.
MEMBER_LIMIT = (2 << 30) - (64 << 10)

BROKEN = (ValueError, OSError, EOFError, RuntimeError, zlib.error, tarfile.TarError, zipfile.BadZipFile, gzip.BadGzipFile)


def _inside(name: str) -> None:
    """A member must come to lie below its bundle, whatever turns its path takes."""
    resolved = posixpath.normpath(posixpath.join("bundle", name.replace("\\", "/")))
    if not resolved.startswith("bundle/"):
        raise ValueError(f"unsafe member path: {name}")


def _checked(name: str, size: int) -> None:
    _inside(name)
    if size > MEMBER_LIMIT:
        raise ValueError(f"member too large for one row: {name}")


def _zip_members(file: BinaryIO) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                _checked(info.filename, info.file_size)
                yield info.filename, archive.read(info)


def _tar_members(file: BinaryIO) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=file, mode="r:gz", ignore_zeros=True) as archive:
        while (info := archive.next()) is not None:
            archive.members = []  # forget earlier members: an archive may hold millions
            if info.isreg():
                _checked(info.name, info.size)
                yield info.name, archive.extractfile(info).read()


def _members(name: str, file: Callable[[], BinaryIO]) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    lower = name.lower()
    try:
        with file() as source:
            if lower.endswith(".zip"):
                members = _zip_members(source)
            elif lower.endswith((".tar.gz", ".tgz")):
                members = _tar_members(source)
            else:
                members = iter([(name.rsplit("/", 1)[-1], source.read())])
            for rel_path, data in members:
                yield rel_path, data, None
    except BROKEN as exc:
        yield None, None, f"{type(exc).__name__}: {exc}"


def _batched(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Small frames: a bundle's expanded size is never held at once."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pd.DataFrame(held, columns=COLUMNS)
            held, size = [], 0
    yield pd.DataFrame(held, columns=COLUMNS)


def expand_archives(df: DataFrame, bundle: str = "bundle", content: str = "content") -> DataFrame:
    """(bundle, rel_path, content, error): one row per regular file of every .zip, .tar.gz or .tgz.

    A broken or unsafe archive gives a row with ``error`` and does not stop the
    others; anything else passes through as a single file.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for name, data in zip(batch["bundle"], batch["content"]):
                for member in _members(name, lambda data=data: io.BytesIO(data)):
                    yield (name, *member)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _batched(rows(batches))

    return df.selectExpr(f"`{bundle}` AS bundle", f"`{content}` AS content").mapInPandas(expand, MEMBERS)


def expand_archive_files(df: DataFrame, bundle: str = "bundle", path: str = "path") -> DataFrame:
    """The same for archives named by path, of any size: tasks stream them from storage."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for name, location in zip(batch["bundle"], batch["path"]):
                for member in _members(location, lambda location=location: opened(location)):
                    yield (name, *member)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _batched(rows(batches))

    return df.selectExpr(f"`{bundle}` AS bundle", f"`{path}` AS path").mapInPandas(expand, MEMBERS)


PIECES = "bundle string, rel_path string, piece_no bigint, content binary, error string"
PIECE_COLUMNS = ["bundle", "rel_path", "piece_no", "content", "error"]


def _streams(name: str, source: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(source) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    _inside(info.filename)
                    with archive.open(info) as member:
                        yield info.filename, member
        return
    with tarfile.open(fileobj=source, mode="r:gz", ignore_zeros=True) as archive:
        while (info := archive.next()) is not None:
            archive.members = []  # forget earlier members: an archive may hold millions
            if info.isreg():
                _inside(info.name)
                yield info.name, archive.extractfile(info)


def _pieces(member: BinaryIO, size: int) -> Iterator[bytes]:
    """A member in pieces that end after a line feed, but for the last and for those without any."""
    held = b""
    while chunk := member.read(size):
        held += chunk
        cut = held.rfind(b"\n") + 1
        # Without a line feed the line goes on; binary content is cut anywhere.
        if cut or b"\x00" in held:
            cut = cut or len(held)
            yield held[:cut]
            held = held[cut:]
    yield held


def expand_archive_pieces(df: DataFrame, bundle: str = "bundle", path: str = "path", size: int = BATCH_BYTES) -> DataFrame:
    """(bundle, rel_path, piece_no, content, error) of archives named by path; archives and members of any size.

    Pieces of a text member end at line feeds, so each can be cut into lines by
    itself. A broken or unsafe archive gives a row with ``error``.
    """

    def rows(name: str, location: str) -> Iterator[tuple]:
        try:
            with opened(location) as source:
                for rel_path, member in _streams(location, source):
                    for number, content in enumerate(_pieces(member, size)):
                        if number == 0 or content:
                            yield name, rel_path, number, content, None
        except BROKEN as exc:
            yield name, None, None, None, f"{type(exc).__name__}: {exc}"

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for batch in batches:
            for name, location in zip(batch["bundle"], batch["path"]):
                for row in rows(name, location):
                    held.append(row)
                    total += len(row[3] or b"")
                    if total >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield pd.DataFrame(held, columns=PIECE_COLUMNS).astype({"piece_no": "Int64"})
                        held, total = [], 0
        yield pd.DataFrame(held, columns=PIECE_COLUMNS).astype({"piece_no": "Int64"})

    return df.selectExpr(f"`{bundle}` AS bundle", f"`{path}` AS path").mapInPandas(expand, PIECES)


def whole_bundles(members: DataFrame) -> DataFrame:
    """Members of sound bundles only: one unreadable member rejects its bundle."""
    broken = members.where("error IS NOT NULL").select("bundle").distinct()
    return members.join(measured(settled(broken)), "bundle", "left_anti")
