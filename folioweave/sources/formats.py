"""Folders of documents and ZIP archives as data sources of Spark.

``document_files`` gives the rows of ``files.parse_files``; ``archive_members`` gives those of
``files.unzip`` and writes rows as archives. Partitions are planned from sizes: small files go
together, a large archive is dealt by ranges of its members, and a task reads its members through
the archive's directory, so that no archive is held whole. Folders are listed by
``pyarrow.fs``, which knows local, HDFS, S3 and GCS addresses.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from folioweave.functions.batches import slices
from folioweave.sources import files

MEMBERS = "archive string, path string, content binary, error string"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session; filters on names then prune files while a read is planned."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(ArchiveMembers)


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """A file system, the path within it, and what stands before such paths in addresses, as ``binaryFile`` writes them."""
    local = re.match(r"(?:file:)?/+(.*)", path)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].rstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/"), path[: len(path.rstrip("/")) - len(inner.rstrip("/"))]


@dataclass
class Piece:
    """A file, or the members ``[first, last)`` of an archive; ``last`` is None for all."""

    path: str
    size: int
    first: int = 0
    last: int | None = None


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def _matches(filters: list[Filter], values: dict[str, str]) -> bool:
    tests = {EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, StringStartsWith: lambda v, w: v.startswith(w), StringEndsWith: lambda v, w: v.endswith(w)}
    return all(tests[type(f)](values[f.attribute[0]], f.value) for f in filters)


class _Files(DataSourceReader):
    """Lists the files under ``path`` (hidden ones aside) and packs them up to ``partition_bytes``."""

    named: tuple[str, ...] = ()

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.target = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in (EqualTo, In, StringStartsWith, StringEndsWith) and f.attribute[0] in self.named and len(f.attribute) == 1 and f.value is not None:
                self.filters.append(f)
            else:
                yield f

    def found(self) -> list[Piece]:
        system, inner, before = opened(self.path)
        base = system.get_file_info(inner)
        if base.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [base] if base.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        shown = [i for i in infos if i.is_file and (i is base or not re.search(r"(^|/)[_.]", i.path[len(inner) :]))]
        pieces = [Piece(before + i.path, i.size) for i in shown]
        return sorted((p for p in pieces if self.kept(p)), key=lambda p: p.path)

    def kept(self, piece: Piece) -> bool:
        return _matches(self.filters, {"path": piece.path, "archive": piece.path, "file_name": piece.path.rsplit("/", 1)[-1]})

    def split(self, piece: Piece) -> Iterator[Piece]:
        yield piece

    def partitions(self) -> list[Pieces]:
        packs, held = [[]], 0
        for piece in (part for whole in self.found() for part in self.split(whole)):
            if packs[-1] and held + piece.size > self.target:
                packs.append([])
                held = 0
            packs[-1].append(piece)
            held += piece.size
        return [Pieces(pack) for pack in packs]


class _Documents(_Files):
    named = ("path", "file_name")

    def read(self, partition: Pieces) -> Iterator[tuple]:
        for piece in partition.pieces:
            system, inner, _ = opened(piece.path)
            try:
                with system.open_input_file(inner) as stream:
                    content = stream.read()
            except Exception as e:  # one file's failure is its own
                yield piece.path, piece.path.rsplit("/", 1)[-1], None, None, None, f"{type(e).__name__}: {e}"[:2000]
                continue
            yield files.parsed(piece.path, content, files.PARSERS)


class DocumentFiles(DataSource):
    """``spark.read.format("document_files").load(folder)``: path, file_name, doc_hash, size_bytes, pages, error.

    A file that can't be read or parsed is a row with an error; a file without bytes, which ``binaryFile``
    leaves out, is one empty text. Option ``partition_bytes``: how much a
    task reads, 64 MB unless given.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return files.PARSED

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options)


class _Members(_Files):
    named = ("archive",)

    def __init__(self, options) -> None:
        super().__init__(options)
        self.most = int(options.get("max_members", files.MAX_MEMBERS))
        self.bytes = int(options.get("max_bytes", files.MAX_BYTES))

    def kept(self, piece: Piece) -> bool:
        return piece.path.lower().endswith(".zip") and super().kept(piece)

    def split(self, piece: Piece) -> Iterator[Piece]:
        """Ranges of members of about the target's unpacked bytes; only the directory of an archive that is larger
        than the target is read while planning."""
        if piece.size <= self.target:
            yield piece
            return
        try:
            sizes = [m.file_size for m in self.members(piece)[1]]
        except Exception:  # its reader gives the error row
            yield piece
            return
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if i > first and held + size > self.target:
                yield Piece(piece.path, self.target, first, i)
                first, held = i, 0
            held += size
        yield Piece(piece.path, min(held, self.target), first, len(sizes))

    def members(self, piece: Piece) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
        system, inner, _ = opened(piece.path)
        stream = system.open_input_file(inner)
        archive = zipfile.ZipFile(io.BytesIO(stream.read()) if piece.size <= self.target else stream)
        return archive, files.members(archive, self.most, self.bytes)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self.rows(partition):
            rows.append(row)
            held += len(row[2] or b"") + 256
            if held >= files.HELD:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, partition: Pieces) -> Iterator[tuple]:
        for piece in partition.pieces:
            try:
                archive, members = self.members(piece)
            except Exception as e:
                yield piece.path, "", None, str(e)
                continue
            for m in members[piece.first : piece.last]:
                yield (piece.path, *files.unpacked(archive, m))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"archive": pa.string(), "path": pa.string(), "content": pa.binary(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class _Archives(DataSourceArrowWriter):
    """An archive for each task, written under a hidden name and shown by the commit."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        system, inner, _ = opened(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.zip"
        hidden = f"{inner}/_attempt-{context.taskAttemptId()}-{name}"
        system.create_dir(inner, recursive=True)
        used: dict[str, int] = {}
        with system.open_output_stream(hidden) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, content in _members_of(iterator):
                if not member:
                    raise ValueError("a member without a path")
                problem = files.member_problem(member)
                if problem:
                    raise ValueError(f"{member}: {problem}")
                archive.writestr(_free(member, used), content or b"")
        return _Written(hidden, f"{inner}/{name}" if used else None)

    def commit(self, messages: list) -> None:
        """Shows what was written, then takes away what was there before an overwrite."""
        system, inner, _ = opened(self.path)
        shown = [m.final for m in messages if m is not None and m.final]
        for m in messages:
            if m is not None and m.final:
                system.move(m.hidden, m.final)
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.is_file and (name.startswith("_attempt-") and self.job in name or self.overwrite and name.endswith(".zip") and not any(s.endswith("/" + name) for s in shown)):
                system.delete_file(info.path)

    def abort(self, messages: list) -> None:
        system, inner, _ = opened(self.path)
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if info.is_file and self.job in info.path:
                system.delete_file(info.path)


def _members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes | None]]:
    for whole in batches:
        for batch in slices(whole.select(["path", "content"]), files.HELD):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


@dataclass
class _Written(WriterCommitMessage):
    hidden: str
    final: str | None


def _free(member: str, used: dict[str, int]) -> str:
    """The name of a member; one that is taken gets a number before its suffix."""
    name = member
    while name in used:
        used[member] += 1
        stem, dot, suffix = member.rpartition(".")
        name = f"{stem} ({used[member]}).{suffix}" if dot and "/" not in suffix and stem else f"{member} ({used[member]})"
    used[name] = 1
    return name


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(folder)``: archive, path, content, error of every member of
    the ``.zip`` files under it; a bad archive or member is an error row. ``write`` takes path and content
    and makes one archive a task; equal paths in one archive are numbered, and an overwrite deletes the
    folder's own archives once the new ones are there. Options: ``partition_bytes``, ``max_members``, ``max_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Members(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Archives(self.options, overwrite)


def export_archive(docs: DataFrame, path: str, ids: list[int], principal, most: int = 200) -> None:
    """One archive of the texts of selected documents that a principal may read (doc_id, folder, file_name, text)."""
    register(docs.sparkSession)
    rows = files.export_selection(docs, ids, principal, most)
    rows.selectExpr("file_name as path", "encode(coalesce(text, ''), 'UTF-8') as content").coalesce(1).write.format("archive_members").mode("overwrite").save(path)
