"""Versioned tables: immutable folders of Parquet and numbered manifests that name those in use.

A table's version is a list of folders. A commit writes new folders of any number of tables and then
one manifest; readers resolve a tag to folders once and are not touched by later commits. Appends
add a folder, changes of documents rewrite the folders that hold them. Paths go through Hadoop's file
systems, so a warehouse may lie in any store that Spark reads.

A manifest is written once, under a number that no other has, and never replaced: a reader takes the
highest one that is whole. A writer that dies leaves at most an unfinished manifest, which nobody
reads, and folders that ``prune`` deletes.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioweave.functions.folders import normalize_folder_name

FILE_BYTES = 128 << 20


class Warehouse:
    """Single writer, many readers. ``tag`` pins what is read: latest, current, prev."""

    def __init__(self, spark: SparkSession, path: str, tag: str = "latest"):
        self.spark, self.path, self.tag = spark, path.rstrip("/"), tag

    # -- files ---------------------------------------------------------------------------------
    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str:
        where, fs = self._file(name)
        stream = fs.open(where)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        """The numbers of the manifests, finished or not, latest first."""
        where, fs = self._file("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))), reverse=True)

    # -- versions ------------------------------------------------------------------------------
    def manifest(self) -> dict:
        """tags: for each tag the folders of each table; written: when each folder was made."""
        for number in self._numbers():
            try:
                return json.loads(self._read_text(f"manifests/{number:012d}.json"))
            except ValueError:  # its writer died
                continue
        return {"tags": {"latest": {}}, "written": {}}

    def _put(self, manifest: dict) -> None:
        number = max(self._numbers(), default=0) + 1
        where, fs = self._file(f"manifests/{number:012d}.json")
        stream = fs.create(where, False)  # fails if another writer was faster
        stream.write(bytearray(json.dumps(manifest | {"number": number, "at": time.time()}).encode()))
        stream.close()

    def _write(self, manifest: dict, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        manifest["written"][folder] = time.time()
        return folder

    def commit(self, **tables: DataFrame) -> None:
        """New versions of the tables, visible together or not at all."""
        manifest = self.manifest()
        written = {name: [self._write(manifest, name, df)] for name, df in tables.items()}
        manifest["tags"]["latest"] = manifest["tags"]["latest"] | written
        self._put(manifest)

    def _folders(self, name: str, manifest: dict | None = None) -> list[str]:
        tags = (manifest or self.manifest())["tags"]
        return tags.get(self.tag, tags["latest"]).get(name, [])

    def _parquet(self, folders: list[str], schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, name: str, schema: StructType | None = None) -> DataFrame | None:
        """The table under this reader's tag; None, or empty with a schema, if there is none."""
        folders = self._folders(name)
        if not folders:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self._parquet(folders, schema)

    def append(self, name: str, rows: DataFrame, schema: StructType) -> None:
        """Rows under a fixed schema: missing columns are null, others are dropped. Old rows stay where they are."""
        manifest = self.manifest()
        latest = manifest["tags"]["latest"]
        latest[name] = [*latest.get(name, []), self._write(manifest, name, conform(rows, schema))]
        self._put(manifest)

    def extend(self, **tables: DataFrame) -> None:
        """Rows added to several tables, visible together or not at all; a table that is there keeps its schema."""
        manifest = self.manifest()
        latest = manifest["tags"]["latest"]
        for name, rows in tables.items():
            old = self._folders(name, manifest)
            rows = rows if not old else conform(rows, self._parquet(old[:1]).schema)
            latest[name] = [*latest.get(name, []), self._write(manifest, name, rows)]
        self._put(manifest)

    def reset(self, name: str, schema: StructType) -> None:
        self.commit(**{name: self.spark.createDataFrame([], schema)})

    def count(self, name: str) -> int:
        df = self.read(name)
        return 0 if df is None else df.count()

    def publish(self) -> None:
        """current becomes latest, prev what current was; nothing if they are equal."""
        manifest = self.manifest()
        tags = manifest["tags"]
        if tags.get("current") != tags["latest"]:
            if "current" in tags:
                tags["prev"] = tags["current"]
            tags["current"] = dict(tags["latest"])
            self._put(manifest)

    def prune(self, grace_seconds: float = 7 * 86400) -> list[str]:
        """Deletes folders that no tag names, and manifests but the last, that are older than the grace."""
        manifest, before = self.manifest(), self._numbers()
        used = {f for tag in manifest["tags"].values() for folders in tag.values() for f in folders}
        old = [f for f, at in manifest["written"].items() if f not in used and time.time() - at >= grace_seconds]
        for folder in old:
            del manifest["written"][folder]
        self._put(manifest)
        for folder in old:
            where, fs = self._file(folder)
            fs.delete(where, True)
        for number in before:
            where, fs = self._file(f"manifests/{number:012d}.json")
            if time.time() - fs.getFileStatus(where).getModificationTime() / 1000 >= grace_seconds:
                fs.delete(where, False)
        return old

    def history(self) -> DataFrame:
        """number, at, tag, name and folders of every manifest that is still there."""
        rows = []
        for number in self._numbers():
            try:
                m = json.loads(self._read_text(f"manifests/{number:012d}.json"))
            except ValueError:
                continue
            rows += [(number, m["at"], tag, name, folders) for tag, names in m["tags"].items() for name, folders in names.items()]
        return self.spark.createDataFrame(rows, "number long, at double, tag string, name string, folders array<string>")

    def compact(self, name: str, file_bytes: int = FILE_BYTES) -> int:
        """Rewrites a table in one folder of files of about the given size; returns how many."""
        total = 0
        for folder in self._folders(name):
            where, fs = self._file(folder)
            total += fs.getContentSummary(where).getLength()
        files = max(1, -(-total // file_bytes))
        self.commit(**{name: self.read(name).repartition(files)})
        return files

    # -- changes -------------------------------------------------------------------------------
    def _rewrite(self, manifest: dict, name: str, rows, change) -> None:
        """Replaces the folders of a table that hold any of the rows by one with what ``change`` makes of them."""
        folders = self._folders(name, manifest)
        hit = self._parquet(folders).where(rows).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("f")).distinct()
        touched = {r["f"] for r in hit.collect()}  # a row for each folder of the version
        if touched:
            new = self._write(manifest, name, change(self._parquet([f for f in folders if f.split("/")[-1] in touched])))
            manifest["tags"]["latest"][name] = [*(f for f in folders if f.split("/")[-1] not in touched), new]

    def delete_documents(self, ids: list[int], tables: tuple[str, ...] = ("documents", "chunks")) -> int:
        """Deletes documents from all tables at once; returns how many there were."""
        gone, manifest = F.col("doc_id").isin(ids), self.manifest()
        n = self._parquet(self._folders(tables[0], manifest)).where(gone).count()
        for t in tables:
            self._rewrite(manifest, t, gone, lambda df: df.where(~F.coalesce(gone, F.lit(False))))
        self._put(manifest)
        return n

    def move_document(self, doc_id: int, folder: str, tables: tuple[str, ...] = ("documents", "chunks")) -> bool:
        """Moves a document in all tables by one commit; False if it is there already."""
        target, manifest, own = normalize_folder_name(folder), self.manifest(), F.col("doc_id") == doc_id
        now = self._parquet(self._folders(tables[0], manifest)).where(own).select("folder").first()
        if now is None or now[0] == target:
            return False
        for t in tables:
            self._rewrite(manifest, t, own, lambda df: df.withColumn("folder", F.when(own, F.lit(target)).otherwise(F.col("folder"))))
        self._put(manifest)
        return True

    def copy_to(self, other: Warehouse) -> None:
        """All tags of this warehouse in another: a backup or a reader's cache. Versions that tags share are copied once."""
        tags, manifest, done = self.manifest()["tags"], other.manifest(), {}
        for tag, names in tags.items():
            for name, folders in names.items():
                if (key := (name, *folders)) not in done:
                    done[key] = [other._write(manifest, name, self._parquet(folders))]
        manifest["tags"] = {tag: {name: done[(name, *folders)] for name, folders in names.items()} for tag, names in tags.items()}
        other._put(manifest)


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def migrate(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of an older table in a newer one's columns, if the newer one is empty."""
    return target.unionByName(conform(source, target.schema)) if target.isEmpty() else target
