"""Pieces that several operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, as in tests, a temporary one where none is set."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="folioweave-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


#: Narrow rows in a file of a checkpoint, where their number is known.
FILE_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint of narrow rows: lineage ends in files that all executors share. ``rows``, if it is
    about known, makes as many files as they need, however many partitions there are."""
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).checkpoint(eager=True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def scratch_table(df: DataFrame) -> DataFrame:
    """Wide rows written as compressed Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, if it is there and the session still runs."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def free_name(taken: list[str], name: str) -> str:
    """The name, or one made of it, that no column has in any case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def text_key(text):
    """16 bytes that stand for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
