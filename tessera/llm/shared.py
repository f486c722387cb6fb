"""Scratch tables, token rules and small helpers that the operators share."""

from __future__ import annotations

import pickle
import re
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Applications whose folder goes when their JVM ends.
_MARKED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in a single local JVM, where that is unset, one of ours."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _folder(spark: SparkSession):
    """Path and file system of this application's scratch tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tessera-{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    path, files = _folder(spark)
    if (app := spark.sparkContext.applicationId) not in _MARKED:
        files.mkdirs(path)  # only what exists can be marked
        files.deleteOnExit(path)
        _MARKED.add(app)
    return f"{shared_root(spark)}/tessera-{app}/{name}-{uuid.uuid4().hex[:12]}"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stash(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    batch_rows: rows of a batch that goes to a Python worker, at most, while
    this table is made; bounds what a worker holds of long rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    rows = spark.conf.get(_BATCH_ROWS)
    if batch_rows is not None:
        spark.conf.set(_BATCH_ROWS, min(batch_rows, int(rows)) if int(rows) > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts a bounded value; classes of this package travel with it, so workers need no copy of it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(held: Broadcast) -> object:
    """What ship() sent; call it once in a task."""
    return pickle.loads(held.value)


def release(spark: SparkSession) -> None:
    """Drop this application's scratch tables; results that read them must have been written before."""
    path, files = _folder(spark)
    files.delete(path, True)
    _MARKED.discard(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z, then split at ASCII white space; null has no words.

    bytes.lower and bytes.split treat exactly A-Z and 0x20, 0x09-0x0D.
    """
    return text.lower().split() if text else []
