"""Session helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in a single local JVM, where it names none, one of ours."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: planned and computed once.  The folder goes when the JVM ends."""
    spark = df.sparkSession
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tessera-tables-{spark.sparkContext.applicationId}")
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.mkdirs(home):
        files.deleteOnExit(home)
    path = f"{home}/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
