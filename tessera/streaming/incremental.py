"""Incremental crawls: a stream of listing rows folded into versions of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.catalog import crawl, insert_if_absent
from tessera.schemas import ITEMS, LISTING


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listing files as a stream."""
    return spark.readStream.schema(LISTING).parquet(path)


def fold_into(listings: DataFrame, catalog: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch's new items to the catalog's next version, at catalog/v=<batch>; a batch that runs again writes the same version."""
    spark = listings.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(ITEMS).parquet(f"{catalog}/v={number - 1}") if number else spark.createDataFrame([], ITEMS)
        fresh, _ = insert_if_absent(before, crawl(batch))
        now = F.current_timestamp()
        fresh = fresh.withColumn("created_at", now).withColumn("updated_at", now)
        columns = [(F.col(f.name) if f.name in fresh.columns else F.lit(False if f.name == "is_archived" else None)).cast(f.dataType).alias(f.name) for f in ITEMS]
        before.unionByName(fresh.select(*columns)).write.mode("overwrite").parquet(f"{catalog}/v={number}")

    return listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Items by type and window with a watermark, over a stream or a table with ts and event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
