"""Streams of menu updates: keep the last good snapshot, and windows of cart events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.loaders import keep_last_good


def upsert_snapshots(updates: DataFrame, path: str, checkpoint: str):
    """Start a stream that folds batches of (restaurant, items, updated_at) into the table at ``path``.

    Each batch is merged with the table of the batch before and written beside it; a batch that
    is run again after a failure begins from the same version.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("restaurant").agg(F.max_by(F.struct("items", "updated_at"), "updated_at").alias("m")).select("restaurant", "m.items", "m.updated_at")
        old = read_snapshots(spark, path, batch_id - 1)
        merged = newest if old is None else keep_last_good(old, newest)
        merged.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshots(spark: SparkSession, path: str, at_most: int | None = None) -> DataFrame | None:
    """The table after the last batch, or after batch ``at_most``."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    found = [v for v in found if at_most is None or v <= at_most]
    return spark.read.parquet(f"{path}/version={max(found)}") if found else None


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n, value) of each user's sessions; works on streams and tables alike."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), "n", "value")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) by fixed windows."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
