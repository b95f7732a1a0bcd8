"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_load(events: DataFrame, key: str, length: str = "60 seconds", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Events and values per key and sliding event-time window; rows later than ``late`` are dropped, which bounds the state."""
    windows = F.window("ts", length, slide)
    out = events.withWatermark("ts", late).groupBy(windows.alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n_events", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n_events")


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch once: the batch number names its folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregated stream over all that is there and gives its last result; every batch replaces the whole table of the one before."""
    spark = stream.sparkSession
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[-1]}")
