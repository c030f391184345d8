"""Metrics over event time, as streams. None of this is in batch metrics' scope
elsewhere: it is the same aggregates with a watermark and a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_by_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, missing (values that are null or NaN), mean and
    snr (mean over population deviation) of each window and type. Works on a
    stream (state is dropped once the watermark has passed) and on a table."""
    there = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    x = F.when(there, F.col("value").cast("double"))
    n = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(there, 0).otherwise(1)).alias("missing"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("s"))
    return n.select(F.col("w.start").alias("start"), "event_type", "n", "missing", F.round("mean", 6).alias("mean"), F.round(F.try_divide("mean", "s"), 6).alias("snr"))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives over all the data that is there now, as a table in
    folder. Each micro-batch writes its own; a batch that is run again after a
    failure overwrites what it wrote, so rows count once."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/batches")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates of each key the last batch's."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")
