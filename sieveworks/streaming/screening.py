"""Screening of a stream of items: an extension of the batch operators.

A stream of items is joined with a static rule table, repeated items are
dropped within the watermark, and hits are counted in event-time windows. The
file sink and the checkpoint make each step exactly-once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Items without repeats of a key that come within the delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def screened(stream: DataFrame, rules: DataFrame, key: str, hit: Column) -> DataFrame:
    """Items with their rule's columns, and whether they trigger; items without a rule stay."""
    return stream.join(rules, key, "left").withColumn("triggered", F.coalesce(hit, F.lit(False)))


def windowed(hits: DataFrame, time: str, size: str, by: str, late: str) -> DataFrame:
    """Items and hits per window and key; windows older than ``late`` are closed and leave the state."""
    kind = hits.schema[time].dataType
    timed = hits.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    per = timed.groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.count_if("triggered").alias("n_triggered"))
    return per.select(F.col("window.start").cast(kind).alias("window_start"), by, "n", "n_triggered")


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there, into files under the folder, and read them."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def drain_updates(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream of changing rows over all that is there and read every state of them; a repeated batch replaces itself."""
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    query = df.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").select(*df.columns)
