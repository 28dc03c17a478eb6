"""Streaming form of the tick-to-bar aggregation (inventory R1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators.bars import timeframe_label, timeframe_seconds


def stream_ticks(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tick stream from a growing folder of parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def stream_bars(ticks: DataFrame, timeframe: str, lateness: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream, emitted once the watermark passes their end (append mode).

    ``datetime`` must be TIMESTAMP (event time cannot be TIMESTAMP_NTZ). Buckets are right-closed: the
    event time moves back by one microsecond, so a left-closed window on it is (start, end] on the original.
    """
    label = timeframe_label(timeframe)
    start = "3 days" if label == "weekly" else "0 seconds"
    moved = ticks.where("datetime is not null and price is not null").withColumn(
        "_t", F.col("datetime") - F.expr("interval 1 microsecond")
    )
    width = f"{timeframe_seconds(label)} seconds"
    position = F.struct("datetime", "seq")
    bars = moved.withWatermark("_t", lateness).groupBy("symbol", F.window("_t", width, width, start)).agg(
        F.min_by("price", position).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", position).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select(
        "symbol", F.lit(label).alias("timeframe"), F.col("window.end").cast("timestamp_ntz").alias("datetime"),
        "open", "high", "low", "close", "volume",
    )


def closing_tick(ticks: DataFrame, timeframe: str, lateness: str = "10 minutes") -> DataFrame:
    """One tick of no symbol that ends a stream of ``ticks``: it moves the watermark past every open bucket.

    It lies later than the last tick by the lateness and two buckets, so its own bucket is the only one that stays open.
    """
    width = F.make_interval(secs=F.lit(2 * timeframe_seconds(timeframe_label(timeframe))))
    last = ticks.agg((F.max("datetime") + F.expr(f"interval {lateness}") + width).alias("datetime")).where("datetime is not null")
    return last.select(F.lit("").alias("symbol"), "datetime", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("price"), F.lit(0.0).alias("volume"))


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; the sink is a parquet folder."""
    df.writeStream.outputMode(mode).format("parquet").option("path", sink).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
