"""Deterministic bar, tick and trade views over the generic test tables.

The tables hold no market data, so the ``events`` stream plays the part of ticks and closed trades and
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import SECONDS_PER_DAY
from tidebar.functions.scans import Run, running, time_block
from tidebar.operators.bars import index_bars, ticks_to_bars

INITIAL_CAPITAL = 100_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("datetime"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "60m") -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), timeframe)


def indexed_bars(spark: SparkSession, sf_dir: str, timeframe: str = "60m") -> DataFrame:
    return index_bars(bars(spark, sf_dir, timeframe))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    hold = F.make_dt_interval(mins=(F.col("event_id") % 90 + 1).cast("int"))
    pnl = F.round(F.col("value") - 50.0, 2)
    direction = F.when(F.col("event_id") % 2 == 0, "long").otherwise("short")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("strategy"),
        F.col("event_id").alias("trade_id"),
        F.col("ts").cast("timestamp_ntz").alias("entry_time"),
        (F.col("ts").cast("timestamp_ntz") + hold).alias("exit_time"),
        direction.alias("direction"),
        F.col("value").alias("entry_price"),
        (F.col("value") + F.when(F.col("event_id") % 2 == 0, pnl + 1.0).otherwise(-(pnl + 1.0))).alias("exit_price"),
        (pnl + 1.0).alias("pnl_points"),
        (pnl + 1.0).alias("pnl_gross"),
        F.lit(1.0).alias("costs"),
        pnl.alias("pnl_net"),
        "props",
    )


def equity(spark: SparkSession, sf_dir: str, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """Equity after each closed trade, ordered by (exit_time, trade_id) within a strategy."""
    rows = trades(spark, sf_dir).select("strategy", "exit_time", "trade_id", "pnl_net")
    summed = running(
        rows, ["strategy"], ["exit_time", "trade_id"], time_block(F.col("exit_time"), SECONDS_PER_DAY),
        [Run("_net", "sum", F.col("pnl_net"))],
    )
    return summed.select(
        "strategy", F.col("exit_time").alias("datetime"), F.col("trade_id").alias("seq"),
        (F.lit(capital) + F.col("_net")).alias("equity"), (F.lit(capital) + F.col("_net")).alias("cash"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward window results: one row per strategy and day of ``events``."""
    day = F.dayofmonth("ts").cast("int").alias("window_id")
    value, odd = F.col("value"), F.col("event_id") % 2 == 1
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy"), day)
    return rows.agg(
        F.coalesce(F.avg(F.when(~odd, value)), F.lit(0.0)).alias("best_train_score"),
        (F.coalesce(F.avg(F.when(odd, value)), F.lit(0.0)) - 50.0).alias("oos_score"),
        F.sum(F.round(value - 50.0, 2)).alias("oos_net_profit"),
        F.max_by("props", "event_id").alias("best_train_params_json"),
    )


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k test results: every event is one tested set, ranked by a hash-free rule within its hour."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("strategy"),
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("window_id"),
        F.col("event_id").alias("train_rank"),
        (F.col("value") + 1.0).alias("train_score"),
        F.round(F.col("value") - 50.0, 2).alias("test_score"),
        F.round(F.col("value") * 2 - 100.0, 2).alias("test_net_profit"),
        F.col("value").alias("test_max_drawdown"),
        F.col("props").alias("params_json"),
    )


def book(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A trade book of one event type; trade_id follows (exit_time, entry_time)."""
    return _book(spark, sf_dir, trades(spark, sf_dir).where(F.col("strategy") == kind))


def half_book(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """The trades of all event types whose event number is even (0) or odd (1), as one book."""
    return _book(spark, sf_dir, trades(spark, sf_dir).where(F.col("trade_id") % 2 == odd))


def _book(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), "user_id")
    rows = rows.withColumn("_book", F.lit(0))
    numbered = running(rows, ["_book"], ["exit_time", "entry_time", "trade_id"], time_block(F.col("exit_time")), [Run("_n", "count")])
    joined = numbered.withColumnRenamed("trade_id", "_e").join(users, "_e")
    return joined.select(
        (F.col("_n") - 1).alias("trade_id"), "user_id", "entry_time", "exit_time",
        F.when(F.col("_e") % 10 == 0, "unknown").otherwise(F.col("direction")).alias("direction"), F.lit(1.0).alias("qty"),
        "entry_price", "exit_price", "pnl_net",
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history over ``orders``."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_tag"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.col("o_orderstatus").alias("symbol"), F.when(F.col("o_custkey") % 2 == 0, "5m").otherwise("60m").alias("timeframe"),
        F.col("o_orderpriority").alias("strategy"), price.alias("score"), F.round(price - 150000.0, 2).alias("net_profit"),
        (F.col("o_custkey") % 100).cast("double").alias("win_rate"), F.round(price / 10.0, 3).alias("max_drawdown"),
        (F.col("o_custkey") % 40).cast("double").alias("trade_count"), (F.col("o_orderkey") % 6 + 1).alias("rank_in_run"),
        F.concat(F.lit('{"b": '), (F.col("o_custkey") % 30).cast("string"), F.lit(', "a": 1}')).alias("params_json"),
    )
