"""Bars from ticks, bar cleaning and bar quality (inventory B)."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import (
    MICROS,
    SECONDS_PER_DAY,
    epoch_micros,
    minute_of_day,
    second_of_day,
)
from tidebar.functions.scans import Run, number_rows, running, time_block

SERIES = ("symbol", "timeframe")

# Timeframe spellings and the label each one stands for.
TIMEFRAME_LABELS = {
    "1m": "1m", "5m": "5m", "10m": "10m", "15m": "15m", "30m": "30m", "60m": "60m",
    "d": "daily", "1d": "daily", "daily": "daily", "diario": "daily",
    "w": "weekly", "1w": "weekly", "weekly": "weekly", "semanal": "weekly",
}

DAILY_SECONDS = SECONDS_PER_DAY
WEEKLY_SECONDS = 7 * SECONDS_PER_DAY
SUNDAY_SHIFT = 3 * SECONDS_PER_DAY      # 1970-01-04 was a Sunday
DEFAULT_SPACING_SECONDS = 300.0


def timeframe_label(text: str) -> str:
    key = "".join(ch for ch in text.strip().lower().replace("á", "a") if ch.isalnum())
    if key not in TIMEFRAME_LABELS:
        raise ValueError(f"unsupported timeframe: {text}")
    return TIMEFRAME_LABELS[key]


def timeframe_seconds(label: str) -> int:
    if label == "daily":
        return DAILY_SECONDS
    if label == "weekly":
        return WEEKLY_SECONDS
    match = re.fullmatch(r"([1-9]\d*)m", label)
    if not match:
        raise ValueError(f"unsupported timeframe: {label}")
    return int(match.group(1)) * 60


def bucket_end(ts: Column, label: str) -> Column:
    """Right edge of the right-closed bucket that holds ``ts``; weeks end on Sunday."""
    width = timeframe_seconds(label) * MICROS
    shift = SUNDAY_SHIFT * MICROS if label == "weekly" else 0
    micros = epoch_micros(ts) - F.lit(shift)
    edge = micros + F.pmod(-micros, F.lit(width))
    return F.timestamp_micros(edge + F.lit(shift)).cast("timestamp_ntz")


def ticks_to_bars(ticks: DataFrame, timeframe: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Aggregate the ticks of each ``by`` to bars labelled by their right-closed bucket end; empty buckets give no bar.

    First and last price are min_by/max_by over one decimal key built from (time, seq): fixed-width
    aggregation buffers keep the plan a map-side combined hash aggregate.
    """
    label = timeframe_label(timeframe)
    valid = ticks.where(F.col("datetime").isNotNull() & F.col("price").isNotNull())
    position = (
        epoch_micros(F.col("datetime")).cast("decimal(17,0)") * F.lit("20000000000000000000").cast("decimal(20,0)")
        + F.col("seq").cast("decimal(19,0)")  # between -2**63 and 2**63, less than half a step
    ).cast("decimal(38,0)")
    keyed = valid.select(
        *by,
        bucket_end(F.col("datetime"), label).alias("datetime"),
        "price",
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        position.alias("_pos"),
    )
    return (
        keyed.groupBy(*by, "datetime")
        .agg(
            F.min_by("price", "_pos").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_pos").alias("close"),
            F.sum("volume").alias("volume"),
        )
        # explode keeps the label a real column: a literal key would be folded out of later window keys
        .withColumn("timeframe", F.explode(F.array(F.lit(label))))
        .select(*by, "timeframe", "datetime", "open", "high", "low", "close", "volume")
    )


def clean_bars(raw: DataFrame, arrival: list[str], zero_prices: bool = False) -> DataFrame:
    """Drop unusable rows and keep the latest arrival of each timestamp. Prices must be positive, or 0 with ``zero_prices``.

    ``arrival`` names the columns that order duplicates (file, row). The de-duplication is a hash
    aggregate on the full bar key, so a hot symbol spreads over its timestamps.
    """
    prices = ["open", "high", "low", "close"]
    finite = F.lit(True)
    for c in prices:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))) & ((F.col(c) >= 0) if zero_prices else (F.col(c) > 0))
    usable = raw.where(F.col("datetime").isNotNull() & finite & (F.col("high") >= F.col("low")))
    latest = usable.groupBy(*SERIES, "datetime").agg(
        F.max_by(F.struct(*prices, "volume"), F.struct(*arrival)).alias("_row")
    )
    return latest.select(
        *SERIES, "datetime", *[F.col(f"_row.{c}").alias(c) for c in prices],
        F.coalesce(F.nanvl(F.col("_row.volume"), F.lit(0.0)), F.lit(0.0)).alias("volume"),
    )


def index_bars(bars: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Add ``bar_idx``, the 0-based position in the series."""
    return number_rows(bars, series, ["datetime"], time_block(F.col("datetime"), 30 * SECONDS_PER_DAY))


def inconsistent_ohlc() -> Column:
    return (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))


def day_gaps(bars: DataFrame) -> DataFrame:
    """Adds ``gap_sec`` to the previous row of the same day (null on the first row of a day)."""
    w = Window.partitionBy(*SERIES, "day").orderBy("datetime")
    rows = bars.withColumn("day", F.col("datetime").cast("date"))
    gap = (epoch_micros(F.col("datetime")) - epoch_micros(F.lag("datetime").over(w))) / F.lit(float(MICROS))
    return rows.withColumn("gap_sec", gap)


def missing_bars(bars: DataFrame) -> DataFrame:
    """Expected but absent intraday bars per series and day; zero for daily and weekly series."""
    minutes = F.regexp_extract("timeframe", r"^(\d+)m$", 1).try_cast("double")
    lacking = F.greatest(F.bround(F.col("gap_sec") / (minutes * 60.0)) - 1, F.lit(0.0))
    return day_gaps(bars).groupBy(*SERIES, "day").agg(
        F.count(F.lit(1)).alias("bars"), F.coalesce(F.sum(lacking), F.lit(0.0)).cast("long").alias("missing")
    )


def quality_report(bars: DataFrame) -> DataFrame:
    """One row per series: extent, duplicates, inconsistencies, missing bars, bars-per-day quantiles.

    Everything is first reduced to one row per (series, day); only those day rows meet per series.
    """
    minutes = F.regexp_extract("timeframe", r"^(\d+)m$", 1).try_cast("double")
    lacking = F.greatest(F.bround(F.col("gap_sec") / (minutes * 60.0)) - 1, F.lit(0.0))
    days = day_gaps(bars).groupBy(*SERIES, "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("datetime").alias("lo"),
        F.max("datetime").alias("hi"),
        F.count_if(F.col("gap_sec") == 0).alias("dup"),
        F.count_if(F.col("gap_sec") <= 0).alias("nonmono"),
        F.count_if(inconsistent_ohlc()).alias("bad"),
        F.coalesce(F.sum(lacking), F.lit(0.0)).cast("long").alias("missing"),
    )
    q = F.percentile("n", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return days.groupBy(*SERIES).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("days"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
        F.sum("dup").alias("duplicate_timestamps"),
        F.sum("nonmono").alias("non_monotonic_timestamps"),
        F.sum("bad").alias("ohlc_inconsistent_rows"),
        F.sum("missing").alias("missing_intraday_bars"),
        q[1].alias("median_bars_per_day"),
        q[0].alias("p05_bars_per_day"),
        q[2].alias("p95_bars_per_day"),
    )


def bar_spacing(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Median positive distance between neighbouring bars in seconds; 300 when a series has none.

    Gaps are counted per distinct value before the median, so the final stage sees the distinct gaps only.
    """
    block = time_block(F.col("datetime"), 30 * SECONDS_PER_DAY)
    gaps = running(bars, keys, ["datetime"], block, [Run("_prev", "prev", F.col("datetime"))])
    gap = (epoch_micros(F.col("datetime")) - epoch_micros(F.col("_prev"))) / F.lit(float(MICROS))
    counted = gaps.select(*keys, gap.alias("gap")).groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    median = F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.5), F.col("n"))
    return counted.groupBy(*keys).agg(F.coalesce(median, F.lit(DEFAULT_SPACING_SECONDS)).alias("spacing_sec"))


def assign_ticks(ticks: DataFrame, indexed_bars: DataFrame, by: Sequence[str] = ("symbol",), label: Sequence[str] = ("timeframe",)) -> DataFrame:
    """Bar that owns each tick: bar i owns [t_i, t_i+1), the last bar one spacing more.

    As-of by union: bars and ticks with equal ``by`` columns are ordered on one time line and the latest bar
    row is carried forward. Equi-partitioned by time block, no inequality join. ``label`` columns come from
    the bar.
    """
    by, label = list(by), list(label)
    keys = [*by, *label]
    ends = indexed_bars.groupBy(*keys).agg(F.max("datetime").alias("_last"))
    margin = F.greatest(F.lit(1), (F.col("spacing_sec") * MICROS).cast("long"))
    limits = ends.join(bar_spacing(indexed_bars, keys), keys).select(
        *keys, F.timestamp_micros(epoch_micros(F.col("_last")) + margin).cast("timestamp_ntz").alias("_until")
    )
    tag = F.struct(*label, "bar_idx")
    bar_rows = indexed_bars.select(
        *by, "datetime", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("double").alias("volume"), tag.alias("_bar"), F.lit(0).alias("_side"),
    )
    nothing = F.lit(None).cast(bar_rows.schema["_bar"].dataType)
    tick_rows = ticks.select(*by, "datetime", "seq", "price", "volume", nothing.alias("_bar"), F.lit(1).alias("_side"))
    owned = running(
        bar_rows.unionByName(tick_rows), by, ["datetime", "_side", "seq"], time_block(F.col("datetime")),
        [Run("_own", "last", F.col("_bar"))],
    ).where((F.col("_side") == 1) & F.col("_own").isNotNull())
    flat = owned.select(
        *by, *[F.col(f"_own.{c}").alias(c) for c in label], F.col("_own.bar_idx").alias("bar_idx"), "datetime", "seq", "price", "volume"
    )
    return flat.join(limits, keys).where(F.col("datetime") < F.col("_until")).drop("_until")


def downsample(indexed: DataFrame, step: int, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Every ``step``-th bar of each series, whatever its length."""
    if step <= 1:
        return indexed
    kept = indexed.where(F.pmod(F.col("bar_idx"), F.lit(step)) == 0)
    return kept.withColumn("bar_idx", F.floor(F.col("bar_idx") / F.lit(step)).cast("long"))


def in_session(ts: Column, start_sec: Column | None, end_sec: Column | None) -> Column:
    """start <= time of day < end; a missing bound does not restrict."""
    sec = second_of_day(ts)
    ok = F.lit(True)
    if start_sec is not None:
        ok = ok & (start_sec.isNull() | (sec >= start_sec))
    if end_sec is not None:
        ok = ok & (end_sec.isNull() | (sec < end_sec))
    return ok


def in_open_auction(ts: Column, start_sec: Column, minutes: Column) -> Column:
    """First ``minutes`` minutes after the session start (whole minutes)."""
    since = minute_of_day(ts) - F.floor(start_sec / F.lit(60))
    return F.coalesce((minutes > 0) & (since >= 0) & (since < minutes), F.lit(False))


def candle_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.lit(0.0))


def trading_days(bars: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Distinct days of a series with their ordinal; the window runs over the distinct days only."""
    days = bars.select(*series, F.col("datetime").cast("date").alias("day")).distinct()
    w = Window.partitionBy(*series).orderBy("day")
    return days.withColumn("day_no", (F.row_number().over(w) - 1).cast("long"))


def tick_day_coverage(ticks: DataFrame, bars: DataFrame, listed_days: DataFrame) -> DataFrame:
    """Status of each listed (symbol, day): ok, sem_tick (no ticks) or sem_candle (no bars). Bars may carry their ``day``."""
    tick_counts = ticks.groupBy("symbol", F.col("datetime").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("ticks"))
    bar_day = F.col("day") if "day" in bars.columns else F.col("datetime").cast("date")
    bar_counts = bars.groupBy("symbol", bar_day.alias("day")).agg(F.count(F.lit(1)).alias("bars"))
    joined = (
        listed_days.select("symbol", "day").distinct()
        .join(tick_counts, ["symbol", "day"], "left")
        .join(bar_counts, ["symbol", "day"], "left")
    )
    n_ticks, n_bars = F.coalesce("ticks", F.lit(0)), F.coalesce("bars", F.lit(0))
    status = F.when(n_ticks == 0, "sem_tick").when(n_bars == 0, "sem_candle").otherwise("ok")
    return joined.select("symbol", "day", n_ticks.alias("ticks"), n_bars.alias("bars"), status.alias("status"))
