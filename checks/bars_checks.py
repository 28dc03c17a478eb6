"""B: bars and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r6, rounded
from checks.sql import r, with_
from tidebar.operators import bars as B
from tidebar.plans import testviews as V

BAR_COLS = "symbol, timeframe, datetime, open, high, low, close, volume"


@query("b1_ticks_to_bars_60m", with_("bars") + f"SELECT {BAR_COLS} FROM bars")
def _(spark, sf):
    return V.bars(spark, sf)


@query(
    "b1_ticks_to_bars_weekly",
    with_("ticks") + """SELECT symbol, 'weekly' AS timeframe, datetime, arg_min(price, p) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, p) AS close, sum(volume) AS volume FROM (
 SELECT symbol, price, volume, row_number() OVER (PARTITION BY symbol ORDER BY datetime, seq) AS p,
 CAST(datetime - INTERVAL 1 MICROSECOND AS DATE) AS d0,
 CAST(CAST(datetime - INTERVAL 1 MICROSECOND AS DATE) + CAST(7 - dayofweek(CAST(datetime - INTERVAL 1 MICROSECOND AS DATE)) AS INTEGER) AS TIMESTAMP) AS datetime FROM ticks)
 GROUP BY symbol, datetime""",
)
def _(spark, sf):
    return V.bars(spark, sf, "weekly")


QUALITY_DAYS = """g AS (SELECT *, CAST(datetime AS DATE) AS day, epoch(datetime) - epoch(lag(datetime) OVER (PARTITION BY symbol, CAST(datetime AS DATE) ORDER BY datetime)) AS gap FROM bars),
d AS (SELECT symbol, timeframe, day, count(*) AS n, min(datetime) AS lo, max(datetime) AS hi, count(*) FILTER (gap = 0) AS dup, count(*) FILTER (gap <= 0) AS nm,
 count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS bad,
 coalesce(sum(greatest(round_even(gap / 3600.0, 0) - 1, 0)), 0) AS missing FROM g GROUP BY ALL)"""


@query(
    "b2_quality_report",
    with_("bars", extra=QUALITY_DAYS)
    + f"""SELECT symbol, timeframe, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS days, min(lo) AS "start", max(hi) AS "end",
 CAST(sum(dup) AS BIGINT) AS duplicate_timestamps, CAST(sum(nm) AS BIGINT) AS non_monotonic_timestamps, CAST(sum(bad) AS BIGINT) AS ohlc_inconsistent_rows,
 CAST(sum(missing) AS BIGINT) AS missing_intraday_bars, {r('quantile_cont(n, 0.5)')} AS median_bars_per_day,
 {r('quantile_cont(n, 0.05)')} AS p05_bars_per_day, {r('quantile_cont(n, 0.95)')} AS p95_bars_per_day FROM d GROUP BY symbol, timeframe""",
)
def _(spark, sf):
    return rounded(B.quality_report(V.bars(spark, sf)), "median_bars_per_day", "p05_bars_per_day", "p95_bars_per_day")


@query(
    "b3_missing_bars_per_day",
    with_("bars", extra=QUALITY_DAYS) + "SELECT symbol, timeframe, day::VARCHAR AS day, n AS bars, CAST(missing AS BIGINT) AS missing FROM d",
)
def _(spark, sf):
    return B.missing_bars(V.bars(spark, sf))


@query(
    "b4_inconsistent_bars",
    with_("bars")
    + """SELECT symbol, datetime, high - 20.0 AS high, low, open, close FROM bars
 WHERE high - 20.0 < greatest(open, close, low) OR low > least(open, close, high - 20.0)""",
)
def _(spark, sf):
    shifted = V.bars(spark, sf).withColumn("high", F.col("high") - 20.0)
    return shifted.where(B.inconsistent_ohlc()).select("symbol", "datetime", "high", "low", "open", "close")


@query(
    "b5_bar_spacing",
    with_("bars", extra="g AS (SELECT symbol, timeframe, epoch(datetime) - epoch(lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime)) AS gap FROM bars)")
    + f"SELECT symbol, timeframe, {r('coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 300.0)')} AS spacing_sec FROM g GROUP BY ALL",
)
def _(spark, sf):
    return rounded(B.bar_spacing(V.bars(spark, sf)), "spacing_sec")


@query(
    "b6_assign_ticks_to_bars",
    with_("idx", extra="""gap AS (SELECT symbol, quantile_cont(g, 0.5) AS sp FROM (SELECT symbol, epoch(datetime) - epoch(lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime)) AS g FROM bars) WHERE g > 0 GROUP BY symbol),
spans AS (SELECT symbol, timeframe, bar_idx, datetime AS t0, coalesce(lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime), datetime + to_seconds(coalesce(sp, 300.0))) AS t1 FROM idx LEFT JOIN gap USING (symbol))""")
    + "SELECT t.symbol, s.timeframe, s.bar_idx, t.datetime, t.seq, t.price, t.volume FROM ticks t JOIN spans s ON t.symbol = s.symbol AND t.datetime >= s.t0 AND t.datetime < s.t1",
)
def _(spark, sf):
    return B.assign_ticks(V.ticks(spark, sf), V.indexed_bars(spark, sf))


@query(
    "b7_downsample",
    with_("idx")
    + "SELECT symbol, datetime, close, bar_idx // 3 AS bar_idx FROM idx WHERE bar_idx % 3 = 0",
)
def _(spark, sf):
    return B.downsample(V.indexed_bars(spark, sf), 3).select("symbol", "datetime", "close", "bar_idx")


@query(
    "b8_b9_b10_bar_flags",
    with_("bars")
    + f"""SELECT symbol, datetime, (hour(datetime) * 60 + minute(datetime) >= 540 AND hour(datetime) * 60 + minute(datetime) < 1060) AS in_session,
 (hour(datetime) * 60 + minute(datetime) - 540 >= 0 AND hour(datetime) * 60 + minute(datetime) - 540 < 90) AS open_auction, {r('greatest(high - low, 0)')} AS candle_range FROM bars""",
)
def _(spark, sf):
    start, end = F.lit(9 * 3600), F.lit(17 * 3600 + 40 * 60)
    ts = F.col("datetime")
    return V.bars(spark, sf).select(
        "symbol", "datetime", B.in_session(ts, start, end).alias("in_session"),
        B.in_open_auction(ts, start, F.lit(90)).alias("open_auction"), r6(B.candle_range()).alias("candle_range"),
    )


@query(
    "b11_trading_days",
    with_("bars")
    + """SELECT symbol, timeframe, day::VARCHAR AS day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS day_no
 FROM (SELECT DISTINCT symbol, timeframe, CAST(datetime AS DATE) AS day FROM bars)""",
)
def _(spark, sf):
    return B.trading_days(V.bars(spark, sf))


@query(
    "b12_tick_day_coverage",
    with_("ticks", "bars", extra="""listed AS (SELECT DISTINCT symbol, CAST(datetime AS DATE) + 1 AS day FROM ticks),
tc AS (SELECT symbol, CAST(datetime AS DATE) AS day, count(*) AS ticks FROM ticks GROUP BY ALL),
bc AS (SELECT symbol, CAST(datetime AS DATE) AS day, count(*) AS bars FROM bars GROUP BY ALL)""")
    + """SELECT symbol, day::VARCHAR AS day, coalesce(ticks, 0) AS ticks, coalesce(bars, 0) AS bars,
 CASE WHEN coalesce(ticks, 0) = 0 THEN 'sem_tick' WHEN coalesce(bars, 0) = 0 THEN 'sem_candle' ELSE 'ok' END AS status
 FROM listed LEFT JOIN tc USING (symbol, day) LEFT JOIN bc USING (symbol, day)""",
)
def _(spark, sf):
    ticks = V.ticks(spark, sf)
    listed = ticks.select("symbol", F.date_add(F.col("datetime").cast("date"), 1).alias("day"))
    return B.tick_day_coverage(ticks, V.bars(spark, sf), listed)
