"""G: signals and their filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.indicator_checks import TR, ema_cte, hilo_ctes, roll, wilder_ctes, SIMPLE
from checks.registry import query
from checks.sql import with_
from tidebar.operators.signals import Prepared, Strategy, register_strategy, strategy_signals
from tidebar.plans import testviews as V

# Price scale of the test ticks is 0..500, so point thresholds are small.
PARAMS = {
    "ema_pullback": {"ema_fast": 5, "ema_slow": 40, "atr_period": 14, "atr_min": 20.0, "use_adx": True, "adx_period": 14,
                     "adx_min": 10.0, "stop_points": 40, "take_points": 90},
    "breakout_range": {"lookback": 8, "min_range_points": 80, "stop_points": 40, "take_points": 90},
    "scalp_break_even": {"ema_fast": 5, "ema_slow": 18, "min_range_points": 20, "stop_points": 30, "take_points": 120,
                         "break_even_trigger_points": 20},
    "trx_htsl": {"ema_period": 20, "hilo_period": 10, "adx_period": 14, "adx_smoothing": 14, "adx_min": 8.0, "stop_points": 30,
                 "take_points": 60, "break_even_trigger_points": 20, "break_even_lock_points": 2, "hour_start": 9, "hour_end": 18,
                 "entry_start_time": "09:00", "entry_end_time": "18:00", "session_end": "20:40", "close_on_session_end": True,
                 "max_consecutive_losses_per_day": 2, "license_start_date": 1240105, "license_end_date": "2024-01-25"},
    "trx_melhor_20_02": {"ema_period": 22, "hilo_period": 9, "adx_period": 13, "adx_smoothing": 14, "adx_min": 5.0,
                         "entry_start_time": "08:00", "entry_end_time": "19:00", "max_bar_range_points": 300, "max_ema_distance_points": 90,
                         "require_adx_rising": True, "stop_points": 30, "take_points": 60, "session_end": "20:40", "close_on_session_end": True},
    "ganhador_80": {"ema_fast": 4, "ema_slow": 14, "range_min_points": 10, "stop_points": 30, "take_points": 90,
                    "entry_start_time": "03:05", "entry_end_time": "21:00"},
}

MIN = "(hour(datetime) * 60 + minute(datetime))"


def signal_sql(ctes: str, source: str, long: str, short: str, allowed: str = "true", recursive: bool = False) -> str:
    return with_("idx", extra=ctes, recursive=recursive) + f"""SELECT symbol, bar_idx, datetime,
 CAST(CASE WHEN NOT ({allowed}) THEN 0 WHEN {short} THEN -1 WHEN {long} THEN 1 ELSE 0 END AS INTEGER) AS signal FROM {source}"""


def run(spark, sf, name):
    return strategy_signals(V.indexed_bars(spark, sf), name, [PARAMS[name]]).select("symbol", "bar_idx", "datetime", "signal")


@query("g1_signal_ema_pullback", signal_sql(
    TR + ",\n" + SIMPLE + f",\nax AS (SELECT symbol, bar_idx, {roll('dx', 14)} AS adx FROM dxs), atrs AS (SELECT symbol, bar_idx, {roll('tr', 14)} AS atr FROM tr),\n"
    + ema_cte("ef", 5) + ",\n" + ema_cte("es", 40),
    "(SELECT i.*, lag(i.close) OVER (PARTITION BY i.symbol ORDER BY i.bar_idx) AS pc, ef.e AS f, es.e AS s, atr, adx FROM idx i JOIN ef USING (symbol, bar_idx) JOIN es USING (symbol, bar_idx) JOIN ax USING (symbol, bar_idx) JOIN atrs USING (symbol, bar_idx))",
    "close > s AND low <= f AND close > open AND close > pc AND close >= f AND atr >= 20 AND adx >= 10",
    "close < s AND high >= f AND close < open AND close < pc AND close <= f AND atr >= 20 AND adx >= 10", recursive=True))
def _(spark, sf):
    return run(spark, sf, "ema_pullback")


@query("g2_signal_breakout_range", signal_sql(
    """ph AS (SELECT *, CASE WHEN count(high) OVER f = 8 THEN max(high) OVER f END AS hi, CASE WHEN count(low) OVER f = 8 THEN min(low) OVER f END AS lo
 FROM idx WINDOW f AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))""",
    "ph", "close > hi AND hi - lo >= 80", "close < lo AND hi - lo >= 80"))
def _(spark, sf):
    return run(spark, sf, "breakout_range")


@query("g3_signal_scalp_break_even", signal_sql(
    ema_cte("ef", 5) + ",\n" + ema_cte("es", 18),
    "(SELECT i.*, lag(i.close) OVER (PARTITION BY i.symbol ORDER BY i.bar_idx) AS pc, ef.e AS f, es.e AS s FROM idx i JOIN ef USING (symbol, bar_idx) JOIN es USING (symbol, bar_idx))",
    "f > s AND close > f AND low <= f AND close > open AND close > pc AND high - low >= 20",
    "f < s AND close < f AND high >= f AND close < open AND close < pc AND high - low >= 20", recursive=True))
def _(spark, sf):
    return run(spark, sf, "scalp_break_even")


def trend_source(ema: int) -> str:
    return """(SELECT i.*, em.e AS ema, em.e - lag(em.e) OVER w AS slope, aw.x AS adx, aw.x - lag(aw.x) OVER w AS rise,
 CASE WHEN side > 0 THEN hl.lo ELSE hl.hi END AS hilo FROM idx i JOIN em USING (symbol, bar_idx) LEFT JOIN aw USING (symbol, bar_idx)
 LEFT JOIN hl USING (symbol, bar_idx) WINDOW w AS (PARTITION BY i.symbol ORDER BY i.bar_idx))"""


@query("g4_g8_g9_signal_trx_htsl", signal_sql(
    TR + ",\n" + wilder_ctes(14, 14) + ",\n" + hilo_ctes(10) + ",\n" + ema_cte("em", 20), trend_source(20),
    "adx >= 8 AND close > ema AND close > hilo", "adx >= 8 AND close < ema AND close < hilo",
    f"{MIN} BETWEEN 540 AND 1080 AND hour(datetime) BETWEEN 9 AND 18 AND CAST(datetime AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'", recursive=True))
def _(spark, sf):
    return run(spark, sf, "trx_htsl")


@query("g5_g7_signal_trx_melhor", signal_sql(
    TR + ",\n" + wilder_ctes(13, 14) + ",\n" + hilo_ctes(9) + ",\n" + ema_cte("em", 22), trend_source(22),
    "adx >= 5 AND rise >= 0 AND high - low <= 300 AND abs(close - ema) <= 90 AND slope > 0 AND close > ema AND close > hilo",
    "adx >= 5 AND rise >= 0 AND high - low <= 300 AND abs(close - ema) <= 90 AND slope < 0 AND close < ema AND close < hilo",
    f"{MIN} BETWEEN 480 AND 1140", recursive=True))
def _(spark, sf):
    return run(spark, sf, "trx_melhor_20_02")


@query("g6_signal_ganhador_80", signal_sql(
    ema_cte("ef", 4) + ",\n" + ema_cte("es", 14),
    "(SELECT i.*, ef.e AS f, es.e AS s, lag(ef.e) OVER w AS f0, lag(es.e) OVER w AS s0 FROM idx i JOIN ef USING (symbol, bar_idx) JOIN es USING (symbol, bar_idx) WINDOW w AS (PARTITION BY i.symbol ORDER BY i.bar_idx))",
    "f > s AND f0 <= s0 AND close > open AND close > f AND close > s AND high - low >= 10",
    "f < s AND f0 >= s0 AND close < open AND close < f AND close < s AND high - low >= 10",
    f"{MIN} BETWEEN 185 AND 1260", recursive=True))
def _(spark, sf):
    return run(spark, sf, "ganhador_80")


@query("g8_hour_window_wraps", signal_sql("", "idx", "close > open", "close < open", "hour(datetime) >= 22 OR hour(datetime) <= 3").replace(",\n\n", "\n"))
def _(spark, sf):
    register_strategy(Strategy("candle_body", lambda bars, sets, keys: Prepared(bars, F.col("close") > F.col("open"), F.col("close") < F.col("open"))))
    sets = [{"hour_start": 22, "hour_end": 3}]
    return strategy_signals(V.indexed_bars(spark, sf), "candle_body", sets).select("symbol", "bar_idx", "datetime", "signal")


@query("g10_registry_custom_strategy", with_("idx", extra="p AS (SELECT * FROM (VALUES (0::BIGINT, 60.0), (1::BIGINT, 150.0)) v(param_id, floor))")
       + "SELECT symbol, bar_idx, param_id, CAST(CASE WHEN close < 10 AND high - low >= floor THEN -1 WHEN close > 100 AND high - low >= floor THEN 1 ELSE 0 END AS INTEGER) AS signal FROM idx, p")
def _(spark, sf):
    from tidebar.operators.params import num

    def rule(bars, sets, keys):
        wide = (F.col("high") - F.col("low")) >= num("floor", 0.0)
        return Prepared(bars, (F.col("close") > 100) & wide, (F.col("close") < 10) & wide)

    register_strategy(Strategy("fade_extremes", rule))
    out = strategy_signals(V.indexed_bars(spark, sf), "fade_extremes", [{"floor": 60.0}, {"floor": 150.0}])
    return out.select("symbol", "bar_idx", "param_id", "signal")
