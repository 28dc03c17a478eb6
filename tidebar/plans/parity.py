"""Fixed-parameter runs: parity with a broker platform, and day-by-day tick validation (inventory T17, T18)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import exits as X
from tidebar.operators.bars import SERIES, assign_ticks, tick_day_coverage, ticks_to_bars
from tidebar.operators.metrics import ScoreSettings, performance
from tidebar.operators.params import ExecutionSettings, params_frame
from tidebar.operators.reports import operations_table, performance_summary
from tidebar.operators.trades import equity_curve, run_trades
from tidebar.session import materialize

# The reference parameter set of the parity run.
REFERENCE_PARAMS: dict[str, Any] = {
    "ema_period": 20, "hilo_period": 10, "adx_period": 14, "adx_smoothing": 14, "adx_min": 20.0,
    "stop_points": 300.0, "take_points": 600.0, "break_even_trigger_points": 190.0, "break_even_lock_points": 10.0,
    "hour_start": 9, "hour_end": 12, "entry_start_time": "09:00", "entry_end_time": "12:00",
    "session_end": "17:40", "close_on_session_end": True, "max_consecutive_losses_per_day": 20,
    "license_start_date": 1250208, "license_end_date": 1260321,
}
PARITY_SCORE = ScoreSettings(drawdown_weight=1.5, min_trade_count=0, penalty_per_missing_trade=0.0)


@dataclass(frozen=True)
class Parity:
    params: dict[str, Any]
    trades: DataFrame
    equity: DataFrame
    metrics: DataFrame
    summary: DataFrame
    operations: DataFrame


def run_parity(
    indexed: DataFrame, base: ExecutionSettings, override: Mapping[str, Any] | None = None, keys: Sequence[str] = SERIES
) -> Parity:
    """One parameter set over all series, scored without the trade-count penalty."""
    params = {**REFERENCE_PARAMS, **(override or {})}
    bars = materialize(indexed)
    group = [*keys, "param_id"]
    trades = materialize(run_trades(bars, "trx_htsl", [params], base, keys))
    equity = materialize(equity_curve(trades, bars, params_frame(bars.sparkSession, [params]).select("param_id"), base, keys))
    return Parity(
        params, trades, equity,
        performance(trades, equity, group, base.initial_capital, PARITY_SCORE),
        performance_summary(trades, equity, group, base.initial_capital, base.contracts),
        operations_table(trades, group, base.initial_capital, base.contracts),
    )


def validate_days(
    ticks: DataFrame,
    bars: DataFrame,
    listed_days: DataFrame,
    strategy: str,
    params: Mapping[str, Any],
    base: ExecutionSettings,
    by_tick: bool = True,
    score: ScoreSettings = ScoreSettings(),
    timeframe: str | None = None,
) -> DataFrame:
    """Each (symbol, day) as a run of its own: status, ticks and metrics.

    The day joins the series key, so indicators, positions and capital start afresh every morning and all
    days of all symbols run in one plan. Given a ``timeframe``, a day without bars takes those its own ticks make.
    """
    day = F.col("datetime").cast("date")
    keys = [*SERIES, "day"]
    bars = bars.withColumn("day", day)
    if timeframe:
        made = ticks_to_bars(ticks.withColumn("day", day), timeframe, ("symbol", "day"))
        bars = bars.unionByName(made.join(bars.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("datetime")
    sliced = materialize(bars.withColumn("bar_idx", (F.row_number().over(w) - 1).cast("long")))
    path = None
    if by_tick:
        owned = assign_ticks(ticks.withColumn("day", day), sliced, by=("symbol", "day"), label=("timeframe",))
        path = X.tick_path(sliced, owned, keys)
    trades = run_trades(sliced, strategy, [params], base, keys, path=path, by_tick=by_tick)
    group = [*keys, "param_id"]
    ids = params_frame(bars.sparkSession, [params]).select("param_id")
    equity = equity_curve(trades, sliced, ids, base, keys)
    metrics = performance(trades, equity, group, base.initial_capital, score)
    status = tick_day_coverage(ticks, sliced, listed_days)
    zero = lambda c: F.when(F.col("status") == "ok", F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
    return status.join(metrics, ["symbol", "day"], "left").select(
        "symbol", "day", "status", "ticks", *[zero(c) for c in ("trade_count", "net_profit", "win_rate", "max_drawdown", "score", "profit_factor")]
    )


def validation_totals(days: DataFrame) -> DataFrame:
    """Per symbol and overall (null symbol): days, ok days, net, mean day and share of positive days."""
    ok = F.col("status") == "ok"
    net = F.when(ok, F.col("net_profit"))
    return days.rollup("symbol").agg(
        F.count(F.lit(1)).alias("total_days"), F.count_if(ok).alias("ok_days"), F.coalesce(F.sum(net), F.lit(0.0)).alias("net_profit"),
        F.coalesce(F.avg(net), F.lit(0.0)).alias("mean_day"),
        F.coalesce(F.avg(F.when(ok, (F.col("net_profit") > 0).cast("double"))) * 100.0, F.lit(0.0)).alias("positive_days_pct"),
    )
