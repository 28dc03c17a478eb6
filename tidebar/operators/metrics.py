"""Performance metrics per group of trades and equity rows (inventory A1-A9)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import SECONDS_PER_DAY, epoch_micros, safe_div
from tidebar.functions.scans import Run, running, time_block

ROWS_PER_YEAR = 252
REJECTED_SCORE = -1e15


@dataclass(frozen=True)
class ScoreSettings:
    """Weights of the robust score."""

    drawdown_weight: float = 1.5
    min_trade_count: int = 20
    penalty_per_missing_trade: float = 150.0


# Named score presets (weight, minimum trades, penalty per missing trade).
SCORE_PRESETS = {
    "conservador": ScoreSettings(2.4, 35, 220.0),
    "equilibrado": ScoreSettings(1.5, 20, 150.0),
    "agressivo": ScoreSettings(0.9, 8, 70.0),
}

METRICS = (
    "trade_count", "win_rate", "net_profit", "gross_profit", "gross_loss", "profit_factor", "avg_trade", "expectancy",
    "payoff_ratio", "win_loss_ratio", "max_consecutive_wins", "max_consecutive_losses", "avg_trade_duration_min",
    "exposure_pct", "max_drawdown", "max_drawdown_pct", "return_pct", "recovery_factor", "monthly_return_mean_pct",
    "monthly_return_std_pct", "positive_months_pct", "sharpe_like", "score",
)


def seconds_between(later: str, earlier: str) -> Column:
    return (epoch_micros(F.col(later)) - epoch_micros(F.col(earlier))) / F.lit(1e6)


def profit_factor(gain: Column, loss: Column, unlimited: float = 0.0) -> Column:
    """|gain / loss|; without losses ``unlimited`` when there is a gain, else 0."""
    return F.when(loss < 0, F.abs(gain / loss)).when(gain > 0, F.lit(unlimited)).otherwise(F.lit(0.0))


def trade_stats(trades: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts, sums and ratios of closed trades; one map-side combined aggregation."""
    pnl, win, loss = F.col("pnl_net"), F.col("pnl_net") > 0, F.col("pnl_net") < 0
    held = F.greatest(F.coalesce(seconds_between("exit_time", "entry_time"), F.lit(0.0)), F.lit(0.0))
    raw = trades.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(win).alias("wins"),
        F.count_if(loss).alias("losses"),
        F.sum(pnl).alias("net_profit"),
        F.coalesce(F.sum(F.when(win, pnl)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(loss, pnl)), F.lit(0.0)).alias("gross_loss"),
        F.avg(pnl).alias("expectancy"),
        F.avg(seconds_between("exit_time", "entry_time")).alias("avg_seconds"),
        F.sum(held).alias("held_seconds"),
    )
    mean_win = safe_div(F.col("gross_profit"), F.col("wins").cast("double"))
    mean_loss = safe_div(F.col("gross_loss"), F.col("losses").cast("double"))
    return raw.select(
        *group,
        F.col("n").cast("double").alias("trade_count"),
        (F.col("wins") / F.col("n")).alias("win_rate"),
        "net_profit", "gross_profit", "gross_loss",
        profit_factor(F.col("gross_profit"), F.col("gross_loss")).alias("profit_factor"),
        F.col("expectancy").alias("avg_trade"), "expectancy",
        F.when(mean_loss < 0, mean_win / F.abs(mean_loss)).otherwise(F.lit(0.0)).alias("payoff_ratio"),
        F.when(F.col("losses") > 0, F.col("wins") / F.col("losses")).otherwise(F.col("wins").cast("double")).alias("win_loss_ratio"),
        F.coalesce(F.col("avg_seconds") / 60.0, F.lit(0.0)).alias("avg_trade_duration_min"),
        "held_seconds",
    )


def streaks(trades: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Longest runs of wins and of losses; a flat trade ends both.

    Wins between two non-wins share the running count of non-wins, so runs are counted by a combined
    aggregation on that number instead of a walk over the whole group.
    """
    pnl = F.col("pnl_net")
    win, loss = F.coalesce(pnl > 0, F.lit(False)), F.coalesce(pnl < 0, F.lit(False))
    one = lambda c: F.when(c, F.lit(0)).otherwise(F.lit(1)).cast("long")
    marked = running(
        trades.select(*dict.fromkeys([*group, *order, "pnl_net"])), group, order, time_block(F.col(order[0])),
        [Run("_w", "sum", one(win)), Run("_l", "sum", one(loss))],
    )
    runs = marked.select(*group, F.explode(F.array_compact(F.array(
        F.when(win, F.struct(F.lit(1).alias("side"), F.col("_w").alias("id"))),
        F.when(loss, F.struct(F.lit(-1).alias("side"), F.col("_l").alias("id"))),
    ))).alias("r"))
    sizes = runs.groupBy(*group, "r.side", "r.id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("side") > 0, F.col("n"))), F.lit(0)).cast("double").alias("max_consecutive_wins"),
        F.coalesce(F.max(F.when(F.col("side") < 0, F.col("n"))), F.lit(0)).cast("double").alias("max_consecutive_losses"),
    )


def equity_stats(equity: DataFrame, group: Sequence[str], order: Sequence[str] = ("datetime",), block: Column | None = None) -> DataFrame:
    """Drawdown, return ratio and monthly returns of an equity curve, reduced by month and then by group."""
    block = block if block is not None else time_block(F.col("datetime"), 7 * SECONDS_PER_DAY)
    slim = equity.select(*dict.fromkeys([*group, *order, "datetime", "equity"]))
    scanned = running(
        slim, group, order, block, [Run("_peak", "max", F.col("equity")), Run("_prev", "prev", F.col("equity"))]
    )
    ret = F.try_divide(F.col("equity") - F.col("_prev"), F.col("_prev"))
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    months = scanned.groupBy(*group, F.trunc(F.col("datetime").cast("date"), "month").alias("_month")).agg(
        F.max(F.col("_peak") - F.col("equity")).alias("dd"),
        F.max("equity").alias("top"),
        F.count(F.lit(1)).alias("rows"),
        F.count(ret).alias("n"),
        F.sum(ret).alias("s1"),
        F.sum(ret * ret).alias("s2"),
        F.min("datetime").alias("lo"),
        F.max("datetime").alias("hi"),
        F.max_by("equity", position).alias("last"),
        F.min_by("equity", position).alias("first"),
    )
    by_month = Window.partitionBy(*group).orderBy("_month")
    monthly = F.try_divide(F.col("last") - F.lag("last").over(by_month), F.lag("last").over(by_month))
    total = months.withColumn("_mr", monthly).groupBy(*group).agg(
        F.greatest(F.max("dd"), F.lit(0.0)).alias("max_drawdown"),
        F.max("top").alias("equity_peak"),
        F.min_by("first", "_month").alias("first_equity"),
        F.max_by("last", "_month").alias("last_equity"),
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
        F.min("lo").alias("first_time"),
        F.max("hi").alias("last_time"),
        (F.coalesce(F.avg("_mr"), F.lit(0.0)) * 100.0).alias("monthly_return_mean_pct"),
        (F.coalesce(F.stddev_samp("_mr"), F.lit(0.0)) * 100.0).alias("monthly_return_std_pct"),
        (safe_div(F.count_if(F.col("_mr") > 0).cast("double"), F.count("_mr").cast("double")) * 100.0).alias("positive_months_pct"),
    )
    n = F.col("n").cast("double")
    variance = F.greatest(F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / n, n - 1.0), F.lit(0.0))
    sharpe = F.when(F.col("rows") < 3, F.lit(0.0)).otherwise(
        safe_div(F.col("s1") / n, F.nullif(F.sqrt(variance), F.lit(0.0))) * F.lit(math.sqrt(ROWS_PER_YEAR))
    )
    return total.select(
        *group, "max_drawdown", "equity_peak", "first_equity", "last_equity", "first_time", "last_time",
        F.when(F.col("n") > 0, sharpe).otherwise(F.lit(0.0)).alias("sharpe_like"),
        "monthly_return_mean_pct", "monthly_return_std_pct", "positive_months_pct",
    )


def robust_score(net: Column, drawdown: Column, count: Column, score: ScoreSettings) -> Column:
    missing = F.greatest(F.lit(float(score.min_trade_count)) - count, F.lit(0.0))
    return net - F.lit(score.drawdown_weight) * drawdown - missing * F.lit(score.penalty_per_missing_trade)


def performance(
    trades: DataFrame,
    equity: DataFrame,
    group: Sequence[str],
    capital: float | DataFrame,
    score: ScoreSettings = ScoreSettings(),
    trade_order: Sequence[str] = ("exit_time",),
    equity_order: Sequence[str] = ("datetime",),
) -> DataFrame:
    """The full metric row of every group that has equity; groups without trades get zeros.

    ``capital`` is one number or a table (group columns, capital).
    """
    joined = (
        equity_stats(equity, group, equity_order)
        .join(trade_stats(trades, group), list(group), "left")
        .join(streaks(trades, group, trade_order), list(group), "left")
    )
    if isinstance(capital, DataFrame):
        joined, start = joined.join(capital, list(group)), F.col("capital")
    else:
        start = F.lit(float(capital))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    span = seconds_between("last_time", "first_time")
    net, dd, count = zero("net_profit"), F.col("max_drawdown"), zero("trade_count")
    derived = {
        "net_profit": net,
        "exposure_pct": F.when(span > 0, F.least(F.greatest(100.0 * zero("held_seconds") / span, F.lit(0.0)), F.lit(100.0))).otherwise(F.lit(0.0)),
        "max_drawdown": dd,
        "max_drawdown_pct": F.when(start > 0, 100.0 * dd / start).otherwise(F.lit(0.0)),
        "return_pct": safe_div(100.0 * net, start),
        "recovery_factor": F.when(dd > 0, net / dd).otherwise(F.lit(0.0)),
        "score": robust_score(net, dd, count, score),
    }
    return joined.select(*group, *[(derived[m] if m in derived else zero(m)).alias(m) for m in METRICS])


def worst_daily(trades: DataFrame, group: Sequence[str]) -> DataFrame:
    days = trades.groupBy(*group, F.col("exit_time").cast("date").alias("_day")).agg(F.sum("pnl_net").alias("_net"))
    return days.groupBy(*group).agg(F.min("_net").alias("worst_daily_pnl"))


def apply_hard_limits(
    metrics: DataFrame, trades: DataFrame, group: Sequence[str], max_daily_loss: float = 0.0, max_drawdown_pct: float = 0.0
) -> DataFrame:
    """Reject groups whose worst day or drawdown is beyond the limits (score -1e15)."""
    joined = metrics.join(worst_daily(trades, group), list(group), "left")
    worst = F.coalesce("worst_daily_pnl", F.lit(0.0))
    broken = F.lit(False)
    if max_daily_loss > 0:
        broken = broken | (worst < -abs(max_daily_loss))
    if max_drawdown_pct > 0:
        broken = broken | (F.col("max_drawdown_pct") > max_drawdown_pct)
    return joined.select(
        *[c for c in metrics.columns if c != "score"],
        F.when(broken, F.lit(REJECTED_SCORE)).otherwise(F.col("score")).alias("score"),
        worst.alias("worst_daily_pnl"), F.when(broken, 0.0).otherwise(1.0).alias("constraints_ok"),
    )
