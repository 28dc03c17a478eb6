"""Prices, costs and P&L of trades, the whole labelling chain, and equity (inventory T2, T11-T17)."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import day_number
from tidebar.functions.scans import BLOCK_ROWS, Run, running
from tidebar.operators import exits as X
from tidebar.operators.bars import SERIES, candle_range
from tidebar.operators.entries import auction_flag, entry_candidates, slippage_points, with_next_bar
from tidebar.operators.params import ExecutionSettings
from tidebar.operators.selection import BLOCK_DAYS, select_trades
from tidebar.operators.signals import Strategy, strategy_signals
from tidebar.session import settled


def trade_costs(entry_range: Column, exit_range: Column, auction: Column, base: ExecutionSettings) -> Column:
    """Fixed and per-contract cost, plus range impact, scaled when a fill was in the open auction."""
    cost = F.lit(base.fixed_cost_per_trade + base.cost_per_contract * base.contracts)
    if base.cost_model == "range_scaled":
        mean = F.greatest(F.lit(0.0), (entry_range + exit_range) / 2.0)
        cost = cost + mean * F.lit(max(base.cost_range_factor, 0.0) * base.point_value * base.contracts)
    if base.open_auction_minutes > 0:
        cost = F.when(auction, cost * F.lit(max(base.open_auction_cost_multiplier, 0.0))).otherwise(cost)
    return F.greatest(cost, F.lit(0.0))


def price_exits(exited: DataFrame, base: ExecutionSettings) -> DataFrame:
    """Exit price after slippage, points, gross, costs, net and duration of each row."""
    auction = auction_flag(F.col("exit_time"), F.col("session_start_sec"), base)
    slipped = F.col("raw_exit") - F.col("side") * slippage_points(F.col("exit_range"), auction, base)
    out = exited.withColumn("exit_price", slipped)
    out = out.withColumn("pnl_points", (F.col("exit_price") - F.col("entry_price")) * F.col("side"))
    out = out.withColumn("pnl_gross", F.col("pnl_points") * F.lit(base.point_value) * F.lit(base.contracts))
    cost = trade_costs(F.col("entry_range"), F.col("exit_range"), auction | F.col("entry_auction"), base)
    out = out.withColumn("costs", cost)
    return out.withColumns(
        {
            "pnl_net": F.col("pnl_gross") - F.col("costs"),
            "duration_bars": F.greatest(F.lit(1), F.col("exit_idx") - F.col("entry_idx") + 1).cast("long"),
        }
    )


def labelled_candidates(
    indexed: DataFrame,
    strategy: Strategy | str,
    sets: Sequence[Mapping[str, Any]],
    base: ExecutionSettings,
    keys: Sequence[str] = SERIES,
    path: DataFrame | None = None,
    by_tick: bool = False,
    params: DataFrame | None = None,
    restrict: Sequence[str] | None = None,
) -> DataFrame:
    """Every tradable signal with its own exit and P&L."""
    indexed = settled(indexed)
    framed = with_next_bar(indexed, keys)
    signals = strategy_signals(framed, strategy, sets, keys, base, only_entries=True, params=params, restrict=restrict)
    candidates = entry_candidates(signals, base)
    break_even = base.break_even_trigger_points > 0 or any(
        "break_even_trigger_points" in p and float(p["break_even_trigger_points"]) > 0 for p in sets
    )
    walk = path if path is not None else X.bar_path(indexed, keys)
    return price_exits(X.first_exit(candidates, walk, keys, break_even, by_tick), base)


def admitted_trades(
    indexed: DataFrame,
    strategy: Strategy | str,
    sets: Sequence[Mapping[str, Any]],
    base: ExecutionSettings,
    keys: Sequence[str] = SERIES,
    group: Sequence[str] | None = None,
    path: DataFrame | None = None,
    by_tick: bool = False,
    params: DataFrame | None = None,
    restrict: Sequence[str] | None = None,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Candidates that became trades, with all their pricing inputs."""
    group = list(group) if group else [*keys, "param_id"]
    priced = labelled_candidates(indexed, strategy, sets, base, keys, path, by_tick, params, restrict)
    chosen = select_trades(priced, group, base.max_positions, block_days)
    return _flattened(chosen, indexed, keys, base) if base.max_positions > 1 else chosen


def run_trades(
    indexed: DataFrame,
    strategy: Strategy | str,
    sets: Sequence[Mapping[str, Any]],
    base: ExecutionSettings,
    keys: Sequence[str] = SERIES,
    group: Sequence[str] | None = None,
    **options: Any,
) -> DataFrame:
    """Signals to trades for all series and parameter sets in one plan (options of :func:`admitted_trades`)."""
    group = list(group) if group else [*keys, "param_id"]
    chosen = admitted_trades(indexed, strategy, sets, base, keys, group, **options)
    return trade_columns(chosen, group, strategy if isinstance(strategy, str) else strategy.name)


def _flattened(chosen: DataFrame, indexed: DataFrame, keys: Sequence[str], base: ExecutionSettings) -> DataFrame:
    """Re-price positions that a daily limit closed, at that bar's close."""
    bars = indexed.select(
        *keys, F.col("bar_idx").alias("flat_idx"), F.col("datetime").alias("_t"), F.col("close").alias("_c"), candle_range().alias("_r")
    )
    joined = chosen.join(bars, [*keys, "flat_idx"], "left")
    hit = F.col("_t").isNotNull()
    swap = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    moved = joined.withColumns(
        {
            "exit_idx": swap(F.col("flat_idx"), "exit_idx"), "exit_time": swap(F.col("_t"), "exit_time"),
            "exit_range": swap(F.col("_r"), "exit_range"), "raw_exit": swap(F.col("_c"), "raw_exit"),
            "exit_reason": swap(F.lit("daily_limit"), "exit_reason"), "exit_day": swap(day_number(F.col("_t")), "exit_day"),
        }
    ).drop("_t", "_c", "_r")
    return price_exits(moved, base)


def trade_columns(chosen: DataFrame, group: Sequence[str], strategy: str) -> DataFrame:
    extra = [c for c in ("params_json",) if c in chosen.columns and c not in group]
    return chosen.select(
        *group, *extra, F.lit(strategy).alias("strategy"), "sig_idx", "entry_idx", "exit_idx", "entry_time", "exit_time",
        F.when(F.col("side") > 0, "long").otherwise("short").alias("direction"), "entry_price", "exit_price",
        "pnl_points", "pnl_gross", "costs", "pnl_net", "duration_bars", "exit_reason",
    )


def held_bars(trades: DataFrame, group: Sequence[str], first: Column, last: Column, *columns: Any) -> DataFrame:
    """One row per trade and bar from ``first`` to ``last``: exactly the bars it is open, to be joined on their index."""
    return trades.where(first <= last).select(*group, *columns, F.explode(F.sequence(first, last)).alias("bar_idx"))


def equity_curve(
    trades: DataFrame,
    indexed: DataFrame,
    groups: DataFrame,
    base: ExecutionSettings,
    keys: Sequence[str] = SERIES,
    group: Sequence[str] | None = None,
    dense: bool = True,
    restrict: Sequence[str] | None = None,
) -> DataFrame:
    """Cash and equity at each bar close for every group (series x parameter set).

    ``groups`` lists the parameter rows; with ``restrict`` they belong to certain series and are joined on
    those columns, otherwise every series meets every row. ``dense=False`` keeps the first bar and the bars that hold or close a position: between those
    equity is flat, so drawdown and returns lose nothing while a sweep avoids bars x sets rows.
    """
    keys = list(keys)
    group = list(group) if group else [*keys, "param_id"]
    start = F.lit(base.initial_capital)
    scale = F.lit(base.point_value) * F.lit(base.contracts)
    side = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    chunk = F.floor(F.col("bar_idx") / F.lit(BLOCK_ROWS)).cast("long")
    held = held_bars(trades, group, F.col("entry_idx"), F.col("exit_idx") - 1, "entry_price", side.alias("_side"))
    marks = indexed.select(*keys, "bar_idx", "close")
    open_rows = held.join(marks, [*keys, "bar_idx"]).select(
        *group, "bar_idx", ((F.col("close") - F.col("entry_price")) * F.col("_side") * scale).alias("floating"), F.lit(0.0).alias("net"))
    closed = trades.select(*group, F.col("exit_idx").alias("bar_idx"), F.lit(0.0).alias("floating"), F.col("pnl_net").alias("net"))
    events = open_rows.unionByName(closed).groupBy(*group, "bar_idx").agg(
        F.sum("floating").alias("floating"), F.sum("net").alias("net")
    )
    skeleton = indexed if dense else indexed.where(F.col("bar_idx") == 0)
    lines = skeleton.select(*keys, "bar_idx", "datetime")
    lines = lines.join(groups, list(restrict)) if restrict else lines.crossJoin(groups)
    if dense:
        rows = lines.select(*group, "bar_idx", "datetime", F.lit(None).cast("double").alias("floating"), F.lit(0.0).alias("net"), F.lit(1).alias("_bar"))
        steps = events.select(*group, "bar_idx", F.lit(None).cast("timestamp_ntz").alias("datetime"), "floating", "net", F.lit(0).alias("_bar"))
        union = rows.unionByName(steps)
        scanned = running(
            union, group, ["bar_idx", "_bar"], chunk,
            [Run("_net", "sum", F.col("net")), Run("_before", "prev", F.struct("bar_idx", "floating"))],
        ).where(F.col("_bar") == 1)
        same = F.col("_before.bar_idx") == F.col("bar_idx")
        floating = F.coalesce(F.when(same, F.col("_before.floating")), F.lit(0.0))
    else:
        first = lines.select(*group, "bar_idx", F.lit(0.0).alias("floating"), F.lit(0.0).alias("net"))
        merged = events.unionByName(first).groupBy(*group, "bar_idx").agg(F.sum("floating").alias("floating"), F.sum("net").alias("net"))
        scanned = running(merged, group, ["bar_idx"], chunk, [Run("_net", "sum", F.col("net"))])
        floating = F.col("floating")
    cash = start + F.col("_net")
    time = ["datetime"] if dense else []
    return scanned.select(*group, "bar_idx", *time, (cash + floating).alias("equity"), cash.alias("cash"))
