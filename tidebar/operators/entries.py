"""From signals to priced entry candidates (inventory T1-T3, T14 inputs)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import day_number
from tidebar.operators import indicators as I
from tidebar.operators.bars import candle_range, in_open_auction, in_session
from tidebar.operators.params import ExecutionSettings


def with_next_bar(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add time, open and range of the following bar (null on the last bar)."""
    lead = lambda c: (lambda w: F.lead(c, 1).over(w))
    return I.over_bars(
        indexed, keys, 0,
        [{"next_time": lead("datetime"), "next_open": lead("open"),
          "next_range": lambda w: F.lead(candle_range(), 1).over(w)}],
        ahead=1,
    )


def slippage_points(rng: Column, auction: Column, base: ExecutionSettings) -> Column:
    """Adverse points of one fill: fixed, plus a share of the bar range, scaled in the open auction."""
    points = F.lit(max(0.0, base.slippage_points))
    if base.slippage_model == "range_scaled":
        points = points + rng * F.lit(max(0.0, base.slippage_range_factor))
    if base.open_auction_minutes > 0:
        points = F.when(auction, points * F.lit(max(0.0, base.open_auction_slippage_multiplier))).otherwise(points)
    return F.greatest(points, F.lit(0.0))


def auction_flag(ts: Column, session_start_sec: Column, base: ExecutionSettings) -> Column:
    return in_open_auction(ts, session_start_sec, F.lit(base.open_auction_minutes))


def entry_candidates(signals: DataFrame, base: ExecutionSettings) -> DataFrame:
    """One row per tradable signal with entry bar, entry price and barriers.

    ``signals`` needs bar columns, :func:`with_next_bar` columns and the settings columns of
    :func:`tidebar.operators.params.with_settings`. ``first_idx`` is the first bar that can end the trade.
    """
    wanted = F.lit(False)
    if base.allow_long:
        wanted = wanted | (F.col("signal") > 0)
    if base.allow_short:
        wanted = wanted | (F.col("signal") < 0)
    live = signals.where((F.col("signal") != 0) & wanted)
    if base.entry_mode == "next_open":
        live = live.where(F.col("next_time").isNotNull())
        when, price, rng = F.col("next_time"), F.col("next_open"), F.col("next_range")
        entry_idx = F.col("bar_idx") + 1
        first_idx = entry_idx
    elif base.entry_mode == "close_slippage":
        when, price, rng, entry_idx = F.col("datetime"), F.col("close"), candle_range(), F.col("bar_idx")
        first_idx = entry_idx + 1
    else:
        raise ValueError(base.entry_mode)
    live = live.where(in_session(when, F.col("session_start_sec"), F.col("session_end_sec")))
    side = F.col("signal").cast("int")
    auction = auction_flag(when, F.col("session_start_sec"), base)
    filled = price + side * slippage_points(rng, auction, base)
    passed = [c for c in signals.columns if c not in (
        "open", "high", "low", "close", "volume", "datetime", "bar_idx", "next_time", "next_open", "next_range", "signal")]
    priced = live.select(
        *passed,
        F.col("bar_idx").alias("sig_idx"),
        day_number(F.col("datetime")).alias("sig_day"),
        side.alias("side"),
        entry_idx.alias("entry_idx"),
        first_idx.alias("first_idx"),
        when.alias("entry_time"),
        filled.alias("entry_price"),
        rng.alias("entry_range"),
        auction.alias("entry_auction"),
    )
    return priced.withColumns(
        {
            "stop_price": F.col("entry_price") - F.col("side") * F.col("stop_points"),
            "take_price": F.col("entry_price") + F.col("side") * F.col("take_points"),
        }
    )

