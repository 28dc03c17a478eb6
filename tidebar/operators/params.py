"""Parameter sets and execution settings as tables (inventory W1-W3, T16).

A parameter set is a ``map<string,string>``; its canonical text is JSON with sorted keys.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import hhmm_seconds

MAX_PARAM_SETS = 50_000      # sets that may be brought to the driver at once; tables of sets have no limit


@dataclass(frozen=True)
class ExecutionSettings:
    """Entry, exit, cost and guard settings of a run; parameter sets may override some of them."""

    # Names and defaults of the settings.
    initial_capital: float = 100_000.0
    contracts: int = 1
    point_value: float = 0.2
    slippage_points: float = 0.0
    slippage_model: str = "fixed"               # fixed | range_scaled
    slippage_range_factor: float = 0.0
    open_auction_minutes: int = 0
    open_auction_slippage_multiplier: float = 1.0
    fixed_cost_per_trade: float = 0.0
    cost_per_contract: float = 0.0
    cost_model: str = "fixed"                   # fixed | range_scaled
    cost_range_factor: float = 0.0
    open_auction_cost_multiplier: float = 1.0
    stop_points: float = 300.0
    take_points: float = 600.0
    break_even_trigger_points: float = 0.0
    break_even_lock_points: float = 0.0
    allow_long: bool = True
    allow_short: bool = True
    max_positions: int = 1
    entry_mode: str = "next_open"               # next_open | close_slippage
    session_start: str | None = None
    session_end: str | None = None
    close_on_session_end: bool = False
    max_consecutive_losses_per_day: int = 0
    enable_daily_limits: bool = False
    daily_loss_limit: float = 0.0
    daily_profit_target: float = 0.0

    def but(self, **changes: Any) -> "ExecutionSettings":
        return replace(self, **changes)


SETTING_COLUMNS = (
    "stop_points", "take_points", "be_trigger", "be_lock", "session_start_sec", "session_end_sec",
    "flatten", "max_losses", "daily_limits", "loss_limit", "profit_target",
)


def canonical_json(params: Mapping[str, Any]) -> str:
    return json.dumps(params, sort_keys=True)


def param_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def params_frame(spark: SparkSession, sets: Sequence[Mapping[str, Any]]) -> DataFrame:
    """(param_id, params, params_json) in the order given."""
    schema = "param_id bigint, params map<string,string>, params_json string"
    rows = [(i, {k: param_text(v) for k, v in p.items()}, canonical_json(p)) for i, p in enumerate(sets)]
    return spark.createDataFrame(rows, schema)


def num(key: str, default: Column | float | None = None) -> Column:
    """Numeric parameter or its default."""
    value = F.try_element_at("params", F.lit(key)).try_cast("double")
    if default is None:
        return value
    return F.coalesce(value, F.lit(default) if not isinstance(default, Column) else default)


def text(key: str, default: str | None = None) -> Column:
    value = F.try_element_at("params", F.lit(key))
    return F.coalesce(value, F.lit(default)) if default is not None else value


def flag(key: str, default: bool) -> Column:
    """Boolean parameter; any non-empty text other than false/0 counts as true."""
    raw = F.lower(F.trim(text(key)))
    return F.when(raw.isNull(), F.lit(default)).otherwise(~raw.isin("false", "0", "0.0", ""))


def with_settings(params: DataFrame, base: ExecutionSettings) -> DataFrame:
    """Attach the effective execution settings of each parameter set (clamped, defaults from ``base``)."""
    nonneg = lambda c: F.greatest(c, F.lit(0.0))
    be_trigger = nonneg(num("break_even_trigger_points", base.break_even_trigger_points))
    be_lock = nonneg(num("break_even_lock_points", base.break_even_lock_points))
    has = lambda key: F.try_element_at("params", F.lit(key)).isNotNull()
    session = lambda key, fallback: F.when(has(key), hhmm_seconds(text(key))).otherwise(
        hhmm_seconds(F.lit(fallback).cast("string"))
    )
    limit = lambda key, fallback: F.coalesce(nonneg(num(key)), F.lit(max(0.0, fallback)))
    return params.withColumns(
        {
            "stop_points": num("stop_points", base.stop_points),
            "take_points": num("take_points", base.take_points),
            "be_trigger": be_trigger,
            "be_lock": be_lock,
            "session_start_sec": session("session_start", base.session_start).cast("int"),
            "session_end_sec": session("session_end", base.session_end).cast("int"),
            "flatten": flag("close_on_session_end", base.close_on_session_end),
            "max_losses": F.coalesce(
                F.greatest(num("max_consecutive_losses_per_day"), F.lit(0.0)),
                F.lit(float(max(0, base.max_consecutive_losses_per_day))),
            ).cast("int"),
            "daily_limits": flag("enable_daily_limits", base.enable_daily_limits),
            "loss_limit": limit("daily_loss_limit", base.daily_loss_limit),
            "profit_target": limit("daily_profit_target", base.daily_profit_target),
        }
    )


def collect_sets(bank: DataFrame, column: str = "params_json", limit: int = MAX_PARAM_SETS) -> list[dict[str, Any]]:
    """Bring a bounded list of parameter sets to the driver (they shape the plan of a sweep)."""
    rows = bank.select(column).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} parameter sets")
    return [json.loads(r[0]) for r in rows]
