"""Entry signals of the six strategies over bars x parameter sets (inventory G).

The indicators for all distinct periods of a sweep are columns of one bars frame; parameter sets are then
joined by broadcast and pick their periods by position. Bars are never shuffled once per parameter set.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import clamped_hhmm_minutes, is_true, loose_date, minute_of_day
from tidebar.operators import indicators as I
from tidebar.operators.bars import SERIES
from tidebar.operators.params import ExecutionSettings, flag, num, params_frame, text, with_settings

ParamSet = Mapping[str, Any]


@dataclass(frozen=True)
class Prepared:
    """Bars with indicator columns plus the parameter-side expressions that select among them."""

    bars: DataFrame
    long: Column
    short: Column
    param_columns: Mapping[str, Column] = field(default_factory=dict)


class ParamSide:
    """Expressions over the parameter map, computed once per parameter set before it meets the bars.

    Calling it registers an expression and returns the column that will hold it, so the row-by-row part of a
    sweep compares plain numbers.
    """

    def __init__(self) -> None:
        self.columns: dict[str, Column] = {}

    def __call__(self, expression: Column) -> Column:
        name = f"_p{len(self.columns)}"
        self.columns[name] = expression
        return F.col(name)

    def pick(self, prefix: str, values: Sequence[Any], selector: Column) -> Column:
        """The prepared column ``<prefix><value>`` whose value equals ``selector``."""
        if len(values) == 1:
            return F.col(f"{prefix}{values[0]}")
        position = self((F.array_position(F.array(*[F.lit(v) for v in values]), selector) - 1).cast("int"))
        return F.get(F.col(f"{prefix}all"), position)


@dataclass(frozen=True)
class Strategy:
    """A named rule. ``prepare(bars, sets, keys)`` returns the two entry predicates.

    Predicates may use bar columns, prepared indicator columns and the ``params`` map of a parameter set.
    ``minute_window`` holds the default entry window of rules that have one.
    """

    name: str
    prepare: Callable[[DataFrame, Sequence[ParamSet], Sequence[str]], Prepared]
    minute_window: tuple[str, str] | None = None


def _ints(sets: Sequence[ParamSet], key: str, default: int | None, floor: int = 1) -> list[int]:
    values = set()
    for p in sets:
        raw = p.get(key, default)
        if raw is None:
            raise KeyError(f"parameter {key} is required")
        values.add(max(floor, int(raw)))
    return sorted(values)


def pack(df: DataFrame, prefix: str, values: Sequence[Any]) -> DataFrame:
    """Fold the columns of several periods into one array column."""
    if len(values) == 1:
        return df
    names = [f"{prefix}{v}" for v in values]
    return df.withColumn(f"{prefix}all", F.array(*[F.col(n) for n in names])).drop(*names)


def _period(key: str, default: int | None, floor: int = 1) -> Column:
    value = num(key, None if default is None else float(default)).cast("int")
    return F.greatest(value, F.lit(floor))


def _with_ema(bars: DataFrame, spans: Sequence[int], keys: Sequence[str]) -> DataFrame:
    return pack(I.ema(bars, spans, keys), "ema_", spans)


def _with_previous(bars: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    return I.over_bars(bars, keys, 1, [{out: I.lag1(src) for out, src in columns.items()}])


def ema_pullback(bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str]) -> Prepared:
    side = ParamSide()
    spans = sorted(set(_ints(sets, "ema_fast", None)) | set(_ints(sets, "ema_slow", None)))
    atrs = _ints(sets, "atr_period", None)
    adxs = _ints(sets, "adx_period", 14)
    frame = I.over_bars(
        bars, keys, max(max(atrs) + 1, 2 * max(adxs) + 1),
        [{"prev_close": I.lag1("close"), **I._simple_adx_stages(adxs)[0]},
         {**{f"atr_{n}": I.rolling_mean("_tr", n) for n in atrs}, **I._simple_adx_stages(adxs)[1]},
         *I._simple_adx_stages(adxs)[2:]],
    ).select(*bars.columns, "prev_close", *[f"atr_{n}" for n in atrs], *[f"adx_{n}" for n in adxs])
    frame = _with_ema(pack(pack(frame, "atr_", atrs), "adx_", adxs), spans, keys)
    fast, slow = side.pick("ema_", spans, _period("ema_fast", None)), side.pick("ema_", spans, _period("ema_slow", None))
    atr, adx = side.pick("atr_", atrs, _period("atr_period", None)), side.pick("adx_", adxs, _period("adx_period", 14))
    close, open_ = F.col("close"), F.col("open")
    floor, adx_off, adx_min = side(num("atr_min", 0.0)), side(~flag("use_adx", False)), side(num("adx_min", 20.0))
    strong = is_true((floor <= 0) | (atr >= floor)) & is_true(adx_off | (adx >= adx_min))
    long = (close > slow) & (F.col("low") <= fast) & (close > open_) & (close > F.col("prev_close")) & (close >= fast)
    short = (close < slow) & (F.col("high") >= fast) & (close < open_) & (close < F.col("prev_close")) & (close <= fast)
    return Prepared(frame, long & strong, short & strong, side.columns)


def breakout_range(bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str]) -> Prepared:
    side = ParamSide()
    spans = _ints(sets, "lookback", None)
    stage: dict[str, I.Feature] = {}
    for n in spans:
        stage[f"top_{n}"] = I.prior_extreme("high", n, True)
        stage[f"bottom_{n}"] = I.prior_extreme("low", n, False)
    frame = pack(pack(I.over_bars(bars, keys, max(spans), [stage]), "top_", spans), "bottom_", spans)
    top, bottom = side.pick("top_", spans, _period("lookback", None)), side.pick("bottom_", spans, _period("lookback", None))
    wide = (top - bottom) >= side(num("min_range_points"))
    return Prepared(frame, (F.col("close") > top) & wide, (F.col("close") < bottom) & wide, side.columns)


def scalp_break_even(bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str]) -> Prepared:
    side = ParamSide()
    spans = sorted(set(_ints(sets, "ema_fast", None)) | set(_ints(sets, "ema_slow", None)))
    frame = _with_ema(_with_previous(bars, keys, {"prev_close": "close"}), spans, keys)
    fast, slow = side.pick("ema_", spans, _period("ema_fast", None)), side.pick("ema_", spans, _period("ema_slow", None))
    close, open_, before = F.col("close"), F.col("open"), F.col("prev_close")
    floor = side(num("min_range_points", 0.0))
    wide = (floor <= 0) | (F.abs(F.col("high") - F.col("low")) >= floor)
    long = (fast > slow) & (close > fast) & (F.col("low") <= fast) & (close > open_) & (close > before)
    short = (fast < slow) & (close < fast) & (F.col("high") >= fast) & (close < open_) & (close < before)
    return Prepared(frame, long & wide, short & wide, side.columns)


def _trend_frame(
    bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str], ema: int, hilo: int, period: int, smoothing: int
) -> tuple[DataFrame, Column, Column, Column, str, list[int]]:
    spans, hilos = _ints(sets, "ema_period", ema, 2), _ints(sets, "hilo_period", hilo, 2)
    pairs = sorted(
        {(max(2, int(p.get("adx_period", period))), max(2, int(p.get("adx_smoothing", smoothing)))) for p in sets}
    )
    frame = I.trend_features(bars, keys, spans, hilos, pairs)
    tags = [f"{p}_{s}" for p, s in pairs]
    tag = F.concat_ws("_", _period("adx_period", period, 2).cast("string"), _period("adx_smoothing", smoothing, 2).cast("string"))
    return frame, spans, hilos, tags, tag


def trx_htsl(bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str]) -> Prepared:
    side = ParamSide()
    frame, spans, hilos, tags, tag = _trend_frame(bars, sets, keys, 20, 10, 14, 14)
    frame = pack(pack(pack(frame, "ema_", spans), "hilo_", hilos), "wadx_", tags)
    ema, hilo = side.pick("ema_", spans, _period("ema_period", 20, 2)), side.pick("hilo_", hilos, _period("hilo_period", 10, 2))
    adx, close = side.pick("wadx_", tags, tag), F.col("close")
    strong = adx >= side(num("adx_min", 20.0))
    up, down = strong & (close > ema) & (close > hilo), strong & (close < ema) & (close < hilo)
    return Prepared(frame, up, down, side.columns)


def trx_melhor(bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str]) -> Prepared:
    side = ParamSide()
    frame, spans, hilos, tags, tag = _trend_frame(bars, sets, keys, 22, 9, 13, 14)
    steps = {f"emad_{n}": I.diff1(f"ema_{n}") for n in spans}
    steps.update({f"wadxd_{t}": I.diff1(f"wadx_{t}") for t in tags})
    frame = I.over_bars(frame, keys, 1, [steps])
    for prefix, values in (("ema_", spans), ("emad_", spans), ("hilo_", hilos), ("wadx_", tags), ("wadxd_", tags)):
        frame = pack(frame, prefix, values)
    span, close = _period("ema_period", 22, 2), F.col("close")
    ema, slope, hilo = side.pick("ema_", spans, span), side.pick("emad_", spans, span), side.pick("hilo_", hilos, _period("hilo_period", 9, 2))
    adx, rise = side.pick("wadx_", tags, tag), side.pick("wadxd_", tags, tag)
    quality = (
        (adx >= side(num("adx_min", 20.9)))
        & is_true(side(~flag("require_adx_rising", True)) | (rise >= 0))
        & (F.abs(F.col("high") - F.col("low")) <= side(num("max_bar_range_points", 500.0)))
        & (F.abs(close - ema) <= side(num("max_ema_distance_points", 250.0)))
    )
    up, down = quality & (slope > 0) & (close > ema) & (close > hilo), quality & (slope < 0) & (close < ema) & (close < hilo)
    return Prepared(frame, up, down, side.columns)


def ganhador_80(bars: DataFrame, sets: Sequence[ParamSet], keys: Sequence[str]) -> Prepared:
    side = ParamSide()
    slow_of = lambda p: max(3, int(p.get("ema_slow", 21)), int(p.get("ema_fast", 8)) + 1)
    spans = sorted(set(_ints(sets, "ema_fast", 8, 2)) | {slow_of(p) for p in sets})
    frame = I.over_bars(I.ema(bars, spans, keys), keys, 1, [{f"emap_{n}": I.lag1(f"ema_{n}") for n in spans}])
    frame = pack(pack(frame, "ema_", spans), "emap_", spans)
    fast_n = _period("ema_fast", 8, 2)
    slow_n = F.greatest(F.lit(3), num("ema_slow", 21.0).cast("int"), num("ema_fast", 8.0).cast("int") + 1)
    fast, slow = side.pick("ema_", spans, fast_n), side.pick("ema_", spans, slow_n)
    fast0, slow0 = side.pick("emap_", spans, fast_n), side.pick("emap_", spans, slow_n)
    close, open_, floor = F.col("close"), F.col("open"), side(num("range_min_points", 0.0))
    wide = (floor <= 0) | (F.abs(F.col("high") - F.col("low")) >= floor)
    up = (fast > slow) & (fast0 <= slow0) & (close > open_) & (close > fast) & (close > slow)
    down = (fast < slow) & (fast0 >= slow0) & (close < open_) & (close < fast) & (close < slow)
    return Prepared(frame, up & wide, down & wide, side.columns)


STRATEGIES: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("ema_pullback", ema_pullback),
        Strategy("breakout_range", breakout_range),
        Strategy("scalp_break_even", scalp_break_even),
        Strategy("ganhador_80", ganhador_80, ("09:05", "12:00")),
        Strategy("trx_htsl", trx_htsl, ("09:00", "12:00")),
        Strategy("trx_melhor_20_02", trx_melhor, ("09:00", "12:00")),
    )
}


def register_strategy(strategy: Strategy) -> None:
    """Make a custom rule available by name."""
    STRATEGIES[strategy.name] = strategy


def minute_window(default: tuple[str, str], side: ParamSide) -> Column:
    """Inclusive entry window by minute of day; malformed bounds do not restrict."""
    lo = side(clamped_hhmm_minutes(text("entry_start_time", default[0])))
    hi = side(clamped_hhmm_minutes(text("entry_end_time", default[1])))
    now = minute_of_day(F.col("datetime"))
    return lo.isNull() | hi.isNull() | ((now >= lo) & (now <= hi))


def hour_window(side: ParamSide) -> Column:
    """Inclusive hours, wrapping midnight when the start is later; needs both bounds."""
    bound = lambda key: F.when(num(key).isNotNull(), F.least(F.greatest(num(key).cast("int"), F.lit(0)), F.lit(23)))
    lo, hi, now = side(bound("hour_start")), side(bound("hour_end")), F.hour("datetime")
    inside = F.when(lo <= hi, (now >= lo) & (now <= hi)).otherwise((now >= lo) | (now <= hi))
    return lo.isNull() | hi.isNull() | is_true(inside)


def validity_window(side: ParamSide) -> Column:
    """Inclusive licence dates; an unreadable or missing bound does not restrict."""
    lo, hi = side(loose_date(text("license_start_date"))), side(loose_date(text("license_end_date")))
    day = F.col("datetime").cast("date")
    return (lo.isNull() | (day >= lo)) & (hi.isNull() | (day <= hi))


def strategy_signals(
    indexed: DataFrame,
    strategy: Strategy | str,
    sets: Sequence[ParamSet],
    keys: Sequence[str] = SERIES,
    base: ExecutionSettings | None = None,
    only_entries: bool = False,
    params: DataFrame | None = None,
    restrict: Sequence[str] | None = None,
) -> DataFrame:
    """Signal in {-1, 0, 1} per (series, parameter set, bar).

    ``base`` adds the execution settings of each set to its rows, ``only_entries`` drops zero signals before
    anything is shuffled. ``params`` replaces the parameter table (for instance one row per window and
    rank); ``restrict`` then names the columns that tie its rows to a series, an ordinary equi-join.
    """
    rule = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    ready = rule.prepare(indexed, sets, keys)
    table = params if params is not None else params_frame(indexed.sparkSession, sets)
    if base is not None:
        table = with_settings(table, base)
    extra = [c for c in table.columns if c not in indexed.columns and c not in ("params",)]
    side = ParamSide()
    side.columns.update(ready.param_columns)
    allowed = hour_window(side) & validity_window(side)
    if rule.minute_window:
        allowed = allowed & minute_window(rule.minute_window, side)
    table = table.withColumns(side.columns)
    by_tuple = only_entries and restrict is None
    if by_tuple:
        # Sets that differ in exits or costs only share their signals: each distinct tuple of what the rules read meets the
        # bars once, and what is left is joined to the full sets by that tuple.
        read = [F.col(c) for c in side.columns]
        table = table.withColumn("_tuple", F.to_json(F.struct(F.lit(0).alias("_"), *read)))
        crossed = ready.bars.crossJoin(table.select("_tuple", *read).dropDuplicates(["_tuple"]))
    else:
        crossed = ready.bars.crossJoin(table) if restrict is None else ready.bars.join(table, list(restrict))
    direction = F.when(is_true(ready.short), -1).when(is_true(ready.long), 1).otherwise(0)
    signal = F.when(allowed, direction).otherwise(0).cast("int").alias("signal")
    if by_tuple:
        fired = crossed.select(*indexed.columns, "_tuple", signal).where("signal <> 0")
        return fired.join(table.select("_tuple", *extra), "_tuple").select(*indexed.columns, *extra, "signal")
    out = crossed.select(*indexed.columns, *extra, signal)
    return out.where("signal <> 0") if only_entries else out
