"""Parameter sampling, evaluation of sweeps and rolling windows (inventory W)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.bars import SERIES
from tidebar.operators.metrics import ScoreSettings, apply_hard_limits, equity_stats, robust_score, trade_stats
from tidebar.operators.params import ExecutionSettings, params_frame
from tidebar.operators.registry import canonical_params
from tidebar.operators.signals import Strategy
from tidebar.operators.trades import equity_curve, run_trades
from tidebar.session import settled


@dataclass(frozen=True)
class SweepSettings:
    """Size and limits of a random search."""

    n_samples: int = 200
    top_k: int = 5
    seed: int = 42
    train_bar_step: int = 1
    max_stop_points: float = 0.0
    max_daily_loss: float = 0.0
    max_drawdown_pct: float = 0.0
    optimize_hours: bool = False
    hour_start_min: int = 9
    hour_start_max: int = 16
    hour_end_min: int = 10
    hour_end_max: int = 18

    def hour_bounds(self) -> tuple[int, int, int, int]:
        clamp = lambda h: max(0, min(23, int(h)))
        a, b, c, d = (clamp(h) for h in (self.hour_start_min, self.hour_start_max, self.hour_end_min, self.hour_end_max))
        return min(a, b), max(a, b), min(c, d), max(c, d)


class Draw:
    """Uniform draws that are a pure function of (seed, sample_no, name): stable under retries."""

    def __init__(self, seed: int):
        self.seed = seed

    def unit(self, name: str) -> Column:
        bits = F.xxhash64(F.lit(self.seed), F.col("sample_no"), F.lit(name)).bitwiseAND(F.lit((1 << 53) - 1))
        return bits / F.lit(float(1 << 53))

    def real(self, name: str, lo: float, hi: float) -> Column:
        return F.lit(lo) + self.unit(name) * F.lit(hi - lo)

    def integer(self, name: str, lo: Column | int, hi: Column | int) -> Column:
        """lo <= n < hi."""
        low, high = (c if isinstance(c, Column) else F.lit(c) for c in (lo, hi))
        return (low + F.floor(self.unit(name) * (high - low))).cast("int")

    def choice(self, name: str, values: Sequence[float]) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), self.integer(name, 0, len(values)))


def _target(stop: Column, ratio: Column, extra: int) -> Column:
    return F.greatest(stop * ratio, stop + extra).cast("int")


def _hhmm(hour: Column, minute: Column) -> Column:
    return F.format_string("%02d:%02d", hour, minute)


def draw_ema_pullback(d: Draw) -> dict[str, Column]:
    fast, stop = d.integer("ema_fast", 10, 41), d.integer("stop_points", 120, 801)
    return {
        "ema_fast": fast, "ema_slow": d.integer("ema_slow", F.greatest(fast + 40, F.lit(80)), 301), "stop_points": stop,
        "take_points": _target(stop, d.real("rr", 1.0, 2.6), 40), "atr_period": d.integer("atr_period", 8, 31),
        "atr_min": d.choice("atr_min", (0, 40, 60, 80, 100, 120, 150)), "use_adx": d.integer("use_adx", 0, 2) == 1,
        "adx_period": d.integer("adx_period", 8, 31), "adx_min": d.choice("adx_min", (15, 20, 25, 30, 35)),
    }


def draw_breakout_range(d: Draw) -> dict[str, Column]:
    stop = d.integer("stop_points", 120, 901)
    return {
        "lookback": d.integer("lookback", 8, 81), "min_range_points": d.integer("min_range_points", 80, 1601),
        "stop_points": stop, "take_points": _target(stop, d.real("rr", 1.0, 2.6), 50),
    }


def draw_scalp_break_even(d: Draw) -> dict[str, Column]:
    stop, fast = d.integer("stop_points", 35, 141), d.integer("ema_fast", 5, 16)
    return {
        "ema_fast": fast, "ema_slow": d.integer("ema_slow", F.greatest(fast + 8, F.lit(18)), 61),
        "min_range_points": d.integer("min_range_points", 20, 251), "stop_points": stop,
        "take_points": _target(stop, d.real("rr", 2.8, 6.2), 120),
        "break_even_trigger_points": F.greatest(F.lit(10.0), stop * d.real("be", 0.5, 1.0)).cast("int"),
    }


def draw_trx_htsl(d: Draw) -> dict[str, Column]:
    start = d.integer("hour_start", 9, 11)
    return {
        "ema_period": d.integer("ema_period", 16, 29), "hilo_period": d.integer("hilo_period", 8, 15),
        "adx_period": d.integer("adx_period", 12, 19), "adx_smoothing": d.integer("adx_smoothing", 12, 19),
        "adx_min": d.real("adx_min", 18.0, 30.0), "stop_points": d.integer("stop_points", 240, 361),
        "take_points": d.integer("take_points", 520, 760), "break_even_trigger_points": d.integer("be", 170, 231),
        "break_even_lock_points": d.integer("lock", 5, 21), "hour_start": start,
        "hour_end": d.integer("hour_end", F.greatest(start, F.lit(11)), 13), "entry_start_time": F.lit("09:00"),
        "entry_end_time": F.lit("12:00"), "session_end": F.lit("17:40"), "close_on_session_end": F.lit(True),
        "max_consecutive_losses_per_day": F.lit(20), "license_start_date": F.lit("2025-02-08"), "license_end_date": F.lit("2026-03-21"),
    }


def draw_trx_melhor(d: Draw) -> dict[str, Column]:
    stop = d.integer("stop_points", 300, 381)
    return {
        "ema_period": d.integer("ema_period", 19, 26), "hilo_period": d.integer("hilo_period", 8, 12),
        "adx_period": d.integer("adx_period", 12, 16), "adx_smoothing": d.integer("adx_smoothing", 12, 16),
        "adx_min": d.real("adx_min", 19.0, 24.0), "stop_points": stop, "take_points": _target(stop, d.real("rr", 1.65, 2.05), 230),
        "break_even_trigger_points": F.least(stop, d.integer("be", 170, 231)), "break_even_lock_points": d.integer("lock", 10, 21),
        "entry_start_time": F.lit("09:00"), "entry_end_time": F.lit("12:00"), "session_end": F.lit("17:40"),
        "close_on_session_end": F.lit(True), "max_consecutive_losses_per_day": d.integer("max_losses", 10, 21),
        "enable_daily_limits": F.lit(True), "daily_loss_limit": d.real("loss_limit", 300.0, 600.0),
        "daily_profit_target": d.real("target", 420.0, 780.0), "max_bar_range_points": d.integer("max_range", 280, 621),
        "max_ema_distance_points": d.integer("max_distance", 140, 361), "require_adx_rising": F.lit(True),
    }


def draw_ganhador_80(d: Draw) -> dict[str, Column]:
    fast, stop = d.integer("ema_fast", 4, 11), d.integer("stop_points", 40, 141)
    return {
        "ema_fast": fast, "ema_slow": d.integer("ema_slow", F.greatest(fast + 6, F.lit(14)), 31),
        "range_min_points": d.integer("range_min", 10, 121), "stop_points": stop,
        "take_points": _target(stop, d.real("rr", 2.0, 4.1), 80),
        "break_even_trigger_points": F.least(d.integer("be", 40, 121), stop), "break_even_lock_points": d.integer("lock", 2, 9),
        "entry_start_time": _hhmm(F.lit(9), d.integer("start_min", 2, 45)),
        "entry_end_time": _hhmm(d.integer("end_hour", 11, 13), d.integer("end_min", 0, 55)),
        "session_end": F.lit("17:40"), "close_on_session_end": F.lit(True),
    }


SAMPLERS: dict[str, Callable[[Draw], dict[str, Column]]] = {
    "ema_pullback": draw_ema_pullback, "breakout_range": draw_breakout_range, "scalp_break_even": draw_scalp_break_even,
    "trx_htsl": draw_trx_htsl, "trx_melhor_20_02": draw_trx_melhor, "ganhador_80": draw_ganhador_80,
}


def sample_parameters(ids: DataFrame, strategy: str, seed: int) -> DataFrame:
    """One parameter set per ``sample_no``; the columns of a strategy follow each other's bounds."""
    return ids.select("sample_no", *[c.alias(n) for n, c in SAMPLERS[strategy](Draw(seed)).items()])


def prepare_candidates(samples: DataFrame, settings: SweepSettings, random_hours: bool) -> DataFrame:
    """Cap stop and break-even trigger, and set the entry hours when they are part of the search."""
    out = samples
    if settings.max_stop_points > 0 and "stop_points" in out.columns:
        cap = lambda c, top: F.when(F.lit(dict(samples.dtypes)[c] == "int"), F.bround(F.least(F.col(c).cast("double"), top))).otherwise(
            F.least(F.col(c).cast("double"), top)
        ).cast(dict(samples.dtypes)[c])
        out = out.withColumn("_stop", F.least(F.col("stop_points").cast("double"), F.lit(float(settings.max_stop_points))))
        out = out.withColumn("stop_points", cap("stop_points", F.col("_stop")))
        if "break_even_trigger_points" in out.columns:
            out = out.withColumn("break_even_trigger_points", cap("break_even_trigger_points", F.col("_stop")))
        out = out.drop("_stop")
    if not settings.optimize_hours:
        return out
    lo, lo_max, hi_min, hi = settings.hour_bounds()
    if random_hours:
        draw = Draw(settings.seed)
        start = draw.integer("search_hour_start", lo, lo_max + 1)
        first_end = F.greatest(start, F.lit(hi_min))
        first_end = F.when(first_end > hi, start).otherwise(first_end)
        return out.withColumn("hour_start", start).withColumn(
            "hour_end", draw.integer("search_hour_end", first_end, F.greatest(first_end, F.lit(hi)) + 1)
        )
    clamp = lambda c: F.least(F.greatest(c.try_cast("double").cast("int"), F.lit(0)), F.lit(23))
    if {"hour_start", "hour_end"} <= set(out.columns):
        ok = clamp(F.col("hour_start")).isNotNull() & clamp(F.col("hour_end")).isNotNull()
        first, last = clamp(F.col("hour_start")), clamp(F.col("hour_end"))
        return out.withColumns(
            {"hour_start": F.when(ok, first).otherwise(F.lit(lo)), "hour_end": F.when(ok, last).otherwise(F.lit(hi))}
        )
    return out.withColumns({"hour_start": F.lit(lo), "hour_end": F.lit(hi)})


def params_text(samples: DataFrame) -> DataFrame:
    """(sample_no, params_json) with sorted keys; :func:`distinct_candidates` brings the values into their canonical form."""
    names = sorted(c for c in samples.columns if c != "sample_no")
    return samples.select("sample_no", F.to_json(F.struct(*names)).alias("params_json"))


def distinct_candidates(seeds: DataFrame, samples: DataFrame, n: int | None = None) -> DataFrame:
    """Seeds first, then samples, each parameter text once; at most ``n`` samples beyond the seeds."""
    tag = lambda df, o: df.select(F.lit(o).alias("origin"), "sample_no", canonical_params("params_json").alias("params_json"))
    rows = tag(seeds, 0).unionByName(tag(samples, 1))
    # minima of plain numbers are hash aggregates; the best row as a struct would sort all rows by their text.
    # Null texts leave after it: a filter on the parsed text below would parse every text once more.
    lowest = lambda origin: F.min(F.when(F.col("origin") == origin, F.col("sample_no")))
    found = rows.groupBy("params_json").agg(F.min("origin").alias("origin"), lowest(0).alias("_seed"), lowest(1).alias("_draw"), F.max(F.col("params_json").isNotNull()).alias("_is"))
    unique = found.where("_is").select("params_json", "origin", F.when(F.col("origin") == 0, F.col("_seed")).otherwise(F.col("_draw")).alias("sample_no"))
    if n is None:
        return unique
    fresh = unique.where("origin = 1").orderBy("sample_no").limit(n)
    return unique.where("origin = 0").unionByName(fresh)


def search_sets(spark, strategy: str, settings: SweepSettings, seeds: Sequence[Mapping[str, Any]] = (), cycle: int = 0, cycle_step: int = 1) -> list[dict]:
    """Parameter sets of one sweep: seeds, then ``n_samples`` distinct draws.

    Draws go on until enough distinct sets exist; when twice the draws bring no new set the space is exhausted, which
    is an error. ``cycle`` shifts the seed, so repeated cycles explore new sets around the bank's best ones.
    """
    from tidebar.operators.params import collect_sets

    shifted = SweepSettings(**{**settings.__dict__, "seed": settings.seed + cycle * max(1, cycle_step)})
    given = params_frame(spark, list(seeds)).select(F.col("param_id").alias("sample_no"), "params_json")
    draws, before = settings.n_samples * 4, -1
    while True:
        ids = spark.range(draws).select(F.col("id").alias("sample_no"))
        drawn = params_text(prepare_candidates(sample_parameters(ids, strategy, shifted.seed), shifted, True))
        found = distinct_candidates(given, drawn).where("origin = 1").count()
        if found >= settings.n_samples:
            return collect_sets(distinct_candidates(given, drawn, settings.n_samples).orderBy("origin", "sample_no"))
        if found == before:
            raise ValueError(f"the parameter space of {strategy} has {found} sets besides the seeds, {settings.n_samples} were asked for")
        draws, before = draws * 2, found


def evaluate_sets(
    indexed: DataFrame,
    strategy: Strategy | str,
    sets: Sequence[Mapping[str, Any]],
    base: ExecutionSettings,
    score: ScoreSettings = ScoreSettings(),
    settings: SweepSettings = SweepSettings(),
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Score of every parameter set on every series in one plan.

    Drawdown comes from the sparse equity curve (bars that hold or close a position), so the sweep never
    builds bars x sets rows.
    """
    group = [*keys, "param_id"]
    indexed = settled(indexed)
    trades = run_trades(indexed, strategy, sets, base, keys)
    ids = params_frame(indexed.sparkSession, sets)
    equity = equity_curve(trades, indexed, ids.select("param_id"), base, keys, dense=False)
    dated = equity.withColumn("datetime", F.timestamp_seconds(F.col("bar_idx")).cast("timestamp_ntz"))
    block = F.floor(F.col("bar_idx") / 4096).cast("long")
    curve = equity_stats(dated, group, ("bar_idx",), block).select(*group, "max_drawdown")
    joined = curve.join(trade_stats(trades, group), group, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    named = joined.select(
        *group, *[zero(c).alias(c) for c in ("trade_count", "win_rate", "net_profit", "profit_factor")], "max_drawdown",
        (100.0 * F.col("max_drawdown") / F.lit(base.initial_capital)).alias("max_drawdown_pct"),
    )
    scored = named.withColumn("score", robust_score(F.col("net_profit"), F.col("max_drawdown"), F.col("trade_count"), score))
    limited = apply_hard_limits(scored, trades, group, settings.max_daily_loss, settings.max_drawdown_pct)
    return limited.join(F.broadcast(ids.select("param_id", "params_json")), "param_id")


def rolling_windows(days: DataFrame, train_days: int, test_days: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """(window_id, phase) memberships of each trading day; windows advance by the test length.

    Membership is arithmetic on the day ordinal, so no range join is needed. Series with too few days for
    one window yield nothing; :func:`require_windows` turns that into an error.
    """
    sizes = days.groupBy(*keys).agg(F.max("day_no").alias("_last"))
    total = F.floor((F.col("_last") + 1 - train_days - test_days) / F.lit(test_days)).cast("long")
    d = F.col("day_no")
    low = F.greatest(F.lit(0), F.ceil((d - train_days + 1) / F.lit(test_days))).cast("long")
    high = F.least(F.floor(d / F.lit(test_days)).cast("long"), total)
    trained = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    w = F.floor((d - train_days) / F.lit(test_days)).cast("long")
    tested = F.when((d >= train_days) & (w <= total), F.array(w)).otherwise(F.array().cast("array<bigint>"))
    as_phase = lambda arr, phase: F.transform(arr, lambda x: F.struct(x.alias("window_id"), F.lit(phase).alias("phase")))
    member = F.concat(as_phase(trained, "train"), as_phase(tested, "test"))
    joined = days.join(sizes, list(keys)).where(F.col("_last") + 1 >= train_days + test_days)
    return joined.select(*days.columns, F.inline(member))


def require_windows(days: DataFrame, train_days: int, test_days: int, keys: Sequence[str] = SERIES) -> None:
    short = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < train_days + test_days)
    first = short.take(1)
    if first:
        raise ValueError(f"series {tuple(first[0])[:-1]} has {first[0]['n']} days, needs {train_days + test_days}")


def window_bars(indexed: DataFrame, train_days: int, test_days: int, phase: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Bars of each window's train or test slice, re-indexed from 0 inside the slice."""
    keys = list(keys)
    day = F.col("datetime").cast("date")
    starts = indexed.groupBy(*keys, day.alias("day")).agg(F.min("bar_idx").alias("_day_idx"))
    order = Window.partitionBy(*keys).orderBy("day")
    days = starts.withColumn("day_no", (F.row_number().over(order) - 1).cast("long"))
    member = rolling_windows(days, train_days, test_days, keys).where(F.col("phase") == phase).drop("phase", "day_no")
    first = Window.partitionBy(*keys, "window_id")
    member = member.withColumn("_base", F.min("_day_idx").over(first)).drop("_day_idx")
    joined = indexed.withColumn("day", day).join(member, [*keys, "day"])
    return joined.withColumn("bar_idx", F.col("bar_idx") - F.col("_base")).drop("_base", "day")


def rank_top(scores: DataFrame, group: Sequence[str], k: int, score: str = "score", tie: str = "param_id") -> DataFrame:
    """Top k per group by score; the earlier candidate wins ties."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("train_rank", F.row_number().over(w).cast("long")).where(F.col("train_rank") <= max(1, k))


def strategy_summary(metrics: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Strategies of a run ranked by score, with the best one flagged."""
    w = Window.partitionBy(*run_keys).orderBy(F.col("score").desc(), "strategy")
    ranked = metrics.withColumn("rank_in_run", F.row_number().over(w).cast("long"))
    return ranked.withColumn("is_best", (F.col("rank_in_run") == 1).cast("int"))


def completed_windows(results: DataFrame, group: Sequence[str]) -> DataFrame:
    """Progress of a run whose window rows arrive over time: finished prefix and latest score."""
    w = Window.partitionBy(*group).orderBy("window_id")
    prefix = results.withColumn("_rank", F.row_number().over(w) - 1).where(F.col("window_id") == F.col("_rank"))
    return prefix.groupBy(*group).agg(
        F.count(F.lit(1)).alias("windows_completed"),
        F.max_by("oos_score", "window_id").alias("latest_oos_score"),
        F.max_by("oos_net_profit", "window_id").alias("latest_oos_net_profit"),
    )
