"""Walk-forward run for many series at once: train sweep, top-k tests, out-of-sample stream."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from typing import Any, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidebar.operators.bars import SERIES, downsample
from tidebar.operators.metrics import METRICS, ScoreSettings, apply_hard_limits, performance
from tidebar.operators.params import ExecutionSettings, canonical_json, params_frame
from tidebar.operators.registry import best_parameters
from tidebar.operators.signals import Strategy
from tidebar.operators.sweep import SweepSettings, evaluate_sets, rank_top, require_windows, window_bars
from tidebar.operators.trades import equity_curve, run_trades
from tidebar.session import materialize


@dataclass(frozen=True)
class WalkForward:
    """Result tables, all keyed by the series columns."""

    windows: DataFrame          # window_id, best_train_score, best_train_params_json, oos_<metric>
    topk: DataFrame             # window_id, train_rank, train_score, test_score, params_json, test_<metric>
    oos_trades: DataFrame
    oos_equity: DataFrame
    consolidated: DataFrame
    best_params: DataFrame


@dataclass(frozen=True)
class Plan:
    """What a walk-forward run does; two runs with equal plans over the same bars have equal results."""

    strategy: Strategy | str
    sets: Sequence[Mapping[str, Any]]
    base: ExecutionSettings
    train_days: int = 120
    test_days: int = 30
    sweep: SweepSettings = SweepSettings()
    score: ScoreSettings = ScoreSettings()
    keys: Sequence[str] = SERIES

    @property
    def slot(self) -> list[str]:
        return [*self.keys, "window_id"]

    def digest(self) -> str:
        name = self.strategy if isinstance(self.strategy, str) else self.strategy.name
        parts = (name, [canonical_json(p) for p in self.sets], self.base, self.train_days, self.test_days, self.sweep, self.score, list(self.keys))
        return hashlib.sha256(repr(parts).encode()).hexdigest()


Parts = dict[str, DataFrame]   # best, trades, equity: what a window leaves behind


def evaluate_windows(bars: DataFrame, plan: Plan, slots: DataFrame | None = None) -> Parts:
    """Train sweep and top-k tests of the windows in ``slots`` (all when None)."""
    slot = plan.slot
    cut = lambda phase: window_bars(bars, plan.train_days, plan.test_days, phase, plan.keys)
    wanted = lambda rows: rows if slots is None else rows.join(slots.select(*slot), slot, "left_semi")
    train = wanted(cut("train"))
    if plan.sweep.train_bar_step > 1:
        train = downsample(train, plan.sweep.train_bar_step, tuple(slot))
    scores = evaluate_sets(materialize(train), plan.strategy, plan.sets, plan.base, plan.score, plan.sweep, slot)
    best = materialize(
        rank_top(scores, slot, plan.sweep.top_k).select(*slot, "train_rank", F.col("score").alias("train_score"), "param_id", "params_json")
    )
    test = materialize(wanted(cut("test")))
    table = best.join(params_frame(bars.sparkSession, plan.sets).select("param_id", "params"), "param_id")
    group = [*slot, "train_rank"]
    trades = materialize(run_trades(test, plan.strategy, plan.sets, plan.base, slot, group, params=table, restrict=slot))
    equity = materialize(equity_curve(trades, test, best.select(*group), plan.base, slot, group, restrict=slot))
    return {"best": best, "trades": trades, "equity": equity}


class WindowStore:
    """Finished windows of a run in a shared folder.

    A batch writes its tables to folders of its own and then one marker row per (series, window). Only what a marker names
    is ever read, so a batch that died half-way leaves nothing behind but unread files, and its windows run again.
    Markers carry the digest of the plan: another plan in the same folder starts from nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, plan: Plan, schema: StructType):
        self.spark, self.folder, self.plan = spark, folder.rstrip("/"), plan
        keys = [schema[c] for c in plan.keys]
        self.marks = StructType([*keys, StructField("window_id", LongType()), StructField("run", StringType()), StructField("plan", StringType())])

    def done(self) -> DataFrame:
        try:
            marks = self.spark.read.schema(self.marks).parquet(f"{self.folder}/done")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            marks = self.spark.createDataFrame([], self.marks)
        return marks.where(F.col("plan") == self.plan.digest())

    def commit(self, parts: Parts, slots: DataFrame) -> None:
        run = uuid.uuid4().hex
        for name, rows in parts.items():
            rows.withColumn("run", F.lit(run)).write.parquet(f"{self.folder}/{name}/{run}")
        marks = slots.select(*self.plan.slot, F.lit(run).alias("run"), F.lit(self.plan.digest()).alias("plan"))
        marks.coalesce(1).write.mode("append").parquet(f"{self.folder}/done")

    def parts(self) -> Parts:
        """Tables of all finished windows."""
        done = materialize(self.done())
        runs = sorted(r.run for r in done.select("run").distinct().collect())  # one per batch
        out = {}
        for name in ("best", "trades", "equity"):
            rows = self.spark.read.parquet(*[f"{self.folder}/{name}/{run}" for run in runs])
            out[name] = rows.join(done.select(*self.plan.slot, "run"), [*self.plan.slot, "run"], "left_semi").drop("run")
        return out


def advance(bars: DataFrame, plan: Plan, folder: str, batch_windows: int = 1, batches: int | None = None) -> int:
    """Runs windows that are not finished, ``batch_windows`` window numbers of all series at a time, at most ``batches`` batches.

    Returns how many (series, window) are still open. A run that was stopped goes on where the last commit left it.
    """
    store = WindowStore(bars.sparkSession, folder, plan, bars.schema)
    slots = materialize(window_bars(bars, plan.train_days, plan.test_days, "test", plan.keys).select(*plan.slot).distinct())
    while True:
        todo = materialize(slots.join(store.done().select(*plan.slot), plan.slot, "left_anti"))
        numbers = [r.window_id for r in todo.select("window_id").distinct().orderBy("window_id").limit(batch_windows).collect()]
        if not numbers or batches == 0:
            return todo.count()
        now = todo.where(F.col("window_id").isin(*numbers))
        store.commit(evaluate_windows(bars, plan, now), now)
        batches = None if batches is None else batches - 1


def run_walkforward(
    indexed: DataFrame,
    strategy: Strategy | str,
    sets: Sequence[Mapping[str, Any]],
    base: ExecutionSettings,
    train_days: int = 120,
    test_days: int = 30,
    sweep: SweepSettings = SweepSettings(),
    score: ScoreSettings = ScoreSettings(),
    keys: Sequence[str] = SERIES,
    folder: str | None = None,
    batch_windows: int = 1,
) -> WalkForward:
    """All windows of all series in parallel. A series with too few days for one window is an error.

    With ``folder`` windows are written there as they finish and a run that was stopped resumes (:func:`advance`); the
    result is the same. P&L does not depend on capital, so the out-of-sample stream is the rank-1 test run shifted by
    the net profit of earlier windows; it is not computed a second time.
    """
    plan = Plan(strategy, sets, base, train_days, test_days, sweep, score, tuple(keys))
    bars = materialize(indexed)
    traded = bars.select(*keys, F.col("datetime").cast("date").alias("day")).distinct()
    require_windows(traded, train_days, test_days, keys)
    if folder is None:
        return summarized(evaluate_windows(bars, plan), plan)
    advance(bars, plan, folder, batch_windows)
    return summarized(WindowStore(bars.sparkSession, folder, plan, bars.schema).parts(), plan)


def summarized(parts: Parts, plan: Plan) -> WalkForward:
    """Metrics of the windows whose tables are given."""
    keys, slot = list(plan.keys), plan.slot
    base, sweep, score = plan.base, plan.sweep, plan.score
    best, trades, equity = parts["best"], parts["trades"], parts["equity"]
    group = [*slot, "train_rank"]
    metrics = performance(trades, equity, group, base.initial_capital, score)
    metrics = apply_hard_limits(metrics, trades, group, sweep.max_daily_loss, sweep.max_drawdown_pct)
    extra = ("worst_daily_pnl", "constraints_ok")
    topk = best.join(metrics, group).select(
        *group, "train_score", F.col("score").alias("test_score"), "param_id", "params_json",
        *[F.col(m).alias(f"test_{m}") for m in (*[m for m in METRICS if m != "score"], *extra)],
    )

    first = F.col("train_rank") == 1
    nets = trades.where(first).groupBy(*slot).agg(F.sum("pnl_net").alias("_net"))
    earlier = Window.partitionBy(*keys).orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    capital = best.where(first).select(*slot).join(nets, slot, "left").select(
        *slot, (F.lit(base.initial_capital) + F.coalesce(F.sum("_net").over(earlier), F.lit(0.0))).alias("capital")
    )
    oos_trades = trades.where(first).drop("train_rank")
    shift = F.col("capital") - F.lit(base.initial_capital)
    oos_equity = equity.where(first).join(capital, slot).select(
        *slot, "bar_idx", "datetime", (F.col("equity") + shift).alias("equity"), (F.col("cash") + shift).alias("cash")
    )
    oos = performance(oos_trades, oos_equity, slot, capital, score)
    oos = apply_hard_limits(oos, oos_trades, slot, sweep.max_daily_loss, sweep.max_drawdown_pct)
    windows = best.where(first).select(
        *slot, F.col("train_score").alias("best_train_score"), F.col("params_json").alias("best_train_params_json")
    ).join(oos, slot).select(
        *slot, "best_train_score", "best_train_params_json", *[F.col(m).alias(f"oos_{m}") for m in (*METRICS, *extra)]
    )
    consolidated = performance(oos_trades, oos_equity, keys, base.initial_capital, score)
    return WalkForward(windows, topk, oos_trades, oos_equity, consolidated, best_parameters(topk, keys))
