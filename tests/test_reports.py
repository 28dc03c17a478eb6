import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bars_frame
from tidebar.operators import metrics as M
from tidebar.operators import reports as R
from tidebar.operators import signals as S
from tidebar.operators import sweep as W
from tidebar.operators.bars import quality_report, trading_days
from tidebar.operators.params import ExecutionSettings
from tidebar.plans import walkforward as WF
from tidebar.plans.walkforward import run_walkforward

TRADES = "strategy string, trade_id long, entry_time timestamp_ntz, exit_time timestamp_ntz, direction string, entry_price double, exit_price double, pnl_points double, pnl_net double"
EQUITY = "strategy string, datetime timestamp_ntz, equity double"


def ts(text):
    return pd.Timestamp(text).to_pydatetime()


def trades(spark, pnls, start="2025-01-02 09:00", step=60, hours=None):
    rows = []
    for i, p in enumerate(pnls):
        t = pd.Timestamp(start) + pd.Timedelta(minutes=step * i) if hours is None else pd.Timestamp(f"2025-01-02 {hours[i]:02d}:00") + pd.Timedelta(minutes=i)
        rows.append(("s", i, t.to_pydatetime(), (t + pd.Timedelta(minutes=10)).to_pydatetime(), "long", 1.0, 1.0, float(p), float(p)))
    return spark.createDataFrame(rows, TRADES)


def equity(spark, points):
    return spark.createDataFrame([("s", ts(t), float(v)) for t, v in points], EQUITY)


def test_expectancy_payoff_and_streaks(spark):
    eq = equity(spark, [("2025-01-02 09:00", 100), ("2025-01-02 10:00", 110), ("2025-01-02 11:00", 105), ("2025-01-02 12:00", 120), ("2025-01-02 13:00", 115)])
    row = M.performance(trades(spark, [10, -5, 15, -5]), eq, ["strategy"], 100.0, M.ScoreSettings(1.5, 0, 0.0)).first()
    assert row["win_rate"] == 0.5 and row["expectancy"] == 3.75 and row["payoff_ratio"] == 2.5
    assert row["max_consecutive_wins"] == 1 and row["max_consecutive_losses"] == 1
    assert row["max_drawdown"] == 5 and row["net_profit"] == 15


def test_group_without_trades_has_zero_metrics(spark):
    eq = equity(spark, [("2025-01-02 09:00", 100), ("2025-01-02 10:00", 100)])
    row = M.performance(trades(spark, []), eq, ["strategy"], 100.0).first()
    assert row["trade_count"] == 0 and row["profit_factor"] == 0 and row["score"] == -20 * 150.0


def test_monthly_report_and_returns(spark):
    eq = equity(spark, [("2025-01-02", 100), ("2025-01-30", 110), ("2025-02-03", 108), ("2025-02-27", 121)])
    out = R.monthly_report(trades(spark, [10]), eq, ["strategy"], 100.0).orderBy("month").collect()
    assert [r["month"] for r in out] == ["2025-01", "2025-02"]
    assert out[0]["net_profit"] == 10 and out[1]["max_drawdown"] == 0 and out[0]["trade_count"] == 1
    stats = M.equity_stats(eq, ["strategy"]).first()
    assert stats["monthly_return_mean_pct"] == pytest.approx(10.0) and stats["monthly_return_std_pct"] == 0.0
    assert stats["positive_months_pct"] == 100.0


def test_hourly_report_puts_best_hour_first(spark):
    first = R.hourly_report(trades(spark, [50, 30, -10, 20], hours=[9, 9, 10, 11]), ["strategy"]).first()
    assert first["hour"] == 9 and first["net_profit"] == 80


def windows(spark):
    rows = [("s", 0, 100.0, 50.0, 60.0, '{"a": 1, "b": 2}'), ("s", 1, 120.0, -30.0, -20.0, '{"a": 1}'), ("s", 2, 90.0, 40.0, 10.0, "broken")]
    return spark.createDataFrame(rows, "strategy string, window_id int, best_train_score double, oos_score double, oos_net_profit double, best_train_params_json string")


def topk(spark):
    rows = [("s", w, k, 10.0 * k - w, 1.0, 2.0, json.dumps({"a": k})) for w in (0, 1) for k in (1, 2)]
    return spark.createDataFrame(rows, "strategy string, window_id int, train_rank int, test_score double, test_net_profit double, test_max_drawdown double, params_json string")


def test_robustness_report(spark):
    dd = spark.createDataFrame([("s", 25.0)], "strategy string, max_drawdown_pct double")
    row = R.robustness_report(windows(spark), topk(spark), dd, ["strategy"]).first()
    assert row["total_windows"] == 3 and row["oos_score_max"] == 50
    stable = row["parameter_stability"]
    assert stable["n_unique_full_sets"] == 3 and stable["dominant_ratio"] == pytest.approx(1 / 3)
    # a set without the key counts as blank
    assert stable["parameters"]["a"]["most_common_value"] == "1" and stable["parameters"]["a"]["unique_values"] == 2
    assert stable["parameters"]["b"]["most_common_value"] == ""
    assert row["topk_dispersion"]["avg_top1_minus_topk_mean"] == pytest.approx(-5.0)
    assert {a["code"] for a in row["alerts"]} == {"HIGH_SCORE_VOLATILITY", "NEGATIVE_TRAIN_TEST_CORR", "HIGH_DRAWDOWN", "UNSTABLE_PARAMS"}


def test_constant_scores_have_no_correlation(spark):
    flat = windows(spark).withColumn("best_train_score", F.lit(1.0))
    assert R.oos_summary(flat, ["strategy"]).first()["train_test_score_corr"] == 0.0


def test_sensitivity_skips_bad_json(spark):
    bad = topk(spark).withColumn("params_json", F.when(F.col("train_rank") == 2, "oops").otherwise(F.col("params_json")))
    out = R.parameter_sensitivity(bad, ["strategy"]).collect()
    assert len(out) == 1 and out[0]["parameter"] == "a" and out[0]["value"] == "1" and out[0]["samples"] == 2


def test_hard_limits_reject(spark):
    eq = equity(spark, [("2025-01-02 09:00", 1000), ("2025-01-02 10:00", 900)])
    t = trades(spark, [-100])
    out = M.apply_hard_limits(M.performance(t, eq, ["strategy"], 1000.0), t, ["strategy"], max_daily_loss=50).first()
    assert out["constraints_ok"] == 0 and out["score"] <= -1e14 and out["worst_daily_pnl"] == -100


def test_brl_and_duration_text(spark):
    row = spark.range(1).select(
        R.brl(F.lit(-1234.5)).alias("m"), R.duration_text(F.lit(3723.9)).alias("h"), R.duration_text(F.lit(65.0)).alias("n"), R.duration_text(F.lit(5.0)).alias("s")
    ).first()
    assert row["m"] == "-R$ 1.234,50" and row["h"] == "1h02min03s" and row["n"] == "1min05s" and row["s"] == "5s"


def test_running_total_of_zero_has_no_sign(spark):
    pnls = [-17.73, -24.89, -0.09, -28.51, -18.25, -10.53]
    assert 100.0 + np.cumsum(pnls)[-1] < 0  # what plain float sums leave
    rows = R.operations_table(trades(spark, pnls), ["strategy"], 100.0, 2, ("exit_time", "trade_id")).orderBy("trade_id").collect()
    assert (rows[-1]["total"], rows[-1]["total_num"]) == ("R$ 0,00", 0.0) and str(rows[-1]["total_num"]) == "0.0"


def test_quality_counts_missing_bar(spark):
    times = ["2025-01-02 09:00", "2025-01-02 09:05", "2025-01-02 09:15", "2025-01-03 09:00", "2025-01-03 09:05"]
    row = quality_report(bars_frame(spark, [(t, 10, 11, 9, 10) for t in times])).first()
    assert row["rows"] == 5 and row["days"] == 2 and row["missing_intraday_bars"] == 1 and row["duplicate_timestamps"] == 0


def test_hour_and_validity_filters(spark):
    S.register_strategy(S.Strategy("always", lambda b, s, k: S.Prepared(b, F.lit(True), F.lit(False))))
    hours = bars_frame(spark, [(f"2025-01-02 {h:02d}:00", 1, 1, 1, 1) for h in (9, 10, 11)])
    out = S.strategy_signals(hours, "always", [{"hour_start": 10, "hour_end": 10}]).orderBy("bar_idx").collect()
    assert [r["signal"] for r in out] == [0, 1, 0]
    days = bars_frame(spark, [(f"{d} 10:00", 1, 1, 1, 1) for d in ("2025-02-07", "2025-02-08", "2026-03-21", "2026-03-22")])
    out = S.strategy_signals(days, "always", [{"license_start_date": 1250208, "license_end_date": 1260321}]).orderBy("bar_idx").collect()
    assert [r["signal"] for r in out] == [0, 1, 1, 0]


def test_walkforward_counts_windows_and_rejects_short_series(spark):
    rows = [(f"2025-01-{d:02d} 10:00", 100 + d, 103 + d, 98 + d, 101 + d) for d in range(2, 10)]
    bars = bars_frame(spark, rows, timeframe="daily")
    days = trading_days(bars)
    assert W.rolling_windows(days, 3, 1).select("window_id").distinct().count() == 5
    with pytest.raises(ValueError):
        W.require_windows(days, 30, 5)
    S.register_strategy(S.Strategy("always", lambda b, s, k: S.Prepared(b, F.lit(True), F.lit(False))))
    wf = run_walkforward(bars, "always", [{"stop_points": 2, "take_points": 2}], ExecutionSettings(entry_mode="close_slippage"), 3, 1)
    assert wf.windows.count() == 5 and wf.topk.count() == 5


def test_walkforward_resumes_after_a_stop(spark, tmp_path, monkeypatch):
    rows = [(f"2025-01-{d:02d} 10:00", 100 + d, 103 + d, 98 + d, 101 + d * (-1) ** d) for d in range(2, 10)]
    bars = bars_frame(spark, rows, timeframe="daily").unionByName(bars_frame(spark, rows[:6], timeframe="daily").withColumn("symbol", F.lit("B")))
    S.register_strategy(S.Strategy("always", lambda b, s, k: S.Prepared(b, F.lit(True), F.lit(False))))
    base = ExecutionSettings(entry_mode="close_slippage")
    args = "always", [{"stop_points": 2, "take_points": 2}, {"stop_points": 4, "take_points": 3}], base, 3, 1
    plan, folder = WF.Plan(*args), f"{tmp_path}/run"
    assert WF.advance(bars, plan, folder, batch_windows=2, batches=1) == 4  # windows 0 and 1 of both series are done; 3 and 1 are open
    real, seen = WF.evaluate_windows, []

    def spied(bars, plan, slots=None):
        seen.append(sorted(tuple(r) for r in slots.select("symbol", "window_id").collect()))
        return real(bars, plan, slots)

    monkeypatch.setattr(WF, "evaluate_windows", spied)
    marker = WF.WindowStore.done

    class Died(Exception):
        pass

    def half_way(self, parts, slots):
        for name, part in parts.items():
            part.withColumn("run", F.lit("lost")).write.parquet(f"{self.folder}/{name}/lost")
        raise Died

    with monkeypatch.context() as m:
        m.setattr(WF.WindowStore, "commit", half_way)
        with pytest.raises(Died):
            WF.run_walkforward(bars, *args, folder=folder)
    assert marker(WF.WindowStore(spark, folder, plan, bars.schema)).count() == 4
    resumed = WF.run_walkforward(bars, *args, folder=folder, batch_windows=2)
    assert seen == [[("B", 2), ("WIN", 2)], [("B", 2), ("WIN", 2), ("WIN", 3)], [("WIN", 4)]]
    monkeypatch.undo()
    whole = WF.run_walkforward(bars, *args)
    for name in ("windows", "topk", "oos_trades"):
        got, want = getattr(resumed, name), getattr(whole, name)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name
    other = WF.Plan("always", args[1][:1], base, 3, 1)
    assert WF.WindowStore(spark, folder, other, bars.schema).done().count() == 0


@pytest.mark.parametrize("name", sorted(W.SAMPLERS))
def test_samplers_respect_dependent_bounds(spark, name):
    out = W.sample_parameters(spark.range(300).withColumnRenamed("id", "sample_no"), name, 1).toPandas()
    again = W.sample_parameters(spark.range(300).withColumnRenamed("id", "sample_no"), name, 1).toPandas()
    assert out.equals(again)
    assert (out["take_points"] > out["stop_points"]).all()
    if "ema_slow" in out:
        assert (out["ema_slow"] > out["ema_fast"]).all()
    if "break_even_trigger_points" in out:
        assert (out["break_even_trigger_points"] <= out["stop_points"]).all()


def test_search_sets_are_distinct_and_start_with_seeds(spark):
    seed = {"lookback": 5, "min_range_points": 90, "stop_points": 100, "take_points": 200}
    sets = W.search_sets(spark, "breakout_range", W.SweepSettings(n_samples=20), [seed, seed])
    texts = {json.dumps(s, sort_keys=True) for s in sets}
    assert len(sets) == 21 == len(texts) and sets[0] == seed
    capped = W.search_sets(spark, "breakout_range", W.SweepSettings(n_samples=10, max_stop_points=150, optimize_hours=True))
    assert all(s["stop_points"] <= 150 and s["hour_end"] >= s["hour_start"] for s in capped)
