import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bars_frame, random_bars, sequential_trades
from tidebar.operators import bars as B
from tidebar.operators import exits as X
from tidebar.operators.params import ExecutionSettings, params_frame
from tidebar.operators.signals import Prepared, Strategy, register_strategy
from tidebar.operators.trades import equity_curve, run_trades

# Signals by bar: one expression over bar_idx, so every case states its own entries.
BASE = ExecutionSettings(point_value=1.0, contracts=1)


def rule(longs=(), shorts=()):
    at = lambda xs: F.col("bar_idx").isin(*[int(x) for x in xs]) if len(xs) else F.lit(False)
    spec = Strategy("listed", lambda bars, sets, keys: Prepared(bars, at(longs), at(shorts)))
    register_strategy(spec)
    return spec


def run(spark, rows, params, base=BASE, longs=(0,), shorts=(), **kw):
    return run_trades(bars_frame(spark, rows), rule(longs, shorts), [params], base, **kw).toPandas()


DAY = "2025-01-02 "


def test_break_even_stops_at_entry(spark):
    rows = [(DAY + "09:00", 100, 101, 99, 100), (DAY + "09:05", 100, 107, 99.5, 106), (DAY + "09:10", 106, 106, 99, 100)]
    out = run(spark, rows, {"stop_points": 10, "take_points": 50, "break_even_trigger_points": 5})
    assert len(out) == 1 and out["exit_reason"][0] == "stop_loss" and out["pnl_points"][0] == 0.0


def test_break_even_lock_points(spark):
    rows = [(DAY + "09:00", 100, 101, 99, 100), (DAY + "09:05", 100, 107, 99.5, 106), (DAY + "09:10", 106, 106, 99, 100)]
    out = run(spark, rows, {"stop_points": 10, "take_points": 50, "break_even_trigger_points": 5, "break_even_lock_points": 2})
    assert out["pnl_points"][0] == pytest.approx(2.0)


def test_session_end_closes_at_open(spark):
    rows = [(DAY + "16:50", 100, 101, 99, 100), (DAY + "16:55", 100, 101, 99, 100), (DAY + "17:00", 102, 103, 101, 102)]
    out = run(spark, rows, {"stop_points": 50, "take_points": 50, "session_end": "17:00", "close_on_session_end": True})
    assert out["exit_reason"][0] == "session_end" and out["exit_price"][0] == 102
    assert str(out["exit_time"][0]).endswith("17:00:00")


def test_loss_streak_and_daily_limit_block_the_day(spark):
    rows = [(DAY + f"09:{5 * i:02d}", 100, 101, 94, 100) for i in range(5)]
    guards = ({"max_consecutive_losses_per_day": 1}, {"enable_daily_limits": True, "daily_loss_limit": 5})
    for guard in guards:
        out = run(spark, rows, {"stop_points": 5, "take_points": 50, **guard}, longs=(0, 2))
        assert len(out) == 1


def test_range_scaled_cost_exceeds_fixed_cost(spark):
    rows = [(DAY + "09:00", 100, 110, 90, 100), (DAY + "09:05", 100, 110, 90, 104)]
    fixed = run(spark, rows, {}, BASE.but(fixed_cost_per_trade=1.0))
    scaled = run(spark, rows, {}, BASE.but(fixed_cost_per_trade=1.0, cost_model="range_scaled", cost_range_factor=0.5))
    assert scaled["costs"][0] > fixed["costs"][0] and scaled["duration_bars"][0] >= 1


def test_tick_order_decides_over_bar_range(spark):
    rows = [(DAY + "09:00", 100, 101, 99, 100), (DAY + "09:05", 100, 106, 94, 100), (DAY + "09:10", 100, 101, 99, 100)]
    params = {"stop_points": 5, "take_points": 5}
    by_bar = run(spark, rows, params)
    assert by_bar["pnl_points"][0] == -5 and by_bar["exit_reason"][0] == "stop_and_take_hit_conservative_stop"
    bars = bars_frame(spark, rows)
    t0 = pd.Timestamp(DAY + "09:05")
    ticks = spark.createDataFrame(
        [("WIN", (t0 + pd.Timedelta(seconds=s)).to_pydatetime(), s, float(p), 1.0) for s, p in ((1, 106), (2, 104))],
        "symbol string, datetime timestamp_ntz, seq long, price double, volume double",
    )
    path = X.tick_path(bars, B.assign_ticks(ticks, bars), B.SERIES)
    by_tick = run_trades(bars, rule((0,)), [params], BASE, path=path, by_tick=True).toPandas()
    assert by_tick["pnl_points"][0] == 5 and by_tick["exit_reason"][0] == "take_profit"


CASES = [
    (dict(stop=12.0, take=20.0), dict(entry_mode="next_open", max_positions=1), 3),
    (dict(stop=60.0, take=90.0, be=15.0, lock=2.0), dict(entry_mode="close_slippage", max_positions=1), 2),
    (dict(stop=10.0, take=15.0, max_losses=2, flat=True, s0=3 * 3600, s1=20 * 3600), dict(entry_mode="next_open", max_positions=1), 3),
    (dict(stop=40.0, take=40.0, limits=True, loss=20.0, target=30.0), dict(entry_mode="next_open", max_positions=1), 2),
    (dict(stop=30.0, take=45.0, limits=True, loss=25.0, target=30.0, max_losses=3), dict(entry_mode="next_open", max_positions=3), 3),
    (dict(stop=80.0, take=25.0, be=10.0, limits=True, loss=60.0, target=40.0), dict(entry_mode="close_slippage", max_positions=2), 2),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_chain_equals_sequential_simulation(spark, monkeypatch, case):
    monkeypatch.setattr(X, "FANOUT", 4)
    p, mode, every = CASES[case]
    base = BASE.but(fixed_cost_per_trade=0.5, **mode)
    pdf = random_bars(100 + case, 420)
    rng = np.random.default_rng(case)
    signal = np.where(rng.random(len(pdf)) < 1 / every, rng.choice([-1, 1], len(pdf)), 0)
    params = {"stop_points": p["stop"], "take_points": p["take"]}
    if "be" in p:
        params |= {"break_even_trigger_points": p["be"], "break_even_lock_points": p.get("lock", 0)}
    if "flat" in p:
        params |= {"session_start": "03:00", "session_end": "20:00", "close_on_session_end": True}
    if "max_losses" in p:
        params["max_consecutive_losses_per_day"] = p["max_losses"]
    if "limits" in p:
        params |= {"enable_daily_limits": True, "daily_loss_limit": p["loss"], "daily_profit_target": p["target"]}
    want = sequential_trades(pdf, signal.tolist(), base, p)
    bars = spark.createDataFrame(pdf)
    got = run_trades(bars, rule(np.flatnonzero(signal > 0), np.flatnonzero(signal < 0)), [params], base, block_days=4).toPandas()
    side = got["direction"].map({"long": 1, "short": -1})
    have = sorted(zip(got["entry_idx"], got["exit_idx"], side, got["exit_price"].round(6), got["exit_reason"]))
    assert [tuple(x) for x in have] == want


def test_sparse_and_dense_equity_agree_on_drawdown(spark):
    pdf = random_bars(7, 300)
    bars = spark.createDataFrame(pdf)
    base = BASE.but(max_positions=1)
    trades = run_trades(bars, rule(range(0, 300, 20)), [{"stop_points": 15, "take_points": 30}], base)
    ids = params_frame(spark, [{}]).select("param_id")
    dense = equity_curve(trades, bars, ids, base).toPandas().sort_values("bar_idx")
    sparse = equity_curve(trades, bars, ids, base, dense=False).toPandas().sort_values("bar_idx")
    drawdown = lambda s: (s.cummax() - s).max()
    assert len(dense) == 300 and len(sparse) < 300
    assert drawdown(dense["equity"]) == pytest.approx(drawdown(sparse["equity"]))
    assert dense["equity"].iloc[-1] == pytest.approx(base.initial_capital + trades.toPandas()["pnl_net"].sum())
