"""Fixture frames and a plain sequential trade simulation used as ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd

BAR_SCHEMA = (
    "symbol string, timeframe string, datetime timestamp_ntz, open double, high double, low double, close double, "
    "volume double, bar_idx long"
)


def bars_frame(spark, rows, symbol="WIN", timeframe="5m"):
    """rows: (iso time, open, high, low, close)."""
    data = [
        (symbol, timeframe, pd.Timestamp(t).to_pydatetime(), float(o), float(h), float(l), float(c), 1.0, i)
        for i, (t, o, h, l, c) in enumerate(rows)
    ]
    return spark.createDataFrame(data, BAR_SCHEMA)


def random_bars(seed, n, minutes=60, symbol="WIN", start="2024-03-01 00:00"):
    rng = np.random.default_rng(seed)
    close = 1000 + np.cumsum(rng.normal(0, 5, n)).round(1)
    open_ = np.concatenate([[1000.0], close[:-1]]) + rng.normal(0, 1, n).round(1)
    high = np.maximum(open_, close) + np.abs(rng.normal(0, 3, n)).round(1)
    low = np.minimum(open_, close) - np.abs(rng.normal(0, 3, n)).round(1)
    times = pd.date_range(start, periods=n, freq=f"{minutes}min")
    return pd.DataFrame(
        {"symbol": symbol, "timeframe": f"{minutes}m", "datetime": times, "open": open_.round(1), "high": high.round(1),
         "low": low.round(1), "close": close, "volume": 1.0, "bar_idx": np.arange(n)}
    )


def sequential_trades(bars: pd.DataFrame, signal, base, p) -> list[tuple]:
    """Bar-by-bar ground truth: (entry_idx, exit_idx, side, exit_price, reason). Fixed costs, no slippage."""
    n = len(bars)
    sec = (bars["datetime"].dt.hour * 3600 + bars["datetime"].dt.minute * 60).tolist()
    day = bars["datetime"].dt.date.tolist()
    o, h, l, c = (bars[k].tolist() for k in ("open", "high", "low", "close"))
    lo_sec, hi_sec = p.get("s0"), p.get("s1")
    inside = [(lo_sec is None or s >= lo_sec) and (hi_sec is None or s < hi_sec) for s in sec]
    live, out = [], []
    planned = None
    today, streak, earned, halted, full_stop = None, 0, 0.0, False, False
    net = lambda pos, price: (price - pos["px"]) * pos["side"] * base.point_value - base.fixed_cost_per_trade
    for i in range(n):
        if day[i] != today:
            today, streak, earned, halted, full_stop = day[i], 0, 0.0, False, False
        if planned is not None:
            if not (halted or full_stop) and len(live) < base.max_positions and inside[i]:
                live.append({"e": i, "px": o[i], "side": planned, "stop": o[i] - planned * p["stop"], "armed": False})
            planned = None
        left, stay = [], []
        for pos in live:
            s = pos["side"]
            take = pos["px"] + s * p["take"]
            bad = l[i] <= pos["stop"] if s > 0 else h[i] >= pos["stop"]
            good = h[i] >= take if s > 0 else l[i] <= take
            if p.get("flat") and not inside[i]:
                left.append((pos, o[i], "session_end"))
            elif bad:
                left.append((pos, pos["stop"], "stop_and_take_hit_conservative_stop" if good else "stop_loss"))
            elif good:
                left.append((pos, take, "take_profit"))
            else:
                stay.append(pos)
        live = stay
        for pos, price, why in left:
            out.append((pos["e"], i, pos["side"], round(price, 6), why))
            gain = net(pos, price)
            earned += gain
            streak = streak + 1 if gain < 0 else 0 if gain > 0 else streak
            halted = halted or (p.get("max_losses", 0) > 0 and streak >= p["max_losses"])
            if p.get("limits"):
                full_stop = full_stop or earned <= -p["loss"] or earned >= p["target"]
        if full_stop:
            out += [(pos["e"], i, pos["side"], round(c[i], 6), "daily_limit") for pos in live]
            live = []
        for pos in live:
            s = pos["side"]
            if p.get("be", 0) > 0 and not pos["armed"] and (c[i] - pos["px"]) * s >= p["be"]:
                lock = pos["px"] + s * p.get("lock", 0)
                pos["stop"] = max(pos["stop"], lock) if s > 0 else min(pos["stop"], lock)
                pos["armed"] = True
        if signal[i] and not (halted or full_stop) and len(live) < base.max_positions:
            if base.entry_mode == "close_slippage":
                if inside[i]:
                    live.append({"e": i, "px": c[i], "side": signal[i], "stop": c[i] - signal[i] * p["stop"], "armed": False})
            elif i + 1 < n:
                planned = signal[i]
    out += [(pos["e"], n - 1, pos["side"], round(c[-1], 6), "end_of_data") for pos in live]
    return sorted(out)
