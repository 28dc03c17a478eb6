"""T: signals to trades to equity."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r6
from checks.sql import r, with_
from checks.trade_sql import breakout_sig, chain, params_cte, trades_sql
from tidebar.operators import bars as B
from tidebar.operators import exits as X
from tidebar.operators.entries import entry_candidates, with_next_bar
from tidebar.operators.params import ExecutionSettings, params_frame, with_settings
from tidebar.operators.signals import strategy_signals
from tidebar.operators.trades import equity_curve, labelled_candidates, run_trades
from tidebar.plans import testviews as V
from tidebar.session import settled

BREAKOUT = [
    {"lookback": 8, "min_range_points": 80, "stop_points": 40, "take_points": 90},
    {"lookback": 20, "min_range_points": 100, "stop_points": 60, "take_points": 60},
]
PLAIN = ExecutionSettings(fixed_cost_per_trade=1.0)
RICH = ExecutionSettings(
    slippage_points=0.5, slippage_model="range_scaled", slippage_range_factor=0.05, open_auction_minutes=120,
    open_auction_slippage_multiplier=2.0, fixed_cost_per_trade=1.0, cost_per_contract=0.25, contracts=2, cost_model="range_scaled",
    cost_range_factor=0.02, open_auction_cost_multiplier=1.5, session_start="09:00", session_end="17:40", close_on_session_end=True,
)
GUARDED = [
    {"lookback": 2, "min_range_points": 10, "stop_points": 15, "take_points": 25, "max_consecutive_losses_per_day": 2},
    {"lookback": 2, "min_range_points": 10, "stop_points": 15, "take_points": 25, "enable_daily_limits": True, "daily_loss_limit": 6, "daily_profit_target": 8},
    {"lookback": 3, "min_range_points": 10, "stop_points": 400, "take_points": 150, "break_even_trigger_points": 30, "break_even_lock_points": 5},
]
MONEY = ("entry_price", "exit_price", "pnl_points", "pnl_gross", "costs", "pnl_net")
TRADE_SQL = ("symbol, param_id, sig_idx, entry_idx, exit_idx, entry_time, exit_time, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, "
             + ", ".join(f"{r(c)} AS {c}" for c in MONEY) + ", duration_bars, exit_reason")


def shown(df):
    return df.select(
        "symbol", "param_id", "sig_idx", "entry_idx", "exit_idx", "entry_time", "exit_time", "direction",
        *[r6(c).alias(c) for c in MONEY], "duration_bars", "exit_reason",
    )


def candidates_shown(df):
    return shown(df.withColumn("direction", F.when(F.col("side") > 0, "long").otherwise("short")))


for mode in ("next_open", "close_slippage"):
    base = RICH.but(entry_mode=mode)

    @query(f"t1_t2_t3_entry_candidates_{mode}", trades_sql(
        breakout_sig(BREAKOUT), BREAKOUT, base,
        f"SELECT symbol, param_id, sig_idx, side, entry_idx, first_idx, entry_time, {r('entry_price')} AS entry_price, {r('entry_range')} AS entry_range, entry_auction, {r('st')} AS stop_price, {r('tk')} AS take_price FROM lv",
        admit=False))
    def _(spark, sf, base=base):
        framed = with_next_bar(V.indexed_bars(spark, sf), B.SERIES)
        c = entry_candidates(strategy_signals(framed, "breakout_range", BREAKOUT, base=base, only_entries=True), base)
        return c.select("symbol", "param_id", "sig_idx", "side", "entry_idx", "first_idx", "entry_time", r6("entry_price").alias("entry_price"),
                        r6("entry_range").alias("entry_range"), "entry_auction", r6("stop_price").alias("stop_price"), r6("take_price").alias("take_price"))


@query("t4_t12_t13_first_touch_exit", trades_sql(breakout_sig(BREAKOUT), BREAKOUT, PLAIN, f"SELECT {TRADE_SQL} FROM ex", admit=False))
def _(spark, sf):
    return candidates_shown(labelled_candidates(V.indexed_bars(spark, sf), "breakout_range", BREAKOUT, PLAIN))


@query("t5_t14_session_exit_costs", trades_sql(breakout_sig(BREAKOUT), BREAKOUT, RICH, f"SELECT {TRADE_SQL} FROM ex", admit=False))
def _(spark, sf):
    return candidates_shown(labelled_candidates(V.indexed_bars(spark, sf), "breakout_range", BREAKOUT, RICH))


@query("t6_break_even_exit", trades_sql(breakout_sig(GUARDED), GUARDED, PLAIN.but(entry_mode="close_slippage"), f"SELECT {TRADE_SQL} FROM ex", admit=False))
def _(spark, sf):
    return candidates_shown(labelled_candidates(V.indexed_bars(spark, sf), "breakout_range", GUARDED, PLAIN.but(entry_mode="close_slippage")))


@query("t8_select_trades", trades_sql(breakout_sig(BREAKOUT), BREAKOUT, PLAIN, f"SELECT {TRADE_SQL} FROM tr"))
def _(spark, sf):
    return shown(run_trades(V.indexed_bars(spark, sf), "breakout_range", BREAKOUT, PLAIN, block_days=7))


@query("t9_t10_t16_guarded_trades", trades_sql(breakout_sig(GUARDED), GUARDED, PLAIN, f"SELECT {TRADE_SQL} FROM tr"))
def _(spark, sf):
    return shown(run_trades(V.indexed_bars(spark, sf), "breakout_range", GUARDED, PLAIN, block_days=7))


@query("t11_three_positions_daily_flatten")
def _(spark, sf):
    base = PLAIN.but(max_positions=3, enable_daily_limits=True, daily_loss_limit=6.0, daily_profit_target=8.0)
    return shown(run_trades(V.indexed_bars(spark, sf), "breakout_range", BREAKOUT[:1], base, block_days=7))


@query("t15_equity_curve", trades_sql(
    breakout_sig(BREAKOUT), BREAKOUT, PLAIN, f"SELECT symbol, param_id, bar_idx, datetime, {r('equity')} AS equity, {r('cash')} AS cash FROM eq", equity=True))
def _(spark, sf):
    bars = settled(V.indexed_bars(spark, sf))
    trades = run_trades(bars, "breakout_range", BREAKOUT, PLAIN)
    eq = equity_curve(trades, bars, params_frame(spark, BREAKOUT).select("param_id"), PLAIN)
    return eq.select("symbol", "param_id", "bar_idx", "datetime", r6("equity").alias("equity"), r6("cash").alias("cash"))


@query("t16_execution_settings", f"""SELECT event_id AS param_id, {r('value')} AS stop_points, 600.0::DOUBLE AS take_points, {r('greatest(value - 50, 0)')} AS be_trigger, 0.0::DOUBLE AS be_lock, 32400 AS session_start_sec,
 CASE WHEN event_id % 2 = 0 THEN 61200 + 1800 ELSE 63600 END AS session_end_sec, event_id % 3 <> 0 AS flatten, CAST(greatest(event_id % 5 - 1, 0) AS INTEGER) AS max_losses, event_id % 7 = 0 AS daily_limits,
 {r('greatest(value - 80, 0)')} AS loss_limit, 0.0::DOUBLE AS profit_target FROM events""")
def _(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    pairs = {
        "stop_points": v, "break_even_trigger_points": v - 50, "session_end": F.when(i % 2 == 0, "17:30"), "close_on_session_end": i % 3 != 0,
        "max_consecutive_losses_per_day": i % 5 - 1, "enable_daily_limits": i % 7 == 0, "daily_loss_limit": v - 80,
    }
    entries = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))) for k, c in pairs.items()]))
    sets = V.table(spark, sf, "events").select(i.alias("param_id"), F.map_from_entries(entries).alias("params"))
    out = with_settings(sets, RICH).drop("params")
    return out.select(*[r6(c).alias(c) if c in ("stop_points", "be_trigger", "loss_limit") else F.col(c) for c in out.columns])


TICK_SETS = [{"lookback": 4, "min_range_points": 20, "stop_points": 30, "take_points": 45, "break_even_trigger_points": 15, "break_even_lock_points": 3}]
TICK_BASE = PLAIN.but(session_start="04:00", session_end="22:00", close_on_session_end=True)


def tick_chain() -> str:
    """Candidates as in the bar chain, then a walk over the tick path instead of the bars."""
    text = chain(TICK_BASE, admit=False)
    cut = text.index(",\nh0 AS")
    head = text[:cut]
    return head + """,
gap AS (SELECT symbol, quantile_cont(g, 0.5) AS sp FROM (SELECT symbol, epoch(datetime) - epoch(lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime)) AS g FROM bars) WHERE g > 0 GROUP BY symbol),
spans AS (SELECT i.*, coalesce(lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime), datetime + to_seconds(coalesce(sp, 300.0))) AS t1 FROM idx i LEFT JOIN gap USING (symbol)),
own AS (SELECT s.symbol, s.bar_idx, t.datetime AS tt, t.seq, t.price FROM ticks t JOIN spans s ON t.symbol = s.symbol AND t.datetime >= s.datetime AND t.datetime < s.t1),
pts AS (SELECT symbol, bar_idx, 0 AS o, NULL::TIMESTAMP AS tt, 0 AS seq, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo, NULL::DOUBLE AS arm, true AS chk FROM idx
 UNION ALL SELECT symbol, bar_idx, 1, tt, seq, price, price, price, false FROM own
 UNION ALL SELECT symbol, bar_idx, 1, NULL, 0, high, low, NULL, false FROM idx i WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.symbol = i.symbol AND own.bar_idx = i.bar_idx)
 UNION ALL SELECT symbol, bar_idx, 2, NULL, 0, NULL, NULL, close, false FROM idx),
pn AS (SELECT p.*, i.datetime, i.open, i.close, row_number() OVER (PARTITION BY p.symbol ORDER BY p.bar_idx, p.o, p.tt, p.seq) AS pos FROM pts p JOIN idx i USING (symbol, bar_idx)),
c0 AS (SELECT c.*, n.pos AS p0 FROM lv c LEFT JOIN pn n ON n.symbol = c.symbol AND n.bar_idx = c.first_idx AND n.o = 0),
m AS (SELECT c.symbol, c.sig_idx, n.pos,
 (n.chk AND c.fl AND (coalesce((hour(n.datetime) * 3600 + minute(n.datetime) * 60) < c.s0, false) OR coalesce((hour(n.datetime) * 3600 + minute(n.datetime) * 60) >= c.s1, false))) AS out_,
 coalesce(CASE WHEN c.side > 0 THEN n.lo <= c.st ELSE n.hi >= c.st END, false) AS s_, coalesce(CASE WHEN c.side > 0 THEN n.lo <= c.st1 ELSE n.hi >= c.st1 END, false) AS s1_,
 coalesce(CASE WHEN c.side > 0 THEN n.hi >= c.tk ELSE n.lo <= c.tk END, false) AS t_, coalesce(CASE WHEN c.side > 0 THEN n.arm >= c.tg ELSE n.arm <= c.tg END, false) AS a_
 FROM c0 c JOIN pn n ON n.symbol = c.symbol AND n.pos >= c.p0),
f0 AS (SELECT symbol, sig_idx, min(pos) FILTER (out_ OR s_ OR t_) AS x0, min(pos) FILTER (a_) AS arm FROM m GROUP BY ALL),
f1 AS (SELECT m.symbol, m.sig_idx, min(pos) AS x1 FROM m JOIN f0 USING (symbol, sig_idx) WHERE arm <= coalesce(x0, 9000000000) AND pos >= arm AND (out_ OR s1_ OR t_) GROUP BY ALL),
f2 AS (SELECT f0.symbol, f0.sig_idx, arm IS NOT NULL AND arm <= coalesce(x0, 9000000000) AS armed, CASE WHEN arm IS NOT NULL AND arm <= coalesce(x0, 9000000000) THEN x1 ELSE x0 END AS x FROM f0 LEFT JOIN f1 USING (symbol, sig_idx)),
fin AS (SELECT c.symbol, c.param_id, c.sig_idx, c.entry_idx, c.entry_price, c.side, coalesce(n.bar_idx, l.bar_idx) AS exit_idx,
 CASE WHEN n.pos IS NULL THEN 'end_of_data' WHEN m.out_ THEN 'session_end' WHEN (CASE WHEN armed THEN m.s1_ ELSE m.s_ END) AND m.t_ AND n.tt IS NULL THEN 'stop_and_take_hit_conservative_stop' WHEN (CASE WHEN armed THEN m.s1_ ELSE m.s_ END) THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason,
 CASE WHEN n.pos IS NULL THEN l.close WHEN m.out_ THEN n.open WHEN (CASE WHEN armed THEN m.s1_ ELSE m.s_ END) THEN (CASE WHEN armed THEN c.st1 ELSE c.st END) ELSE c.tk END AS exit_price
 FROM c0 c LEFT JOIN f2 USING (symbol, sig_idx) LEFT JOIN pn n ON n.symbol = c.symbol AND n.pos = f2.x LEFT JOIN m ON m.symbol = c.symbol AND m.sig_idx = c.sig_idx AND m.pos = f2.x
 JOIN (SELECT symbol, max(bar_idx) AS bar_idx, arg_max(close, bar_idx) AS close FROM idx GROUP BY symbol) l ON l.symbol = c.symbol)"""


@query("t7_tick_path_exit", with_("idx", extra=breakout_sig(TICK_SETS) + ",\n" + params_cte(TICK_SETS, TICK_BASE) + ",\n" + tick_chain())
       + f"SELECT symbol, param_id, sig_idx, entry_idx, exit_idx, exit_reason, {r('exit_price')} AS exit_price, {r('(exit_price - entry_price) * side')} AS pnl_points FROM fin")
def _(spark, sf):
    bars = settled(V.indexed_bars(spark, sf))
    path = X.tick_path(bars, B.assign_ticks(V.ticks(spark, sf), bars), B.SERIES)
    out = labelled_candidates(bars, "breakout_range", TICK_SETS, TICK_BASE, path=path, by_tick=True)
    return out.select("symbol", "param_id", "sig_idx", "entry_idx", "exit_idx", "exit_reason", r6("exit_price").alias("exit_price"), r6("pnl_points").alias("pnl_points"))
