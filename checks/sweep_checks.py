"""W: sampling, sweeps, walk-forward, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.source_checks import scratch
from checks.sql import r, with_
from checks.trade_checks import PLAIN
from checks.trade_sql import breakout_sig, chain, equity_ctes, params_cte
from tidebar.operators import sweep as W
from tidebar.operators.bars import trading_days
from tidebar.operators.metrics import ScoreSettings
from tidebar.plans import testviews as V
from tidebar.plans.walkforward import Plan, advance, run_walkforward
from tidebar.session import materialize

SETS = [
    {"lookback": n, "min_range_points": 60, "stop_points": s, "take_points": t}
    for n, s, t in ((4, 30, 60), (6, 40, 90), (8, 50, 50), (10, 30, 120), (12, 60, 80), (14, 90, 90))
]
SCORE = ScoreSettings(1.5, 20, 1.0)
TRAIN, TEST = 10, 5


@query("w1_sample_parameters")
def _(spark, sf):
    ids = V.table(spark, sf, "events").select(F.col("event_id").alias("sample_no"))
    return rounded(W.sample_parameters(ids, "ema_pullback", 7), "atr_min", "adx_min")


# What the draws of each strategy must hold, dependent bounds included.
TARGET = "take_points >= stop_points + {} AND take_points <= greatest(stop_points * {}, stop_points + {})"
BOUNDS = {
    "ema_pullback": "ema_fast BETWEEN 10 AND 40 AND ema_slow BETWEEN greatest(ema_fast + 40, 80) AND 300 AND stop_points BETWEEN 120 AND 800 AND atr_period BETWEEN 8 AND 30 AND "
                    "atr_min IN (0, 40, 60, 80, 100, 120, 150) AND adx_period BETWEEN 8 AND 30 AND adx_min IN (15, 20, 25, 30, 35) AND use_adx IS NOT NULL AND " + TARGET.format(40, 2.6, 40),
    "breakout_range": "lookback BETWEEN 8 AND 80 AND min_range_points BETWEEN 80 AND 1600 AND stop_points BETWEEN 120 AND 900 AND " + TARGET.format(50, 2.6, 50),
    "scalp_break_even": "ema_fast BETWEEN 5 AND 15 AND ema_slow BETWEEN greatest(ema_fast + 8, 18) AND 60 AND min_range_points BETWEEN 20 AND 250 AND stop_points BETWEEN 35 AND 140 AND "
                        "break_even_trigger_points BETWEEN greatest(10, floor(stop_points * 0.5)) AND stop_points AND " + TARGET.format(120, 6.2, 120),
    "trx_htsl": "ema_period BETWEEN 16 AND 28 AND hilo_period BETWEEN 8 AND 14 AND adx_period BETWEEN 12 AND 18 AND adx_smoothing BETWEEN 12 AND 18 AND adx_min BETWEEN 18 AND 30 AND "
                "stop_points BETWEEN 240 AND 360 AND take_points BETWEEN 520 AND 759 AND break_even_trigger_points BETWEEN 170 AND 230 AND break_even_lock_points BETWEEN 5 AND 20 AND "
                "hour_start BETWEEN 9 AND 10 AND hour_end BETWEEN greatest(hour_start, 11) AND 12",
    "trx_melhor_20_02": "ema_period BETWEEN 19 AND 25 AND hilo_period BETWEEN 8 AND 11 AND adx_period BETWEEN 12 AND 15 AND adx_smoothing BETWEEN 12 AND 15 AND adx_min BETWEEN 19 AND 24 AND "
                        "stop_points BETWEEN 300 AND 380 AND break_even_trigger_points <= stop_points AND break_even_trigger_points BETWEEN 170 AND 230 AND break_even_lock_points BETWEEN 10 AND 20 AND "
                        "max_consecutive_losses_per_day BETWEEN 10 AND 20 AND daily_loss_limit BETWEEN 300 AND 600 AND daily_profit_target BETWEEN 420 AND 780 AND "
                        "max_bar_range_points BETWEEN 280 AND 620 AND max_ema_distance_points BETWEEN 140 AND 360 AND " + TARGET.format(230, 2.05, 230),
    "ganhador_80": "ema_fast BETWEEN 4 AND 10 AND ema_slow BETWEEN greatest(ema_fast + 6, 14) AND 30 AND range_min_points BETWEEN 10 AND 120 AND stop_points BETWEEN 40 AND 140 AND "
                   "break_even_trigger_points <= stop_points AND break_even_trigger_points BETWEEN 40 AND 120 AND break_even_lock_points BETWEEN 2 AND 8 AND "
                   "entry_start_time BETWEEN '09:02' AND '09:44' AND entry_end_time BETWEEN '11:00' AND '12:54' AND " + TARGET.format(80, 4.1, 80),
}


@query("w1_sampler_bounds", f"SELECT strategy, count(*) AS sets, count(*) AS within_bounds FROM events, (SELECT unnest({list(BOUNDS)}) AS strategy) GROUP BY strategy")
def _(spark, sf):
    ids = V.table(spark, sf, "events").select(F.col("event_id").alias("sample_no"))
    counted = [W.sample_parameters(ids, name, 7).agg(F.count("*").alias("sets"), F.count_if(F.expr(rule)).alias("within_bounds")).select(F.lit(name).alias("strategy"), "*")
               for name, rule in BOUNDS.items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


@query("w2_prepare_candidates", f"""SELECT event_id AS sample_no, CAST(least(value, 60.0) AS DOUBLE) AS stop_points, CAST(round_even(least(CAST(event_id % 100 AS DOUBLE), least(value, 60.0)), 0) AS INTEGER) AS break_even_trigger_points,
 CAST(least(greatest(event_id % 40 - 5, 0), 23) AS INTEGER) AS hour_start, 20 AS hour_end FROM events""")
def _(spark, sf):
    raw = V.table(spark, sf, "events").select(
        F.col("event_id").alias("sample_no"), F.col("value").alias("stop_points"), (F.col("event_id") % 100).cast("int").alias("break_even_trigger_points"),
        (F.col("event_id") % 40 - 5).cast("int").alias("hour_start"), F.lit(20).alias("hour_end"))
    return W.prepare_candidates(raw, W.SweepSettings(max_stop_points=60.0, optimize_hours=True), random_hours=False)


@query("w3_distinct_candidates", with_("topk", extra="c AS (SELECT CASE WHEN train_rank % 50 = 0 THEN 0 ELSE 1 END AS origin, train_rank AS sample_no, '{\"k\":' || json_extract_string(params_json, '$.k') || '}' AS params_json FROM topk)")
       + "SELECT params_json, CAST(min(origin) AS INTEGER) AS origin, arg_min(sample_no, (origin, sample_no)) AS sample_no FROM c GROUP BY params_json")
def _(spark, sf):
    rows = V.topk(spark, sf).select(F.col("train_rank").alias("sample_no"), "params_json")
    return W.distinct_candidates(rows.where("sample_no % 50 = 0"), rows.where("sample_no % 50 <> 0"))


def scores_select(part: str, base=PLAIN) -> str:
    """Score of every (series, set) from tr, eq and p."""
    return f"""SELECT {part}, param_id, coalesce(n, 0)::DOUBLE AS trade_count, coalesce(net, 0) AS net_profit, dd AS max_drawdown, coalesce(net, 0) - 1.5 * dd - greatest(20 - coalesce(n, 0), 0) * 1.0 AS score
 FROM (SELECT {part}, param_id, max(d) AS dd FROM (SELECT {part}, param_id, max(equity) OVER (PARTITION BY {part}, param_id ORDER BY bar_idx) - equity AS d FROM eq) GROUP BY ALL)
 LEFT JOIN (SELECT {part}, param_id, count(*) AS n, sum(pnl_net) AS net FROM tr GROUP BY ALL) USING ({part}, param_id)"""


@query("w4_evaluate_sets", with_("idx", extra=breakout_sig(SETS) + ",\n" + params_cte(SETS, PLAIN) + ",\n" + chain(PLAIN) + equity_ctes(PLAIN), recursive=True)
       + f"SELECT symbol, param_id, trade_count, {r('net_profit')} AS net_profit, {r('max_drawdown')} AS max_drawdown, {r('score')} AS score FROM ({scores_select('symbol')})")
def _(spark, sf):
    out = W.evaluate_sets(V.indexed_bars(spark, sf), "breakout_range", SETS, PLAIN, SCORE)
    return rounded(out.select("symbol", "param_id", "trade_count", "net_profit", "max_drawdown", "score"), "net_profit", "max_drawdown", "score")


WINDOWS = f"""dy AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS day_no, count(*) OVER (PARTITION BY symbol) AS nd FROM (SELECT DISTINCT symbol, CAST(datetime AS DATE) AS day FROM bars)),
wn AS (SELECT DISTINCT symbol, unnest(range((nd - {TRAIN + TEST}) // {TEST} + 1)) AS window_id FROM dy WHERE nd >= {TRAIN + TEST}),
mem AS (SELECT w.symbol, w.window_id, d.day, d.day_no, CASE WHEN d.day_no < w.window_id * {TEST} + {TRAIN} THEN 'train' ELSE 'test' END AS phase FROM wn w JOIN dy d ON d.symbol = w.symbol
 AND d.day_no >= w.window_id * {TEST} AND d.day_no < w.window_id * {TEST} + {TRAIN + TEST})"""


@query("w5_rolling_windows", with_("bars", extra=WINDOWS) + "SELECT symbol, window_id, phase, day::VARCHAR AS day, day_no FROM mem")
def _(spark, sf):
    return W.rolling_windows(trading_days(V.bars(spark, sf)), TRAIN, TEST).select("symbol", "window_id", "phase", "day", "day_no")


@query("w6_rank_top", with_("topk") + f"SELECT * FROM (SELECT strategy, window_id, train_rank AS param_id, {r('test_score')} AS score, row_number() OVER (PARTITION BY strategy, window_id ORDER BY test_score DESC, train_rank) AS train_rank FROM topk) WHERE train_rank <= 3")
def _(spark, sf):
    rows = V.topk(spark, sf).select("strategy", "window_id", F.col("train_rank").alias("param_id"), F.col("test_score").alias("score"))
    return rounded(W.rank_top(rows, ["strategy", "window_id"], 3), "score")


SLICE = """{name} AS (SELECT i.* EXCLUDE (bar_idx), m.window_id, row_number() OVER (PARTITION BY i.symbol, m.window_id ORDER BY i.datetime) - 1 AS bar_idx
 FROM idx i JOIN mem m ON m.symbol = i.symbol AND m.day = CAST(i.datetime AS DATE) AND m.phase = '{phase}')"""
PART = "symbol, window_id"


def walk_sql(select: str) -> str:
    body = ",\n".join([breakout_sig(SETS, "wb", PART), params_cte(SETS, PLAIN), chain(PLAIN, "wb", PART)]) + equity_ctes(PLAIN, "wb", PART)
    train = "train AS (WITH RECURSIVE " + SLICE.format(name="wb", phase="train") + ",\n" + body + "\n" + scores_select(PART) + ")"
    best = f"best AS (SELECT * FROM (SELECT {PART}, param_id, score AS train_score, row_number() OVER (PARTITION BY {PART} ORDER BY score DESC, param_id) AS train_rank FROM train) WHERE train_rank <= 3)"
    test = SLICE.format(name="wb", phase="test") + ",\n" + body
    return with_("idx", extra=WINDOWS + ",\n" + train + ",\n" + best + ",\n" + test + f",\nsc AS ({scores_select(PART)})", recursive=True) + select


def walk(spark, sf):
    return run_walkforward(V.indexed_bars(spark, sf), "breakout_range", SETS, PLAIN, TRAIN, TEST, W.SweepSettings(top_k=3), SCORE)


@query("w7_topk_tests", walk_sql(f"""SELECT symbol, window_id, train_rank, param_id, {r('train_score')} AS train_score, {r('score')} AS test_score, trade_count AS test_trade_count, {r('net_profit')} AS test_net_profit,
 {r('max_drawdown')} AS test_max_drawdown FROM best JOIN sc USING (symbol, window_id, param_id)"""))
def _(spark, sf):
    out = walk(spark, sf).topk.select("symbol", "window_id", "train_rank", "param_id", "train_score", "test_score", "test_trade_count", "test_net_profit", "test_max_drawdown")
    return rounded(out, "train_score", "test_score", "test_net_profit", "test_max_drawdown")


@query("w13_resumed_topk", walk_sql(f"""SELECT symbol, window_id, train_rank, param_id, {r('train_score')} AS train_score, {r('score')} AS test_score, {r('net_profit')} AS test_net_profit
 FROM best JOIN sc USING (symbol, window_id, param_id)"""))
def _(spark, sf):
    """Stops after one batch of windows, then a second run takes up what is left."""
    bars, folder = materialize(V.indexed_bars(spark, sf)), scratch(spark)
    args = "breakout_range", SETS, PLAIN, TRAIN, TEST, W.SweepSettings(top_k=3), SCORE
    advance(bars, Plan(*args), folder, batch_windows=4, batches=1)
    out = run_walkforward(bars, *args, folder=folder, batch_windows=10).topk
    return rounded(out.select("symbol", "window_id", "train_rank", "param_id", "train_score", "test_score", "test_net_profit"), "train_score", "test_score", "test_net_profit")


CAPITAL = "cp AS (SELECT symbol, window_id, 100000.0 + coalesce(sum(net_profit) OVER (PARTITION BY symbol ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capital, * EXCLUDE (symbol, window_id) FROM best JOIN sc USING (symbol, window_id, param_id) WHERE train_rank = 1)"


@query("w8_oos_windows", walk_sql(f"SELECT symbol, window_id, {r('train_score')} AS best_train_score, {r('net_profit')} AS oos_net_profit, {r('score')} AS oos_score, {r('100.0 * net_profit / capital')} AS oos_return_pct, {r('100.0 * max_drawdown / capital')} AS oos_max_drawdown_pct FROM cp").replace("\nSELECT symbol, window_id, (round(CAST(train_score", ",\n" + CAPITAL + "\nSELECT symbol, window_id, (round(CAST(train_score"))
def _(spark, sf):
    names = ["best_train_score", "oos_net_profit", "oos_score", "oos_return_pct", "oos_max_drawdown_pct"]
    return rounded(walk(spark, sf).windows.select("symbol", "window_id", *names), *names)


@query("w9_consolidated_oos", walk_sql(f"""SELECT symbol, {r('net')} AS net_profit, n::DOUBLE AS trade_count, {r('dd')} AS max_drawdown, {r('net - 1.5 * dd - greatest(20 - n, 0) * 1.0')} AS score FROM (
 SELECT symbol, sum(net_profit) AS net, sum(trade_count) AS n FROM cp GROUP BY symbol) JOIN (SELECT symbol, max(d) AS dd FROM (
 SELECT symbol, max(equity + capital) OVER (PARTITION BY symbol ORDER BY window_id, bar_idx) - (equity + capital) AS d FROM eq JOIN cp USING (symbol, window_id, param_id)) GROUP BY symbol) USING (symbol)""").replace("\nSELECT symbol, (round(CAST(net AS", ",\n" + CAPITAL + "\nSELECT symbol, (round(CAST(net AS"))
def _(spark, sf):
    out = walk(spark, sf).consolidated.select("symbol", "net_profit", "trade_count", "max_drawdown", "score")
    return rounded(out, "net_profit", "max_drawdown", "score")


@query("w12_strategy_summary", with_("history", extra="m AS (SELECT symbol, timeframe, strategy, avg(score) AS score FROM history GROUP BY ALL)")
       + f"SELECT symbol, timeframe, strategy, {r('score')} AS score, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY score DESC, strategy) AS rank_in_run, CAST(row_number() OVER (PARTITION BY symbol, timeframe ORDER BY score DESC, strategy) = 1 AS INTEGER) AS is_best FROM m")
def _(spark, sf):
    m = V.history(spark, sf).groupBy("symbol", "timeframe", "strategy").agg(F.avg("score").alias("score"))
    return rounded(W.strategy_summary(m, ["symbol", "timeframe"]), "score")


@query("w13_completed_windows", with_("windows", extra="d AS (SELECT strategy, window_id - 1 AS w, oos_score, oos_net_profit FROM windows WHERE window_id <> 12), q AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY w) - 1 AS i FROM d)")
       + f"SELECT strategy, count(*) AS windows_completed, {r('arg_max(oos_score, w)')} AS latest_oos_score, {r('arg_max(oos_net_profit, w)')} AS latest_oos_net_profit FROM q WHERE w = i GROUP BY strategy")
def _(spark, sf):
    rows = V.windows(spark, sf).where("window_id <> 12").withColumn("window_id", F.col("window_id") - 1)
    return rounded(W.completed_windows(rows, ["strategy"]), "latest_oos_score", "latest_oos_net_profit")


@query("w14_cycle_seeds")
def _(spark, sf):
    """Three evolution cycles: each shifts the seed and re-uses the bank's best sets."""
    from tidebar.operators.registry import bank_rows, bank_top

    ids = V.table(spark, sf, "events").select(F.col("event_id").alias("sample_no"))
    bank = bank_rows(V.topk(spark, sf)).withColumnRenamed("train_rank", "row_no")
    seeds = materialize(bank_top(bank, 5).select(F.col("row_no").alias("sample_no"), "params_json"))  # once for all cycles
    cycles = [
        W.distinct_candidates(seeds, W.params_text(W.sample_parameters(ids, "breakout_range", 42 + c * 1000))).withColumn("cycle", F.lit(c))
        for c in range(3)
    ]
    return cycles[0].unionByName(cycles[1]).unionByName(cycles[2])
