"""R: streams and their batch twins; T17 and T18 runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query, r6, rounded
from checks.signal_checks import PARAMS, signal_sql, trend_source
from checks.indicator_checks import TR, ema_cte, hilo_ctes, wilder_ctes
from checks.source_checks import scratch
from checks.sql import r, with_
from checks.trade_checks import BREAKOUT, PLAIN
from checks.trade_sql import breakout_sig, chain, equity_ctes, params_cte
from tidebar.operators.params import params_frame
from tidebar.operators.trades import admitted_trades, equity_curve, trade_columns
from tidebar.plans import parity as PT
from tidebar.plans import testviews as V
from tidebar.session import materialize
from tidebar.streaming import progress as PG
from tidebar.streaming import risk as RK
from tidebar.streaming import tick_bars as TB

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


@query("r1_stream_bars", with_("bars") + "SELECT symbol, timeframe, datetime, open, high, low, close, volume FROM bars")
def _(spark, sf):
    as_ticks = lambda rows: rows.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("datetime"), F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    root = scratch(spark)
    closing = TB.closing_tick(as_ticks(V.table(spark, sf, "events")), "60m")
    closing.limit(0).write.parquet(f"{root}/closing")
    stream = as_ticks(TB.stream_ticks(spark, f"{sf}/events*.parquet", EVENTS)).unionByName(TB.stream_ticks(spark, f"{root}/closing", closing.schema))
    bars = TB.stream_bars(stream, "60m")
    TB.run_available(bars, f"{root}/bars", f"{root}/state")
    closing.write.mode("append").parquet(f"{root}/closing")
    TB.run_available(bars, f"{root}/bars", f"{root}/state")
    return spark.read.schema(bars.schema).parquet(f"{root}/bars")


LIMITS = RK.RiskLimits(daily_loss_limit=150.0, max_drawdown_pct=0.9, max_consecutive_losses=7)

BREACH = """ev AS (SELECT strategy, exit_time AS ts, trade_id AS seq, CAST(exit_time AS DATE) AS d, pnl_net, equity, greatest(100000.0, max(equity) OVER (PARTITION BY strategy ORDER BY exit_time, trade_id)) AS pk,
 sum(pnl_net) OVER (PARTITION BY strategy, CAST(exit_time AS DATE) ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS dp,
 count(*) FILTER (pnl_net > 0) OVER (PARTITION BY strategy, CAST(exit_time AS DATE) ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS w
 FROM trades t JOIN (SELECT strategy, seq AS trade_id, equity FROM equity) USING (strategy, trade_id)),
ek AS (SELECT *, count(*) FILTER (pnl_net < 0) OVER (PARTITION BY strategy, d, w ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS st FROM ev),
hit AS (SELECT strategy, ts, seq, CASE WHEN 100.0 * (pk - equity) / pk >= 0.9 THEN 'MAX_DRAWDOWN_PCT' WHEN dp <= -150 THEN 'DAILY_LOSS_LIMIT' WHEN st >= 7 THEN 'MAX_CONSECUTIVE_LOSSES' END AS code,
 CASE WHEN 100.0 * (pk - equity) / pk >= 0.9 THEN 100.0 * (pk - equity) / pk WHEN dp <= -150 THEN dp ELSE st END AS value, row_number() OVER (PARTITION BY strategy ORDER BY ts, seq) AS rn FROM ek
 WHERE 100.0 * (pk - equity) / pk >= 0.9 OR dp <= -150 OR st >= 7)"""


def account_events(spark, sf):
    eq = V.equity(spark, sf).select("strategy", F.col("seq").alias("trade_id"), "equity")
    return V.trades(spark, sf).join(eq, ["strategy", "trade_id"]).select(
        F.col("strategy").alias("account"), F.col("exit_time").alias("ts"), F.col("trade_id").alias("seq"), F.lit("close").alias("kind"), "equity", "pnl_net")


@query("r2_first_breach", with_("trades", "equity", extra=BREACH) + f"SELECT strategy AS account, ts, seq, code, {r('value')} AS value FROM hit WHERE rn = 1")
def _(spark, sf):
    return rounded(RK.first_breach(account_events(spark, sf), LIMITS, V.INITIAL_CAPITAL), "value")


EVENT_ROWS = T.StructType([
    T.StructField("account", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("equity", T.DoubleType()), T.StructField("pnl_net", T.DoubleType())])


@query("r2_first_breach_stream", with_("trades", "equity", extra=BREACH) + f"SELECT strategy AS account, ts, seq, code, {r('value')} AS value FROM hit WHERE rn = 1")
def _(spark, sf):
    root = scratch(spark)
    lateness = "40 days"
    # A file holds a month of events; every third event comes a month late, and no file is in order.
    events = materialize(account_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "part", F.floor(F.unix_timestamp("ts") / 2_592_000) + F.when(F.col("seq") % 3 == 0, 1).otherwise(0)))
    for month in [r.part for r in events.select("part").distinct().orderBy("part").collect()]:
        events.where(F.col("part") == month).drop("part").repartition(3, "seq").write.mode("append").parquet(f"{root}/in")
    RK.use_rocksdb(spark)
    source = spark.readStream.schema(EVENT_ROWS).option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
    out = RK.monitor_stream(source, LIMITS, V.INITIAL_CAPITAL, lateness)
    TB.run_available(out, f"{root}/out", f"{root}/state")
    RK.closing_event(events, lateness).write.mode("append").parquet(f"{root}/in")
    TB.run_available(out, f"{root}/out", f"{root}/state")
    back = spark.read.schema(RK.BREACH_SCHEMA).parquet(f"{root}/out")
    return back.select("account", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "code", r6("value").alias("value"))


@query("r3_alerts", with_("trades", "equity", extra=BREACH) + """SELECT strategy AS account, seq, 'high' AS level, code, CASE WHEN code = 'MAX_DRAWDOWN_PCT' THEN printf('Drawdown %.2f%% >= limite 0.90%%', value) WHEN code = 'DAILY_LOSS_LIMIT' THEN printf('Perda diaria %.2f <= -150.00', value)
 ELSE printf('Sequencia de perdas %d >= limite 7', value::BIGINT) END AS message, CASE WHEN code = 'MAX_CONSECUTIVE_LOSSES' THEN '{"consecutive_losses":' || value::BIGINT::VARCHAR || '}' WHEN code = 'DAILY_LOSS_LIMIT' THEN 'day_pnl' ELSE 'drawdown_pct' END AS context
 FROM hit WHERE rn = 1""")
def _(spark, sf):
    out = RK.alerts(RK.first_breach(account_events(spark, sf), LIMITS, V.INITIAL_CAPITAL), LIMITS)
    name = F.regexp_extract("context_json", r'"(\w+)"', 1)
    context = F.when(name == "consecutive_losses", F.col("context_json")).otherwise(name)
    return out.select("account", "seq", "level", "code", "message", context.alias("context"))


CUT_BASE = PLAIN.but(point_value=20.0)
CUT_LIMITS = RK.RiskLimits(daily_loss_limit=3000.0, max_drawdown_pct=6.0)

CUT = """, mk AS (SELECT e.symbol, e.param_id, e.bar_idx, e.datetime, 0 AS ph, lag(cash, 1, 100000.0) OVER (PARTITION BY e.symbol, e.param_id ORDER BY e.bar_idx) + coalesce((SELECT sum((i.open - t.entry_price) * t.side * 20.0) FROM tr t JOIN idx i ON i.symbol = t.symbol AND i.bar_idx = e.bar_idx WHERE t.symbol = e.symbol AND t.param_id = e.param_id AND t.entry_idx < e.bar_idx AND t.exit_idx >= e.bar_idx), 0) AS equity, NULL::DOUBLE AS pnl FROM eq e
 UNION ALL SELECT e.symbol, e.param_id, e.bar_idx, e.datetime, 1, cash, t.pnl_net FROM eq e JOIN tr t ON t.symbol = e.symbol AND t.param_id = e.param_id AND t.exit_idx = e.bar_idx
 UNION ALL SELECT symbol, param_id, bar_idx, datetime, 2, equity, NULL FROM eq),
mr AS (SELECT *, greatest(100000.0, max(equity) OVER (PARTITION BY symbol, param_id ORDER BY bar_idx, ph)) AS pk, sum(pnl) OVER (PARTITION BY symbol, param_id, CAST(datetime AS DATE) ORDER BY bar_idx, ph ROWS UNBOUNDED PRECEDING) AS dp FROM mk),
ht AS (SELECT symbol, param_id, arg_min(bar_idx, bar_idx * 3 + ph) AS hb, arg_min(ph, bar_idx * 3 + ph) AS hp FROM mr WHERE 100.0 * (pk - equity) / pk >= 6.0 OR (ph = 1 AND dp <= -3000) GROUP BY ALL),
ct AS (SELECT t.*, hb, hp, CASE WHEN hp = 0 THEN hb <= exit_idx WHEN hp = 2 THEN hb < exit_idx OR (hb = exit_idx AND exit_reason = 'end_of_data') ELSE false END AS cut FROM tr t LEFT JOIN ht USING (symbol, param_id)
 WHERE hb IS NULL OR (CASE WHEN hp = 0 THEN entry_idx < hb ELSE entry_idx <= hb END))"""


@query("r4_risk_cut_trades", with_("idx", extra=breakout_sig(BREAKOUT) + ",\n" + params_cte(BREAKOUT, CUT_BASE) + ",\n" + chain(CUT_BASE) + equity_ctes(CUT_BASE) + CUT, recursive=True)
       + f"""SELECT c.symbol, c.param_id, sig_idx, entry_idx, CASE WHEN coalesce(cut, false) THEN hb ELSE exit_idx END AS exit_idx, CASE WHEN NOT coalesce(cut, false) THEN exit_reason WHEN hp = 0 THEN 'risk_halt' ELSE 'risk_halt_close' END AS exit_reason,
 {r('CASE WHEN NOT coalesce(cut, false) THEN c.pnl_net ELSE ((CASE WHEN hp = 0 THEN i.open ELSE i.close END) - entry_price) * side * 20.0 - 1.0 END')} AS pnl_net FROM ct c LEFT JOIN idx i ON i.symbol = c.symbol AND i.bar_idx = hb""")
def _(spark, sf):
    bars = materialize(V.indexed_bars(spark, sf))
    keys, group = ["symbol", "timeframe"], ["symbol", "timeframe", "param_id"]
    priced = materialize(admitted_trades(bars, "breakout_range", BREAKOUT, CUT_BASE))
    trades = trade_columns(priced, group, "breakout_range")
    eq = materialize(equity_curve(trades, bars, params_frame(spark, BREAKOUT).select("param_id"), CUT_BASE))
    halts = RK.first_breach(RK.risk_events(trades, eq, bars, CUT_BASE, keys, group), CUT_LIMITS, CUT_BASE.initial_capital, group)
    out = RK.cut_trades(priced, halts, bars, CUT_BASE, keys, group)
    return out.select("symbol", "param_id", "sig_idx", "entry_idx", "exit_idx", "exit_reason", r6("pnl_net").alias("pnl_net"))


def log_lines(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    two = lambda c: F.format_string("%.2f", c)
    head = F.concat(F.lit("[PROGRESS] "), F.when(i % 3 == 0, "5m").otherwise("60m"), F.lit("/"), "event_type", F.lit(" "))
    line = (
        F.when(i % 41 == 0, F.concat(F.lit("[WARN] 5m/"), "event_type", F.lit(": failed")))
        .when(i % 17 == 0, F.concat(head, F.lit("done score="), two(v), F.lit(" net="), two(v * 2), F.lit(" pf="), two(v + 3)))
        .when(i % 5 == 0, F.concat(head, F.lit("window 2/9 done oos_score="), two(v - 9), F.lit(" oos_net="), two(v + 9), F.lit(" oos_pf="), two(v + 4)))
        .when(i % 2 == 0, F.concat(head, F.lit("sample 4/100 score="), two(v + 1), F.lit(" net="), two(v + 2), F.lit(" pf="), two(v + 5)))
        .otherwise(F.concat(F.lit("noise "), "props")))
    return V.table(spark, sf, "events").select(i.alias("seq"), line.alias("line"))


@query("r5_progress_board", f"""WITH l AS (SELECT event_id AS seq, event_type AS strategy, CASE WHEN event_id % 41 = 0 THEN '5m' WHEN event_id % 3 = 0 THEN '5m' ELSE '60m' END AS timeframe, value AS v,
 CASE WHEN event_id % 41 = 0 THEN 'w' WHEN event_id % 17 = 0 THEN 'd' WHEN event_id % 5 = 0 THEN 'o' WHEN event_id % 2 = 0 THEN 's' END AS k FROM events),
f AS (SELECT *, CASE k WHEN 'w' THEN 'Erro' WHEN 'd' THEN 'Concluida' ELSE 'Em andamento' END AS status, CASE WHEN k = 'd' THEN printf('%.2f', v)::DOUBLE END AS score,
 CASE k WHEN 'd' THEN printf('%.2f', v * 2)::DOUBLE WHEN 'o' THEN printf('%.2f', v + 9)::DOUBLE WHEN 's' THEN printf('%.2f', v + 2)::DOUBLE END AS net, CASE WHEN k = 'o' THEN printf('%.2f', v - 9)::DOUBLE END AS ps,
 CASE WHEN k = 'o' THEN printf('%.2f', v + 9)::DOUBLE END AS pn, CASE WHEN k = 's' THEN printf('%.2f', v + 1)::DOUBLE END AS tsc, CASE k WHEN 'd' THEN printf('%.2f', v + 3)::DOUBLE WHEN 'o' THEN printf('%.2f', v + 4)::DOUBLE WHEN 's' THEN printf('%.2f', v + 5)::DOUBLE END AS pf FROM l WHERE k IS NOT NULL)
SELECT timeframe, strategy, arg_max(status, seq) AS status, {r('arg_max(score, seq) FILTER (score IS NOT NULL)')} AS score, {r('arg_max(net, seq) FILTER (net IS NOT NULL)')} AS net_profit,
 {r('arg_max(ps, seq) FILTER (ps IS NOT NULL)')} AS partial_score, {r('arg_max(pn, seq) FILTER (pn IS NOT NULL)')} AS partial_net, {r('arg_max(tsc, seq) FILTER (tsc IS NOT NULL)')} AS train_score, {r('arg_max(pf, seq) FILTER (pf IS NOT NULL)')} AS profit_factor FROM f GROUP BY timeframe, strategy""")
def _(spark, sf):
    return rounded(PG.progress_board(log_lines(spark, sf)), *PG.FIELDS)


PARITY = {**{k: v for k, v in PARAMS["trx_htsl"].items()}, "max_consecutive_losses_per_day": 2}


def parity_sql(select: str) -> str:
    sig = signal_sql("", trend_source(20), "adx >= 8 AND close > ema AND close > hilo", "adx >= 8 AND close < ema AND close < hilo",
                     "(hour(datetime) * 60 + minute(datetime)) BETWEEN 540 AND 1080 AND hour(datetime) BETWEEN 9 AND 18 AND CAST(datetime AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
    body = sig[sig.index("SELECT symbol, bar_idx, datetime,"):].replace("SELECT symbol, bar_idx, datetime,", "SELECT symbol, bar_idx, 0::BIGINT AS param_id,", 1)
    extra = ",\n".join([TR, wilder_ctes(14, 14), hilo_ctes(10), ema_cte("em", 20), f"sig AS ({body})", params_cte([PARITY], PLAIN), chain(PLAIN).replace("\ntr AS (", "\nadmitted AS (")])
    return with_("idx", extra=extra, recursive=True) + select


@query("t17_parity_run", parity_sql(f"SELECT symbol, count(*)::BIGINT AS numero_operacoes, {r('sum(pnl_net)')} AS saldo_liquido_total, {r('avg(pnl_net)')} AS media_lucro_prejuizo, count(*) FILTER (pnl_net > 0) AS operacoes_vencedoras FROM admitted GROUP BY symbol"))
def _(spark, sf):
    out = PT.run_parity(V.indexed_bars(spark, sf), PLAIN, PARITY).summary
    return rounded(out.select("symbol", "numero_operacoes", "saldo_liquido_total", "media_lucro_prejuizo", "operacoes_vencedoras"), "saldo_liquido_total", "media_lucro_prejuizo")


DAY_SETS = [{"lookback": 3, "min_range_points": 20, "stop_points": 30, "take_points": 45}]
DAYS = """ib AS (SELECT b.* , CAST(datetime AS DATE) AS day, row_number() OVER (PARTITION BY symbol, CAST(datetime AS DATE) ORDER BY datetime) - 1 AS bar_idx FROM bars b)"""


MADE_DAYS = """tkd AS (SELECT symbol, CAST(datetime AS DATE) AS day, make_timestamp(CAST(ceil(epoch_us(datetime)/3600000000.0) AS BIGINT)*3600000000) AS datetime, price, volume,
 row_number() OVER (PARTITION BY symbol ORDER BY datetime, seq) AS seq FROM ticks),
kpt AS (SELECT *, CAST(datetime AS DATE) AS day FROM bars WHERE day(datetime) % 3 <> 0),
alb AS (SELECT symbol, timeframe, datetime, open, high, low, close, volume, day FROM kpt UNION ALL
 SELECT symbol, '60m', datetime, arg_min(price, seq), max(price), min(price), arg_max(price, seq), sum(volume), day FROM tkd t WHERE NOT EXISTS (SELECT 1 FROM kpt k WHERE k.symbol = t.symbol AND k.day = t.day) GROUP BY symbol, day, datetime),
ib AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY datetime) - 1 AS bar_idx FROM alb)"""


def days_sql(days: str) -> str:
    """Every (symbol, day) of ``days`` (relation ib) as a run of its own."""
    return (with_("bars", extra=days + ",\n" + breakout_sig(DAY_SETS, "ib", "symbol, day") + ",\n" + params_cte(DAY_SETS, PLAIN) + ",\n" + chain(PLAIN, "ib", "symbol, day") + equity_ctes(PLAIN, "ib", "symbol, day") + """,
m AS (SELECT symbol, day, max(d) AS dd FROM (SELECT symbol, day, max(equity) OVER (PARTITION BY symbol, day ORDER BY bar_idx) - equity AS d FROM eq) GROUP BY ALL),
q AS (SELECT symbol, day, count(*) AS n, sum(pnl_net) AS net, avg((pnl_net > 0)::INT) AS wr FROM tr GROUP BY ALL),
ls AS (SELECT DISTINCT symbol, CAST(datetime AS DATE) + 1 AS day FROM ticks), tc AS (SELECT symbol, CAST(datetime AS DATE) AS day, count(*) AS ticks FROM ticks GROUP BY ALL)""", recursive=True)
       + f"""SELECT symbol, day::VARCHAR AS day, CASE WHEN ticks IS NULL THEN 'sem_tick' WHEN dd IS NULL THEN 'sem_candle' ELSE 'ok' END AS status, coalesce(ticks, 0) AS ticks,
 CASE WHEN ticks IS NULL THEN 0 ELSE coalesce(n, 0) END::DOUBLE AS trade_count, {r('CASE WHEN ticks IS NULL THEN 0 ELSE coalesce(net, 0) END')} AS net_profit, {r('CASE WHEN ticks IS NULL THEN 0 ELSE coalesce(wr, 0) END')} AS win_rate,
 {r('CASE WHEN ticks IS NULL THEN 0 ELSE coalesce(dd, 0) END')} AS max_drawdown FROM ls LEFT JOIN tc USING (symbol, day) LEFT JOIN m USING (symbol, day) LEFT JOIN q USING (symbol, day)""")


@query("t18_validate_days", days_sql(DAYS))
def _(spark, sf):
    ticks = V.ticks(spark, sf)
    listed = ticks.select("symbol", F.date_add(F.col("datetime").cast("date"), 1).alias("day"))
    out = PT.validate_days(ticks, V.bars(spark, sf), listed, "breakout_range", DAY_SETS[0], PLAIN, by_tick=False)
    return rounded(out.select("symbol", "day", "status", "ticks", "trade_count", "net_profit", "win_rate", "max_drawdown"), "net_profit", "win_rate", "max_drawdown")


@query("t18_validate_days_by_tick")
def _(spark, sf):
    ticks = V.ticks(spark, sf)
    listed = ticks.select("symbol", F.col("datetime").cast("date").alias("day"))
    days = PT.validate_days(ticks, V.bars(spark, sf), listed, "breakout_range", DAY_SETS[0], PLAIN, by_tick=True)
    return rounded(PT.validation_totals(days), "net_profit", "mean_day", "positive_days_pct")


@query("t18_days_without_candles", days_sql(MADE_DAYS))
def _(spark, sf):
    # the bars of a third of the days are gone; the ticks of a day make them
    ticks, bars = V.ticks(spark, sf), V.bars(spark, sf).where("day(datetime) % 3 <> 0")
    listed = ticks.select("symbol", F.date_add(F.col("datetime").cast("date"), 1).alias("day"))
    out = PT.validate_days(ticks, bars, listed, "breakout_range", DAY_SETS[0], PLAIN, by_tick=False, timeframe="60m")
    return rounded(out.select("symbol", "day", "status", "ticks", "trade_count", "net_profit", "win_rate", "max_drawdown"), "net_profit", "win_rate", "max_drawdown")
