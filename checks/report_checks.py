"""A: metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r6, rounded
from checks.sql import r, with_
from checks.trade_checks import BREAKOUT, PLAIN
from checks.trade_sql import breakout_sig, trades_sql
from tidebar.operators import metrics as M
from tidebar.operators import reports as R
from tidebar.plans import testviews as V

G = ["strategy"]
T_ORDER, E_ORDER = ("exit_time", "trade_id"), ("datetime", "seq")

TRADE_STATS = f"""SELECT strategy, count(*)::DOUBLE AS trade_count, {r('avg((pnl_net > 0)::INT)')} AS win_rate, {r('sum(pnl_net)')} AS net_profit,
 {r('coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0)')} AS gross_profit, {r('coalesce(sum(pnl_net) FILTER (pnl_net < 0), 0)')} AS gross_loss,
 {r('CASE WHEN coalesce(sum(pnl_net) FILTER (pnl_net < 0), 0) < 0 THEN abs(sum(pnl_net) FILTER (pnl_net > 0) / sum(pnl_net) FILTER (pnl_net < 0)) ELSE 0 END')} AS profit_factor,
 {r('avg(pnl_net)')} AS avg_trade, {r('avg(pnl_net)')} AS expectancy,
 {r('coalesce(avg(pnl_net) FILTER (pnl_net > 0) / abs(avg(pnl_net) FILTER (pnl_net < 0)), 0)')} AS payoff_ratio,
 {r('CASE WHEN count(*) FILTER (pnl_net < 0) > 0 THEN count(*) FILTER (pnl_net > 0) / count(*) FILTER (pnl_net < 0) ELSE count(*) FILTER (pnl_net > 0) END')} AS win_loss_ratio"""

STREAK = """sx AS (SELECT strategy, sign(pnl_net) AS s, row_number() OVER (PARTITION BY strategy ORDER BY exit_time, trade_id)
  - row_number() OVER (PARTITION BY strategy, sign(pnl_net) ORDER BY exit_time, trade_id) AS isl FROM trades),
streak AS (SELECT strategy, coalesce(max(n) FILTER (s > 0), 0)::DOUBLE AS w, coalesce(max(n) FILTER (s < 0), 0)::DOUBLE AS l FROM (SELECT strategy, s, isl, count(*) AS n FROM sx GROUP BY ALL) GROUP BY strategy)"""

EQ = """er AS (SELECT *, max(equity) OVER w - equity AS dd, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret FROM equity WINDOW w AS (PARTITION BY strategy ORDER BY datetime, seq)),
em AS (SELECT strategy, date_trunc('month', datetime) AS mo, arg_max(equity, n) AS last FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY datetime, seq) AS n FROM equity) GROUP BY ALL),
mr AS (SELECT strategy, last / nullif(lag(last) OVER (PARTITION BY strategy ORDER BY mo), 0) - 1 AS r FROM em),
es AS (SELECT strategy, greatest(max(dd), 0) AS dd, CASE WHEN count(*) < 3 OR coalesce(stddev_samp(ret), 0) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe,
  min(datetime) AS lo, max(datetime) AS hi, max(equity) AS top, arg_min(equity, (datetime, seq)) AS first FROM er GROUP BY strategy),
ms AS (SELECT strategy, coalesce(avg(r), 0) * 100 AS m, coalesce(stddev_samp(r), 0) * 100 AS s, coalesce(avg((r > 0)::INT), 0) * 100 AS p FROM mr GROUP BY strategy)"""


@query("a1_trade_metrics", with_("trades") + TRADE_STATS + " FROM trades GROUP BY strategy")
def _(spark, sf):
    out = M.trade_stats(V.trades(spark, sf), G).drop("avg_trade_duration_min", "held_seconds")
    return rounded(out, *[c for c in out.columns if c != "strategy"])


@query("a2_streaks", with_("trades", extra=STREAK) + "SELECT strategy, w AS max_consecutive_wins, l AS max_consecutive_losses FROM streak")
def _(spark, sf):
    return M.streaks(V.trades(spark, sf), G, T_ORDER)


@query("a3_a4_a5_equity_metrics", with_("equity", extra=EQ) + f"SELECT strategy, {r('dd')} AS max_drawdown, {r('sharpe')} AS sharpe_like, {r('m')} AS monthly_return_mean_pct, {r('s')} AS monthly_return_std_pct, {r('p')} AS positive_months_pct FROM es JOIN ms USING (strategy)")
def _(spark, sf):
    out = M.equity_stats(V.equity(spark, sf), G, E_ORDER)
    names = ["max_drawdown", "sharpe_like", "monthly_return_mean_pct", "monthly_return_std_pct", "positive_months_pct"]
    return out.select("strategy", *[r6(c).alias(c) for c in names])


PERF = f"""SELECT t.strategy, trade_count, win_rate, net_profit, gross_profit, gross_loss, profit_factor, avg_trade, expectancy, payoff_ratio, win_loss_ratio,
 w AS max_consecutive_wins, l AS max_consecutive_losses, avg_trade_duration_min, {r('least(greatest(100.0 * held / epoch(hi - lo), 0), 100)')} AS exposure_pct, {r('dd')} AS max_drawdown,
 {r('100.0 * dd / 100000.0')} AS max_drawdown_pct, {r('100.0 * net_profit / 100000.0')} AS return_pct, {r('CASE WHEN dd > 0 THEN net_profit / dd ELSE 0 END')} AS recovery_factor,
 {r('m')} AS monthly_return_mean_pct, {r('s')} AS monthly_return_std_pct, {r('p')} AS positive_months_pct, {r('sharpe')} AS sharpe_like,
 {r('net_profit - 1.5 * dd - greatest(20 - trade_count, 0) * 150.0')} AS score
 FROM ({TRADE_STATS}, {r('avg(epoch(exit_time - entry_time)) / 60.0')} AS avg_trade_duration_min, sum(epoch(exit_time - entry_time)) AS held FROM trades GROUP BY strategy) t
 JOIN streak USING (strategy) JOIN es USING (strategy) JOIN ms USING (strategy)"""


@query("a6_a7_performance", with_("trades", "equity", extra=STREAK + ",\n" + EQ) + PERF)
def _(spark, sf):
    out = M.performance(V.trades(spark, sf), V.equity(spark, sf), G, V.INITIAL_CAPITAL, trade_order=T_ORDER, equity_order=E_ORDER)
    return rounded(out, *M.METRICS)


@query("a7_score_presets", with_("trades", "equity", extra=EQ + ",\npre AS (SELECT * FROM (VALUES ('conservador', 2.4, 35, 220.0), ('equilibrado', 1.5, 20, 150.0), ('agressivo', 0.9, 8, 70.0)) v(preset, w, n, p))")
       + f"SELECT strategy, preset, {r('net - w * dd - greatest(n - cnt, 0) * p')} AS score FROM (SELECT strategy, sum(pnl_net) AS net, count(*) AS cnt FROM trades GROUP BY 1) JOIN es USING (strategy), pre")
def _(spark, sf):
    stats = M.trade_stats(V.trades(spark, sf), G).join(M.equity_stats(V.equity(spark, sf), G, E_ORDER), G)
    args = F.col("net_profit"), F.col("max_drawdown"), F.col("trade_count")
    items = F.array(*[F.struct(F.lit(n).alias("preset"), M.robust_score(*args, s).alias("score")) for n, s in M.SCORE_PRESETS.items()])
    return stats.select("strategy", F.inline(items)).select("strategy", "preset", r6("score").alias("score"))


@query("a8_worst_daily", with_("trades") + f"SELECT strategy, {r('min(d)')} AS worst_daily_pnl FROM (SELECT strategy, CAST(exit_time AS DATE) AS day, sum(pnl_net) AS d FROM trades GROUP BY ALL) GROUP BY strategy")
def _(spark, sf):
    return rounded(M.worst_daily(V.trades(spark, sf), G), "worst_daily_pnl")


@query("a9_hard_limits", with_("trades", "equity", extra=EQ + ",\nwd AS (SELECT strategy, min(d) AS d FROM (SELECT strategy, CAST(exit_time AS DATE) AS day, sum(pnl_net) AS d FROM trades GROUP BY ALL) GROUP BY strategy)")
       + f"""SELECT strategy, {r('d')} AS worst_daily_pnl, CASE WHEN d < -400 OR 100.0 * dd / 100000 > 3.0 THEN 0.0 ELSE 1.0 END::DOUBLE AS constraints_ok,
 {r('CASE WHEN d < -400 OR 100.0 * dd / 100000 > 3.0 THEN -1e15 ELSE net - 1.5 * dd - greatest(20 - n, 0) * 150.0 END')} AS score
 FROM (SELECT strategy, sum(pnl_net) AS net, count(*) AS n FROM trades GROUP BY 1) JOIN es USING (strategy) JOIN wd USING (strategy)""")
def _(spark, sf):
    trades, equity = V.trades(spark, sf), V.equity(spark, sf)
    perf = M.performance(trades, equity, G, V.INITIAL_CAPITAL, trade_order=T_ORDER, equity_order=E_ORDER)
    out = M.apply_hard_limits(perf, trades, G, 400.0, 3.0)
    return rounded(out.select("strategy", "worst_daily_pnl", "constraints_ok", "score"), "worst_daily_pnl", "score")


@query("a10_monthly_report", with_("equity", extra="""en AS (SELECT *, strftime(datetime, '%Y-%m') AS month, row_number() OVER (PARTITION BY strategy ORDER BY datetime, seq) AS n FROM equity),
ed AS (SELECT *, max(equity) OVER (PARTITION BY strategy, month ORDER BY n) - equity AS dd FROM en),
mm AS (SELECT strategy, month, arg_min(equity, n) AS s, arg_max(equity, n) AS e, max(dd) AS dd FROM ed GROUP BY ALL),
tt AS (SELECT strategy, strftime(exit_time, '%Y-%m') AS month, count(*)::DOUBLE AS n, avg((pnl_net > 0)::INT) AS wr, coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) AS gp, coalesce(sum(pnl_net) FILTER (pnl_net < 0), 0) AS gl FROM trades GROUP BY ALL)""")
       + f"""SELECT strategy, month, {r('s')} AS start_equity, {r('e')} AS end_equity, {r('e - s')} AS net_profit, {r('100.0 * (e - s) / s')} AS return_pct, coalesce(n, 0)::DOUBLE AS trade_count,
 {r('coalesce(wr, 0)')} AS win_rate, {r('CASE WHEN gl < 0 THEN abs(gp / gl) ELSE 0 END')} AS profit_factor, {r('dd')} AS max_drawdown FROM mm LEFT JOIN tt USING (strategy, month)""")
def _(spark, sf):
    out = R.monthly_report(V.trades(spark, sf), V.equity(spark, sf), G, V.INITIAL_CAPITAL, E_ORDER)
    return rounded(out, *[c for c in out.columns if c not in ("strategy", "month")])


@query("a11_hourly_report", with_("trades") + f"""SELECT strategy, CAST(hour(entry_time) AS INTEGER) AS hour, count(*)::DOUBLE AS trade_count, {r('avg((pnl_net > 0)::INT)')} AS win_rate, {r('sum(pnl_net)')} AS net_profit,
 {r('coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0)')} AS gross_profit, {r('coalesce(sum(pnl_net) FILTER (pnl_net < 0), 0)')} AS gross_loss, {r('avg(pnl_net)')} AS avg_trade,
 {r('CASE WHEN coalesce(sum(pnl_net) FILTER (pnl_net < 0), 0) < 0 THEN abs(coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) / sum(pnl_net) FILTER (pnl_net < 0)) ELSE 0 END')} AS profit_factor FROM trades GROUP BY ALL""")
def _(spark, sf):
    out = R.hourly_report(V.trades(spark, sf), G)
    return rounded(out, *[c for c in out.columns if c not in ("strategy", "hour")])


OOS = """oos AS (SELECT strategy, count(*) AS total_windows, avg(oos_score) AS mu, coalesce(stddev_samp(oos_score), 0) AS sd, min(oos_score) AS lo, max(oos_score) AS hi,
 avg((oos_net_profit > 0)::INT) * 100 AS pos, coalesce(corr(best_train_score, oos_score), 0) AS cor FROM windows GROUP BY strategy)"""


@query("a12_a13_oos_summary", with_("windows", extra=OOS) + f"SELECT strategy, total_windows, {r('mu')} AS oos_score_mean, {r('sd')} AS oos_score_std, {r('lo')} AS oos_score_min, {r('hi')} AS oos_score_max, {r('pos')} AS positive_oos_windows_pct, {r('cor')} AS train_test_score_corr FROM oos")
def _(spark, sf):
    out = R.oos_summary(V.windows(spark, sf), G)
    return rounded(out, *[c for c in out.columns if c not in ("strategy", "total_windows")])


STABLE = """st AS (SELECT strategy, best_train_params_json AS j, count(*) AS n FROM windows GROUP BY ALL),
kv AS (SELECT strategy, 'k' AS key, json_extract_string(j, '$.k') AS value, sum(n) AS n FROM st GROUP BY ALL)"""


@query("a14_parameter_stability", with_("windows", extra=STABLE) + f"""SELECT strategy, {r('dominant_ratio')} AS dominant_ratio, n_unique_full_sets, key, unique_values, most_common_value, {r('mr')} AS most_common_ratio
 FROM (SELECT strategy, max(n) / sum(n) AS dominant_ratio, count(*) AS n_unique_full_sets FROM st GROUP BY strategy)
 JOIN (SELECT strategy, key, count(*) AS unique_values, arg_min(value, (-n, value)) AS most_common_value, max(n) / sum(n) AS mr FROM kv GROUP BY ALL) USING (strategy)""")
def _(spark, sf):
    out = R.parameter_stability(V.windows(spark, sf), G)
    flat = out.select("strategy", r6("dominant_ratio").alias("dominant_ratio"), "n_unique_full_sets", F.explode("parameters").alias("key", "p"))
    return flat.select("strategy", "dominant_ratio", "n_unique_full_sets", "key", F.col("p.unique_values").alias("unique_values"),
                       F.col("p.most_common_value").alias("most_common_value"), r6(F.col("p.most_common_ratio")).alias("most_common_ratio"))


TOPK = """tw AS (SELECT strategy, window_id, arg_min(test_score, train_rank) AS t1, avg(test_score) AS mu FROM topk GROUP BY ALL),
tk AS (SELECT strategy, avg(t1 - mu) AS d, avg(t1) AS t1, avg(mu) AS mu FROM tw GROUP BY strategy)"""


@query("a15_topk_dispersion", with_("topk", extra=TOPK) + f"SELECT strategy, {r('d')} AS avg_top1_minus_topk_mean, {r('t1')} AS avg_top1_test_score, {r('mu')} AS avg_topk_test_score FROM tk")
def _(spark, sf):
    return rounded(R.topk_dispersion(V.topk(spark, sf), G), "avg_top1_minus_topk_mean", "avg_top1_test_score", "avg_topk_test_score")


@query("a16_robustness_alerts", with_("windows", "equity", extra=OOS + ",\n" + STABLE + """,
dd AS (SELECT strategy, max(d) / 1000.0 AS pct FROM (SELECT strategy, max(equity) OVER (PARTITION BY strategy ORDER BY datetime, seq) - equity AS d FROM equity) GROUP BY 1),
al AS (SELECT o.strategy, unnest([CASE WHEN pos < 50 THEN {'severity': 'high', 'code': 'LOW_POSITIVE_WINDOWS'} END, CASE WHEN abs(mu) > 1e-9 AND sd > abs(mu) * 1.5 THEN {'severity': 'medium', 'code': 'HIGH_SCORE_VOLATILITY'} END,
 CASE WHEN cor < 0 THEN {'severity': 'high', 'code': 'NEGATIVE_TRAIN_TEST_CORR'} END, CASE WHEN pct > 20 THEN {'severity': 'medium', 'code': 'HIGH_DRAWDOWN'} END,
 CASE WHEN s.dr < 0.4 THEN {'severity': 'low', 'code': 'UNSTABLE_PARAMS'} END]) AS a FROM oos o JOIN dd USING (strategy) JOIN (SELECT strategy, max(n) / sum(n) AS dr FROM st GROUP BY 1) s USING (strategy))""")
       + "SELECT strategy, a.severity AS severity, a.code AS code FROM al WHERE a IS NOT NULL")
def _(spark, sf):
    dd = M.equity_stats(V.equity(spark, sf), G, E_ORDER).select("strategy", (F.col("max_drawdown") / 1000.0).alias("max_drawdown_pct"))
    out = R.robustness_report(V.windows(spark, sf), V.topk(spark, sf), dd, G)
    return out.select("strategy", F.inline("alerts")).select("strategy", "severity", "code")


@query("a17_parameter_sensitivity", with_("topk") + f"""SELECT strategy, 'k' AS parameter, json_extract_string(params_json, '$.k') AS value, count(test_score) AS samples, {r('avg(test_score)')} AS avg_test_score,
 {r('coalesce(stddev_samp(test_score), 0)')} AS std_test_score, {r('avg(test_net_profit)')} AS avg_test_net_profit, {r('avg(test_max_drawdown)')} AS avg_test_max_drawdown FROM topk GROUP BY ALL""")
def _(spark, sf):
    out = R.parameter_sensitivity(V.topk(spark, sf), G)
    return rounded(out, "avg_test_score", "std_test_score", "avg_test_net_profit", "avg_test_max_drawdown")


BRL = lambda x: f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs({x})), ',.', '.,'))"
DUR = lambda s: (f"(CASE WHEN floor({s})::BIGINT // 3600 > 0 THEN (floor({s})::BIGINT // 3600)::VARCHAR || 'h' || lpad(((floor({s})::BIGINT % 3600) // 60)::VARCHAR, 2, '0') || 'min' || lpad((floor({s})::BIGINT % 60)::VARCHAR, 2, '0') || 's' "
                 f"WHEN (floor({s})::BIGINT % 3600) // 60 > 0 THEN ((floor({s})::BIGINT % 3600) // 60)::VARCHAR || 'min' || lpad((floor({s})::BIGINT % 60)::VARCHAR, 2, '0') || 's' ELSE (floor({s})::BIGINT % 60)::VARCHAR || 's' END)")


@query("a18_operations_table", with_("trades", extra="o AS (SELECT *, 100.0 + sum(pnl_net) OVER (PARTITION BY strategy ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS tot FROM trades)")
       + f"""SELECT strategy, trade_id, exit_time, strftime(entry_time, '%d/%m/%Y %H:%M:%S') AS abertura, strftime(exit_time, '%d/%m/%Y %H:%M:%S') AS fechamento, {DUR('epoch(exit_time - entry_time)')} AS tempo_op, 2 AS qtd,
 CASE WHEN direction = 'long' THEN 'C' ELSE 'V' END AS lado, printf('%.3f', CASE WHEN direction = 'long' THEN entry_price ELSE exit_price END) AS preco_compra,
 printf('%.3f', CASE WHEN direction = 'long' THEN exit_price ELSE entry_price END) AS preco_venda, {BRL('pnl_net')} AS resultado, printf('%.2f', pnl_points) AS resultado_pts,
 printf('%.2f', 100.0 * pnl_net / 100.0) || '%' AS resultado_pct, {BRL('tot')} AS total, {r('pnl_net')} AS resultado_num, {r('tot')} AS total_num FROM o""")
def _(spark, sf):
    out = R.operations_table(V.trades(spark, sf), G, 100.0, 2, T_ORDER)
    return rounded(out, "resultado_num", "total_num")


def summary_sql(capital: str, base: str) -> str:
    return with_("trades", "equity", extra=STREAK + ",\n" + EQ + f""",
bal AS (SELECT *, sum(pnl_net) OVER (PARTITION BY strategy ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS b FROM trades),
bd AS (SELECT strategy, max(d) AS tdd, max(t) AS ttop FROM (SELECT strategy, max(b) OVER w - b AS d, max(b) OVER w AS t FROM bal WINDOW w AS (PARTITION BY strategy ORDER BY exit_time, trade_id)) GROUP BY 1),
q AS (SELECT strategy, sum(pnl_net) AS net, coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) AS gp, coalesce(sum(pnl_net) FILTER (pnl_net < 0), 0) AS gl, count(*) AS n, count(*) FILTER (pnl_net > 0) AS nw, count(*) FILTER (pnl_net < 0) AS nl,
 count(*) FILTER (pnl_net = 0) AS nf, avg(pnl_net) AS mu, avg(pnl_net) FILTER (pnl_net > 0) AS mw, avg(pnl_net) FILTER (pnl_net < 0) AS ml, max(pnl_net) AS mx, min(pnl_net) AS mn,
 avg(epoch(exit_time - entry_time)) FILTER (pnl_net > 0) AS tw, avg(epoch(exit_time - entry_time)) FILTER (pnl_net < 0) AS tl, avg(epoch(exit_time - entry_time)) AS ta FROM trades GROUP BY strategy)""") + f"""
SELECT strategy, {r('net')} AS saldo_liquido_total, {r('gp')} AS lucro_bruto, {r('gl')} AS prejuizo_bruto, {r('CASE WHEN gl < 0 THEN abs(gp / gl) WHEN gp > 0 THEN 999 ELSE 0 END')} AS fator_lucro, n AS numero_operacoes,
 nw AS operacoes_vencedoras, nl AS operacoes_perdedoras, nf AS operacoes_zeradas, {r('mu')} AS media_lucro_prejuizo, {r('mw')} AS media_operacoes_vencedoras, {r('ml')} AS media_operacoes_perdedoras,
 {r('mx')} AS maior_operacao_vencedora, {r('mn')} AS maior_operacao_perdedora, w::BIGINT AS maior_sequencia_vencedora, l::BIGINT AS maior_sequencia_perdedora, {DUR('tw')} AS media_tempo_operacao_vencedora,
 {DUR('tl')} AS media_tempo_operacao_perdedora, {DUR('ta')} AS tempo_medio_operacao_total, 3::BIGINT AS maximo_contratos, {r(f'100.0 * net / {capital}')} AS retorno_capital_inicial_pct, {r('top')} AS patrimonio_maximo,
 {r('dd')} AS declinio_maximo_topo_fundo_valor, {r(f'100.0 * dd / {capital}')} AS declinio_maximo_topo_fundo_pct, {r('tdd')} AS declinio_maximo_trade_a_trade_valor, {r(f'100.0 * tdd / {base}')} AS declinio_maximo_trade_a_trade_pct
 FROM q JOIN streak USING (strategy) JOIN es USING (strategy) JOIN bd USING (strategy)"""


SUMMARY_ROUND = ("saldo_liquido_total", "lucro_bruto", "prejuizo_bruto", "fator_lucro", "media_lucro_prejuizo", "media_operacoes_vencedoras", "media_operacoes_perdedoras",
                 "maior_operacao_vencedora", "maior_operacao_perdedora", "retorno_capital_inicial_pct", "patrimonio_maximo", "declinio_maximo_topo_fundo_valor",
                 "declinio_maximo_topo_fundo_pct", "declinio_maximo_trade_a_trade_valor", "declinio_maximo_trade_a_trade_pct")


@query("a19_performance_summary", summary_sql("100000.0", "100000.0"))
def _(spark, sf):
    out = R.performance_summary(V.trades(spark, sf), V.equity(spark, sf), G, V.INITIAL_CAPITAL, 3, trade_order=T_ORDER, equity_order=E_ORDER)
    return rounded(out, *SUMMARY_ROUND)


@query("a20_viewer_summary", summary_sql("first", "(first + ttop)"))
def _(spark, sf):
    out = R.performance_summary(V.trades(spark, sf), V.equity(spark, sf), G, None, 3, over_peak=True, trade_order=T_ORDER, equity_order=E_ORDER)
    return rounded(out, *SUMMARY_ROUND)


@query("a21_pnl_split", with_("equity", extra="f AS (SELECT *, equity - first_value(equity) OVER (PARTITION BY strategy ORDER BY datetime, seq) AS g FROM equity)")
       + f"SELECT strategy, datetime, seq, {r('g')} AS pnl, {r('CASE WHEN g >= 0 THEN g END')} AS pnl_positive, {r('CASE WHEN g < 0 THEN g END')} AS pnl_negative FROM f")
def _(spark, sf):
    out = R.pnl_split(V.equity(spark, sf), G, E_ORDER)
    return out.select("strategy", "datetime", "seq", *[r6(c).alias(c) for c in ("pnl", "pnl_positive", "pnl_negative")])


@query("flagship_breakout", trades_sql(breakout_sig(BREAKOUT[1:]), BREAKOUT[1:], PLAIN, f"SELECT symbol, count(*)::DOUBLE AS trade_count, {r('sum(pnl_net)')} AS net_profit, {r('avg((pnl_net > 0)::INT)')} AS win_rate FROM tr GROUP BY symbol"))
def _(spark, sf):
    from tidebar.operators.trades import run_trades

    trades = run_trades(V.indexed_bars(spark, sf), "breakout_range", BREAKOUT[1:], PLAIN)
    return rounded(M.trade_stats(trades, ["symbol"]).select("symbol", "trade_count", "net_profit", "win_rate"), "net_profit", "win_rate")
