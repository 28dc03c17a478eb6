"""U: reconciliation and run registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r6, rounded
from checks.sql import r, with_
from tidebar.operators import matching as N
from tidebar.operators import registry as U
from tidebar.plans import testviews as V
from tidebar.sources import parameters as PA

TOL = 1800

PAIRS = f"""pr AS (SELECT a.no AS a, b.no AS b, abs(epoch_us(a.entry_time) - epoch_us(b.entry_time)) / 1e6 AS ge, abs(epoch_us(a.exit_time) - epoch_us(b.exit_time)) / 1e6 AS gx, abs(a.pnl_net - b.pnl_net) AS gp
 FROM ba a JOIN bb b ON a.user_id = b.user_id AND (a.dir = b.dir OR a.dir = 'unknown' OR b.dir = 'unknown')),
ps AS (SELECT *, least(ge, gx) * 1000.0 + gp AS score FROM pr WHERE least(ge, gx) <= {TOL}),
ord AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM ps)),
pk AS (SELECT i, a, list(b ORDER BY score, b) AS bs FROM ps JOIN ord USING (a) GROUP BY ALL),
gr AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b
 UNION ALL SELECT n.i, CASE WHEN n.pick IS NULL THEN n.used ELSE list_append(n.used, n.pick) END, n.a, n.pick FROM (
  SELECT k.i, g.used, k.a, list_filter(k.bs, lambda x: NOT list_contains(g.used, x))[1] AS pick FROM gr g JOIN pk k ON k.i = g.i + 1) n),
mt AS (SELECT gr.a, gr.b, ge, gx FROM gr JOIN ps ON ps.a = gr.a AND ps.b = gr.b)"""


def books(spark, sf):
    return V.half_book(spark, sf, 0), V.half_book(spark, sf, 1)


@query("u1_match_trades", with_("books", extra=PAIRS, recursive=True) + f"SELECT a AS a_id, b AS b_id, {r('ge')} AS entry_gap, {r('gx')} AS exit_gap FROM mt")
def _(spark, sf):
    a, b = books(spark, sf)
    return rounded(N.match_trades(a, b, TOL, by=["user_id"]), "entry_gap", "exit_gap")


DETAIL = f"""dt AS (SELECT m.a, m.b, abs(a.entry_price - b.entry_price) AS pe, abs(a.exit_price - b.exit_price) AS px, abs(a.pnl_net - b.pnl_net) AS pp FROM mt m JOIN ba a ON a.no = m.a JOIN bb b ON b.no = m.b),
dd AS (SELECT *, pe <= 20 AND px <= 20 AND pp <= 20 AS eqv FROM dt)"""


@query("u2_match_detail", with_("books", extra=PAIRS + ",\n" + DETAIL, recursive=True) + f"SELECT a AS a_id, b AS b_id, {r('pe')} AS entry_price_diff, {r('px')} AS exit_price_diff, {r('pp')} AS pnl_net_diff, true AS within_time_tol, pe <= 20 AND px <= 20 AS within_price_tol, pp <= 20 AS within_pnl_tol, eqv AS equivalent FROM dd")
def _(spark, sf):
    a, b = books(spark, sf)
    d = N.match_detail(N.match_trades(a, b, TOL, by=["user_id"]), a, b, TOL, 20.0, 20.0)
    out = d.select("a_id", "b_id", "entry_price_diff", "exit_price_diff", "pnl_net_diff", "within_time_tol", "within_price_tol", "within_pnl_tol", "equivalent")
    return rounded(out, "entry_price_diff", "exit_price_diff", "pnl_net_diff")


@query("u2_match_summary", with_("books", extra=PAIRS + ",\n" + DETAIL, recursive=True) + f"""SELECT na AS a_trade_count, nb AS b_trade_count, n AS matched_trade_count, na - n AS only_a_count, nb - n AS only_b_count, {r('sa')} AS a_net, {r('sb')} AS b_net, {r('sa - sb')} AS net_diff,
 {r('100.0 * n / na')} AS match_rate_a_pct, {r('100.0 * n / nb')} AS match_rate_b_pct, {r('coalesce(e, 0)')} AS equivalent_matches_pct, (na = nb AND n = na AND abs(sa - sb) <= 20 AND n > 0 AND e = 100) AS strict_parity
 FROM (SELECT count(*) AS na, sum(pnl_net) AS sa FROM ba), (SELECT count(*) AS nb, sum(pnl_net) AS sb FROM bb), (SELECT count(*) AS n, avg(eqv::INT) * 100 AS e FROM dd)""")
def _(spark, sf):
    a, b = books(spark, sf)
    d = N.match_detail(N.match_trades(a, b, TOL, by=["user_id"]), a, b, TOL, 20.0, 20.0)
    return rounded(N.match_summary(a, b, d, 20.0), "a_net", "b_net", "net_diff", "match_rate_a_pct", "match_rate_b_pct", "equivalent_matches_pct")


@query("u2_only_in_a", with_("books", extra=PAIRS, recursive=True) + f"SELECT no AS trade_id, user_id, {r('pnl_net')} AS pnl_net FROM ba WHERE no NOT IN (SELECT a FROM mt)")
def _(spark, sf):
    a, b = books(spark, sf)
    return N.unmatched(a, N.match_trades(a, b, TOL, by=["user_id"]), "a").select("trade_id", "user_id", r6("pnl_net").alias("pnl_net"))


BANK = "bank AS (SELECT '{\"k\":' || json_extract_string(params_json, '$.k') || '}' AS params_json, test_score, train_score, train_rank AS row_no FROM topk)"


@query("u3_params_bank_top", with_("topk", extra=BANK) + f"SELECT params_json, {r('max(test_score)')} AS test_score, arg_max(row_no, (test_score, -row_no)) AS row_no FROM bank GROUP BY params_json ORDER BY max(test_score) DESC, params_json LIMIT 30")
def _(spark, sf):
    bank = U.bank_rows(V.topk(spark, sf)).withColumnRenamed("train_rank", "row_no")
    return U.bank_top(bank, 30).select("params_json", r6("test_score").alias("test_score"), "row_no")


@query("u4_merge_banks", with_("topk", extra=BANK) + f"SELECT params_json, {r('max(test_score)')} AS test_score, arg_max(row_no, (test_score, -CAST(row_no % 2 AS INTEGER), -row_no)) AS row_no FROM bank GROUP BY params_json")
def _(spark, sf):
    bank = U.bank_rows(V.topk(spark, sf)).withColumnRenamed("train_rank", "row_no")
    out = U.merge_banks([bank.where("row_no % 2 = 0"), bank.where("row_no % 2 = 1")])
    return out.select("params_json", r6("test_score").alias("test_score"), "row_no")


ROWD = "sha256(strftime(datetime, '%Y-%m-%dT%H:%M:%S') || ',' || concat_ws(',', open::VARCHAR, high::VARCHAR, low::VARCHAR, close::VARCHAR, volume::VARCHAR))"


@query("u5_fingerprint", with_("bars", extra=f"""rd AS (SELECT symbol, timeframe, CAST(datetime AS DATE) AS day, {ROWD} AS d FROM bars),
dg AS (SELECT symbol, timeframe, day, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM rd GROUP BY ALL)""")
       + "SELECT symbol, timeframe, sha256(string_agg(day::VARCHAR || ':' || d, chr(10) ORDER BY day::VARCHAR || ':' || d)) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM dg GROUP BY ALL")
def _(spark, sf):
    return U.fingerprint(V.bars(spark, sf))


FRESH = "fresh AS (SELECT * REPLACE (score + 1 AS score, CAST(created_at + INTERVAL 1 DAY AS TIMESTAMP) AS created_at) FROM history WHERE symbol = 'F')"


@query("u6_u7_history_upsert", with_("history", extra=FRESH) + f"SELECT run_tag, timeframe, strategy, created_at, {r('score')} AS score FROM (SELECT * FROM history WHERE symbol <> 'F' UNION ALL SELECT * FROM fresh)")
def _(spark, sf):
    h = V.history(spark, sf)
    fresh = h.where("symbol = 'F'").withColumns({"score": F.col("score") + 1, "created_at": F.col("created_at") + F.expr("interval 1 day")})
    return U.upsert(h, fresh, ["run_tag", "timeframe", "strategy"]).select("run_tag", "timeframe", "strategy", "created_at", r6("score").alias("score"))


@query("u8_consolidate_histories", with_("history") + f"""SELECT tag, timeframe, strategy, created_at, run_tag, rank_in_run, {r('score')} AS score FROM (
 SELECT *, run_tag // 7 AS tag, row_number() OVER (PARTITION BY run_tag // 7, timeframe, strategy ORDER BY created_at DESC NULLS LAST, rank_in_run, CASE WHEN symbol = 'O' THEN 0 ELSE 1 END, run_tag) AS rn FROM history) WHERE rn = 1""")
def _(spark, sf):
    h = V.history(spark, sf).withColumn("tag", F.floor(F.col("run_tag") / 7).cast("long"))
    out = U.consolidate([h.where("symbol = 'O'"), h.where("symbol <> 'O'")], ["tag", "timeframe", "strategy"], "rank_in_run")
    return out.select("tag", "timeframe", "strategy", "created_at", "run_tag", "rank_in_run", r6("score").alias("score"))


@query("u9_global_ranking", with_("history") + f"""SELECT symbol, timeframe, strategy, count(run_tag) AS runs, {r('max(net_profit)')} AS best_pnl, {r('avg(net_profit)')} AS avg_pnl, {r('max(score)')} AS best_score, {r('avg(score)')} AS avg_score,
 {r('avg(win_rate)')} AS avg_win_rate, {r('avg(max_drawdown)')} AS avg_dd, max(created_at) AS last_run FROM history WHERE net_profit > 0 GROUP BY ALL""")
def _(spark, sf):
    out = U.global_ranking(V.history(spark, sf), ["symbol", "timeframe", "strategy"], only_positive=True)
    return rounded(out, "best_pnl", "avg_pnl", "best_score", "avg_score", "avg_win_rate", "avg_dd")


@query("u10_top_runs", with_("history") + f"SELECT run_tag, sha256(params_json) AS params_hash, {r('net_profit')} AS net_profit, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY params_json ORDER BY net_profit DESC, score DESC, run_tag) AS rn FROM history) WHERE rn = 1 ORDER BY net_profit DESC, score DESC, run_tag LIMIT 10")
def _(spark, sf):
    return U.top_runs(V.history(spark, sf)).select("run_tag", "params_hash", r6("net_profit").alias("net_profit"), r6("score").alias("score"))


@query("u11_strategy_rollup", with_("history") + f"""SELECT timeframe, strategy, count(run_tag) AS runs, {r('max(score)')} AS best_score, {r('avg(score)')} AS avg_score, {r('max(net_profit)')} AS best_pnl, {r('avg(net_profit)')} AS avg_pnl,
 {r('avg(win_rate)')} AS avg_win_rate, {r('avg(max_drawdown)')} AS avg_dd, {r('avg(trade_count)')} AS avg_trades, max(created_at) AS last_run, {r('arg_max(net_profit, (created_at, run_tag))')} AS last_pnl, {r('arg_max(score, (created_at, run_tag))')} AS last_score FROM history GROUP BY ALL""")
def _(spark, sf):
    out = U.strategy_rollup(V.history(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("timeframe", "strategy", "runs", "last_run")])


@query("u12_filtered_history", with_("history") + f"SELECT run_tag, created_at, symbol, timeframe, strategy, {r('net_profit')} AS net_profit FROM history WHERE symbol = 'O' AND timeframe = '5m' AND strategy = '1-URGENT' AND net_profit > 0")
def _(spark, sf):
    out = U.filter_history(V.history(spark, sf), "O", "5m", "1-URGENT", True)
    return out.select("run_tag", "created_at", "symbol", "timeframe", "strategy", r6("net_profit").alias("net_profit"))


@query("u13_validated_strategies", with_("history") + "SELECT DISTINCT strategy FROM history WHERE (net_profit > 290000 OR (symbol = 'P' AND net_profit > 0)) AND strategy IN ('1-URGENT', '2-HIGH', 'other')")
def _(spark, sf):
    h = V.history(spark, sf)
    registry = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("other",)], "strategy string")
    return U.validated_strategies(h.withColumn("net_profit", F.col("net_profit") - 290000), h.where("symbol = 'P'"), registry)


@query("u13_known_strategies", with_("history", "topk") + "SELECT strategy FROM history WHERE strategy <> '' UNION SELECT strategy FROM topk WHERE strategy <> ''")
def _(spark, sf):
    return U.known_strategies(V.history(spark, sf).select("strategy"), V.topk(spark, sf).select("strategy"))


@query("u14_parameter_candidates", with_("history") + f"SELECT canon AS params_json, run_tag, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY score DESC, net_profit DESC, run_tag) AS rn FROM history WHERE strategy = '2-HIGH' AND timeframe = '5m') WHERE rn = 1 ORDER BY score DESC, run_tag LIMIT 10")
def _(spark, sf):
    return U.parameter_candidates(V.history(spark, sf), "2-HIGH", "5m").select("params_json", "run_tag", r6("score").alias("score"))


@query("u14_candidates_from_files", with_("history") + f"""SELECT canon AS params_json, run_tag::VARCHAR AS run_tag, {r('score')} AS avg_test_score, {r('net_profit')} AS avg_test_net_profit, rank_in_run AS windows FROM (
 SELECT *, row_number() OVER (PARTITION BY canon ORDER BY score DESC, net_profit DESC, run_tag) AS rn FROM history WHERE strategy = '2-HIGH' AND timeframe = '5m' AND run_tag % 4 <> 0) WHERE rn = 1 ORDER BY score DESC, net_profit DESC, run_tag LIMIT 10""")
def _(spark, sf):
    # every run names a file of parameters, as snapshot or as latest; those of every fourth run are gone
    h = V.history(spark, sf).withColumn("file", F.concat_ws("/", F.lit("outputs"), "symbol", "timeframe", F.concat(F.lit("params_"), "run_tag", F.lit(".json"))))
    value = F.concat(F.lit('{"strategies": {"'), "strategy", F.lit('": {"best_params_from_tests": '), "params_json", F.lit("}}}"))
    files = PA.strategy_params(h.where("run_tag % 4 <> 0").select("file", value.alias("value")), "2-HIGH")
    snap = F.col("run_tag") % 3 == 0
    runs = h.select(F.col("run_tag").cast("string").alias("run_tag"), "timeframe", F.col("strategy").alias("best_strategy"), F.col("score").alias("best_score"), F.col("net_profit").alias("best_net_profit"),
                    F.col("rank_in_run").alias("windows"), F.when(snap, F.col("file")).otherwise("").alias("best_params_snapshot"), F.when(~snap, F.col("file")).alias("best_params_latest"))
    return rounded(U.candidates_from_files(runs, files, "2-HIGH", "5m"), "avg_test_score", "avg_test_net_profit")


@query("w10_best_parameters", with_("topk", extra="g AS (SELECT strategy, params_json, avg(test_score) AS s, count(*) AS n FROM topk GROUP BY ALL)") + f"SELECT strategy, params_json, {r('s')} AS avg_test_score, n AS windows FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY s DESC, n DESC, params_json) AS rn FROM g) WHERE rn = 1")
def _(spark, sf):
    return rounded(U.best_parameters(V.topk(spark, sf), ["strategy"]), "avg_test_score")


@query("w11_top_parameter_candidates", with_("topk", extra="g AS (SELECT strategy, params_json, avg(test_score) AS s, avg(test_net_profit) AS p, count(*) AS n FROM topk GROUP BY ALL)") + f"SELECT * FROM (SELECT strategy, params_json, {r('s')} AS avg_test_score, {r('p')} AS avg_test_net_profit, n AS windows, row_number() OVER (PARTITION BY strategy ORDER BY s DESC, p DESC, n DESC, params_json) AS rank FROM g) WHERE rank <= 10")
def _(spark, sf):
    return rounded(U.top_parameters(V.topk(spark, sf), ["strategy"], 10), "avg_test_score", "avg_test_net_profit")
