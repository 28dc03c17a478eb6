"""Report tables from trades, equity and walk-forward results (inventory A10-A21)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import SECONDS_PER_DAY
from tidebar.functions.scans import Run, running, time_block
from tidebar.operators.metrics import equity_stats, profit_factor, seconds_between, streaks


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_report(
    trades: DataFrame, equity: DataFrame, group: Sequence[str], capital: float, equity_order: Sequence[str] = ("datetime",)
) -> DataFrame:
    """Start and end equity, return, trades and drawdown inside each calendar month with equity rows."""
    group = list(group)
    eq = equity.select(*dict.fromkeys([*group, *equity_order, "datetime", "equity"])).withColumn("month", month_text(F.col("datetime")))
    scanned = running(eq, [*group, "month"], equity_order, time_block(F.col("datetime")), [Run("_peak", "max", F.col("equity"))])
    position = F.col(equity_order[0]) if len(equity_order) == 1 else F.struct(*equity_order)
    months = scanned.groupBy(*group, "month").agg(
        F.min_by("equity", position).alias("start_equity"),
        F.max_by("equity", position).alias("end_equity"),
        F.max(F.col("_peak") - F.col("equity")).alias("max_drawdown"),
    )
    pnl = F.col("pnl_net")
    closed = trades.groupBy(*group, month_text(F.col("exit_time")).alias("month")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("wr"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("gp"), F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("gl"),
    )
    net = F.col("end_equity") - F.col("start_equity")
    base = F.when(F.abs("start_equity") > 1e-12, F.col("start_equity")).otherwise(F.lit(max(capital, 1e-12)))
    zero = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0.0))
    return months.join(closed, [*group, "month"], "left").select(
        *group, "month", "start_equity", "end_equity", net.alias("net_profit"), (100.0 * net / base).alias("return_pct"),
        zero("n").alias("trade_count"), zero("wr").alias("win_rate"),
        zero(profit_factor(F.col("gp"), F.col("gl"))).alias("profit_factor"), "max_drawdown",
    )


def hourly_report(trades: DataFrame, group: Sequence[str]) -> DataFrame:
    """Results by hour of entry (of exit where there is no entry time), best hour first."""
    pnl = F.coalesce("pnl_net", F.lit(0.0))
    hours = trades.select(*group, F.hour(F.coalesce("entry_time", "exit_time")).alias("hour"), pnl.alias("pnl")).where("hour is not null")
    p = F.col("pnl")
    out = hours.groupBy(*group, "hour").agg(
        F.count(F.lit(1)).cast("double").alias("trade_count"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum(p).alias("net_profit"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0)).alias("gross_loss"), F.avg(p).alias("avg_trade"),
    )
    return out.withColumn("profit_factor", profit_factor(F.col("gross_profit"), F.col("gross_loss"))).orderBy(
        *group, F.col("net_profit").desc()
    )


def parse_params(column: Column | str) -> Column:
    """JSON object as map<string,string>; anything else is null."""
    return F.from_json(column, "map<string,string>")


def parameter_stability(windows: DataFrame, group: Sequence[str]) -> DataFrame:
    """How often the same parameter set, and the same value of each parameter, won a window."""
    group = list(group)
    sets = windows.groupBy(*group, "best_train_params_json").agg(F.count(F.lit(1)).alias("n"))
    overall = sets.groupBy(*group).agg(
        (F.max("n") / F.sum("n")).alias("dominant_ratio"), F.count(F.lit(1)).alias("n_unique_full_sets"), F.sum("n").alias("_windows")
    )
    # Work on distinct sets with their counts from here on.
    parsed = sets.select(*group, "n", F.coalesce(parse_params("best_train_params_json"), F.create_map().cast("map<string,string>")).alias("m"))
    present = parsed.select(*group, "n", F.explode("m").alias("key", "value")).groupBy(*group, "key", "value").agg(F.sum("n").alias("n"))
    keyed = present.groupBy(*group, "key").agg(F.sum("n").alias("_with"))
    absent = keyed.join(overall, group).where(F.col("_with") < F.col("_windows")).select(
        *group, "key", F.lit("").alias("value"), (F.col("_windows") - F.col("_with")).alias("n")
    )
    values = present.unionByName(absent).groupBy(*group, "key", "value").agg(F.sum("n").alias("n"))
    per_key = values.groupBy(*group, "key").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common_value"),
        (F.max("n") / F.sum("n")).alias("most_common_ratio"),
    )
    maps = per_key.groupBy(*group).agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("key", F.struct("unique_values", "most_common_value", "most_common_ratio"))
        ))).alias("parameters")
    )
    return overall.join(maps, group, "left").select(
        *group, "dominant_ratio", "n_unique_full_sets",
        F.coalesce("parameters", F.create_map().cast(maps.schema["parameters"].dataType)).alias("parameters"),
    )


def topk_dispersion(topk: DataFrame, group: Sequence[str]) -> DataFrame:
    group = list(group)
    per_window = topk.groupBy(*group, "window_id").agg(
        F.min_by("test_score", "train_rank").alias("top1"), F.avg("test_score").alias("mean")
    )
    return per_window.groupBy(*group).agg(
        F.avg(F.col("top1") - F.col("mean")).alias("avg_top1_minus_topk_mean"),
        F.avg("top1").alias("avg_top1_test_score"), F.avg("mean").alias("avg_topk_test_score"),
    )


def oos_summary(windows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Out-of-sample score statistics and the train/test correlation (0 where undefined)."""
    x, y = F.col("best_train_score"), F.col("oos_score")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    # ANSI corr() divides by zero on constant input
    corr = F.try_divide(F.covar_samp(xs, ys), F.nullif(F.stddev_samp(xs) * F.stddev_samp(ys), F.lit(0.0)))
    return windows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.coalesce(F.avg(y), F.lit(0.0)).alias("oos_score_mean"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("oos_score_std"),
        F.coalesce(F.min(y), F.lit(0.0)).alias("oos_score_min"),
        F.coalesce(F.max(y), F.lit(0.0)).alias("oos_score_max"),
        (F.avg(F.when(F.col("oos_net_profit") > 0, 1.0).otherwise(0.0)) * 100.0).alias("positive_oos_windows_pct"),
        # coalesce first: least and greatest skip nulls
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(corr, F.lit(0.0)))).alias("train_test_score_corr"),
    )


# Alert codes, severities and texts.
ALERTS = (
    ("high", "LOW_POSITIVE_WINDOWS", "Menos de 50% das janelas OOS com lucro."),
    ("medium", "HIGH_SCORE_VOLATILITY", "Volatilidade de score OOS alta em relacao a media."),
    ("high", "NEGATIVE_TRAIN_TEST_CORR", "Correlacao treino vs teste negativa (possivel overfit)."),
    ("medium", "HIGH_DRAWDOWN", "Drawdown maximo acima de 20% do capital."),
    ("low", "UNSTABLE_PARAMS", "Baixa repeticao do melhor conjunto de parametros entre janelas."),
)


def robustness_alerts() -> Column:
    """Array of (severity, code, message) from the robustness columns of a row."""
    mean = F.abs("oos_score_mean")
    rules = (
        F.col("positive_oos_windows_pct") < 50.0,
        (mean > 1e-9) & (F.col("oos_score_std") > mean * 1.5),
        F.col("train_test_score_corr") < 0.0,
        F.col("max_drawdown_pct") > 20.0,
        F.col("dominant_ratio") < 0.40,
    )
    items = [
        F.when(rule, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(m).alias("message")))
        for rule, (s, c, m) in zip(rules, ALERTS)
    ]
    return F.array_compact(F.array(*items))


def robustness_report(windows: DataFrame, topk: DataFrame, drawdowns: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group: score statistics, parameter stability, dispersion and alerts.

    ``drawdowns`` holds ``max_drawdown_pct`` per group.
    """
    group = list(group)
    joined = (
        oos_summary(windows, group)
        .join(parameter_stability(windows, group), group, "left")
        .join(topk_dispersion(topk, group), group, "left")
        .join(drawdowns.select(*group, "max_drawdown_pct"), group, "left")
        .withColumn("max_drawdown_pct", F.coalesce("max_drawdown_pct", F.lit(0.0)))
    )
    spread = ("avg_top1_minus_topk_mean", "avg_top1_test_score", "avg_topk_test_score")
    return joined.select(
        *group, "total_windows", "oos_score_mean", "oos_score_std", "oos_score_min", "oos_score_max",
        "positive_oos_windows_pct", "train_test_score_corr",
        F.struct("dominant_ratio", "n_unique_full_sets", "parameters").alias("parameter_stability"),
        F.struct(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in spread]).alias("topk_dispersion"),
        robustness_alerts().alias("alerts"),
    )


def parameter_sensitivity(topk: DataFrame, group: Sequence[str]) -> DataFrame:
    """Test results by (parameter, value); rows whose JSON is unreadable contribute nothing."""
    rows = topk.select(
        *group, F.explode(parse_params("params_json")).alias("parameter", "value"), "test_score", "test_net_profit", "test_max_drawdown"
    )
    return rows.groupBy(*group, "parameter", "value").agg(
        F.count("test_score").alias("samples"),
        F.avg("test_score").alias("avg_test_score"),
        F.coalesce(F.stddev_samp("test_score"), F.lit(0.0)).alias("std_test_score"),
        F.avg("test_net_profit").alias("avg_test_net_profit"),
        F.avg("test_max_drawdown").alias("avg_test_max_drawdown"),
    ).orderBy(*group, "parameter", F.col("avg_test_score").desc())


def brl(value: Column) -> Column:
    """'R$ 1.234,56'."""
    text = F.translate(F.format_number(F.abs(value), 2), ",.", ".,")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("R$ "), text)


def duration_text(seconds: Column) -> Column:
    """'1h02min03s', '2min03s' or '3s'."""
    t = F.floor(F.greatest(seconds, F.lit(0.0))).cast("int")
    h, m, s = F.floor(t / 3600).cast("int"), F.floor(F.pmod(t, F.lit(3600)) / 60).cast("int"), F.pmod(t, F.lit(60))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("min"), two(s), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("min"), two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def operations_table(
    trades: DataFrame, group: Sequence[str], capital: float, contracts: int, order: Sequence[str] = ("exit_time",)
) -> DataFrame:
    """Broker-style list of operations with running total; the total is rounded where only the noise of float sums is left."""
    totals = running(trades, group, order, time_block(F.col(order[0])), [Run("_sum", "sum", F.col("pnl_net"))])
    long, pnl = F.col("direction") == "long", F.col("pnl_net").cast("double")
    total = F.round(F.lit(float(capital)) + F.col("_sum"), 6) + F.lit(0.0)
    stamp = lambda c: F.date_format(F.col(c), "dd/MM/yyyy HH:mm:ss")
    fixed = lambda c, digits: F.format_string(f"%.{digits}f", c)
    return totals.select(
        *group, *[c for c in order if c != "exit_time"], "exit_time",
        stamp("entry_time").alias("abertura"), stamp("exit_time").alias("fechamento"),
        duration_text(seconds_between("exit_time", "entry_time")).alias("tempo_op"),
        F.lit(max(1, int(contracts))).alias("qtd"),
        F.when(long, "C").when(F.col("direction") == "short", "V").otherwise("-").alias("lado"),
        fixed(F.when(long, F.col("entry_price")).otherwise(F.col("exit_price")), 3).alias("preco_compra"),
        fixed(F.when(long, F.col("exit_price")).otherwise(F.col("entry_price")), 3).alias("preco_venda"),
        brl(pnl).alias("resultado"), fixed(F.col("pnl_points").cast("double"), 2).alias("resultado_pts"),
        F.concat(fixed(100.0 * pnl / F.lit(max(float(capital), 1e-9)), 2), F.lit("%")).alias("resultado_pct"),
        brl(total).alias("total"), pnl.alias("resultado_num"), total.alias("total_num"),
    )


def performance_summary(
    trades: DataFrame,
    equity: DataFrame,
    group: Sequence[str],
    capital: float | None,
    contracts: int = 1,
    over_peak: bool = False,
    trade_order: Sequence[str] = ("exit_time",),
    equity_order: Sequence[str] = ("datetime",),
) -> DataFrame:
    """Trading summary in broker terms.

    ``capital=None`` takes the first equity value. ``over_peak`` expresses the trade-to-trade drawdown in
    percent of the highest trade balance instead of the capital. No losses but gains: profit factor 999.
    """
    group = list(group)
    pnl, win, loss = F.col("pnl_net"), F.col("pnl_net") > 0, F.col("pnl_net") < 0
    secs = F.coalesce(seconds_between("exit_time", "entry_time"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = trades.groupBy(*group).agg(
        F.sum(pnl).alias("net"), zero(F.sum(F.when(win, pnl))).alias("gain"), zero(F.sum(F.when(loss, pnl))).alias("lost"),
        F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.count_if(pnl == 0).alias("flats"),
        F.avg(pnl).alias("mean"), zero(F.avg(F.when(win, pnl))).alias("mean_win"), zero(F.avg(F.when(loss, pnl))).alias("mean_loss"),
        zero(F.max(F.when(win, pnl))).alias("best"), zero(F.min(F.when(loss, pnl))).alias("worst"),
        F.avg(F.when(win, secs)).alias("t_win"), F.avg(F.when(loss, secs)).alias("t_loss"), F.avg(secs).alias("t_all"),
    )
    curve = equity_stats(equity, group, equity_order)
    balance = running(
        trades.select(*dict.fromkeys([*group, *trade_order, "pnl_net"])), group, trade_order, time_block(F.col(trade_order[0])),
        [Run("_bal", "sum", F.col("pnl_net"))],
    )
    peaks = running(balance, group, trade_order, time_block(F.col(trade_order[0])), [Run("_top", "max", F.col("_bal"))])
    tops = peaks.groupBy(*group).agg(F.max(F.col("_top") - F.col("_bal")).alias("trade_dd"), F.max("_top").alias("trade_top"))
    start = F.lit(float(capital)) if capital is not None else F.col("first_equity")
    floor = F.greatest(start, F.lit(1e-9))
    joined = stats.join(curve, group, "left").join(tops, group, "left").join(streaks(trades, group, trade_order), group, "left")
    trade_base = F.greatest(start + F.col("trade_top"), F.lit(1e-9)) if over_peak else floor
    shown = lambda c: F.coalesce(duration_text(F.col(c)), F.lit("0min"))
    return joined.select(
        *group, F.col("net").alias("saldo_liquido_total"), F.col("gain").alias("lucro_bruto"), F.col("lost").alias("prejuizo_bruto"),
        profit_factor(F.col("gain"), F.col("lost"), 999.0).alias("fator_lucro"), F.col("n").alias("numero_operacoes"),
        F.col("wins").alias("operacoes_vencedoras"), F.col("losses").alias("operacoes_perdedoras"), F.col("flats").alias("operacoes_zeradas"),
        F.col("mean").alias("media_lucro_prejuizo"), F.col("mean_win").alias("media_operacoes_vencedoras"),
        F.col("mean_loss").alias("media_operacoes_perdedoras"), F.col("best").alias("maior_operacao_vencedora"),
        F.col("worst").alias("maior_operacao_perdedora"),
        F.coalesce("max_consecutive_wins", F.lit(0.0)).cast("long").alias("maior_sequencia_vencedora"),
        F.coalesce("max_consecutive_losses", F.lit(0.0)).cast("long").alias("maior_sequencia_perdedora"),
        shown("t_win").alias("media_tempo_operacao_vencedora"), shown("t_loss").alias("media_tempo_operacao_perdedora"),
        shown("t_all").alias("tempo_medio_operacao_total"), F.lit(max(1, int(contracts))).cast("long").alias("maximo_contratos"),
        (100.0 * F.col("net") / floor).alias("retorno_capital_inicial_pct"),
        F.coalesce("equity_peak", start).alias("patrimonio_maximo"),
        zero(F.col("max_drawdown")).alias("declinio_maximo_topo_fundo_valor"),
        F.when(start > 0, 100.0 * zero(F.col("max_drawdown")) / floor).otherwise(F.lit(0.0)).alias("declinio_maximo_topo_fundo_pct"),
        zero(F.col("trade_dd")).alias("declinio_maximo_trade_a_trade_valor"),
        F.when(start > 0, 100.0 * zero(F.col("trade_dd")) / trade_base).otherwise(F.lit(0.0)).alias("declinio_maximo_trade_a_trade_pct"),
    )


def pnl_split(equity: DataFrame, group: Sequence[str], order: Sequence[str] = ("datetime",)) -> DataFrame:
    """Profit since the first equity row, split into its positive and negative part."""
    scanned = running(
        equity, group, order, time_block(F.col("datetime"), 7 * SECONDS_PER_DAY), [Run("_first", "first", F.col("equity"))]
    )
    gain = F.col("equity") - F.col("_first")
    return scanned.select(
        *equity.columns, gain.alias("pnl"), F.when(gain >= 0, gain).alias("pnl_positive"), F.when(gain < 0, gain).alias("pnl_negative")
    )
