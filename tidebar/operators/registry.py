"""History of runs and parameters (inventory U3-U14, S12 use).

"Best or newest row per key" is a max_by aggregation: it combines on the map side and never sorts a group.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_params(column: Column | str) -> Column:
    """JSON object text with sorted keys and no extra blanks; null unless the text is an object."""
    text = F.col(column) if isinstance(column, str) else column
    # a JSON text that begins with a brace is an object; asking the parsed value for its type would parse twice
    return F.when(F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), F.to_json(F.try_parse_json(text)))


def best_per_key(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key with the greatest ``rank`` (compared left to right, nulls lowest)."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    top = F.max_by(F.struct(*columns), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    return df.groupBy(*keys).agg(top.alias("_top")).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in columns])


def bank_rows(topk: DataFrame) -> DataFrame:
    """Bank entries of top-k test results; unreadable parameter texts are skipped."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = topk.select(
        zero("test_score").alias("test_score"), zero("train_score").alias("train_score"), canonical_params("params_json").alias("params_json"),
        *[c for c in topk.columns if c not in ("test_score", "train_score", "params_json")],
    )
    return rows.where(F.col("params_json").isNotNull())


def merge_banks(banks: Sequence[DataFrame]) -> DataFrame:
    """Best score per parameter set over several banks, the earlier bank and row on ties.

    Each bank has ``params_json``, ``test_score`` and ``row_no``, and ``file`` if its rows come from several.
    """
    tagged = [b.withColumn("bank_no", F.lit(i)) for i, b in enumerate(banks)]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    rows = rows.withColumns({"params_json": canonical_params("params_json"), "test_score": F.coalesce("test_score", F.lit(0.0))})
    place = ["bank_no", *(["file"] if "file" in rows.columns else []), "row_no"]
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "params_json"]), F.struct(-F.col("test_score"), *place))
    # null texts leave after the aggregation: a filter on the parsed text below it would parse every text once more
    best = rows.groupBy("params_json").agg(first.alias("_first"), F.max(F.col("params_json").isNotNull()).alias("_is"))
    best = best.where("_is").select("params_json", "_first.*")
    return best.orderBy(F.col("test_score").desc(), "params_json")


def bank_top(bank: DataFrame, n: int) -> DataFrame:
    """Top n distinct parameter sets by score with their rank (top-n report)."""
    return merge_banks([bank]).limit(max(0, n))


def fingerprint(bars: DataFrame, series: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Digest per series that does not depend on row order: rows, then days, then the series.

    A day of a cleaned series has at most one row per timestamp, so each level digests a short sorted list.
    """
    prices = [F.coalesce(F.round(c, 10).cast("string"), F.lit("")) for c in ("open", "high", "low", "close", "volume")]
    stamp = F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss")
    rows = bars.select(*series, F.col("datetime").cast("date").alias("_day"), F.sha2(F.concat_ws(",", stamp, *prices), 256).alias("_d"))
    digest = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    days = rows.groupBy(*series, "_day").agg(digest("_d").alias("_d"), F.count(F.lit(1)).alias("_n"))
    tagged = F.concat_ws(":", F.col("_day").cast("string"), F.col("_d"))
    return days.groupBy(*series).agg(digest(tagged).alias("fingerprint"), F.sum("_n").alias("rows"))


def upsert(history: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace rows with the same key, append the rest."""
    kept = history.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def consolidate(histories: Sequence[DataFrame], keys: Sequence[str], rank_column: str | None = None) -> DataFrame:
    """Union of several histories, newest row per key (then lowest rank, then earliest source, then lowest ``run_tag``)."""
    tagged = [h.withColumn("source_no", F.lit(i)) for i, h in enumerate(histories)]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    newest = F.unix_micros(F.col("created_at").try_cast("timestamp"))
    places = [-newest, *[F.col(c) for c in ([rank_column] if rank_column else []) + ["source_no"] + (["run_tag"] if "run_tag" in rows.columns else [])]]
    columns = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*columns), F.struct(*[f(p) for p in places for f in (F.isnull, lambda p: p)]))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def merge_counts(sources: DataFrame) -> DataFrame:
    """Number of merged files per kind from (kind, path) rows."""
    return sources.groupBy("kind").agg(F.countDistinct("path").alias("merged_files"))


def global_ranking(history: DataFrame, keys: Sequence[str], only_positive: bool = False, limit: int | None = None) -> DataFrame:
    """Runs, best and mean results and last run per key; best P&L first, nulls last."""
    rows = history.where(F.col("net_profit") > 0) if only_positive else history
    ranked = rows.groupBy(*keys).agg(
        F.count("run_tag").alias("runs"), F.max("net_profit").alias("best_pnl"), F.avg("net_profit").alias("avg_pnl"),
        F.max("score").alias("best_score"), F.avg("score").alias("avg_score"), F.avg("win_rate").alias("avg_win_rate"),
        F.avg("max_drawdown").alias("avg_dd"), F.max("created_at").alias("last_run"),
    ).orderBy(F.col("best_pnl").desc_nulls_last(), F.col("best_score").desc_nulls_last(), *keys)
    return ranked.limit(limit) if limit else ranked


def top_runs(history: DataFrame, n: int = 10, only_positive: bool = False) -> DataFrame:
    """Best runs with distinct parameter content (top-n report)."""
    rows = history.where(F.col("net_profit") > 0) if only_positive else history
    hashed = rows.withColumn("params_hash", F.sha2(F.coalesce("params_json", F.lit("")), 256))
    best = best_per_key(hashed, ["params_hash"], [F.col("net_profit"), F.col("score"), -F.col("run_tag")])
    return best.orderBy(F.col("net_profit").desc_nulls_last(), F.col("score").desc_nulls_last(), "run_tag").limit(n)


def strategy_rollup(history: DataFrame, keys: Sequence[str] = ("timeframe", "strategy")) -> DataFrame:
    """Totals per key left-joined with the latest run of the key."""
    keys = list(keys)
    totals = history.groupBy(*keys).agg(
        F.count("run_tag").alias("runs"), F.max("score").alias("best_score"), F.avg("score").alias("avg_score"),
        F.max("net_profit").alias("best_pnl"), F.avg("net_profit").alias("avg_pnl"), F.avg("win_rate").alias("avg_win_rate"),
        F.avg("max_drawdown").alias("avg_dd"), F.avg("trade_count").alias("avg_trades"),
    )
    dated = history.where(F.col("created_at").isNotNull())
    latest = best_per_key(dated, keys, [F.col("created_at"), F.col("run_tag")], ["created_at", "net_profit", "score"])
    latest = latest.select(*keys, F.col("created_at").alias("last_run"), F.col("net_profit").alias("last_pnl"), F.col("score").alias("last_score"))
    return totals.join(latest, keys, "left")


def filter_history(
    history: DataFrame, symbol: str | None = None, timeframe: str | None = None, strategy: str | None = None,
    only_positive: bool = False, limit: int | None = None,
) -> DataFrame:
    rows = history
    for column, wanted in (("symbol", symbol), ("timeframe", timeframe), ("strategy", strategy)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if only_positive:
        rows = rows.where(F.col("net_profit") > 0)
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "run_tag").limit(limit) if limit else rows


def validated_strategies(history: DataFrame, summaries: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered names with a positive result in the history or in a summary."""
    positive = lambda df: df.where(F.col("net_profit") > 0).select("strategy")
    return positive(history).union(positive(summaries)).distinct().join(registry.select("strategy"), "strategy", "left_semi")


def known_strategies(artifact_names: DataFrame, payload_names: DataFrame) -> DataFrame:
    """Names found in artifact files or in parameter payloads."""
    return artifact_names.select("strategy").union(payload_names.select("strategy")).where("strategy <> ''").distinct()


def parameter_candidates(history: DataFrame, strategy: str, timeframe: str, limit: int = 10) -> DataFrame:
    """Distinct parameter sets of a strategy's runs, best run first (top-n report)."""
    rows = history.where((F.col("strategy") == strategy) & (F.col("timeframe") == timeframe))
    rows = rows.withColumn("params_json", canonical_params("params_json")).where("params_json is not null and params_json <> '{}'")
    best = best_per_key(rows, ["params_json"], [F.col("score"), F.col("net_profit"), -F.col("run_tag")])
    return best.orderBy(F.col("score").desc(), F.col("net_profit").desc(), "run_tag").limit(max(1, limit))


def candidates_from_files(history: DataFrame, files: DataFrame, strategy: str, timeframe: str, limit: int = 10) -> DataFrame:
    """Distinct parameter sets that the files of a strategy's best runs hold, best run first (top-n report).

    ``history`` names a file in ``best_params_snapshot``, else in ``best_params_latest``; ``files`` has (file, params_json), one
    row per file. Runs whose file is absent or holds no parameters are left out. Scores without a value come last and become 0; the smaller run tag wins ties.
    """
    named = F.coalesce(F.nullif(F.trim("best_params_snapshot"), F.lit("")), F.nullif(F.trim("best_params_latest"), F.lit("")))
    rows = history.where((F.col("best_strategy") == strategy) & (F.col("timeframe") == timeframe)).withColumn("file", named)
    held = rows.drop("params_json").join(files.select("file", "params_json"), "file")
    columns = ("best_score", "best_net_profit", "windows", "run_tag")
    order = [c for name in columns[:2] for c in (F.col(name).isNull(), -F.col(name))] + [F.col("run_tag")]
    best = held.groupBy("params_json").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_best")).select("params_json", "_best.*")
    ranked = best.orderBy(*order, "params_json").limit(max(1, limit))
    zero = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t))
    ranked = best.orderBy(F.col("best_score").desc_nulls_last(), F.col("best_net_profit").desc_nulls_last(), F.col("run_tag").try_cast("long")).limit(max(1, limit))
    return ranked.select("params_json", "run_tag", zero("best_score", "double").alias("avg_test_score"),
                         zero("best_net_profit", "double").alias("avg_test_net_profit"), zero("windows", "long").alias("windows"))


def top_parameters(topk: DataFrame, group: Sequence[str], limit: int | None = None) -> DataFrame:
    """Mean test score and net of each parameter set over its windows; ``rank`` within the group."""
    group = list(group)
    means = topk.groupBy(*group, "params_json").agg(
        F.avg("test_score").alias("avg_test_score"), F.avg("test_net_profit").alias("avg_test_net_profit"), F.count("params_json").alias("windows")
    )
    w = Window.partitionBy(*group).orderBy(
        F.col("avg_test_score").desc(), F.col("avg_test_net_profit").desc(), F.col("windows").desc(), "params_json"
    )
    ranked = means.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def best_parameters(topk: DataFrame, group: Sequence[str]) -> DataFrame:
    """Parameter set with the best mean test score, then the most windows."""
    group = list(group)
    means = topk.groupBy(*group, "params_json").agg(F.avg("test_score").alias("avg_test_score"), F.count("test_score").alias("windows"))
    top = F.min_by(
        F.struct("params_json", "avg_test_score", "windows"), F.struct(-F.col("avg_test_score"), -F.col("windows"), F.col("params_json"))
    )
    return means.groupBy(*group).agg(top.alias("_t")).select(*group, "_t.*")
