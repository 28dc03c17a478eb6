"""Readers for parameter banks, best-parameter files and run artifacts (inventory S12-S14)."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.sources.delimited import read_lines, split_fields


def object_text(column: Column, path: str) -> Column:
    """Sorted-key JSON text of an object inside a JSON text, null unless it is an object."""
    part = F.try_variant_get(F.try_parse_json(column), path, "variant")
    return F.when(F.schema_of_variant(part).startswith("OBJECT"), F.to_json(part))


def read_bank(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Bank lines (JSONL): broken lines and lines without a params object are skipped, bad scores become 0.

    (file, row_no) is the order of the lines: files by name, then as they stand in the file.
    """
    return parse_bank(read_lines(spark, paths).select("file", F.col("line").alias("value"), F.col("line_key").alias("row_no")))


def parse_bank(lines: DataFrame) -> DataFrame:
    """Bank rows of (file, value, row_no)."""
    payload = F.try_parse_json("value")
    score = lambda key: F.coalesce(F.get_json_object("value", f"$.{key}").try_cast("double"), F.lit(0.0))
    rows = lines.where(payload.isNotNull()).select(
        F.get_json_object("value", "$.timestamp").alias("timestamp"), score("test_score").alias("test_score"),
        score("train_score").alias("train_score"), object_text(F.col("value"), "$.params").alias("params_json"),
        "file", "row_no",
    )
    return rows.where("params_json is not null")


def typed_parameters(rows: DataFrame, params: str) -> DataFrame:
    """Rows with a map<string,string> column ``params``, as one row per (parameter, text, number, flag) of it.

    'true'/'false' fill ``flag``; numeric text fills ``number``; other text has both null.
    """
    others = [c for c in rows.columns if c != params]
    # outer: for an inner one Spark puts a filter on the map's size below, which would parse every text twice
    each = rows.select(*others, F.explode_outer(params).alias("parameter", "text")).where("parameter is not null")
    word = F.lower(F.trim("text"))
    return each.select(
        *others, "parameter", "text", word.try_cast("double").alias("number"), F.when(word.isin("true", "false"), word == "true").alias("flag"),
    )


def params_table(files: DataFrame, strategy: str | None = None, keep_text: bool = False) -> DataFrame:
    """One row per (file, strategy, parameter) from whole best-parameter files (file, value).

    The strategy is the requested one, else the file's best, else its first. Files without a
    ``strategies`` object hold the parameters directly or under ``best_params_from_tests``.
    Every step parses a text once: what later steps use more than once is a column of an earlier one.
    """
    named = F.lit(strategy).cast("string") if strategy else F.nullif(F.get_json_object("value", "$.best_strategy"), F.lit(""))
    flat_name = F.coalesce(F.lit(strategy).cast("string"), F.get_json_object("value", "$.strategy"))
    flat = F.coalesce(F.get_json_object("value", "$.best_params_from_tests"), F.col("value"))
    grown = F.col("tree").isNotNull()
    trees = files.select("file", "value", F.from_json(F.get_json_object("value", "$.strategies"), "map<string,string>").alias("tree"))
    picked = trees.select("file", "value", "tree", F.when(grown, F.coalesce(named, F.get(F.map_keys("tree"), F.lit(0)))).otherwise(flat_name).alias("strategy"))
    nested = F.get_json_object(F.try_element_at("tree", F.col("strategy")), "$.best_params_from_tests")
    chosen = picked.select("file", "strategy", F.from_json(F.when(grown, nested).otherwise(flat), "map<string,string>").alias("params"))
    rows = typed_parameters(chosen, "params")
    return rows if keep_text else rows.where(F.col("number").isNotNull() | F.col("flag").isNotNull())


def strategy_params(files: DataFrame, strategy: str) -> DataFrame:
    """(file, params_json): the parameters that files (file, value) hold for one strategy, keys sorted; files without any have no row."""
    held = F.try_element_at(F.from_json(F.get_json_object("value", "$.strategies"), "map<string,string>"), F.lit(strategy))
    params = files.select("file", object_text(held, "$.best_params_from_tests").alias("params_json"))
    return params.where("params_json is not null and params_json <> '{}'")


def read_params_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, value) of JSON parameter files; each file is one small document."""
    raw = spark.read.option("wholetext", True).text(list(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), "value")


# Columns a history file may have; missing ones are null.
HISTORY_COLUMNS = {
    "run_tag": "string", "created_at_utc": "string", "symbol": "string", "timeframe": "string", "best_strategy": "string",
    "best_score": "double", "best_net_profit": "double", "best_trade_count": "double", "best_win_rate": "double",
    "best_max_drawdown": "double", "best_max_drawdown_pct": "double", "windows": "double", "best_params_latest": "string",
    "best_params_snapshot": "string",
}
SUMMARY_COLUMNS = {
    "strategy": "string", "score": "double", "net_profit": "double", "win_rate": "double", "max_drawdown": "double", "trade_count": "double",
}


def below_roots(file: Column, roots: Sequence[str]) -> Column:
    """(source_root, below): name of the root a file stands under and its path from there; of nested roots the inner one."""
    plain = lambda path: re.sub("^[a-z]+:/*", "/", path.rstrip("/")) + "/"
    tail = F.regexp_replace(file, "^[a-z]+:/*", "/")
    found = F.lit(None)
    for root in sorted(map(plain, roots), key=len):
        here = F.struct(F.lit(root.rstrip("/").rsplit("/", 1)[-1]).alias("source_root"), F.substr(tail, F.locate(root, tail) + F.lit(len(root))).alias("below"))
        found = F.when(F.contains(tail, F.lit(root)), here).otherwise(found)
    return found


def scan_artifacts(spark: SparkSession, roots: Sequence[str], pattern: str, wanted: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Rows of matching CSV artifacts below several roots, with provenance; absent columns and blank fields are null.

    Every file has its own header, in any order of columns; files without a ``required`` column are left out. ``symbol``
    and ``timeframe`` come from the two folders below the root where the file does not have them, and ``artifact`` is its
    path. All roots are one scan, and headers, one row per file, are joined once.
    """
    lines = read_lines(spark, roots, recursiveFileLookup="true", pathGlobFilter=pattern)
    heads = lines.where(F.col("line_key") < F.lit(1 << 33)).groupBy("file").agg(F.min("line_key").alias("_at"), F.min_by("line", "line_key").alias("_head"))
    heads = heads.select("file", "_at", split_fields(F.col("_head"), F.lit(",")).alias("_head"), below_roots(F.col("file"), roots).alias("_place"))
    for name in required:
        heads = heads.where(F.array_contains("_head", name))
    fields = lines.join(heads, "file").where("line_key <> _at").withColumn("_f", split_fields(F.col("line"), F.lit(",")))
    field = lambda c: F.nullif(F.trim(F.get("_f", (F.array_position("_head", F.lit(c)) - 1).cast("int"))), F.lit(""))
    folders = F.split("_place.below", "/")
    folder = lambda i: F.when(F.size(folders) >= 3, F.regexp_replace(F.get(folders, F.lit(i)), "^[a-z]+=", "")).otherwise("")
    places = {c: F.coalesce(field(c), folder(i)) if c in wanted else folder(i) for i, c in enumerate(("symbol", "timeframe"))}
    typed = [field(c).try_cast(t).alias(c) for c, t in wanted.items() if c not in places]
    return fields.select(*typed, F.col("_place.source_root").alias("source_root"), F.col("file").alias("artifact"), *[v.alias(c) for c, v in places.items()])


def scan_history(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    rows = scan_artifacts(spark, roots, "best_history_*.csv", HISTORY_COLUMNS)
    return rows.withColumn("created_at_utc", F.try_to_timestamp("created_at_utc"))


def scan_latest_summaries(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Latest summaries only: ``summary_<timeframe>.csv`` without a run suffix, of files that name strategies.

    The name of the file gives the timeframe where no folders do.
    """
    rows = scan_artifacts(spark, roots, "summary_*.csv", SUMMARY_COLUMNS, ["strategy"])
    named = F.regexp_extract("artifact", r"/summary_([^_/]+)\.csv$", 1)
    return rows.where(named != "").withColumn("timeframe", F.coalesce(F.nullif("timeframe", F.lit("")), named))
