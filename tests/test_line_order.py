import pytest
from pyspark.sql import functions as F

from tidebar.functions.scans import Run, running
from tidebar.operators import sweep as W
from tidebar.operators.bars import downsample, ticks_to_bars
from tidebar.operators.registry import canonical_params
from tidebar.sources.market import read_bars, read_ticks
from tidebar.sources.parameters import params_table

HEAD = "Ativo;Data;Hora;Comprador;Preco;Quantidade;Vendedor;Tipo"


def test_ticks_of_one_second_keep_file_order(spark, tmp_path):
    rows = [f"WIN;02/01/2025;09:00:01;a;{100 + i};1;b;c" for i in range(8)]
    (tmp_path / "WIN_x_02-01-2025.csv").write_text("\n".join([HEAD, *rows]) + "\n", encoding="utf-8")
    (tmp_path / "WIN_x_03-01-2025.csv").write_text("\n".join([HEAD, "WIN;03/01/2025;09:00:01;a;5;1;b;c"]) + "\n", encoding="utf-8")
    ticks = read_ticks(spark, str(tmp_path), ["WIN"], "2025-01-02", "2025-01-02")
    assert [r.price for r in ticks.orderBy("seq").collect()] == [100.0 + i for i in range(8)]
    bar = ticks_to_bars(ticks, "5m").first()
    assert (bar.open, bar.close) == (100.0, 107.0)


def test_last_line_of_a_timestamp_wins(spark, tmp_path):
    folder = tmp_path / "WIN" / "5m"
    folder.mkdir(parents=True)
    rows = [f"2025-01-02 09:{m:02d}:00,{p},{p},{p},{p},1" for m in range(12) for p in (50 + m, 90 - m)]
    (folder / "a.csv").write_text("\n".join(["datetime,open,high,low,close,volume", *rows]) + "\n", encoding="utf-8")
    got = [r.close for r in read_bars(spark, str(tmp_path), ["WIN"], "5m").orderBy("datetime").collect()]
    assert got == [90.0 - m for m in range(12)]


def test_order_key_holds_for_all_sequence_numbers(spark):
    ticks = spark.sql("""SELECT 'A' symbol, timestamp_ntz'2025-01-02 09:00:00' + make_dt_interval(0,0,0,t/1000000) datetime, seq, p price, 1.0D volume
        FROM VALUES (1, 9000000000000000000L, 1.0D), (2, -9000000000000000000L, 2.0D) AS x(t, seq, p)""")
    bar = ticks_to_bars(ticks, "5m").first()
    assert (bar.open, bar.close) == (1.0, 2.0)


def test_rows_without_a_block_stay(spark):
    rows = spark.range(20).select(F.lit("a").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("at"), F.lit(1.0).alias("v"))
    out = running(rows, ["k"], ["at"], F.floor(F.col("at") / 4), [Run("s", "sum", F.col("v"))]).collect()
    assert len(out) == 20 and max(r.s for r in out if r["at"] is None) == 20.0


def test_thinning_depends_on_the_step_alone(spark):
    bars = spark.range(10).select(F.lit("a").alias("symbol"), F.lit("5m").alias("timeframe"), F.col("id").alias("bar_idx"))
    assert [r.bar_idx for r in downsample(bars, 3).orderBy("bar_idx").collect()] == [0, 1, 2, 3]


def test_empty_best_strategy_takes_the_first(spark):
    text = '{"best_strategy": "", "strategies": {"s1": {"best_params_from_tests": {"a": 1}}}}'
    files = spark.createDataFrame([("f", text)], "file string, value string")
    assert params_table(files).count() == 1


def test_sampling_returns_as_many_sets_as_asked(spark):
    sets = W.search_sets(spark, "breakout_range", W.SweepSettings(n_samples=60))
    assert len(sets) == 60


def test_parameter_files_are_parsed_once(spark):
    text = '{"best_strategy": "s2", "strategies": {"s1": {"best_params_from_tests": {"a": 1}}, "s2": {"best_params_from_tests": {"b": 2.5, "c": true, "d": "x", "e": null}}}}'
    rows = [("f", text), ("flat", '{"strategy": "t", "k": "7"}'), ("none", '{"strategies": {"s1": {}}}'), ("broken", "x"), ("null", None)]
    out = params_table(spark.createDataFrame(rows, "file string, value string"), keep_text=True)
    assert sorted((r.file, r.strategy, r.parameter, r.text, r.number, r.flag) for r in out.where("parameter <> 'e'").collect()) == [
        ("f", "s2", "b", "2.5", 2.5, None), ("f", "s2", "c", "true", None, True), ("f", "s2", "d", "x", None, None), ("flat", "t", "k", "7", 7.0, None), ("flat", "t", "strategy", "t", None, None)]
    plan = params_table(spark.range(9).selectExpr("string(id) file", "string(id) value"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count("$.strategies") == 1, plan


def test_candidates_take_seeds_first_without_sorting_texts(spark):
    seeds = spark.createDataFrame([(7, '{"b": 2, "a": 1.0}'), (5, '{"a":1,"b":2}')], "sample_no long, params_json string")
    samples = spark.createDataFrame([(1, '{"a":1,"b":2}'), (4, '{"c":3}'), (3, '{"c": 3}'), (9, "broken")], "sample_no long, params_json string")
    out = W.distinct_candidates(seeds, samples)
    assert sorted((r.params_json, r.origin, r.sample_no) for r in out.collect()) == [('{"a":1,"b":2}', 0, 5), ('{"c":3}', 1, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan, plan
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2  # one for each of the two inputs


def test_canonical_parameters_are_objects_only(spark):
    texts = {' \t\n{"b": 2, "a": 1.0} ': '{"a":1,"b":2}', "{}": "{}", "[1]": None, '"{x"': None, "{broken": None, "": None, "1": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.c for r in rows.select("t", canonical_params("t").alias("c")).collect()} == texts
