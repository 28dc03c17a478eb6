import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import registry as U
from tidebar.sources import delimited as D
from tidebar.sources import parameters as PA
from tidebar.sources.market import read_bars, read_ticks, read_tradebook


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def bars_file(days):
    return "\n".join(["Data;Hora;Abertura;Máxima;Mínima;Fechamento", *[f"{d};10:00;1;2;1;2" for d in days]]) + "\n"


@pytest.mark.parametrize("days,expected", [
    (["05/02/2025", "06/02/2025"], [(2, 5), (2, 6)]),                 # day-first
    (["02/15/2025", "02/16/2025"], [(2, 15), (2, 16)]),               # none is a day-first date: month-first
    (["02/05/2025", "02/16/2025"], [(5, 2)]),                         # one is: the other is no date
    (["2025-02-16", "02/16/2025"], [(2, 16)]),                        # ISO counts as read
])
def test_date_order_is_decided_per_file(spark, tmp_path, days, expected):
    put(tmp_path / "A" / "60m" / "a.csv", bars_file(days))
    put(tmp_path / "B" / "60m" / "a.csv", bars_file(["05/02/2025"]))  # another file has its own order
    bars = read_bars(spark, str(tmp_path), None, "60m").orderBy("symbol", "datetime").collect()
    assert [(r.datetime.month, r.datetime.day) for r in bars if r.symbol == "A"] == expected
    assert [(r.datetime.month, r.datetime.day) for r in bars if r.symbol == "B"] == [(2, 5)]


def test_book_dates_by_row(spark):
    rows = [("2025/03/04 10:00:00", (3, 4)), ("04/03/2025 10:00:00", (3, 4)), ("04/23/2025", (4, 23)), ("04-03-2025", (4, 3)), ("23-04-2025", (4, 23)), ("", None), (None, None), ("x", None)]
    found = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", D.book_stamp(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d and (r.d.month, r.d.day) for r in found] == [e for _, e in rows]


def test_tradebook_reads_mixed_dates(spark, tmp_path):
    put(tmp_path / "b.csv", "Abertura;Fechamento;Lado;Resultado\n02/03/2025 10:00:00;02/03/2025 10:05:00;C;1,5\n2025-03-01 10:00:00;2025-03-01 10:05:00;V;-2,5\n")
    book = read_tradebook(spark, [str(tmp_path / "b.csv")], "own").orderBy("trade_id").collect()
    assert [(r.entry_time, r.direction, r.pnl_net) for r in book] == [(dt.datetime(2025, 3, 1, 10), "short", -2.5), (dt.datetime(2025, 3, 2, 10), "long", 1.5)]


def test_first_line_of_the_first_bank_file_wins_ties(spark, tmp_path):
    line = lambda train, score=1: f'{{"test_score": {score}, "train_score": {train}, "params": {{"a": 1}}}}\n'
    put(tmp_path / "a.jsonl", line(9, 0) + line(5) + line(4) + line(3))
    put(tmp_path / "b.jsonl", line(1) + "[]\n\n" + line(2))
    one = U.merge_banks([PA.read_bank(spark, [str(tmp_path)])]).collect()
    assert [r.train_score for r in one] == [5.0]
    two = U.merge_banks([PA.read_bank(spark, [str(tmp_path / f)]) for f in ("b.jsonl", "a.jsonl")]).collect()
    assert [r.train_score for r in two] == [1.0]


def test_every_artifact_has_its_own_header(spark, tmp_path):
    roots = [tmp_path / "outputs_a", tmp_path / "outputs_a" / "old"]
    put(roots[0] / "WIN" / "5m" / "best_history_5m.csv", "run_tag,best_score,best_params_latest\nr1,2.5,\"a, \"\"b\"\"\"\nr2,x,\n")
    put(roots[0] / "WDO" / "5m" / "x" / "best_history_5m.csv", "best_score,symbol,run_tag,created_at_utc,more\n1,IND,r3,2025-01-02T10:00:00,zz\n2,,r4,bad,zz\n")
    put(roots[0] / "best_history_1m.csv", "run_tag\nr5\n")
    put(roots[1] / "M" / "15m" / "best_history_15m.csv", "run_tag,symbol\nr6,\n")
    put(roots[0] / "WIN" / "5m" / "other.csv", "run_tag\nr7\n")
    rows = {r.run_tag: r for r in PA.scan_history(spark, [str(p) for p in roots]).distinct().collect()}
    assert sorted(rows) == ["r1", "r2", "r3", "r4", "r5", "r6"]
    assert [(rows[k].symbol, rows[k].timeframe) for k in sorted(rows)] == [("WIN", "5m"), ("WIN", "5m"), ("IND", "5m"), ("WDO", "5m"), ("", ""), ("M", "15m")]
    assert [rows[k].best_score for k in sorted(rows)] == [2.5, None, 1.0, 2.0, None, None]
    assert rows["r1"].best_params_latest == 'a, "b"' and rows["r3"].created_at_utc and rows["r4"].created_at_utc is None
    assert [rows[k].source_root for k in ("r1", "r6")] == ["outputs_a", "old"]


def test_latest_summaries(spark, tmp_path):
    put(tmp_path / "o" / "WIN" / "5m" / "summary_5m.csv", "score,strategy\n1,s\nbad,t\n")
    put(tmp_path / "o" / "WIN" / "5m" / "summary_5m_20250101.csv", "score,strategy\n1,old\n")
    put(tmp_path / "o" / "summary_15m.csv", "strategy,net_profit\nu,3\n")
    put(tmp_path / "o" / "WDO" / "5m" / "summary_5m.csv", "score\n7\n")
    rows = sorted((r.strategy, r.symbol, r.timeframe, r.score, r.net_profit) for r in PA.scan_latest_summaries(spark, [str(tmp_path / "o")]).collect())
    assert rows == [("s", "WIN", "5m", 1.0, None), ("t", "WIN", "5m", None, None), ("u", "", "15m", None, 3.0)]


def test_candidates_come_from_the_files_of_the_runs(spark):
    text = lambda params: '{"strategies": {"s": {"best_params_from_tests": %s}, "t": {}}}' % params
    files = spark.createDataFrame([("f1", text('{"b": 2, "a": 1}')), ("f2", text('{"a": 1, "b": 2}')), ("f3", text("{}")), ("f4", "broken"), ("f5", text("[1]")), ("f6", text('{"a": 3}'))], "file string, value string")
    runs = spark.createDataFrame([("r1", "5m", "s", 1.0, 1.0, 4, "f1", "f6"), ("r2", "5m", "s", 2.0, 1.0, 5, "", "f2"), ("r3", "5m", "s", 9.0, 1.0, 5, "f3", ""), ("r4", "5m", "s", 9.0, 1.0, 5, "f4", ""),
                                  ("r5", "5m", "s", 9.0, 1.0, 5, "f5", ""), ("r6", "5m", "s", None, None, None, None, "f6"), ("r7", "5m", "t", 9.0, 1.0, 5, "f1", ""), ("r8", "1m", "s", 9.0, 1.0, 5, "f1", ""), ("r9", "5m", "s", 9.0, 1.0, 5, "gone", "f1"), ("r0", "5m", "s", 9.0, 1.0, 5, None, None)],
                                 "run_tag string, timeframe string, best_strategy string, best_score double, best_net_profit double, windows long, best_params_snapshot string, best_params_latest string")
    out = U.candidates_from_files(runs, PA.strategy_params(files, "s"), "s", "5m").collect()
    assert [tuple(r) for r in out] == [('{"a":1,"b":2}', "r2", 2.0, 1.0, 5), ('{"a":3}', "r6", 0.0, 0.0, 0)]
    assert U.candidates_from_files(runs, PA.strategy_params(files, "s"), "s", "5m", 1).count() == 1


def test_prices_of_zero_are_kept_on_demand(spark, tmp_path):
    put(tmp_path / "bars" / "A" / "60m" / "a.csv", "Data;Hora;Abertura;Máxima;Mínima;Fechamento\n05/02/2025;10:00;1,5;2;0;1\n05/02/2025;11:00;1;2;1;2\n05/02/2025;12:00;1;2;-1;2\n")
    put(tmp_path / "ticks" / "A_F_0_Trade_05-02-2025.csv", "Ativo;Data;Hora;Preco;Quantidade\nA;05/02/2025;10:00:00;0.000;1\nA;05/02/2025;10:00:01;1.500;2\nA;05/02/2025;10:00:02;-1.000;2\n")
    for zero, hours, prices in ((False, [11], [1.5]), (True, [10, 11], [0.0, 1.5])):
        bars = read_bars(spark, str(tmp_path / "bars"), ["A"], "60m", "2025-02-05", "2025-02-05", zero_prices=zero)
        assert sorted(r.datetime.hour for r in bars.collect()) == hours
        ticks = read_ticks(spark, str(tmp_path / "ticks"), ["a"], "2025-02-05", "2025-02-05", zero_prices=zero)
        assert sorted(r.price for r in ticks.collect()) == prices


def test_number_check_writes_one_decimal_dot_at_any_size(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, dt.datetime(2025, 1, 2), 1, "view", 1.25, "{}") for i in (0, 998_999, 999_000, 6_000_000, 10_000_000_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    out = entry.queries()["s5_s6_s8_parse_numbers"](spark, str(tmp_path)).collect()
    assert {r.event_id: (r.group_style, r.dot_style, r.comma_style) for r in out} == {i: (i + 1000.0, (i + 1000) / 1000, 1.25) for i, *_ in rows}
