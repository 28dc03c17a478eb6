import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bars_frame
from tidebar.operators import matching as N
from tidebar.operators import registry as U
from tidebar.sources import market as MK
from tidebar.sources import parameters as PA
from tidebar.streaming import progress as PG
from tidebar.streaming import risk as RK
from tidebar.streaming import tick_bars as TB

BOOK = "trade_id long, entry_time timestamp_ntz, exit_time timestamp_ntz, direction string, qty double, entry_price double, exit_price double, pnl_net double"


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_read_bars_mixed_styles_and_duplicates(spark, tmp_path):
    folder = tmp_path / "WIN" / "5m"
    write(folder / "a.csv", "Data;Hora;Abertura;Máxima;Mínima;Fechamento;Volume\n02/01/2025;09:00;1.000,5;1.001,0;999,5;1.000,0;10\n02/01/2025;09:05;0;1;1;1;1\n", "latin1")
    write(folder / "b.csv", "datetime,open,high,low,close\n2025-01-02 09:00:00,2000.5,2001,1999.5,2000\n2025-01-02 09:10:00,2000.5,2001,1999.5,2000\n")
    out = MK.read_bars(spark, str(tmp_path), ["WIN"], "5m", "2025-01-02", "2025-01-02").orderBy("datetime").collect()
    assert [r["open"] for r in out] == [2000.5, 2000.5] and out[0]["volume"] == 0.0 and out[0]["symbol"] == "WIN"
    alone = MK.read_bars(spark, str(tmp_path), None, "5m", end="2025-01-02 09:05")
    assert alone.count() == 1
    with pytest.raises(ValueError):
        MK.require_rows(MK.read_bars(spark, str(tmp_path), ["WIN"], "5m", "2030-01-01"), "WIN 5m")


def test_tick_numbers_have_no_thousands_rule(spark, tmp_path):
    write(tmp_path / "WINFUT_F_0_02-01-2025.csv", "Ativo;Data;Hora;Comprador;Preco;Quantidade;Vendedor;Tipo\nWINFUT;02/01/2025;09:05:01;X;106.000;1;Y;C\nWINFUT;02/01/2025;09:05:02;X;104.000;1;Y;C\n")
    write(tmp_path / "WINFUT_F_0_03-01-2025.csv", "Data;Hora;Preco;Quantidade\n03/01/2025;09:00:00;1;1\n")
    out = MK.read_ticks(spark, str(tmp_path), ["WINFUT"], "2025-01-02", "2025-01-02").orderBy("datetime").collect()
    assert [r["price"] for r in out] == [106.0, 104.0]
    assert MK.tick_days(spark, str(tmp_path), "winfut").count() == 2


def test_broker_book_in_local_format(spark, tmp_path):
    write(tmp_path / "ops.csv", "Abertura;Fechamento;Qtd;Lado;Preço Compra;Preço Venda;Resultado\n02/01/2025 09:10:00;02/01/2025 09:20:00;1;V;190.355;190.295;R$ 60,00\n02/01/2025 09:00:00;02/01/2025 09:05:00;1;C;190.300;190.360;R$ 60,00\n")
    out = MK.read_tradebook(spark, [str(tmp_path / "ops.csv")], "broker").orderBy("trade_id").collect()
    assert [r["direction"] for r in out] == ["long", "short"]
    assert out[1]["entry_price"] == 190355 and out[0]["pnl_net"] == 60


def test_own_book_with_quoted_params(spark, tmp_path):
    write(tmp_path / "t.csv", 'strategy,entry_time,exit_time,direction,entry_price,exit_price,pnl_net,params\nx,2025-01-02 09:00:00,2025-01-02 09:05:00,long,100.5,101.25,0.75,"{""a"": 1, ""b"": 2}"\n')
    row = MK.read_tradebook(spark, [str(tmp_path / "t.csv")], "own").first()
    assert row["pnl_net"] == 0.75 and row["qty"] == 1.0 and row["direction"] == "long"


def book(spark, rows):
    return spark.createDataFrame([(i, pd.Timestamp(a).to_pydatetime(), pd.Timestamp(b).to_pydatetime(), d, 1.0, 10.0, 10.0, float(p)) for i, (a, b, d, p) in enumerate(rows)], BOOK)


def test_two_books_one_match(spark):
    a = book(spark, [("2025-01-02 09:00:00", "2025-01-02 09:05:00", "long", 60), ("2025-01-02 10:00:00", "2025-01-02 10:05:00", "long", 30)])
    b = book(spark, [("2025-01-02 09:00:10", "2025-01-02 09:05:10", "long", 60), ("2025-01-02 12:00:00", "2025-01-02 12:05:00", "short", 0)])
    detail = N.match_detail(N.match_trades(a, b, 60), a, b, 60)
    s = N.match_summary(a, b, detail).first()
    assert s["matched_trade_count"] == 1 and s["only_a_count"] == 1 and s["only_b_count"] == 1
    assert s["net_diff"] == 30 and not s["strict_parity"]


def test_matching_equals_sequential_greedy_on_dense_books(spark):
    rng = np.random.default_rng(5)
    def make(n):
        t = np.sort(rng.integers(0, 3000, n))
        return [(pd.Timestamp("2025-01-02") + pd.Timedelta(seconds=int(x)), pd.Timestamp("2025-01-02") + pd.Timedelta(seconds=int(x + 60)), rng.choice(["long", "short", "unknown"]), int(rng.integers(-9, 9))) for x in t]
    ra, rb = make(60), make(60)
    used, want = set(), []
    for i, (e, x, d, p) in enumerate(ra):
        best = None
        for j, (e2, x2, d2, p2) in enumerate(rb):
            gap = min(abs((e - e2).total_seconds()), abs((x - x2).total_seconds()))
            if j in used or gap > 120 or not (d == d2 or "unknown" in (d, d2)):
                continue
            score = gap * 1000 + abs(p - p2)
            if best is None or score < best[0]:
                best = (score, j)
        if best:
            used.add(best[1])
            want.append((i, best[1]))
    got = N.match_trades(book(spark, ra), book(spark, rb), 120).toPandas()
    assert sorted(zip(got["a_id"], got["b_id"])) == want


HIST = "run_tag string, timeframe string, strategy string, created_at timestamp, rank_in_run int, net_profit double"


def hist(spark, rows):
    return spark.createDataFrame([(t, "5m", s, pd.Timestamp(c).to_pydatetime(), r, float(n)) for t, s, c, r, n in rows], HIST)


def test_upsert_and_consolidation(spark):
    old = hist(spark, [("run_1", "a", "2025-01-01", 1, 100), ("run_1", "b", "2025-01-01", 2, 50)])
    new = hist(spark, [("run_1", "a", "2025-01-02", 1, 999)])
    out = U.upsert(old, new, ["run_tag", "timeframe", "strategy"]).toPandas()
    assert len(out) == 2 and set(out["net_profit"]) == {999.0, 50.0}
    merged = U.consolidate([old, new], ["run_tag", "timeframe", "strategy"], "rank_in_run").toPandas().set_index("strategy")
    assert merged.loc["a", "net_profit"] == 999 and len(merged) == 2


@pytest.mark.parametrize("kind", ["string", "long"])
def test_equal_histories_fall_to_the_lowest_run_tag(spark, kind):
    rows = hist(spark, [("7", "a", "2025-01-02", 1, 7), ("3", "a", "2025-01-02", 1, 3), ("5", "a", "2025-01-02", 1, 5), ("1", "a", "2025-01-01", 1, 1), ("2", "a", "2025-01-02", 2, 2)])
    other = hist(spark, [("0", "a", "2025-01-02", 1, 0), ("9", "b", "2000-01-01", 4, 9)]).withColumn("created_at", F.expr("nullif(created_at, timestamp'2000-01-01')"))
    for order in ("run_tag", "-net_profit"):  # whatever the order of arrival
        parts = [h.withColumn("run_tag", F.col("run_tag").cast(kind)).coalesce(1).sortWithinPartitions(F.expr(order)) for h in (rows, other)]
        out = U.consolidate(parts, ["timeframe", "strategy"], "rank_in_run").collect()
        assert {(r.strategy, str(r.run_tag), r.net_profit) for r in out} == {("a", "3", 3.0), ("b", "9", 9.0)}


def test_bank_reader_and_merge(spark, tmp_path):
    write(tmp_path / "b1.jsonl", '{"test_score": 10.0, "params": {"b": 2, "a": 1}}\nbroken\n{"test_score": "x", "params": {"c": 1}}\n{"test_score": 1, "params": [1]}\n')
    write(tmp_path / "b2.jsonl", '{"test_score": 12.0, "params": {"a": 1, "b": 2}}\n{"test_score": 5, "params": {"d": 1}}\n')
    banks = [PA.read_bank(spark, [str(tmp_path / f)]) for f in ("b1.jsonl", "b2.jsonl")]
    out = U.merge_banks(banks).collect()
    assert len(out) == 3 and out[0]["test_score"] == 12.0
    assert json.loads(out[0]["params_json"]) == {"a": 1, "b": 2}


def test_fingerprint_ignores_order(spark):
    rows = [(f"2025-01-0{d} 10:00", 10 + d, 12 + d, 9 + d, 11 + d) for d in range(2, 6)]
    one = U.fingerprint(bars_frame(spark, rows)).first()["fingerprint"]
    assert one == U.fingerprint(bars_frame(spark, rows[::-1])).first()["fingerprint"]
    assert one != U.fingerprint(bars_frame(spark, rows[1:])).first()["fingerprint"]


def events(spark, rows):
    return spark.createDataFrame([("a", pd.Timestamp(t).to_pydatetime(), i, k, float(e), None if p is None else float(p)) for i, (t, k, e, p) in enumerate(rows)],
                                 "account string, ts timestamp, seq long, kind string, equity double, pnl_net double")


@pytest.mark.parametrize("limits,rows,code,seq", [
    (RK.RiskLimits(daily_loss_limit=100), [("2025-01-02 10:00", "close", 880, -120)], "DAILY_LOSS_LIMIT", 0),
    (RK.RiskLimits(daily_loss_limit=100), [("2025-01-02 10:00", "close", 940, -60), ("2025-01-03 10:00", "close", 880, -60)], None, None),
    (RK.RiskLimits(max_drawdown_pct=5), [("2025-01-02 10:00", "mark", 1010, None), ("2025-01-02 10:05", "mark", 950, None)], "MAX_DRAWDOWN_PCT", 1),
    (RK.RiskLimits(max_consecutive_losses=2), [("2025-01-02 10:00", "close", 999, -1), ("2025-01-02 10:05", "close", 999, 0), ("2025-01-02 10:10", "close", 998, -1)], "MAX_CONSECUTIVE_LOSSES", 2),
    (RK.RiskLimits(max_consecutive_losses=2), [("2025-01-02 10:00", "close", 999, -1), ("2025-01-02 10:05", "close", 1000, 1), ("2025-01-02 10:10", "close", 998, -2)], None, None),
])
def test_first_breach(spark, limits, rows, code, seq):
    out = RK.first_breach(events(spark, rows), limits, 1000.0).collect()
    assert [(r["code"], r["seq"]) for r in out] == ([(code, seq)] if code else [])
    alerts = RK.alerts(RK.first_breach(events(spark, rows), limits, 1000.0), limits)
    assert RK.has_high_severity(alerts).first()["has_high"] == bool(code)


def test_progress_board(spark):
    lines = ["[PROGRESS] 5m/alpha sample 3/10 score=1.5 net=-2 pf=0.9", "noise", "[PROGRESS] 5m/alpha window 1/4 done oos_score=7 oos_net=8 oos_pf=1.2",
             "[PROGRESS] 60m/beta done score=10 net=20 pf=2", "[WARN] 5m/gamma: boom"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    board = {r["strategy"]: r for r in PG.progress_board(df).collect()}
    assert board["alpha"]["partial_score"] == 7 and board["alpha"]["train_score"] == 1.5 and board["alpha"]["net_profit"] == 8
    assert board["beta"]["status"] == "Concluida" and board["gamma"]["status"] == "Erro"
    ranked = PG.ranked_board(PG.pending_board(PG.progress_board(df), ["5m"], ["alpha", "delta"])).toPandas()
    assert ranked["strategy"].iloc[0] == "beta" and "Pendente" in set(ranked["status"])


def test_stream_of_unordered_files_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for account in ("a", "b", "c", "quiet"):
        t, equity = pd.Timestamp("2025-01-02 09:00"), 1000.0
        for i in range(150):
            t += pd.Timedelta(seconds=int(rng.integers(0, 900)))  # some share a minute, some an instant
            pnl = float(rng.normal(0, 0.01 if account == "quiet" else 12))
            equity += pnl
            rows.append((account, t.to_pydatetime(), i, "close" if i % 3 else "mark", equity, pnl if i % 3 else None))
    schema = "account string, ts timestamp, seq long, kind string, equity double, pnl_net double"
    limits = RK.RiskLimits(daily_loss_limit=60, max_drawdown_pct=9, max_consecutive_losses=5)
    whole = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in RK.first_breach(whole, limits, 1000.0).select("account", "ts", "seq", "code", F.round("value", 6)).collect()}
    late = [int(rng.integers(0, 3)) for _ in rows]
    first = min(r[1] for r in rows)
    for n in range(40):
        part = [r for r, d in zip(rows, late) if (r[1] - first) // pd.Timedelta(hours=3) + d == n]
        if part:
            order = rng.permutation(len(part))
            spark.createDataFrame([part[i] for i in order], schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    RK.use_rocksdb(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    out = RK.monitor_stream(source, limits, 1000.0, "24 hours")
    TB.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    RK.closing_event(whole, "24 hours").write.mode("append").parquet(f"{tmp_path}/in")
    TB.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema(RK.BREACH_SCHEMA).parquet(f"{tmp_path}/out").withColumn("value", F.round("value", 6)).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)
    assert "quiet" not in {r.account for r in got}


class CountedState:
    """State of one key in memory; counts the calls, each of which is a round trip from the Python worker."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.value = 0, set(), {}, None

    def getValueState(self, name, schema):
        return CountedValue(self)

    def getMapState(self, name, key, value):
        return CountedMap(self, self.maps.setdefault(name, {}))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class CountedValue:
    def __init__(self, state):
        self.state = state

    def exists(self):
        return self.state.value is not None

    def get(self):
        return self.state.value

    def update(self, value):
        self.state.value = value


class CountedMap:
    def __init__(self, state, rows):
        self.state, self.rows = state, rows

    def _call(self, result=None):
        self.state.calls += 1
        return result

    def containsKey(self, key):
        return self._call(key in self.rows)

    def getValue(self, key):
        return self._call(self.rows[key])

    def updateValue(self, key, value):
        self._call(self.rows.__setitem__(key, value))

    def removeKey(self, key):
        self._call(self.rows.pop(key, None))

    def clear(self):
        self._call(self.rows.clear())


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_state_calls_do_not_grow_with_the_events(spark):
    slot = RK.slot_ms(spark, "40 days")
    assert slot == 40 * 86_400_000 // RK.SLOTS and RK.slot_ms(spark, "10 minutes") == RK.SLOT_MS
    limits, calls = RK.RiskLimits(daily_loss_limit=1e9, max_drawdown_pct=50), []
    for n in (2_000, 20_000):
        monitor, state = RK.BreachMonitor(limits, 1000.0, slot), CountedState()
        monitor.init(state)
        rng = np.random.default_rng(1)
        at = np.sort(rng.integers(0, 10 * 86_400, n))
        frame = pd.DataFrame({"ts": pd.to_datetime(at, unit="s"), "seq": np.arange(n), "kind": "close", "equity": 1000.0, "pnl_net": None})
        frame.loc[n // 2:, "equity"] = 400.0
        mixed = frame.sample(frac=1, random_state=2)
        chunks = [mixed.iloc[i:i + 500] for i in range(0, n, 500)]
        assert list(monitor.handleInputRows(("a",), iter(chunks), None)) == []
        hits = [h for t in sorted(state.timers) for h in monitor.handleExpiredTimer(("a",), None, Expired(t))]
        assert [(h["seq"][0], h["code"][0], h["value"][0]) for h in hits] == [(n // 2, "MAX_DRAWDOWN_PCT", 60.0)]
        assert not any(state.maps.values()) and state.value[4]
        calls.append(state.calls)
    assert calls[1] <= 1.5 * calls[0] < 500, calls
