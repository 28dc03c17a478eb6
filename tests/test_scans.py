import itertools
import operator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import random_bars
from tidebar.functions import scans
from tidebar.operators import indicators as I


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(scans, "SCAN_RUN", 16)
    monkeypatch.setattr(scans, "SCAN_GROUP", 3)
    monkeypatch.setattr(scans, "SCAN_LEVELS", 2)
    monkeypatch.setattr(scans, "BLOCK_ROWS", 40)


def test_running_aggregates_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 300, p=[0.8, 0.2]), "t": np.arange(300), "v": rng.normal(size=300).round(3)})
    pdf["g"] = pdf["v"].where(rng.random(300) < 0.3)
    df = spark.createDataFrame(pdf).withColumn("g", F.nanvl("g", F.lit(None).cast("double")))
    out = scans.running(
        df, ["k"], ["t"], F.floor(F.col("t") / 7).cast("long"),
        [scans.Run("s", "sum", F.col("v")), scans.Run("n", "count"), scans.Run("hi", "max", F.col("v")), scans.Run("lo", "min", F.col("v")),
         scans.Run("ff", "last", F.col("g")), scans.Run("pv", "prev", F.col("g")), scans.Run("first", "first", F.col("v")),
         scans.Run("x", "xor", F.xxhash64("t"))],
    ).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    by = want.groupby("k")
    assert np.allclose(out["s"], by["v"].cumsum())
    assert (out["n"] == by.cumcount() + 1).all()
    assert np.allclose(out["hi"], by["v"].cummax()) and np.allclose(out["lo"], by["v"].cummin())
    assert np.allclose(out["ff"], by["g"].ffill(), equal_nan=True)
    assert np.allclose(out["pv"], by["g"].shift(1), equal_nan=True)
    assert np.allclose(out["first"], by["v"].transform("first"))
    hashes = {r.t: r.h for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    for _, part in out.groupby("k"):
        assert part["x"].tolist() == list(itertools.accumulate((hashes[t] for t in part["t"]), operator.xor))


@pytest.mark.parametrize("spans", [(2, 5, 20, 300)])
def test_ema_over_many_runs_and_groups(spark, small_blocks, spans):
    pdf = random_bars(3, 400)
    out = I.ema(spark.createDataFrame(pdf), spans).toPandas().sort_values("bar_idx")
    for n in spans:
        want = pdf["close"].ewm(span=n, adjust=False).mean()
        assert np.abs(out[f"ema_{n}"].to_numpy() - want.to_numpy()).max() < 1e-8


def test_rolling_and_prior_windows_cross_block_borders(spark, small_blocks):
    pdf = random_bars(4, 130)
    out = I.over_bars(
        spark.createDataFrame(pdf), I.SERIES, 12,
        [{"ma": I.rolling_mean("close", 12), "top": I.prior_extreme("high", 9, True), "pc": I.lag1("close")}],
    ).toPandas().sort_values("bar_idx")
    assert len(out) == 130
    assert np.allclose(out["ma"], pdf["close"].rolling(12).mean(), equal_nan=True)
    assert np.allclose(out["top"], pdf["high"].shift(1).rolling(9).max(), equal_nan=True)
    assert np.allclose(out["pc"], pdf["close"].shift(1), equal_nan=True)


def test_wilder_adx_is_empty_for_short_series_and_bounded(spark, small_blocks):
    pdf = random_bars(5, 200)
    out = I.adx_wilder(spark.createDataFrame(pdf), [(14, 14), (150, 60)]).toPandas().sort_values("bar_idx")
    assert out["wadx_14_14"].notna().sum() == 200 - 28
    assert out["wadx_14_14"].dropna().between(0, 100).all()
    assert out["wadx_150_60"].isna().all()


def test_flat_prices_leave_adx_undefined(spark):
    pdf = random_bars(5, 60).assign(open=10.0, high=10.0, low=10.0, close=10.0)
    out = I.adx_wilder(spark.createDataFrame(pdf), [(3, 3)]).toPandas()
    assert out["wadx_3_3"].isna().all()
