"""I: indicators. Recurrences are checked with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r6
from checks.sql import r, with_
from tidebar.operators import indicators as I
from tidebar.plans import testviews as V

W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)"
TR = f"""tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
 CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high - lag(high) OVER w > 0 THEN high - lag(high) OVER w ELSE 0.0 END AS pdm,
 CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w - low > 0 THEN lag(low) OVER w - low ELSE 0.0 END AS mdm
 FROM idx {W})"""


def ema_cte(name: str, span: int, source: str = "idx") -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""{name} AS (SELECT symbol, bar_idx, close::DOUBLE AS e FROM {source} WHERE bar_idx = 0
 UNION ALL SELECT b.symbol, b.bar_idx, {a} * b.close + (1.0 - {a}) * p.e FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx + 1)"""


def roll(col: str, n: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {frame} = {n} THEN avg({col}) OVER {frame} END"


@query(
    "i1_lag_diff",
    with_("idx") + f"SELECT symbol, bar_idx, lag(close) OVER w AS prev_close, {r('close - lag(close) OVER w')} AS diff_close FROM idx {W}",
)
def _(spark, sf):
    out = I.over_bars(V.indexed_bars(spark, sf), I.SERIES, 1, [{"prev_close": I.lag1("close"), "diff_close": I.diff1("close")}])
    return out.select("symbol", "bar_idx", "prev_close", r6("diff_close").alias("diff_close"))


@query("i2_rolling_mean", with_("idx") + f"SELECT symbol, bar_idx, {r(roll('close', 20))} AS ma FROM idx")
def _(spark, sf):
    out = I.over_bars(V.indexed_bars(spark, sf), I.SERIES, 20, [{"ma": I.rolling_mean("close", 20)}])
    return out.select("symbol", "bar_idx", r6("ma").alias("ma"))


@query(
    "i3_prior_high_low",
    with_("idx")
    + """SELECT symbol, bar_idx, CASE WHEN count(high) OVER f = 20 THEN max(high) OVER f END AS prior_high,
 CASE WHEN count(low) OVER f = 20 THEN min(low) OVER f END AS prior_low FROM idx
 WINDOW f AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, sf):
    out = I.over_bars(
        V.indexed_bars(spark, sf), I.SERIES, 20,
        [{"prior_high": I.prior_extreme("high", 20, True), "prior_low": I.prior_extreme("low", 20, False)}],
    )
    return out.select("symbol", "bar_idx", "prior_high", "prior_low")


@query(
    "i4_i5_ema",
    with_("idx", extra=ema_cte("e9", 9) + ",\n" + ema_cte("e60", 60), recursive=True)
    + f"SELECT symbol, bar_idx, {r('e9.e')} AS ema_9, {r('e60.e')} AS ema_60 FROM e9 JOIN e60 USING (symbol, bar_idx)",
)
def _(spark, sf):
    out = I.ema(V.indexed_bars(spark, sf), [9, 60])
    return out.select("symbol", "bar_idx", r6("ema_9").alias("ema_9"), r6("ema_60").alias("ema_60"))


@query(
    "i6_i8_true_range_dm",
    with_("idx", extra=TR) + f"SELECT symbol, bar_idx, {r('tr')} AS tr, {r('pdm')} AS plus_dm, {r('mdm')} AS minus_dm FROM tr",
)
def _(spark, sf):
    out = I.over_bars(V.indexed_bars(spark, sf), I.SERIES, 1, [{"tr": I.true_range, "plus_dm": I.plus_dm, "minus_dm": I.minus_dm}])
    return out.select("symbol", "bar_idx", *[r6(c).alias(c) for c in ("tr", "plus_dm", "minus_dm")])


@query("i7_atr", with_("idx", extra=TR) + f"SELECT symbol, bar_idx, {r(roll('tr', 14))} AS atr_14 FROM tr")
def _(spark, sf):
    return I.atr(V.indexed_bars(spark, sf), [14]).select("symbol", "bar_idx", r6("atr_14").alias("atr_14"))


SIMPLE = f"""m AS (SELECT symbol, bar_idx, {roll('tr', 14)} AS a, {roll('pdm', 14)} AS u, {roll('mdm', 14)} AS d FROM tr),
dxs AS (SELECT symbol, bar_idx, 100.0 * abs(100 * u / nullif(a, 0) - 100 * d / nullif(a, 0)) / nullif(100 * u / nullif(a, 0) + 100 * d / nullif(a, 0), 0) AS dx FROM m)"""


@query(
    "i9_adx_simple",
    with_("idx", extra=TR + ",\n" + SIMPLE) + f"SELECT symbol, bar_idx, {r(roll('dx', 14))} AS adx_14 FROM dxs",
)
def _(spark, sf):
    return I.adx_simple(V.indexed_bars(spark, sf), [14]).select("symbol", "bar_idx", r6("adx_14").alias("adx_14"))


def wilder_ctes(p: int, s: int) -> str:
    return f"""seed AS (SELECT symbol, sum(tr) AS a, sum(pdm) AS u, sum(mdm) AS d FROM tr WHERE bar_idx BETWEEN 1 AND {p} GROUP BY symbol),
sm AS (SELECT t.symbol, t.bar_idx, s.a::DOUBLE AS a, s.u::DOUBLE AS u, s.d::DOUBLE AS d FROM tr t JOIN seed s USING (symbol) WHERE t.bar_idx = {p}
 UNION ALL SELECT t.symbol, t.bar_idx, p.a - p.a / {p}.0 + t.tr, p.u - p.u / {p}.0 + t.pdm, p.d - p.d / {p}.0 + t.mdm
 FROM sm p JOIN tr t ON t.symbol = p.symbol AND t.bar_idx = p.bar_idx + 1),
dxw AS (SELECT symbol, bar_idx, 100.0 * abs(100 * u / nullif(a, 0) - 100 * d / nullif(a, 0)) / nullif(100 * u / nullif(a, 0) + 100 * d / nullif(a, 0), 0) AS dx FROM sm),
aseed AS (SELECT symbol, avg(dx) AS x FROM dxw WHERE bar_idx BETWEEN {p + 1} AND {p + s} GROUP BY symbol),
aw AS (SELECT d.symbol, d.bar_idx, s.x AS x FROM dxw d JOIN aseed s USING (symbol) WHERE d.bar_idx = {p + s}
 UNION ALL SELECT d.symbol, d.bar_idx, (p.x * {s - 1} + d.dx) / {s}.0 FROM aw p JOIN dxw d ON d.symbol = p.symbol AND d.bar_idx = p.bar_idx + 1)"""


@query(
    "i10_adx_wilder",
    with_("idx", extra=TR + ",\n" + wilder_ctes(14, 14), recursive=True)
    + f"SELECT i.symbol, i.bar_idx, {r('x')} AS adx FROM idx i LEFT JOIN aw USING (symbol, bar_idx)",
)
def _(spark, sf):
    out = I.adx_wilder(V.indexed_bars(spark, sf), [(14, 14)])
    return out.select("symbol", "bar_idx", r6("wadx_14_14").alias("adx"))


def hilo_ctes(n: int) -> str:
    return f"""hm AS (SELECT symbol, bar_idx, close, {roll('high', n)} AS hi, {roll('low', n)} AS lo FROM idx),
hl AS (SELECT symbol, bar_idx, CASE WHEN close >= lo THEN 1 ELSE -1 END AS side, hi, lo FROM hm WHERE bar_idx = {n - 1}
 UNION ALL SELECT b.symbol, b.bar_idx, CASE WHEN b.close > (CASE WHEN p.side > 0 THEN p.lo ELSE p.hi END) THEN 1
  WHEN b.close < (CASE WHEN p.side > 0 THEN p.lo ELSE p.hi END) THEN -1 ELSE p.side END, b.hi, b.lo
 FROM hl p JOIN hm b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx + 1)"""


@query(
    "i11_hilo_activator",
    with_("idx", extra=hilo_ctes(10), recursive=True)
    + f"SELECT i.symbol, i.bar_idx, {r('CASE WHEN side > 0 THEN lo ELSE hi END')} AS hilo FROM idx i LEFT JOIN hl USING (symbol, bar_idx)",
)
def _(spark, sf):
    return I.hilo_activator(V.indexed_bars(spark, sf), [10]).select("symbol", "bar_idx", r6("hilo_10").alias("hilo"))


@query(
    "i12_crossover",
    with_("idx", extra=ema_cte("e8", 8) + ",\n" + ema_cte("e21", 21), recursive=True)
    + f"""SELECT symbol, bar_idx, coalesce(f > s AND lag(f) OVER w <= lag(s) OVER w, false) AS up_cross, coalesce(f < s AND lag(f) OVER w >= lag(s) OVER w, false) AS down_cross
 FROM (SELECT symbol, bar_idx, e8.e AS f, e21.e AS s FROM e8 JOIN e21 USING (symbol, bar_idx)) {W}""",
)
def _(spark, sf):
    out = I.over_bars(I.ema(V.indexed_bars(spark, sf), [8, 21]), I.SERIES, 1, [{"pf": I.lag1("ema_8"), "ps": I.lag1("ema_21")}])
    up = I.is_true((F.col("ema_8") > F.col("ema_21")) & (F.col("pf") <= F.col("ps")))
    down = I.is_true((F.col("ema_8") < F.col("ema_21")) & (F.col("pf") >= F.col("ps")))
    return out.select("symbol", "bar_idx", up.alias("up_cross"), down.alias("down_cross"))
