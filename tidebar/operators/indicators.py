"""Window indicators on an indexed series (inventory I).

Every function takes bars with ``bar_idx`` and the series keys. Frames of known length run over index
blocks with a halo; recurrences use the block-wise scans of :mod:`tidebar.functions.scans`.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.columns import is_true
from tidebar.functions.scans import Affine, Latest, drop_halo, series_scan, with_halo
from tidebar.operators.bars import SERIES

Feature = Callable[[WindowSpec], Column]


def over_bars(
    df: DataFrame, keys: Sequence[str], back: int, stages: Sequence[Mapping[str, Feature]], ahead: int = 0
) -> DataFrame:
    """Evaluate stages of window features on one shuffle by (keys, block)."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("bar_idx")
    out = with_halo(df, "bar_idx", back, ahead)
    for stage in stages:
        if stage:
            out = out.withColumns({name: make(w) for name, make in stage.items()})
    return drop_halo(out)


def lag1(column: str) -> Feature:
    return lambda w: F.lag(column, 1).over(w)


def diff1(column: str) -> Feature:
    return lambda w: F.col(column) - F.lag(column, 1).over(w)


def rolling_mean(column: str, n: int) -> Feature:
    """Mean of the last n values, null until the frame holds n non-null values."""

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-n + 1, 0)
        return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))

    return make


def prior_extreme(column: str, n: int, highest: bool) -> Feature:
    """Max or min of the n rows before the current one, null until there are n of them."""

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-n, -1)
        agg = F.max(column) if highest else F.min(column)
        return F.when(F.count(column).over(frame) == n, agg.over(frame))

    return make


def true_range(w: WindowSpec) -> Column:
    previous = F.lag("close", 1).over(w)
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def plus_dm(w: WindowSpec) -> Column:
    up = F.col("high") - F.lag("high", 1).over(w)
    down = F.lag("low", 1).over(w) - F.col("low")
    return F.when(is_true((up > down) & (up > 0)), up).otherwise(F.lit(0.0))


def minus_dm(w: WindowSpec) -> Column:
    up = F.col("high") - F.lag("high", 1).over(w)
    down = F.lag("low", 1).over(w) - F.col("low")
    return F.when(is_true((down > up) & (down > 0)), down).otherwise(F.lit(0.0))


def ema_factor(span: int) -> float:
    return (span - 1.0) / (span + 1.0)


def ema_scans(spans: Iterable[int], column: str = "close", prefix: str = "ema_") -> list[Affine]:
    """Exponential averages started at the first value, one column per span."""
    x = F.col(column)
    return [
        Affine(f"{prefix}{n}", ema_factor(n), F.when(F.col("bar_idx") == 0, x).otherwise(x * F.lit(2.0 / (n + 1.0))))
        for n in sorted(set(spans))
    ]


def ema(df: DataFrame, spans: Iterable[int], keys: Sequence[str] = SERIES, column: str = "close", prefix: str = "ema_") -> DataFrame:
    return series_scan(df, keys, "bar_idx", ema_scans(spans, column, prefix))


def atr(df: DataFrame, periods: Iterable[int], keys: Sequence[str] = SERIES) -> DataFrame:
    ns = sorted(set(periods))
    return over_bars(
        df, keys, max(ns) + 1, [{"tr": true_range}, {f"atr_{n}": rolling_mean("tr", n) for n in ns}]
    ).drop("tr")


def _simple_adx_stages(ns: Sequence[int]) -> list[dict[str, Feature]]:
    def dx(n: int) -> Feature:
        def make(_: WindowSpec) -> Column:
            base = F.nullif(F.col(f"_atr{n}"), F.lit(0.0))
            up, down = 100.0 * F.try_divide(F.col(f"_up{n}"), base), 100.0 * F.try_divide(F.col(f"_dn{n}"), base)
            return F.try_divide(100.0 * F.abs(up - down), F.nullif(up + down, F.lit(0.0)))

        return make

    return [
        {"_tr": true_range, "_pdm": plus_dm, "_mdm": minus_dm},
        {
            k: v for n in ns
            for k, v in ((f"_atr{n}", rolling_mean("_tr", n)), (f"_up{n}", rolling_mean("_pdm", n)), (f"_dn{n}", rolling_mean("_mdm", n)))
        },
        {f"_dx{n}": dx(n) for n in ns},
        {f"adx_{n}": rolling_mean(f"_dx{n}", n) for n in ns},
    ]


def adx_simple(df: DataFrame, periods: Iterable[int], keys: Sequence[str] = SERIES) -> DataFrame:
    """Directional index from simple means; a zero denominator leaves a null that voids its frame."""
    ns = sorted(set(periods))
    out = over_bars(df, keys, 2 * max(ns) + 1, _simple_adx_stages(ns))
    return out.select(*df.columns, *[f"adx_{n}" for n in ns])


def trend_features(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    spans: Iterable[int] = (),
    hilo_periods: Iterable[int] = (),
    adx_pairs: Iterable[tuple[int, int]] = (),
) -> DataFrame:
    """EMA (``ema_<n>``), HiLo line (``hilo_<n>``) and Wilder ADX (``wadx_<period>_<smoothing>``) together.

    All first-level recurrences share one halo pass and one scan; the ADX smoothing is a second scan.

    ADX: Wilder sums are seeded at row ``period`` with rows 1..period and decay by 1/period; the index is
    seeded at row period+smoothing with the mean of the DX values after the first seed. A DX that is
    undefined later stays undefined for the rest of the series, hence NaN and not null inside the scan.

    HiLo: the line follows the mean low in an up phase and the mean high in a down phase. The phase turns
    when the close crosses the previous opposite mean, so the phase is the latest turn.
    """
    spans, hilos, pairs = sorted(set(spans)), sorted(set(hilo_periods)), sorted(set(adx_pairs))
    ns = sorted({p for p, _ in pairs})
    moves = ("_tr", "_pdm", "_mdm")
    nan, idx = F.lit(float("nan")), F.col("bar_idx")

    def window_sum(column: str, n: int) -> Feature:
        return lambda w: F.sum(column).over(w.rowsBetween(-n + 1, 0))

    def turn(n: int) -> Feature:
        def make(w: WindowSpec) -> Column:
            close, above, below = F.col("close"), F.lag(f"_hm{n}", 1).over(w), F.lag(f"_lm{n}", 1).over(w)
            return (
                F.when(idx == n - 1, F.when(close >= F.col(f"_lm{n}"), 1).otherwise(-1))
                .when(close > above, 1)
                .when(close < below, -1)
            )

        return make

    first: dict[str, Feature] = {"_tr": true_range, "_pdm": plus_dm, "_mdm": minus_dm} if ns else {}
    for n in hilos:
        first[f"_hm{n}"] = rolling_mean("high", n)
        first[f"_lm{n}"] = rolling_mean("low", n)
    second: dict[str, Feature] = {f"{c}_s{n}": window_sum(c, n) for n in ns for c in moves}
    second.update({f"_turn{n}": turn(n) for n in hilos})
    base = over_bars(df, keys, max([*ns, *hilos]) + 1, [first, second]) if ns or hilos else df
    scans = ema_scans(spans) + [
        Affine(f"{c}_y{n}", 1.0 - 1.0 / n, F.when(idx == n, F.col(f"{c}_s{n}")).when(idx > n, F.col(c)).otherwise(F.lit(0.0)))
        for n in ns for c in moves
    ]
    scanned = series_scan(base, keys, "bar_idx", scans, [Latest(f"_phase{n}", F.col(f"_turn{n}")) for n in hilos])

    def dx(n: int) -> Column:
        total = F.col(f"_tr_y{n}")
        up, down = F.try_divide(100.0 * F.col(f"_pdm_y{n}"), total), F.try_divide(100.0 * F.col(f"_mdm_y{n}"), total)
        return F.when(idx >= n, F.coalesce(F.try_divide(100.0 * F.abs(up - down), up + down), nan))

    hilo_line = lambda n: F.when(F.col(f"_phase{n}") > 0, F.col(f"_lm{n}")).otherwise(F.col(f"_hm{n}"))
    out = scanned.select(
        *df.columns, *[f"ema_{n}" for n in spans], *[hilo_line(n).alias(f"hilo_{n}") for n in hilos],
        *[dx(n).alias(f"_dx{n}") for n in ns],
    )
    if not pairs:
        return out
    kept = [c for c in out.columns if not c.startswith("_dx")]

    def seed(n: int, s: int) -> Feature:
        def make(w: WindowSpec) -> Column:
            seen = F.when((idx > n) & ~F.isnan(f"_dx{n}"), F.col(f"_dx{n}"))
            return F.coalesce(F.avg(seen).over(w.rowsBetween(-s + 1, 0)), nan)

        return make

    seeded = over_bars(out, keys, max(s for _, s in pairs) + 1, [{f"_seed{n}_{s}": seed(n, s) for n, s in pairs}])
    final = series_scan(
        seeded, keys, "bar_idx",
        [
            Affine(
                f"_adx{n}_{s}", (s - 1.0) / s,
                F.when(idx == n + s, F.col(f"_seed{n}_{s}")).when(idx > n + s, F.col(f"_dx{n}") / float(s)).otherwise(F.lit(0.0)),
            )
            for n, s in pairs
        ],
    )
    return final.select(
        *kept,
        *[F.when((idx >= n + s) & ~F.isnan(f"_adx{n}_{s}"), F.col(f"_adx{n}_{s}")).alias(f"wadx_{n}_{s}") for n, s in pairs],
    )


def adx_wilder(df: DataFrame, pairs: Iterable[tuple[int, int]], keys: Sequence[str] = SERIES) -> DataFrame:
    return trend_features(df, keys, adx_pairs=pairs)


def hilo_activator(df: DataFrame, periods: Iterable[int], keys: Sequence[str] = SERIES) -> DataFrame:
    return trend_features(df, keys, hilo_periods=periods)
