"""Reconciliation of two trade books within time tolerance (inventory U1, U2).

Both books have trade_id, entry_time, exit_time, direction, qty, entry_price, exit_price, pnl_net; book A is
processed in trade_id order and each trade takes the best unused partner of book B.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import MICROS, epoch_micros
from tidebar.session import materialize

BOOK = ("trade_id", "entry_time", "exit_time", "direction", "qty", "entry_price", "exit_price", "pnl_net")


def candidate_pairs(a: DataFrame, b: DataFrame, tolerance_sec: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs close in entry or in exit time with compatible direction: equi-joins on time bins, no range join.

    A trade of A meets the bins next to its own, so the bin width is the tolerance.
    """
    tol = max(0.0, float(tolerance_sec))
    width = int(max(tol, 1.0) * MICROS)
    slim = lambda df, s: df.select(
        *by, F.col("trade_id").alias(f"{s}_id"), F.lower("direction").alias(f"{s}_dir"), F.col("pnl_net").alias(f"{s}_pnl"),
        epoch_micros(F.col("entry_time")).alias(f"{s}_in"), epoch_micros(F.col("exit_time")).alias(f"{s}_out"),
    )
    left, right = slim(a, "a"), slim(b, "b")
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    near = lambda c: F.explode(F.array(*[bin_of(c) + d for d in (-1, 0, 1)])).alias("_bin")
    parts = []
    for point in ("in", "out"):
        found = left.select("*", near(f"a_{point}")).join(right.select("*", bin_of(f"b_{point}").alias("_bin")), [*by, "_bin"])
        within = F.abs(F.col(f"a_{point}") - F.col(f"b_{point}")) <= F.lit(int(tol * MICROS))
        other = "out" if point == "in" else "in"
        close_too = F.abs(F.col(f"a_{other}") - F.col(f"b_{other}")) <= F.lit(int(tol * MICROS))
        # pairs near in both times are kept by the first join only
        parts.append(found.where(within if point == "in" else within & ~F.coalesce(close_too, F.lit(False))))
    pairs = parts[0].unionByName(parts[1])
    gap = lambda p: F.coalesce(F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) / F.lit(float(MICROS)), F.lit(float("inf")))
    agree = (F.col("a_dir") == F.col("b_dir")) | (F.col("a_dir") == "unknown") | (F.col("b_dir") == "unknown")
    score = F.least(gap("in"), gap("out")) * 1000.0 + F.abs(F.col("a_pnl") - F.col("b_pnl"))
    scored = pairs.where(agree).select("a_id", "b_id", gap("in").alias("entry_gap"), gap("out").alias("exit_gap"), score.alias("score"))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score"))


def match_trades(a: DataFrame, b: DataFrame, tolerance_sec: float = 300.0, by: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, entry_gap, exit_gap) of the sequential greedy matching: trades of A choose in order of trade_id.

    Equals the stable matching in which every trade of B prefers the earlier trade of A, which is found in rounds by all
    trades at once: each trade of A offers itself to its best remaining partner, and a partner that has an offer of trade i
    drops all pairs with later trades, as it never gets a worse one. A pair is final when it is the best of its A and the
    first of its B; both leave with all their pairs. The first remaining trade of A is always final, so rounds end, and pairs
    that do not compete are settled in the same round. A round is aggregations by minimum, which combine before the
    shuffle, and joins on ids: no order of blocks is guessed and no cluster of near trades is gathered in one task.
    Trade ids of A must be numbers in processing order.
    """
    pairs = materialize(candidate_pairs(a, b, tolerance_sec, by))
    active = pairs.select("a_id", "b_id", "score")
    final: list[DataFrame] = []
    while True:
        best = active.groupBy("a_id").agg(F.min(F.struct("score", "b_id")).alias("_best")).select("a_id", F.col("_best.b_id").alias("b_id"))
        offers = best.groupBy("b_id").agg(F.min("a_id").alias("_holder"))
        first = active.groupBy("b_id").agg(F.min("a_id").alias("_first"))
        heard = materialize(first.join(offers, "b_id", "left"))
        settled = heard.where(F.col("_holder") == F.col("_first")).select(F.col("_holder").alias("a_id"), "b_id")
        final.append(settled)
        kept = active.join(settled.select("a_id"), "a_id", "left_anti").join(heard, "b_id")
        beaten = F.col("_holder").isNotNull() & (F.col("a_id") > F.col("_holder"))
        active = materialize(kept.where(~beaten & ~F.col("_holder").eqNullSafe(F.col("_first"))).select("a_id", "b_id", "score"))
        if active.isEmpty():
            break
    matches = reduce(DataFrame.unionByName, final)
    return matches.join(pairs.select("a_id", "b_id", "entry_gap", "exit_gap"), ["a_id", "b_id"])


def match_detail(
    matches: DataFrame, a: DataFrame, b: DataFrame, tolerance_sec: float = 300.0, pnl_tolerance: float = 5.0, price_tolerance: float = 5.0
) -> DataFrame:
    """Both sides of each match with differences and tolerance flags; unknown values differ infinitely."""
    side = lambda df, s: df.select(*[F.col(c).alias("a_id" if (s, c) == ("a", "trade_id") else "b_id" if c == "trade_id" else f"{s}_{c}") for c in BOOK])
    joined = matches.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
    diff = lambda c: F.coalesce(F.nanvl(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), F.lit(float("inf"))), F.lit(float("inf")))
    out = joined.withColumns({f"{c}_diff": diff(c) for c in ("entry_price", "exit_price", "pnl_net")})
    out = out.withColumns(
        {
            "within_time_tol": F.least("entry_gap", "exit_gap") <= F.lit(max(0.0, float(tolerance_sec))),
            "within_price_tol": (F.col("entry_price_diff") <= price_tolerance) & (F.col("exit_price_diff") <= price_tolerance),
            "within_pnl_tol": F.col("pnl_net_diff") <= pnl_tolerance,
        }
    )
    return out.withColumn("equivalent", F.col("within_time_tol") & F.col("within_price_tol") & F.col("within_pnl_tol"))


def unmatched(book: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Trades of one book (side 'a' or 'b') without partner."""
    return book.join(matches.select(F.col(f"{side}_id").alias("trade_id")), "trade_id", "left_anti")


def match_summary(a: DataFrame, b: DataFrame, detail: DataFrame, pnl_tolerance: float = 5.0) -> DataFrame:
    """One row: counts, nets, match rates and strict parity."""
    total = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"{s}_trade_count"), F.coalesce(F.sum("pnl_net"), F.lit(0.0)).alias(f"{s}_net"))
    found = detail.agg(
        F.count(F.lit(1)).alias("matched_trade_count"), F.coalesce(F.avg(F.col("equivalent").cast("double")) * 100.0, F.lit(0.0)).alias("equivalent_matches_pct")
    )
    # three one-row aggregates side by side
    row = total(a, "a").join(total(b, "b"), F.lit(True)).join(found, F.lit(True))
    n, na, nb = F.col("matched_trade_count"), F.col("a_trade_count"), F.col("b_trade_count")
    pct = lambda whole: F.coalesce(F.try_divide(100.0 * n, whole.cast("double")), F.lit(0.0))
    net = F.col("a_net") - F.col("b_net")
    return row.select(
        "a_trade_count", "b_trade_count", "matched_trade_count", (na - n).alias("only_a_count"), (nb - n).alias("only_b_count"),
        "a_net", "b_net", net.alias("net_diff"), pct(na).alias("match_rate_a_pct"), pct(nb).alias("match_rate_b_pct"), "equivalent_matches_pct",
        ((na == nb) & (n == na) & (F.abs(net) <= pnl_tolerance) & (n > 0) & (F.col("equivalent_matches_pct") == 100.0)).alias("strict_parity"),
    )
