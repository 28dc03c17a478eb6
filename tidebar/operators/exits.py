"""First exit of every candidate on its own (inventory T4-T7, T12).

A naive join pairs a candidate with every later bar up to its exit. Here a series is stored as rows of 128
path points with their extremes, rows of 128 such rows and so on. A candidate climbs: it looks ahead in its own row of
each level for the first part that can end it, and then descends into that part. Every step is an equi-join on
(keys, block) that returns one row per candidate, whatever the holding time.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import day_number, epoch_micros, is_true, second_of_day
from tidebar.functions.scans import number_rows
from tidebar.operators.bars import candle_range
from tidebar.session import materialize

FANOUT = 128
EXTREMES = ("hi", "lo", "mxc", "mnc", "mns", "mxs")
PAYLOAD = ("bar_idx", "datetime", "open", "close", "rng", "kind")

BAR, OPENING, TICK, CLOSING = 0, 1, 2, 3       # kinds of path points

STOP, TAKE, BOTH = "stop_loss", "take_profit", "stop_and_take_hit_conservative_stop"
SESSION, END = "session_end", "end_of_data"


def bar_path(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One path point per bar: range for the barriers, close for arming, time of day for the session."""
    sec = second_of_day(F.col("datetime"))
    return indexed.select(
        *keys, F.col("bar_idx").alias("pos"), F.col("high").alias("hi"), F.col("low").alias("lo"),
        F.col("close").alias("mxc"), F.col("close").alias("mnc"), sec.alias("mns"), sec.alias("mxs"),
        "bar_idx", "datetime", "open", "close", candle_range().alias("rng"), F.lit(BAR).alias("kind"),
    )


def tick_path(indexed: DataFrame, owned_ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Path with the ticks of each bar in place of its range.

    Points of a bar: its opening (session check), its ticks or, without ticks, its range, then its close
    (arming). ``owned_ticks`` comes from :func:`tidebar.operators.bars.assign_ticks`.
    """
    keys = list(keys)
    none = F.lit(None).cast("double")
    sec = second_of_day(F.col("datetime"))
    counted = owned_ticks.groupBy(*keys, "bar_idx").agg(F.count(F.lit(1)).alias("_ticks"))
    bars = indexed.join(counted, [*keys, "bar_idx"], "left").withColumn("rng", candle_range())
    body = ("bar_idx", "datetime", "open", "close", "rng")

    def points(df: DataFrame, kind: int, order: int, hi: Column, lo: Column, arm: Column, check: Column,
               us: Column = F.lit(-1).cast("long"), seq: Column = F.lit(-1).cast("long")) -> DataFrame:
        return df.select(
            *keys, hi.alias("hi"), lo.alias("lo"), arm.alias("mxc"), arm.alias("mnc"), check.alias("mns"), check.alias("mxs"),
            *body, F.lit(kind).alias("kind"), F.lit(order).alias("_ord"), us.alias("_us"), seq.alias("_seq"),
        )

    unchecked, price, close = F.lit(None).cast("int"), F.col("price"), F.col("close")
    ticks = owned_ticks.select(*keys, "bar_idx", "seq", "price", epoch_micros(F.col("datetime")).alias("_us")).join(
        bars.select(*keys, *body), [*keys, "bar_idx"]
    )
    tickless = bars.where(F.col("_ticks").isNull())
    line = (
        points(bars, OPENING, 0, none, none, none, sec)
        .unionByName(points(ticks, TICK, 1, price, price, price, unchecked, F.col("_us"), F.col("seq")))
        .unionByName(points(tickless, BAR, 1, F.col("high"), F.col("low"), none, unchecked))
        .unionByName(points(bars, CLOSING, 2, none, none, close, unchecked))
    )
    numbered = number_rows(
        line, keys, ["bar_idx", "_ord", "_us", "_seq"], F.floor(F.col("bar_idx") / F.lit(512)).cast("long"), out="pos"
    )
    return numbered.select(*keys, "pos", *EXTREMES, *PAYLOAD)


def _rollup(rows: DataFrame, keys: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """Rows of up to FANOUT items in order of ``pos``, with the extremes over them; ``block`` counts the rows of a series."""
    return rows.withColumn("block", F.floor(F.col("pos") / FANOUT).cast("long")).groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", *EXTREMES, *payload))).alias("items"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("mxc").alias("mxc"), F.min("mnc").alias("mnc"),
        F.min("mns").alias("mns"), F.max("mxs").alias("mxs"),
    )


class PathIndex:
    """Index over a path: rows of points, then rows of the extremes of FANOUT rows below, up to one row per series.

    The rows of points are written once (checkpoint); all levels and lookups read them. There are as many levels as the
    longest series needs, and every level is looked up in the same way.
    """

    def __init__(self, path: DataFrame, keys: Sequence[str], payload: Sequence[str] = PAYLOAD):
        self.keys = list(keys)
        self.leaves = materialize(_rollup(path, self.keys, payload))
        self.levels = [self.leaves]
        last = self.leaves.agg(F.max("block")).first()[0] or 0
        while last > 0:
            below = self.levels[-1].select(*self.keys, F.col("block").alias("pos"), *EXTREMES)
            self.levels.append(_rollup(below, self.keys))
            last //= FANOUT

    def points(self) -> DataFrame:
        return self.leaves.select(*self.keys, F.explode("items").alias("p"))

    def finals(self) -> DataFrame:
        """Last point of each series."""
        ends = F.element_at("items", -1)
        return self.leaves.groupBy(*self.keys).agg(F.max_by(ends, F.col("block")).alias("_final"))

    def _look(self, queries: DataFrame, level: int, block: Column, matches: Callable[[Column], Column], out: str) -> DataFrame:
        """Add ``out``: the first item for which ``matches`` holds in row ``block`` of a level; a null block asks for nothing."""
        rows = self.levels[level].select(*self.keys, F.col("block").alias("_block"), F.col("items").alias("_items"))
        placed = queries.withColumn("_block", F.coalesce(block, -1 - F.col("sig_idx")))
        found = F.get(F.filter("_items", lambda p: is_true(matches(p))), F.lit(0))
        return placed.join(rows, [*self.keys, "_block"], "left").withColumn(out, found).drop("_block", "_items")

    def first(self, queries: DataFrame, start: str, matches: Callable[[Column], Column], out: str) -> DataFrame:
        """Add ``out``: the first path point at or after ``start`` for which ``matches(point)`` holds.

        ``matches`` is written against extremes, so it is also a sound test for whole rows of points. A null
        ``start`` asks for nothing. Queries must carry ``sig_idx``; rows that are already answered get a
        spread-out dummy join key instead of one shared null.
        """
        at = lambda level: F.floor(F.col(start) / FANOUT**level).cast("long")
        q, wanted = queries, F.col(start).isNotNull()
        for level in range(len(self.levels)):
            ahead = lambda p, first=at(level) + (1 if level else 0): (p["pos"] >= first) & matches(p)
            q = self._look(q, level, F.when(wanted, at(level + 1)), ahead, f"_up{level}")
            wanted = wanted & F.col(f"_up{level}").isNull()
        below = F.lit(None).cast("long")
        for level in range(len(self.levels) - 2, -1, -1):
            below = F.coalesce(F.col(f"_up{level + 1}.pos"), below)
            q = self._look(q, level, below, matches, f"_down{level}")
            below = F.col(f"_down{level}.pos")
        found = F.coalesce("_up0", "_down0") if len(self.levels) > 1 else F.col("_up0")
        return q.select(*queries.columns, found.alias(out))


def first_exit(
    candidates: DataFrame, path: DataFrame, keys: Sequence[str], break_even: bool = True, by_tick: bool = False
) -> DataFrame:
    """Exit bar, raw price and reason of each candidate as if it were the only position.

    Precedence inside a bar: session end (at its open), then stop before take. Once a bar that survived
    closes beyond the break-even trigger the stop moves to entry +/- lock: for later bars on the bar path,
    from the arming point on for ticks. A candidate that meets nothing leaves at the last close.
    """
    index = PathIndex(path, keys)
    side, entry = F.col("side"), F.col("entry_price")
    long = side > 0

    def closes_session(p: Column) -> Column:
        outside = F.coalesce(p["mns"] < F.col("session_start_sec"), F.lit(False)) | F.coalesce(
            p["mxs"] >= F.col("session_end_sec"), F.lit(False)
        )
        return F.col("flatten") & outside

    def touches(p: Column, stop: Column, take: Column) -> tuple[Column, Column]:
        stop_hit = F.when(long, p["lo"] <= stop).otherwise(p["hi"] >= stop)
        take_hit = F.when(long, p["hi"] >= take).otherwise(p["lo"] <= take)
        return F.coalesce(stop_hit, F.lit(False)), F.coalesce(take_hit, F.lit(False))

    trigger = entry + side * F.col("be_trigger")
    arms = lambda p: (F.col("be_trigger") > 0) & F.coalesce(
        F.when(long, p["mxc"] >= trigger).otherwise(p["mnc"] <= trigger), F.lit(False)
    )
    ends = lambda p, stop: closes_session(p) | touches(p, stop, F.col("take_price"))[0] | touches(p, stop, F.col("take_price"))[1]

    q = candidates
    if by_tick:
        openings = index.points().where(F.col("p.kind") == OPENING).select(
            *keys, F.col("p.bar_idx").alias("first_idx"), F.col("p.pos").alias("_start")
        )
        q = q.join(openings, [*keys, "first_idx"], "left")
    else:
        q = q.withColumn("_start", F.col("first_idx"))
    kept = [c for c in q.columns if c not in ("_start",)]
    plain_stop = F.col("stop_price")
    if not break_even:
        q = index.first(q, "_start", lambda p: ends(p, plain_stop), "_exit").withColumn("_stop", plain_stop)
    else:
        q = index.first(q, "_start", lambda p: ends(p, plain_stop) | arms(p), "_event")
        event = F.col("_event")
        armed_here = is_true(arms(event)) if by_tick else is_true(arms(event)) & ~is_true(ends(event, plain_stop))
        locked = entry + side * F.col("be_lock")
        moved = F.when(long, F.greatest(plain_stop, locked)).otherwise(F.least(plain_stop, locked))
        q = q.withColumn("_armed", armed_here)
        q = q.withColumn("_stop", F.when(F.col("_armed"), moved).otherwise(plain_stop))
        q = q.withColumn("_resume", F.when(F.col("_armed"), event["pos"] + F.lit(0 if by_tick else 1)))
        q = index.first(q, "_resume", lambda p: ends(p, F.col("_stop")), "_after")
        q = q.withColumn("_exit", F.when(F.col("_armed"), F.col("_after")).otherwise(event))
    q = q.join(index.finals(), list(keys))
    hit, final = F.col("_exit"), F.col("_final")
    session = is_true(closes_session(hit))
    stop_hit, take_hit = touches(hit, F.col("_stop"), F.col("take_price"))
    reason = (
        F.when(hit.isNull(), END).when(session, SESSION)
        .when(stop_hit & take_hit & (hit["kind"] != TICK), BOTH).when(stop_hit, STOP).otherwise(TAKE)
    )
    raw = F.when(hit.isNull(), final["close"]).when(session, hit["open"]).when(stop_hit, F.col("_stop")).otherwise(F.col("take_price"))
    at = lambda name: F.when(hit.isNull(), final[name]).otherwise(hit[name])
    return q.select(
        *kept,
        at("bar_idx").alias("exit_idx"), at("datetime").alias("exit_time"), at("rng").alias("exit_range"),
        day_number(at("datetime")).alias("exit_day"), raw.alias("raw_exit"), reason.alias("exit_reason"),
    )

