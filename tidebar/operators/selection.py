"""Which candidates become trades (inventory T8-T11).

Exits are independent of each other, admission is not: positions exclude later candidates while open, and
daily guards block the rest of a day. Admission is a fold in signal order over the candidates of one (group, block
of days), a JVM-side ``aggregate`` over an array of bounded length, so no task holds a whole series and no row passes
through Python. A block starts from the positions still open in the block before it. The first pass assumes there are
none; blocks whose assumption was wrong run again with the true positions until nothing changes. The fixed point equals
the plain sequential fold: block 0 is right from the start and each pass settles at least one more block. Guards reset
every day and blocks hold whole days, so open positions are the only state that crosses a border.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.exits import END
from tidebar.session import materialize

BLOCK_DAYS = 30
_FACTS = ("sig_idx", "sig_day", "entry_idx", "exit_idx", "exit_day", "pnl_net", "max_losses", "daily_limits", "loss_limit", "profit_target")
_OPEN = "array<struct<exit_idx:bigint,sig_idx:bigint,exit_day:bigint,pnl:double,entry_idx:bigint>>"
_FLAT = "array<struct<sig_idx:bigint,flat_idx:bigint>>"
_BOOK = ("open", "day", "streak", "realised", "streak_stop", "limit_stop", "takes", "flats")


def _with(book: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(c, book[c]).alias(c) for c in _BOOK])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turned(book: Column, day: Column) -> Column:
    """The book on ``day``: guards start anew when it is another one."""
    fresh = _with(book, day=day, streak=F.lit(0).cast("long"), realised=F.lit(0.0), streak_stop=F.lit(False), limit_stop=F.lit(False))
    return F.when(book["day"].eqNullSafe(day), book).otherwise(fresh)


def _closed(book: Column, position: Column, rules: Column) -> Column:
    """The book after a position has closed and its P&L has met the guards."""
    def settle(b: Column) -> Column:
        pnl = position["pnl"]
        streak = F.when(pnl < 0, b["streak"] + 1).when(pnl > 0, F.lit(0).cast("long")).otherwise(b["streak"])
        realised = b["realised"] + pnl
        losing = (rules["max_losses"] > 0) & (streak >= rules["max_losses"])
        limit = ((rules["loss_limit"] > 0) & (realised <= -rules["loss_limit"])) | ((rules["profit_target"] > 0) & (realised >= rules["profit_target"]))
        return _with(b, open=F.filter(b["open"], lambda q: q["sig_idx"] != position["sig_idx"]), streak=streak, realised=realised,
                     streak_stop=b["streak_stop"] | losing, limit_stop=b["limit_stop"] | (rules["daily_limits"] & limit))

    return _let(_turned(book, position["exit_day"]), settle)


def _flattened(book: Column, bar: Column) -> Column:
    """Once a daily limit is hit at ``bar``, all positions entered by then leave there."""
    present = F.filter(book["open"], lambda q: q["entry_idx"] <= bar)
    left = _with(book, open=F.filter(book["open"], lambda q: q["entry_idx"] > bar),
                 flats=F.concat(book["flats"], F.transform(present, lambda q: F.struct(q["sig_idx"].alias("sig_idx"), bar.alias("flat_idx")))))
    return F.when(book["limit_stop"] & (F.size(book["open"]) > 0), left).otherwise(book)


def _settled(book: Column, due: Callable[[Column], Column], rules: Column, slots: int) -> Column:
    """Closes the positions for which ``due`` holds in order of exit, then signal; a bar's exits count before it flattens."""
    bars = F.array_sort(F.array_distinct(F.transform(F.filter(book["open"], due), lambda q: q["exit_idx"])))

    def bar_done(b: Column, bar: Column) -> Column:
        leaving = F.array_sort(F.filter(b["open"], lambda q: q["exit_idx"] == bar))
        after = F.aggregate(leaving, b, lambda c, q: _closed(c, q, rules))
        return _let(after, lambda c: _flattened(c, bar)) if slots > 1 else after

    return F.when(F.exists(book["open"], due), F.aggregate(bars, book, bar_done)).otherwise(book)


def _fold(rows: Column, incoming: Column, until: Column, slots: int) -> Column:
    """Struct takes, flats, carry of one block: ``rows`` in signal order, ``until`` the first day of the next block or null."""
    start = F.struct(
        incoming.alias("open"), F.lit(None).cast("bigint").alias("day"), F.lit(0).cast("long").alias("streak"), F.lit(0.0).alias("realised"),
        F.lit(False).alias("streak_stop"), F.lit(False).alias("limit_stop"), F.array().cast("array<bigint>").alias("takes"), F.array().cast(_FLAT).alias("flats"))

    def step(book: Column, x: Column) -> Column:
        def admit(b: Column) -> Column:
            position = F.struct(x["exit_idx"].alias("exit_idx"), x["sig_idx"].alias("sig_idx"), x["exit_day"].alias("exit_day"), x["pnl_net"].alias("pnl"), x["entry_idx"].alias("entry_idx"))
            shut = b["streak_stop"] | b["limit_stop"] | (F.size(b["open"]) >= slots)
            taken = _with(b, open=F.array_append(b["open"], position), takes=F.array_append(b["takes"], x["sig_idx"]))
            return F.when(shut, b).otherwise(taken)

        ready = _settled(book, lambda q: q["exit_idx"] <= x["sig_idx"], x, slots)
        return _let(ready, lambda b: _let(_turned(b, x["sig_day"]), admit))

    def finish(book: Column) -> Column:
        last = F.element_at(rows, -1)
        ended = _settled(book, lambda q: until.isNull() | (q["exit_day"] < until), last, slots)
        return _let(ended, lambda b: F.struct(b["takes"].alias("takes"), b["flats"].alias("flats"), F.when(until.isNull(), F.array().cast(_OPEN)).otherwise(F.array_sort(b["open"])).alias("carry")))

    return _let(F.aggregate(rows, start, step), finish)


def _fold_single(rows: Column, incoming: Column, until: Column) -> Column:
    """As :func:`_fold` for one position at a time, whose state is flat and which nothing flattens."""
    names = ("leaves", "sig_idx", "exit_day", "pnl", "entry_idx", "day", "streak", "realised", "stopped", "takes")
    fresh = dict(day=F.lit(None).cast("bigint"), streak=F.lit(0).cast("long"), realised=F.lit(0.0), stopped=F.lit(False), takes=F.array().cast("array<bigint>"))
    held = F.get(incoming, 0)
    start = F.struct(*[fresh.get(c, held["exit_idx" if c == "leaves" else c]).alias(c) for c in names])

    def step(b: Column, x: Column) -> Column:
        def admit(r: Column) -> Column:
            position = {"leaves": x["exit_idx"], "sig_idx": x["sig_idx"], "exit_day": x["exit_day"], "pnl": x["pnl_net"], "entry_idx": x["entry_idx"], "takes": F.array_append(r["takes"], x["sig_idx"])}
            empty = F.when(r["free"], F.lit(None).cast("bigint")).otherwise(r["leaves"])
            taken = F.struct(*[position.get(c, r[c]).alias(c) for c in names])
            return F.when(r["free"] & ~r["stopped"], taken).otherwise(F.struct(*[(empty if c == "leaves" else r[c]).alias(c) for c in names]))

        # what the position that has left by now did to the guards of its day, if that is still the day
        closing = b["leaves"].isNotNull() & (b["leaves"] <= x["sig_idx"])
        own = closing & (b["exit_day"] == x["sig_day"])
        same = b["day"].eqNullSafe(x["sig_day"])
        streak0 = F.when(same, b["streak"]).otherwise(F.lit(0).cast("long"))
        realised0 = F.when(same, b["realised"]).otherwise(F.lit(0.0))
        streak = F.when(own & (b["pnl"] < 0), streak0 + 1).when(own & (b["pnl"] > 0), F.lit(0).cast("long")).otherwise(streak0)
        realised = F.when(own, realised0 + b["pnl"]).otherwise(realised0)
        guarded = F.struct(*[b[c].alias(c) for c in names[:5]], x["sig_day"].alias("day"), streak.alias("streak"), realised.alias("realised"), (same & b["stopped"]).alias("stopped"), b["takes"].alias("takes"),
                           (closing | b["leaves"].isNull()).alias("free"), own.alias("own"))

        def judged(r: Column) -> Column:
            losing = (x["max_losses"] > 0) & (r["streak"] >= x["max_losses"])
            limit = x["daily_limits"] & (((x["loss_limit"] > 0) & (r["realised"] <= -x["loss_limit"])) | ((x["profit_target"] > 0) & (r["realised"] >= x["profit_target"])))
            return r.withField("stopped", r["stopped"] | (r["own"] & (losing | limit)))

        return _let(_let(guarded, judged), admit)

    def finish(b: Column) -> Column:
        position = F.struct(b["leaves"].alias("exit_idx"), *[b[c].alias(c) for c in names[1:5]])
        crosses = until.isNotNull() & b["leaves"].isNotNull() & (b["exit_day"] >= until)
        return F.struct(b["takes"].alias("takes"), F.array().cast(_FLAT).alias("flats"), F.when(crosses, F.array(position)).otherwise(F.array().cast(_OPEN)).alias("carry"))

    return _let(F.aggregate(rows, start, step), finish)


def select_trades(
    candidates: DataFrame, group: Sequence[str], max_positions: int = 1, block_days: int = BLOCK_DAYS
) -> DataFrame:
    """Admitted candidates per group. Adds ``flat_idx``: bar at which a daily limit closed the position.

    Runs Spark jobs while it is called (one per pass, usually two).
    """
    group, slots = list(group), max(1, max_positions)
    held = materialize(candidates.withColumn("_blk", F.floor(F.col("sig_day") / F.lit(block_days)).cast("long")))
    place = [*group, "_blk"]
    # the forced close at the end of the data comes after the last bar's signal
    leaves = F.col("exit_idx") + F.when(F.col("exit_reason") == END, 1).otherwise(0)
    kinds = {"max_losses": "int", "daily_limits": "boolean", **{c: "double" for c in ("pnl_net", "loss_limit", "profit_target")}}
    facts = held.withColumn("exit_idx", leaves).select(*place, F.struct(*[F.col(c).cast(kinds.get(c, "bigint")).alias(c) for c in _FACTS]).alias("_row"))
    ahead = F.lead("_blk", 1).over(Window.partitionBy(*group).orderBy("_blk"))
    next_blocks = held.select(*place).distinct().withColumn("_next", ahead)
    nobody = F.array().cast(_OPEN)

    def fold(rows: DataFrame, incoming: DataFrame) -> DataFrame:
        """One row per block in ``incoming`` (place, _next, _in) with what it takes and hands on."""
        packed = rows.groupBy(*place).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))  # candidates of block_days days
        until = (F.col("_next") * F.lit(block_days)).cast("bigint")
        args = F.col("_rows"), F.col("_in"), until
        return packed.join(incoming, place).select(*place, "_next", "_in", (_fold_single(*args) if slots == 1 else _fold(*args, slots)).alias("_out"))

    out = materialize(fold(facts, next_blocks.withColumn("_in", nobody)))
    while True:
        arriving = out.where(F.size("_out.carry") > 0).select(*group, F.col("_next").alias("_blk"), F.col("_out.carry").alias("_new"))
        moved = out.select(*place, "_next", "_in").join(arriving, place, "left").withColumn("_new", F.coalesce("_new", nobody))
        changed = materialize(moved.where(F.col("_new") != F.col("_in")).select(*place, "_next", F.col("_new").alias("_in")))
        if changed.isEmpty():
            break
        again = fold(facts.join(changed.select(*place), place, "left_semi"), changed)
        out = materialize(out.join(changed.select(*place), place, "left_anti").unionByName(again))

    takes = out.select(*group, F.explode("_out.takes").alias("sig_idx"))
    chosen = held.drop("_blk").join(takes, [*group, "sig_idx"], "left_semi")
    if slots == 1:
        return chosen.withColumn("flat_idx", F.lit(None).cast("long"))
    flats = out.select(*group, F.explode("_out.flats").alias("_f")).select(*group, "_f.*")
    return chosen.join(flats, [*group, "sig_idx"], "left")
