"""Risk limits over account events, as a stream and as its batch twin (inventory R2-R4).

Events: account, ts, seq, kind ('mark' or 'close'), equity, pnl_net. Every event is first a mark: the peak
starts at the capital, a drawdown of ``max_drawdown_pct`` or more halts. A close then adds to the day's P&L
and loss streak. The first breach halts the account for good.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.functions.scans import Run, running, time_block
from tidebar.operators.bars import candle_range
from tidebar.operators.params import ExecutionSettings
from tidebar.operators.trades import held_bars, price_exits


@dataclass(frozen=True)
class RiskLimits:
    daily_loss_limit: float = 0.0
    max_drawdown_pct: float = 0.0
    max_consecutive_losses: int = 0


BREACH_SCHEMA = "account string, ts timestamp, seq long, code string, value double"
_BOOK = "day string, peak double, day_pnl double, streak long, halted boolean"
SLOT_MS = 60_000          # events of an account are held and released by slots of a minute or more
SLOTS = 32                # slots within the lateness: a slot adds that part of it to the wait
HOLD_ROWS = 1 << 17       # events of an account that are packed into state at a time
EVENT = np.dtype([("ts", "<i8"), ("seq", "<i8"), ("close", "?"), ("equity", "<f8"), ("pnl", "<f8")])
CLOSING = "closing"       # kind of the event that ends a stream


@dataclass
class RiskBook:
    """Running day, peak, day P&L and loss streak of one account."""

    day: str
    peak: float
    day_pnl: float = 0.0
    streak: int = 0
    halted: bool = False

    def breach(self, limits: RiskLimits, day: str, kind: str, equity: float, pnl: float | None) -> tuple[str, float] | None:
        """Takes one event in; code and value of the limit that it breaks."""
        if day != self.day:
            self.day, self.day_pnl, self.streak = day, 0.0, 0
        self.peak = max(self.peak, equity)
        fall = 100.0 * (self.peak - equity) / self.peak if self.peak > 0 else 0.0
        if limits.max_drawdown_pct > 0 and self.peak > 0 and fall >= limits.max_drawdown_pct:
            return "MAX_DRAWDOWN_PCT", fall
        if kind == "close":
            pnl = pnl or 0.0
            self.day_pnl += pnl
            self.streak = self.streak + 1 if pnl < 0 else (0 if pnl > 0 else self.streak)
            if limits.daily_loss_limit > 0 and self.day_pnl <= -abs(limits.daily_loss_limit):
                return "DAILY_LOSS_LIMIT", self.day_pnl
            if limits.max_consecutive_losses > 0 and self.streak >= limits.max_consecutive_losses:
                return "MAX_CONSECUTIVE_LOSSES", float(self.streak)
        return None


def packed(frame: pd.DataFrame) -> np.ndarray:
    """Events as records of fixed width; no P&L counts as 0."""
    out = np.empty(len(frame), EVENT)
    out["ts"], out["seq"] = frame["ts"].astype("datetime64[us]").astype("int64"), frame["seq"]
    out["close"], out["equity"], out["pnl"] = frame["kind"] == "close", frame["equity"], frame["pnl_net"].astype("float64").fillna(0.0)
    return out


class BreachMonitor(StatefulProcessor):
    """Holds events of an account by slots of time and releases a slot once the watermark has passed it.

    State per account: one small book, and the packed events of the slots that are still open. A packet is written once
    and read once, however many arrive for a slot. An account that has halted holds nothing.
    """

    def __init__(self, limits: RiskLimits, capital: float, slot: int = SLOT_MS):
        self.limits, self.capital, self.slot = limits, float(capital), int(slot)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", _BOOK)
        self.packets = handle.getMapState("packets", "slot long", "n long")
        self.held = handle.getMapState("held", "slot long, n long", "events binary")

    def hold(self, frames: list[pd.DataFrame]) -> None:
        events = packed(pd.concat(frames, ignore_index=True))
        slots = events["ts"] // (1000 * self.slot)
        order = np.argsort(slots, kind="stable")
        found, starts = np.unique(slots[order], return_index=True)
        for slot, part in zip(found.tolist(), np.split(events[order], starts[1:])):
            n = self.packets.getValue((slot,))[0] if self.packets.containsKey((slot,)) else 0
            self.held.updateValue((slot, n), (part.tobytes(),))
            self.packets.updateValue((slot,), (n + 1,))
            if n == 0:
                self.handle.registerTimer((slot + 1) * self.slot)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        halted = self.book.exists() and self.book.get()[4]
        frames, size = [], 0
        for frame in rows:
            frame = frame[frame["kind"] != CLOSING]
            if halted or frame.empty:
                continue
            frames.append(frame)
            size += len(frame)
            if size >= HOLD_ROWS:
                self.hold(frames)
                frames, size = [], 0
        if frames:
            self.hold(frames)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot - 1
        if not self.packets.containsKey((slot,)):
            return
        packets = []
        for n in range(self.packets.getValue((slot,))[0]):
            packets.append(np.frombuffer(bytes(self.held.getValue((slot, n))[0]), EVENT))
            self.held.removeKey((slot, n))
        self.packets.removeKey((slot,))
        events = np.concatenate(packets)
        events = events[np.lexsort((events["seq"], events["ts"]))]
        days = np.datetime_as_string(events["ts"].astype("datetime64[us]"), "D").tolist()
        book = RiskBook(*self.book.get()) if self.book.exists() else RiskBook("", self.capital)
        for day, (micros, seq, close, equity, pnl) in zip(days, events.tolist()):
            hit = book.breach(self.limits, day, "close" if close else "mark", equity, pnl)
            if hit:
                book.halted = True
                self.held.clear()
                self.packets.clear()
                yield pd.DataFrame([(key[0], pd.Timestamp(micros, unit="us"), seq, *hit)], columns=["account", "ts", "seq", "code", "value"])
                break
        self.book.update((book.day, book.peak, book.day_pnl, book.streak, book.halted))


def slot_ms(spark: SparkSession, lateness: str) -> int:
    """Milliseconds of a slot: a part of the lateness, a minute at least."""
    wait = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {lateness}"))).first()[0]
    return max(SLOT_MS, wait // SLOTS)


def monitor_stream(events: DataFrame, limits: RiskLimits, capital: float, lateness: str = "10 minutes") -> DataFrame:
    """First breach per account of an event stream whose events are at most ``lateness`` out of order.

    Events are judged in order of (ts, seq) per account, whatever the files or micro-batches they came in: they wait in
    keyed state until the watermark passes their slot, which is a minute or a 32nd of the lateness (:func:`slot_ms`). Rows
    of one batch reach the processor in chunks, never as a whole account. What is later than the watermark is dropped by Spark. An event of kind ``closing``
    (:func:`closing_event`) moves the watermark past all others and so releases what is left.
    Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    named = events.where("account is not null and ts is not null").select("account", "ts", "seq", "kind", "equity", "pnl_net")
    monitor = BreachMonitor(limits, capital, slot_ms(events.sparkSession, lateness))
    return named.withWatermark("ts", lateness).groupBy("account").transformWithStateInPandas(
        monitor, outputStructType=BREACH_SCHEMA, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State store that timers and map state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def closing_event(events: DataFrame, lateness: str) -> DataFrame:
    """One event that ends a stream of ``events``: later than the last one by more than ``lateness`` and a slot."""
    slot = slot_ms(events.sparkSession, lateness)
    last = events.agg((F.max("ts") + F.expr(f"interval {lateness}") + F.expr(f"interval {2 * slot} milliseconds")).alias("ts"))
    return last.where("ts is not null").select(F.lit("").alias("account"), "ts", F.lit(0).cast("long").alias("seq"), F.lit(CLOSING).alias("kind"), F.lit(0.0).alias("equity"), F.lit(None).cast("double").alias("pnl_net"))


def first_breach(events: DataFrame, limits: RiskLimits, capital: float, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Batch twin: running peak, day P&L and loss streak by block-wise scans, then the earliest breach."""
    keys = list(keys)
    order, block = ["ts", "seq"], time_block(F.col("ts"))
    close = F.col("kind") == "close"
    pnl = F.when(close, F.col("pnl_net"))
    rows = events.withColumn("_day", F.col("ts").cast("date"))
    peaks = running(rows, keys, order, block, [Run("_top", "max", F.col("equity"))])
    day_keys = [*keys, "_day"]
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long")
    daily = running(
        peaks, day_keys, order, block,
        [Run("_pnl", "sum", F.coalesce(pnl, F.lit(0.0))), Run("_losses", "sum", one(pnl < 0)), Run("_wins", "sum", one(pnl > 0))],
    )
    # losses since the last win of the day: running losses minus their value at that win
    since = running(daily, day_keys, order, block, [Run("_at_win", "last", F.when(pnl > 0, F.col("_losses")))])
    peak = F.greatest(F.lit(float(capital)), F.col("_top"))
    fall = F.when(peak > 0, 100.0 * (peak - F.col("equity")) / peak)
    streak = F.col("_losses") - F.coalesce("_at_win", F.lit(0))
    never = F.lit(False)
    dd = (fall >= limits.max_drawdown_pct) if limits.max_drawdown_pct > 0 else never
    loss = (close & (F.col("_pnl") <= -abs(limits.daily_loss_limit))) if limits.daily_loss_limit > 0 else never
    run = (close & (streak >= limits.max_consecutive_losses)) if limits.max_consecutive_losses > 0 else never
    code = F.when(dd, "MAX_DRAWDOWN_PCT").when(loss, "DAILY_LOSS_LIMIT").when(run, "MAX_CONSECUTIVE_LOSSES")
    value = F.when(dd, fall).when(loss, F.col("_pnl")).otherwise(streak.cast("double"))
    carried = [c for c in events.columns if c not in (*keys, "kind", "equity", "pnl_net")]
    hits = since.select(*keys, *carried, code.alias("code"), value.alias("value")).where("code is not null")
    return hits.groupBy(*keys).agg(
        F.min_by(F.struct(*carried, "code", "value"), F.struct(*order)).alias("_b")
    ).select(*keys, "_b.*")


def alerts(breaches: DataFrame, limits: RiskLimits) -> DataFrame:
    """Alert rows of breaches: level, code, message and context as JSON."""
    code, value = F.col("code"), F.col("value")
    two = lambda c: F.format_string("%.2f", c)
    message = (
        F.when(code == "MAX_DRAWDOWN_PCT", F.concat(F.lit("Drawdown "), two(value), F.lit(f"% >= limite {limits.max_drawdown_pct:.2f}%")))
        .when(code == "DAILY_LOSS_LIMIT", F.concat(F.lit("Perda diaria "), two(value), F.lit(f" <= -{abs(limits.daily_loss_limit):.2f}")))
        .otherwise(F.concat(F.lit("Sequencia de perdas "), value.cast("long").cast("string"), F.lit(f" >= limite {limits.max_consecutive_losses}")))
    )
    context = (
        F.when(code == "MAX_DRAWDOWN_PCT", F.to_json(F.struct(value.alias("drawdown_pct"))))
        .when(code == "DAILY_LOSS_LIMIT", F.to_json(F.struct(value.alias("day_pnl"))))
        .otherwise(F.to_json(F.struct(value.cast("long").alias("consecutive_losses"))))
    )
    others = [c for c in breaches.columns if c not in ("code", "value")]
    return breaches.select(*others, F.lit("high").alias("level"), "code", message.alias("message"), context.alias("context_json"))


def has_high_severity(alert_rows: DataFrame) -> DataFrame:
    """One row telling whether a high-level alert exists."""
    return alert_rows.agg(F.coalesce(F.bool_or(F.col("level") == "high"), F.lit(False)).alias("has_high"))


OPEN_MARK, TRADE_CLOSE, CLOSE_MARK = 0, 1, 2


def risk_events(trades: DataFrame, equity: DataFrame, indexed: DataFrame, base: ExecutionSettings, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Events of a run in replay order: mark at each bar open, closes, mark at each bar close.

    ``seq`` is phase-ordered inside a bar; the open mark values positions held into the bar at its open.
    """
    keys, group = list(keys), list(group)
    side = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    scale = F.lit(base.point_value * base.contracts)
    block = F.floor(F.col("bar_idx") / 4096).cast("long")
    timed = running(equity, group, ["bar_idx"], block, [Run("_cash0", "prev", F.col("cash"))])
    held = held_bars(trades, group, F.col("entry_idx") + 1, F.col("exit_idx"), "entry_price", side.alias("_side"))
    opens = indexed.select(*keys, "bar_idx", "open")
    floating = held.join(opens, [*keys, "bar_idx"]).groupBy(*group, "bar_idx").agg(
        F.sum((F.col("open") - F.col("entry_price")) * F.col("_side") * scale).alias("_float"))
    start = F.coalesce("_cash0", F.lit(base.initial_capital))
    marks = timed.join(floating, [*group, "bar_idx"], "left")
    none = F.lit(None).cast("double")
    row = lambda df, phase, kind, value, pnl: df.select(
        *group, F.col("datetime").alias("ts"), (F.col("bar_idx") * 3 + phase).alias("seq"), "bar_idx", F.lit(phase).alias("phase"),
        F.lit(kind).alias("kind"), value.alias("equity"), pnl.alias("pnl_net"),
    )
    closes = trades.select(*group, F.col("exit_idx").alias("bar_idx"), "pnl_net").join(equity.select(*group, "bar_idx", "datetime", "cash"), [*group, "bar_idx"])
    return (
        row(marks, OPEN_MARK, "mark", start + F.coalesce("_float", F.lit(0.0)), none)
        .unionByName(row(closes, TRADE_CLOSE, "close", F.col("cash"), F.col("pnl_net")))
        .unionByName(row(timed, CLOSE_MARK, "mark", F.col("equity"), none))
    )


def cut_trades(priced: DataFrame, halts: DataFrame, indexed: DataFrame, base: ExecutionSettings, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Trades of a run after its risk halt: no new entries, the open position leaves at the halting mark.

    ``priced`` are admitted candidates (before :func:`tidebar.operators.trades.trade_columns`), ``halts`` has
    ``bar_idx`` and ``phase`` per group.
    """
    keys, group = list(keys), list(group)
    bars = indexed.select(
        *keys, F.col("bar_idx").alias("_hb"), F.col("datetime").alias("_ht"), F.col("open").alias("_ho"), F.col("close").alias("_hc"), candle_range().alias("_hr")
    )
    marks = halts.select(*group, F.col("bar_idx").alias("_hb"), F.col("phase").alias("_hp")).join(bars, [*keys, "_hb"])
    joined = priced.join(marks, group, "left")
    at_open, at_close = F.col("_hp") == OPEN_MARK, F.col("_hp") == CLOSE_MARK
    by_close = F.lit(base.entry_mode == "close_slippage")
    late = F.when(at_open, F.col("entry_idx") >= F.col("_hb")).when(at_close, F.col("entry_idx") > F.col("_hb")).otherwise(
        F.when(by_close, F.col("entry_idx") >= F.col("_hb")).otherwise(F.col("entry_idx") > F.col("_hb"))
    )
    kept = joined.where(F.col("_hb").isNull() | ~late)
    cut = F.when(at_open, F.col("_hb") <= F.col("exit_idx")).when(at_close, F.col("_hb") < F.col("exit_idx")).otherwise(F.lit(False))
    # the final close of the data comes after the last bar's mark
    cut = cut | (at_close & (F.col("_hb") == F.col("exit_idx")) & (F.col("exit_reason") == "end_of_data"))
    cut = F.coalesce(cut, F.lit(False))
    swap = lambda new, old: F.when(cut, new).otherwise(F.col(old))
    moved = kept.withColumns(
        {
            "exit_idx": swap(F.col("_hb"), "exit_idx"), "exit_time": swap(F.col("_ht"), "exit_time"), "exit_range": swap(F.col("_hr"), "exit_range"),
            "raw_exit": swap(F.when(at_open, F.col("_ho")).otherwise(F.col("_hc")), "raw_exit"),
            "exit_reason": swap(F.when(at_open, "risk_halt").otherwise("risk_halt_close"), "exit_reason"),
        }
    ).drop("_hb", "_hp", "_ht", "_ho", "_hc", "_hr")
    return price_exits(moved, base)
