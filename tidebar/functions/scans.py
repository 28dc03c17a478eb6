"""Ordered computations that do not put one whole series into one task.

``Window.partitionBy(symbol).orderBy(time)`` sends every row of a symbol to one task, which fails when a
symbol holds a third of the data. The helpers here split a series into blocks, work inside blocks, combine
one summary row per block, and hand each block the state that precedes it:

* :func:`running`      sum / xor / count / max / min / last / previous row / first row, unbounded frame
* :func:`with_halo`    rows near a block border are copied to the neighbour, for frames of known length
* :func:`series_scan`  y[t] = a * y[t-1] + b[t], the core of exponential and Wilder averages
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import SECONDS_PER_DAY, epoch_seconds

SCAN_RUN = 256        # rows per scaled cumulative sum: a**-256 stays finite for a >= 0.065
SCAN_GROUP = 4096     # items of a level that are one item of the level above
SCAN_LEVELS = 1       # levels above the runs, before the last one, which has one item per million rows; each costs a shuffle
BLOCK_ROWS = 4096     # rows per block on an indexed series


def time_block(ts: Column, seconds: int = SECONDS_PER_DAY) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("long")


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` over ``value`` up to and including the current row.

    kind: sum, xor (of longs), count, max, min, last (latest non-null), prev (value of the previous row, null kept),
    first (value of the first row).
    """

    out: str
    kind: str
    value: Column | None = None
    default: float | None = None


def _shared(rows: DataFrame, parts: Sequence[str]) -> tuple[DataFrame, Column]:
    """Shuffle once by ``parts`` for two readers.

    A scan reads its rows twice, for the block summaries and for the result. Spark reuses one shuffle for
    both readers when they need the same columns, so the summary also touches every column through the
    returned aggregate (filter the summary on it being non-null).
    """
    present = F.lit(True)
    for c in parts:
        present = present & F.col(c).isNotNull()
    placed = rows.where(present).repartition(*parts)
    hashable = [f.name for f in placed.schema.fields if "map<" not in f.dataType.simpleString()]
    return placed, F.max(F.xxhash64(*hashable)).alias("_touch")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    runs: Sequence[Run],
) -> DataFrame:
    """Unbounded running aggregates in two levels. ``block`` must not decrease along ``order``.

    Rows without a block form the last block of their series. Rows without a key belong to no series and are dropped.
    """
    keys = list(keys)
    rows = df.withColumn("_blk", F.coalesce(block.cast("long"), F.lit(2**63 - 1)))
    for i, run in enumerate(runs):
        if run.value is not None:
            rows = rows.withColumn(f"_v{i}", F.struct(run.value.alias("x")) if run.kind in ("prev", "first") else run.value)
    ordering = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    rows, touch = _shared(rows, [*keys, "_blk"])

    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals, carries, local, outs = [], [], [], []
    for i, run in enumerate(runs):
        v, t, l, c = F.col(f"_v{i}"), F.col(f"_t{i}"), F.col(f"_l{i}"), F.col(f"_c{i}")
        if run.kind == "sum":
            parts = F.sum(v), F.sum(t), F.sum(v).over(upto)
            value = F.when(l.isNull(), c).when(c.isNull(), l).otherwise(l + c)
        elif run.kind == "xor":
            parts = F.bit_xor(v), F.bit_xor(t), F.bit_xor(v).over(upto)
            value = F.coalesce(l.bitwiseXOR(c), l, c)
        elif run.kind == "count":
            parts = F.count(F.lit(1)), F.sum(t), F.row_number().over(inside).cast("long")
            value = l + F.coalesce(c, F.lit(0))
        elif run.kind == "max":
            parts = F.max(v), F.max(t), F.max(v).over(upto)
            value = F.greatest(l, c)
        elif run.kind == "min":
            parts = F.min(v), F.min(t), F.min(v).over(upto)
            value = F.least(l, c)
        elif run.kind == "last":
            parts = F.max_by(v, F.when(v.isNotNull(), ordering)), F.last(t, ignorenulls=True), F.last(v, ignorenulls=True).over(upto)
            value = F.coalesce(l, c)
        elif run.kind == "prev":
            parts = F.max_by(v, ordering), F.last(t), F.lag(v, 1).over(inside)
            value = F.coalesce(l, c)["x"]
        elif run.kind == "first":
            parts = F.min_by(v, ordering), F.first(t), F.first(v).over(upto)
            value = F.coalesce(c, l)["x"]
        else:
            raise ValueError(run.kind)
        totals.append(parts[0].alias(f"_t{i}"))
        carries.append(parts[1].over(before).alias(f"_c{i}"))
        local.append(parts[2].alias(f"_l{i}"))
        if run.default is not None:
            value = F.coalesce(value, F.lit(run.default))
        outs.append(value.alias(run.out))

    summary = rows.groupBy(*keys, "_blk").agg(*totals, touch).where(F.col("_touch").isNotNull())
    carry = summary.select(*keys, "_blk", *carries)
    return rows.select("*", *local).join(carry, [*keys, "_blk"]).select(*df.columns, *outs)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "bar_idx"
) -> DataFrame:
    """0-based position of each row in its series."""
    numbered = running(df, keys, order, block, [Run("_n", "count")])
    return numbered.select(*df.columns, (F.col("_n") - 1).alias(out))


def with_halo(df: DataFrame, idx: str, back: int, ahead: int = 0, block_rows: int | None = None) -> DataFrame:
    """Assign rows to index blocks and copy border rows to the neighbouring block.

    Adds ``_chunk`` (block the copy belongs to). Keep the rows of a block with :func:`drop_halo` after the
    windows over ``(keys, _chunk)`` are done. ``back`` and ``ahead`` may not exceed the block length.
    """
    size = max(block_rows or BLOCK_ROWS, back, ahead)
    home = F.floor(F.col(idx) / F.lit(size)).cast("long")
    offset = F.pmod(F.col(idx), F.lit(size))
    copies = [home]
    if back:
        copies.append(F.when(offset >= size - back, home + 1))
    if ahead:
        copies.append(F.when((offset < ahead) & (home > 0), home - 1))
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


@dataclass(frozen=True)
class Affine:
    """y[t] = a * y[t-1] + b[t] with y[-1] = 0; ``a`` is a constant in [0, 1)."""

    out: str
    a: float
    b: Column


@dataclass(frozen=True)
class Latest:
    """Latest non-null value up to and including the current row."""

    out: str
    value: Column


def series_scan(
    df: DataFrame, keys: Sequence[str], idx: str, scans: Sequence[Affine], latest: Sequence[Latest] = ()
) -> DataFrame:
    """Linear recurrences (and latest values) by an associative scan tree over an indexed series.

    Runs of 256 rows use a scaled cumulative sum, a plain window aggregate. Run summaries are composed 4,096 at a
    time, level by level, and the states come back down the same way.
    """
    keys = list(keys)
    n = len(scans)
    rows = df.withColumn("_run", F.floor(F.col(idx) / F.lit(SCAN_RUN)).cast("long"))
    rows = rows.withColumn("_k", F.pmod(F.col(idx), F.lit(SCAN_RUN)).cast("int"))
    rows = rows.withColumns({f"_b{i}": s.b.cast("double") for i, s in enumerate(scans)})
    rows = rows.withColumns({f"_v{j}": x.value for j, x in enumerate(latest)})
    rows, touch = _shared(rows, [*keys, "_run"])
    inside = Window.partitionBy(*keys, "_run").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("_k").cast("double")
    local = []
    for i, s in enumerate(scans):
        if s.a and s.a ** -SCAN_RUN > 1e300:
            raise ValueError(f"factor {s.a} is too small for runs of {SCAN_RUN} rows")
        scaled = F.sum(F.col(f"_b{i}") * F.pow(F.lit(s.a), -k)).over(inside) * F.pow(F.lit(s.a), k)
        local.append((scaled if s.a else F.col(f"_b{i}")).alias(f"_y{i}"))
    for j, _ in enumerate(latest):
        local.append(F.last(f"_v{j}", ignorenulls=True).over(inside).alias(f"_l{j}"))
    done = rows.select("*", *local)

    # End value of a run started from zero: weighted sum of its inputs, no window needed.
    top = F.max("_k").alias("_len")
    sums = [F.sum(F.col(f"_b{i}") * (F.pow(F.lit(s.a), -k) if s.a else F.when(F.col("_k") >= 0, 1.0))).alias(f"_s{i}")
            for i, s in enumerate(scans)]
    last_in = [F.max_by(F.col(f"_b{i}"), F.col("_k")).alias(f"_e{i}") for i, s in enumerate(scans) if not s.a]
    seen = [F.max_by(F.col(f"_v{j}"), F.when(F.col(f"_v{j}").isNotNull(), F.col("_k"))).alias(f"_t{j}") for j, _ in enumerate(latest)]
    runs = rows.groupBy(*keys, "_run").agg(top, *sums, *last_in, *seen, touch).where(F.col("_touch").isNotNull())
    power = F.col("_len").cast("double")
    ends = [F.col(f"_s{i}") * F.pow(F.lit(s.a), power) if s.a else F.col(f"_e{i}") for i, s in enumerate(scans)]
    runs = runs.select(
        *keys, "_run",
        F.array(*[F.pow(F.lit(s.a), power + 1.0) for s in scans]).cast("array<double>").alias("_fac"),
        F.array(*ends).cast("array<double>").alias("_end"),
        F.struct(F.lit(True).alias("x"), *[F.col(f"_t{j}").alias(f"c{j}") for j, _ in enumerate(latest)]).alias("_seen"),
    )
    entry = _entry_states(runs, keys, n, SCAN_LEVELS)
    joined = done.join(entry, [*keys, "_run"])
    outs = [
        (F.col(f"_y{i}") + F.pow(F.lit(s.a), k + 1.0) * F.col("_in")[i]).alias(s.out) if s.a else F.col(f"_y{i}").alias(s.out)
        for i, s in enumerate(scans)
    ]
    outs += [F.coalesce(F.col(f"_l{j}"), F.col("_seen")[f"c{j}"]).alias(x.out) for j, x in enumerate(latest)]
    return joined.select(*df.columns, *outs)


def _entry_states(items: DataFrame, keys: Sequence[str], n: int, levels: int) -> DataFrame:
    """State before each item, from factors ``_fac``, zero-start ends ``_end`` and latest values ``_seen`` of items ``_run``.

    An up-sweep composes SCAN_GROUP neighbouring items to one of the level above, whose own states come from the same
    step; the down-sweep hands them back to the items. The last level takes one item for SCAN_RUN * SCAN_GROUP ** levels
    rows of a series.
    """
    one, zero = F.array_repeat(F.lit(1.0), n), F.array_repeat(F.lit(0.0), n)
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    kind = items.schema["_seen"].dataType
    later = lambda a, b: F.struct(*[F.coalesce(b[c], a[c]).alias(c) for c in kind.names])
    unseen = F.lit(None).cast(kind.simpleString())
    nothing = F.array().cast(f"array<struct<_run:bigint,pf:array<double>,pv:array<double>,ps:{kind.simpleString()}>>")

    def step(acc: Column, x: Column) -> Column:
        item = F.struct(x["_run"].alias("_run"), acc["f"].alias("pf"), acc["v"].alias("pv"), acc["s"].alias("ps"))
        return F.struct(
            times(acc["f"], x["_fac"]).alias("f"), plus(times(x["_fac"], acc["v"]), x["_end"]).alias("v"),
            later(acc["s"], x["_seen"]).alias("s"), F.array_append(acc["out"], item).alias("out"),
        )

    group = F.floor(F.col("_run") / SCAN_GROUP).cast("long") if levels else F.lit(0).cast("long")
    packed = items.groupBy(*keys, group.alias("_grp")).agg(F.sort_array(F.collect_list(F.struct("_run", "_fac", "_end", "_seen"))).alias("_items"))
    start = F.struct(one.alias("f"), zero.alias("v"), unseen.alias("s"), nothing.alias("out"))
    composed = packed.select(*keys, "_grp", F.aggregate("_items", start, step).alias("_acc"))
    if not levels:
        return composed.select(*keys, F.explode("_acc.out").alias("_o")).select(*keys, F.col("_o._run").alias("_run"), F.col("_o.pv").alias("_in"), F.col("_o.ps").alias("_seen"))
    upper = composed.select(*keys, F.col("_grp").alias("_run"), F.col("_acc.f").alias("_fac"), F.col("_acc.v").alias("_end"), F.col("_acc.s").alias("_seen"))
    above = _entry_states(upper, keys, n, levels - 1).select(*keys, F.col("_run").alias("_grp"), F.col("_in").alias("_gin"), F.col("_seen").alias("_gseen"))
    below = composed.join(above, [*keys, "_grp"]).select(*keys, "_gin", "_gseen", F.explode("_acc.out").alias("_o"))
    return below.select(*keys, F.col("_o._run").alias("_run"), plus(times(F.col("_o.pf"), F.col("_gin")), F.col("_o.pv")).alias("_in"),
                        later(F.col("_gseen"), F.col("_o.ps")).alias("_seen"))
