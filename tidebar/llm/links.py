"""Connected groups of similar items found through shared buckets, without writing out all pairs of a bucket.

First each bucket compares its members with two members only, its hubs, which costs two pairs per posting however large
the bucket is. One is that of lowest rank; the other is drawn for each bucket, so that many near copies that are not all near
to one of them meet several others, as they share several buckets. The links found are closed to components. A bucket whose
members then share one component is done. In the others, members outside the first hub's component are compared with members
of other components; the cheap test runs inside the join, on a few numbers, and what passes is tested on the whole items once,
however many buckets its two items share. So every pair of a bucket is either tested or already connected, and no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.session import materialize

Near = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id that can be reached.

    Alternates two steps until nothing changes: larger neighbours are hung on the smallest neighbour, then each
    id and its smaller neighbours are hung on the smallest of them. A round is an aggregation by minimum, which
    combines before the shuffle, and a join that can be split, so a hub with many neighbours is no hot task.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")
    seen = edges.agg(*mark).first()
    while seen[1]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        edges = materialize(small.where("u <> v").distinct())
        now = edges.agg(*mark).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def linked(items: DataFrame, postings: DataFrame, light: list[str], cheap: Near, likely: Near | None, near: Near | None, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tested links (a, b) of items that share a bucket, enough for all components.

    ``items``: id, rank, the columns ``light`` and what ``likely`` and ``near`` read. ``postings``: bucket, id, of buckets with several
    members. ``cheap(a, b)``: necessary test on id and ``light``, which must be few and narrow: only they are dealt to the buckets,
    where pairs are many. ``likely`` (pairs with a hub) and ``near`` (others) test the pairs that pass on whole items. ``verify``: keeps
    the true links of pairs (a, b). The first hub of a bucket is its member of lowest rank, the second has the smallest hash with the bucket.
    """
    at = lambda side: lambda name: F.col(f"{side}.{name}")
    told = items.select("id", "rank", *light)
    row = F.struct("id", *light)
    ordered, dealt_out = (Window.partitionBy("bucket").orderBy(*order) for order in (("rank", "id"), (F.xxhash64("bucket", "id"), F.col("id"))))

    def verified(pairs: DataFrame, test: Near | None) -> DataFrame:
        found = materialize(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
        if test is not None:
            held = found.alias("p").join(items.alias("x"), F.col("p.a") == F.col("x.id")).join(items.alias("y"), F.col("p.b") == F.col("y.id"))
            found = materialize(held.where(test(at("x"), at("y"))).select("p.a", "p.b"))
        return materialize(verify(found))

    hubs = [F.first(row).over(order).alias(name) for order, name in ((ordered, "p"), (dealt_out, "q"))]
    met = postings.join(told, "id").select(row.alias("x"), *hubs).select("x", F.explode(F.array("p", "q")).alias("y")).where("x.id <> y.id")
    first = verified(met.where(cheap(at("x"), at("y"))), likely)
    groups = components(first)

    placed = materialize(told.join(groups, "id", "left").select(*told.columns, F.coalesce("component", "id").alias("component")))
    dealt = postings.join(placed, "id").withColumns({"hub": F.first("id").over(ordered), "central": F.first("component").over(ordered)})
    outside = F.col("component") != F.col("central")
    some = dealt.withColumn("open", F.max(outside).over(Window.partitionBy("bucket"))).where("open and id <> hub")
    crossing = (some.where(outside).alias("x").join(some.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
                & ((F.col("y.component") == F.col("y.central")) | (F.col("x.id") < F.col("y.id"))) & cheap(at("x"), at("y"))))
    return first.union(verified(crossing, near))


@contextmanager
def parts_suffice(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside take rows that are partitioned by some of their keys as they are, without another shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def linked_by_parts(items: DataFrame, starts: Column, seconds: Column, near: Near, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As :func:`linked`, for buckets that are many and small. A bucket is a (part, second).

    ``items``: id and fixed-width columns that ``near`` reads. ``starts``: the parts of an item, an array of structs with the
    field part. ``seconds``: an array of what makes buckets of a part, from the columns of items and the fields of the struct.
    Rows are shuffled once per part and spread into their buckets after it, where sorting and windows do the rest: an item
    with 28 buckets in 7 parts moves 7 times. The hub of a bucket is its smallest id. Members outside the component of the
    hub are compared with all members of other components.
    """
    at = lambda side: lambda name: F.col(f"{side}.{name}")
    bucket = ("part", "second")
    ordered = Window.partitionBy(*bucket).orderBy("id")

    def spread(rows: DataFrame) -> DataFrame:
        kept = rows.columns
        return rows.select(F.explode(starts).alias("_start"), *kept).select("_start.*", *kept).repartition("part").select("part", F.explode(seconds).alias("second"), *kept)

    hub = F.first(F.struct(*items.columns)).over(ordered)
    met = spread(items).select(F.struct(*items.columns).alias("x"), hub.alias("y")).where(F.col("x.id") != F.col("y.id"))
    tested = materialize(met.where(near(at("x"), at("y"))).select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct())
    first = materialize(verify(tested))
    groups = materialize(components(first))

    placed = materialize(items.join(groups, "id", "left").select(*items.columns, F.coalesce("component", "id").alias("component")))
    central = spread(placed).withColumn("central", F.first("component").over(ordered))
    outside = F.col("component") != F.col("central")
    some = central.withColumn("open", F.max(outside).over(Window.partitionBy(*bucket))).where("open")
    crossing = (some.where(outside).alias("x").join(some.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.second") == F.col("y.second"))
                & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.central")) | (F.col("x.id") < F.col("y.id")))
                & near(at("x"), at("y"))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    with parts_suffice(items.sparkSession):
        found = materialize(crossing.join(tested, ["a", "b"], "left_anti"))
    return first.union(materialize(verify(found)))
