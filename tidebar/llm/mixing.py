"""Mix sources to target weights by systematic sampling.

A document of source s is expected ``rate(s) = target(s) / size(s)`` times. Documents of a source are put in a
fixed order, their expected copies are summed up, one offset drawn from the source's name is added, and a document
is taken once for each whole number that its stretch of the running sum crosses. The order is by size class, then
by digest of the id, so that each class is sampled evenly and the words taken come near the target.

Order statistics are never computed over a whole source in one task: a rank is the number of documents in earlier
classes, plus those in earlier digest blocks of the class, plus the row number inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import text_of, words_of, wrapped

BLOCK_DIGITS = 3      # hexadecimal digits of the digest that name a block: 4,096 blocks a class
CLASSES_PER_DOUBLING = 4


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources. ``sizes``: source, source_size, one row per source, so one task holds all rows.

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is dealt by weight; a source
    stops at ``most`` times its size and the others share what is over. With the sources ordered by cap per
    weight, those before the first one whose cap exceeds its share of what is left are the capped ones.
    """
    whole, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    rows = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
            .withColumn("cap", F.col("source_size") * F.lit(float(most))))
    filled = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"))


def offset_of(source: Column) -> Column:
    """Offset in [0, 1) of a source, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce(source, F.lit("\x00null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Columns doc_id, digest, source, size, source_size, target, copies: one row per row of ``docs``.

    Null text has size 0; null source is a source of its own. Rows that repeat an id and text are separate rows.
    A source without words has target 0 and takes nothing. An empty table gives no rows.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")))
    base = docs.select("doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"), key.alias("digest"))
    base = base.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * CLASSES_PER_DOUBLING).cast("int")).withColumn("block", F.substring("digest", 1, BLOCK_DIGITS))
    group = ["source", "class", "block"]
    counts = base.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    in_class = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source", "class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    by_class = classes.withColumn("earlier", F.sum("n").over(Window.partitionBy("source").orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = (in_class.alias("b").join(by_class.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.class") == F.col("c.class")))
              .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
              .select("b.source", "b.class", "b.block", "t.source_size", "t.target", (F.coalesce("b.before", F.lit(0)) + F.coalesce("c.earlier", F.lit(0))).alias("start")))
    ranked = base.withColumn("row", F.row_number().over(Window.partitionBy(*group).orderBy("digest", "doc_id", "size")))
    joined = (ranked.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.class") == F.col("s.class")) & (F.col("d.block") == F.col("s.block")))
              .select("d.doc_id", "d.digest", "d.source", "d.size", "s.source_size", "s.target", (F.col("s.start") + F.col("d.row")).alias("rank")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = offset_of(F.col("source"))
    crossed = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    copies = F.least(crossed.cast("long"), F.ceil(rate).cast("long"))
    return joined.select("doc_id", "digest", "source", "size", "source_size", "target", F.col("rank"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    taken = mix(docs, **settings).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # Rows that repeat an id share the copies of that id, the first rows taking one more where they do not divide.
    numbered = wrapped(docs).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("row") <= F.col("copies") % F.col("rows")).cast("int")
    joined = numbered.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    repeated = joined.where("copies > 0").select("_document", own.cast("int").alias("n")).where("n > 0")
    return repeated.select("_document", F.explode(F.sequence(F.lit(1), F.col("n")))).select("_document.*")
