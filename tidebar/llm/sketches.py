"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash that lies in the lowest ``1 / scale`` of the hash range, and the smallest hash in any
case. Sketches of parts merge by union, and the share of the smaller sketch that the other one has estimates containment
also between texts of very different length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import hashed_shingles, let, text_of, word_hashes, words_of

SCALE = 4
SHINGLE = 5
LOWEST = -(2**63)
BLOCK_BITS, SUPER_BITS = 6, 12


def sketch_of(text: Column, scale: int = SCALE, size: int = SHINGLE) -> Column:
    """Sorted kept hashes of a text without nulls; a text without words has the empty sketch."""
    limit = LOWEST + 2**64 // scale
    shingles = let(word_hashes(words_of(text)), lambda h: hashed_shingles(h, size))
    return let(shingles, lambda s: F.array_sort(F.array_union(F.filter(s, lambda x: x < F.lit(limit)), F.filter(F.array(F.array_min(s)), lambda x: x.isNotNull()))))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of what two sketches cover together."""
    limit = LOWEST + 2**64 // scale
    both = lambda s: F.array_sort(F.filter(s, lambda x: (x < F.lit(limit)) | (x == F.array_min(s))))
    return let(F.array_union(a, b), both)


def written(sketch: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(F.shiftrightunsigned(x.bitwiseXOR(F.lit(LOWEST)), 8)))), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other has; two empty sketches are alike, an empty and another are not."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / least)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch and next_text, next_sketch of the next row by descending doc_id; after the last, the first.

    Rows are dealt out in blocks of 64 ids. A window gives the next row inside a block; only the first texts of blocks move
    to the block above. Null ids come last; rows of one id are ordered by a hash of the text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    block = F.shiftright(key, BLOCK_BITS)
    base = docs.select("doc_id", text_of().alias("text")).withColumn("_k", key).withColumn("_h", F.xxhash64("text")).withColumn("_b", block)
    heads = base.groupBy("_b").agg(F.max_by("text", F.struct("_k", F.bitwise_not("_h"))).alias("head"))
    blocks = base.select("_b").distinct().withColumn("_s", F.shiftright("_b", SUPER_BITS))
    supers = blocks.groupBy("_s").agg(F.max("_b").alias("top"))
    around = Window.partitionBy()
    below = Window.orderBy(F.col("_s").desc())
    supers = supers.select("_s", F.coalesce(F.lead("top").over(below), F.max("top").over(around)).alias("lower"))
    follow = Window.partitionBy("_s").orderBy(F.col("_b").desc())
    order = blocks.withColumn("_n", F.lead("_b").over(follow)).join(supers, "_s").select("_b", F.coalesce("_n", "lower").alias("_n"))
    next_heads = order.join(heads.select(F.col("_b").alias("_n"), "head"), "_n").select("_b", "head")
    inside = Window.partitionBy("_b").orderBy(F.col("_k").desc(), "_h")
    rows = base.withColumn("sketch", sketch_of(F.col("text"))).select(
        "doc_id", "text", "sketch", "_b", F.lead("text").over(inside).alias("_t"), F.lead("sketch").over(inside).alias("_sk"))
    joined = rows.join(next_heads, "_b", "left")
    return joined.select("doc_id", "text", "sketch", F.coalesce("_t", "head").alias("next_text"), F.coalesce("_sk", F.when(F.col("_t").isNull(), sketch_of(F.col("head")))).alias("next_sketch"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row.

    The edited text is the text with its last half (rounded down) replaced by as much of the next document's start. Null text
    is empty: empty fingerprint, alike to other empty texts only. With one row the next document is itself.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    sketched = edited.withColumn("edited_sketch", sketch_of(F.col("edited")))
    return sketched.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
                           containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
