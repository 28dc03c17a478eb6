"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.session import materialize

# Words are runs of anything but the six ASCII white space characters.
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns of a row as the struct ``_document``, so that no working column can clash with one."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"))


def besides(docs: DataFrame, *made: str) -> list[Column]:
    """The columns of ``_document`` but for those that have the name of one in ``made``, which replace them."""
    names = {c.lower() for c in made}
    return [F.col(f"_document.`{c}`") for c in docs.columns if c.lower() not in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls."""
    return F.array_remove(F.split(text, SPACES), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_shingles(hashes: Column, size: int) -> Column:
    """One 64-bit hash for each ``size``-word shingle of an array of word hashes.

    Fewer words: the whole sequence is the only shingle. No word: no shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - F.lit(size - 1), F.lit(1)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, size))))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


FILTER_WORDS = 65_536     # longs of a bitmap, half a MB whatever the number of keys


def thinned(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a 64-bit hash or id) may be in ``wanted`` (one column ``key``)."""
    return sieved(df, key, wanted)[0]


def sieved(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be in ``wanted``, and those whose key is not.

    Only a filter before a join: the first part has every row that the join finds and, while the keys are few, hardly any
    other, so that large texts are not shuffled in vain. The bitmap has a fixed size.
    """
    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(FILTER_WORDS)).cast("int")

    def flag(k: Column) -> Column:
        return F.element_at(F.array(*[F.lit(-2**63 if i == 63 else 1 << i).cast("long") for i in range(64)]), F.pmod(F.shiftright(F.xxhash64(k), 20), F.lit(64)).cast("int") + 1)

    marks = wanted.groupBy(slot(F.col("key")).alias("i")).agg(F.bit_or(flag(F.col("key"))).alias("m"))
    filled = df.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("i")).join(marks, "i", "left").select("i", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    bits = materialize(filled.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("r")).select(F.transform("r", lambda r: r["m"]).alias("bits"))).scalar()
    marked = df.withColumn("_key", key).withColumn("_bits", bits)
    maybe = F.element_at("_bits", slot(F.col("_key")) + 1).bitwiseAND(flag(F.col("_key"))) != 0
    return marked.where(maybe).drop("_key", "_bits"), marked.where(~maybe).drop("_key", "_bits")
