"""Quality rules with a hashed n-gram likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are counted, one over
trusted documents and one over the whole corpus. A document's score is the sum of the log ratios of its n-grams divided
by their number; documents below the threshold go, and so do those that fail plain rules on length and repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import let, text_of, thinned, word_hashes, words_of
from tidebar.session import materialize

BUCKETS = 65_536
THRESHOLD = -0.2
WINDOW = 8


def joined(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places on; empty where there are no more than ``apart``."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(apart + 1), n), lambda x, y: F.xxhash64(x, y))


def bucket(gram: Column) -> Column:
    """Bucket of a word or a word pair, given by its hash."""
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def bytes_of(text: Column, characters: str) -> Column:
    """Number of bytes that ASCII ``characters`` take in a text."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ratios array<double>, log of trusted over corpus share per bucket, each count raised by one.

    ``trusted``: distinct doc_id of trusted documents. Counts cover every document and every trusted one; only the texts
    that may be trusted move to the join.
    """
    count = lambda rows, name: rows.select(F.explode(let(word_hashes(words_of(text_of())), lambda h: F.concat(h, joined(h, 1)))).alias("gram")).groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias(name))
    chosen = thinned(docs, F.col("doc_id"), trusted.select(F.col("doc_id").alias("key"))).join(trusted, "doc_id", "left_semi")
    counted = count(docs, "n").join(count(chosen, "t"), "bucket", "left")
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = F.array_sort(F.collect_list(F.struct("bucket", "n", "t")))  # ``buckets`` entries
    one = full.agg(rows.alias("rows"), F.sum("n").alias("all"), F.sum("t").alias("trusted"))
    ratio = lambda r: F.log((r["t"] + 1) / (F.col("trusted") + buckets)) - F.log((r["n"] + 1) / (F.col("all") + buckets))
    return materialize(one.select(F.transform("rows", ratio).alias("ratios")))


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Number of words inside windows of WINDOW words that occur twice or more in the text.

    ``pairs``: hashes of adjacent words. Those of four words are made of them, those of windows of these. A text in which no
    four words come again has no window that does.
    """
    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        again = let(placed, lambda p: F.array_sort(F.transform(
            F.filter(F.transform(p, lambda s, k: F.when(F.coalesce(s["w"] == F.get(p, k - 1)["w"], F.lit(False)) | F.coalesce(s["w"] == F.get(p, k + 1)["w"], F.lit(False)), s["i"])), lambda i: i.isNotNull()), lambda i: i)))
        return let(again, lambda a: F.aggregate(
            F.transform(a, lambda i, k: F.least(F.coalesce(F.get(a, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x))

    once = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    windows = lambda fours: let(joined(fours, 4), lambda w: F.when(once(w), F.lit(0)).otherwise(covered(w)))
    repeats = let(joined(pairs, 2), lambda fours: F.when(once(fours), F.lit(0)).otherwise(windows(fours)))
    return F.when(F.size(hashes) > WINDOW, repeats).otherwise(F.lit(0)).cast("long")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept; one row per row.

    Trusted are documents that all labels call good and none toxic. Null and empty texts have no words, score 0 and fail. Without trusted documents all scores are near 0.
    """
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0 and doc_id is not null")
    trusted = materialize(agreed.select("doc_id"))
    ratios = bucket_ratios(docs.select("doc_id", "text"), trusted).scalar()
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    wide = docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id", word_hashes(words_of(text)).alias("_h"),
        (F.length(text) - bytes_of(text, " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        bytes_of(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    wide = wide.withColumn("_p", joined(F.col("_h"), 1)).withColumn("_r", ratios)
    total = F.aggregate(F.concat("_h", "_p"), F.lit(0.0), lambda s, g: s + F.element_at(F.col("_r"), bucket(g) + 1)) / F.greatest(F.size("_h") + F.size("_p"), F.lit(1))
    out = wide.select("doc_id", F.size("_h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("_h"), F.col("_p")).alias("n_repeat_words"), total.alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
