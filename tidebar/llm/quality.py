"""Quality classifier: a sparse rule ensemble.

Boosted trees over text statistics are grown on a bounded sample of labelled documents. Every path from a root to a node is a
conjunctive rule. A logistic model with a lasso penalty is fitted over the rules; the rules whose weight is not zero are
compiled into Spark column expressions, so that scoring a document needs no model object and no Python.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm import trees
from tidebar.llm.common import besides, let, text_of, words_of, wrapped
from tidebar.session import materialize

TRAIN_ROWS = 8_000        # labelled documents that the rules are learned from, at most
TREES, DEPTH, LASSO = 12, 3, 0.002
CUT = 0.3

STATISTICS = ("words", "word_length", "distinct_share", "symbol_share", "upper_share", "digit_share", "exclaim_share", "pipe_share", "comma_share", "stop_share", "line_repeat", "line_words")


def statistics(text: Column) -> list[Column]:
    """Statistics of a text without nulls, as named columns; all are 0 for a text without words."""
    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / F.greatest(F.length(text), F.lit(1))

    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    n = F.greatest(F.col("_w.n"), F.lit(1))
    values = (F.col("_w.n"), F.length(text) / n, F.col("_w.d") / n, share("#*$%&<>"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("!?"), share("|"), share(","), share("."),
              1 - F.col("_l.d") / F.greatest(F.col("_l.n"), F.lit(1)), F.col("_w.n") / F.greatest(F.col("_l.n"), F.lit(1)))
    return [counts.alias("_w"), by_line.alias("_l")], [v.cast("double").alias(name) for name, v in zip(STATISTICS, values)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds one double column ``_s_<name>`` per statistic."""
    counted, values = statistics(text_of())
    wide = docs.select("*", *counted)
    return wide.select(*docs.columns, *[v.alias(f"_s_{n}") for n, v in zip(STATISTICS, values)])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, trees_grown: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> tuple[float, list[tuple]]:
    """(intercept, [(weight, rule)]) learned from at most ``rows`` labelled documents, those of smallest id digest.

    Documents without a label, or whose labels disagree, are not used. With one class only, the rule list is empty and the
    intercept says which.
    """
    agreed = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("double").alias("label"))
    chosen = agreed.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` short rows
    sample = with_statistics(texts).select("doc_id", "label", *[f"_s_{n}" for n in STATISTICS])
    sample = materialize(materialize(sample).dropDuplicates(["doc_id"]).coalesce(1).sortWithinPartitions("doc_id"))
    share = sample.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return (0.0 if share is None else 4.0 if share else -4.0), []
    gathered = VectorAssembler(inputCols=[f"_s_{n}" for n in STATISTICS], outputCol="features").transform(sample).cache()
    grown = GBTClassifier(maxIter=trees_grown, maxDepth=depth, stepSize=0.3, subsamplingRate=0.8, seed=seed, maxMemoryInMB=64).fit(gathered)
    rules = sorted({trees.simplified(r) for t in trees.parsed(grown.toDebugString) for r in trees.rules_of(t)})
    features = [F.col(f"_s_{n}") for n in STATISTICS]
    binary = sample.select("label", *[trees.holds(r, features).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    inputs = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(binary).select("label", "rules").cache()
    fitted = LogisticRegression(featuresCol="rules", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(inputs)
    gathered.unpersist()
    inputs.unpersist()
    return float(fitted.intercept), [(float(w), r) for w, r in zip(fitted.coefficients.toArray(), rules) if w]


def score_column(model: tuple[float, list[tuple]]) -> Column:
    """Probability of good quality as an expression over the ``_s_`` columns."""
    intercept, rules = model
    features = [F.col(f"_s_{n}") for n in STATISTICS]
    total = F.lit(intercept)
    for weight, rule in rules:
        total = total + F.when(trees.holds(rule, features), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out() -> Column:
    """Fold of documents that labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """_document (a struct of all columns of ``docs``), doc_id, held_out, score, predicted: one row per row of ``docs``."""
    model = fit(docs, labels.where(~held_out()))
    wide = with_statistics(wrapped(docs))
    out = wide.select("_document", "doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` with held_out, score and predicted, which replace columns of these names.

    Null and empty texts get the score of a text without words. Rows that repeat an id get the score of their own text.
    """
    made = ("held_out", "score", "predicted")
    return judged(docs, labels, cut).select(*besides(docs, *made), *made)
