"""Toxic passages as maximum-scoring segments over token log-odds.

Counts: every word of the labelled documents is counted with its prefixes of four to eight letters, by class, in a count-min
sketch of fixed size that is merged by addition; the median slot, which is what collisions add, is taken off again. The
log-odds of a word are the posterior mean under a chain of Dirichlet (here two-class: beta) priors: the prior mean of a
word is the share among the other words of its longest prefix, whose own prior are the other words of the next shorter
one. So an unseen inflection of a toxic stem is toxic, and a clean word that begins like one is not.

Segments: log-odds less a fixed drift are scores whose mean over the corpus is negative. One scan in linear time gives all
maximal scoring segments of a text (disjoint; none can be made longer or shorter for a higher score).

Calibration: lambda solves sum p(s) exp(lambda s) = 1 over the scores of every word of the corpus. The best segment of a
clean document of n words has lambda S - ln n of Gumbel type; its location gives ln K. A segment then has the e-value
K n exp(-lambda S). The e-values of a document are summed up by the sum statistic of its r best segments, and a logistic
curve over it, the best segment and the length, fitted on labelled documents that were not counted, gives a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import thinned
from tidebar.session import materialize

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
WIDTH = 1 << 20           # slots of each of the two rows of the sketch: 16 MB in all, whatever the corpus
PRIOR = 4.0               # strength of a prior, in words
DRIFT = 1.0               # taken off each log-odds
BINS, BIN = 2_048, 1 / 64  # histogram of scores, from -16 to 16
E_VALUE = 0.05            # segments at most this often expected in a clean text count
CUT = 0.3
CACHE = 400_000           # words whose scores a task remembers
FEATURES = ("best", "total", "gain", "found", "length")
NOTHING = -10.0           # best of a text without a segment


def held_out() -> Column:
    """Fold of documents whose labels are never used."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def calibrates() -> Column:
    """Fold of labelled documents that the logistic curve and ln K are fitted on; the rest is counted."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 3


def features_of(word: str) -> list[bytes]:
    """A lower-cased word's prefixes, shortest first, and the word itself."""
    return [word[:k].encode() for k in PREFIXES if len(word) >= k] + [b"=" + word.encode()]


def slots(feature: bytes) -> tuple[int, int]:
    first = crc32(feature)
    return first & (WIDTH - 1), WIDTH + (crc32(feature, first ^ 0x5BD1E995) & (WIDTH - 1))


@dataclass(frozen=True)
class Odds:
    """Sketch of the words of either class: counts by slot, and their totals."""

    clean: np.ndarray
    toxic: np.ndarray
    n_clean: float
    n_toxic: float

    def score(self, word: str) -> float:
        """Log-odds of a lower-cased word, less the drift. 0 odds where a class has no word at all."""
        if not self.n_clean or not self.n_toxic:
            return -DRIFT
        base = share = self.n_toxic / (self.n_toxic + self.n_clean)
        seen = []
        for feature in features_of(word):
            i, j = slots(feature)
            if self.clean[j] + self.toxic[j] < self.clean[i] + self.toxic[i]:
                i = j
            seen.append((float(self.toxic[i]), float(self.clean[i])))
        for (t, c), (inner_t, inner_c) in zip(seen, seen[1:] + [(0.0, 0.0)]):
            t, c = max(t - inner_t, 0.0), max(c - inner_c, 0.0)
            share = (t + PRIOR * share) / (t + c + PRIOR)
        return math.log(share / (1 - share)) - math.log(base / (1 - base)) - DRIFT


def agreed(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of documents whose labels are not null and do not contradict each other, held-out ones left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    return known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 2 * WIDTH), np.int64)
    totals = [0, 0]
    for batch in batches:
        words = Counter(), Counter()
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words[toxic.as_py()].update(WORD.findall(text.as_py().lower()))
        for side in (0, 1):
            totals[side] += sum(words[side].values())
            for word, n in words[side].items():
                for feature in features_of(word):
                    for slot in slots(feature):
                        counts[side, slot] += n
    used = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(used), 100_000):
        part = used[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[0, part]), pa.array(counts[1, part])], ["slot", "clean", "toxic"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())], ["slot", "clean", "toxic"])


def word_odds(docs: DataFrame, labels: DataFrame) -> Odds:
    """Counts over every labelled document outside the held-out and calibrating folds. ``labels``: as :func:`agreed`."""
    counted = labels.where(~calibrates() & F.col("toxic").isin(0, 1))
    texts = thinned(docs.where("text is not null").select("doc_id", "text"), F.col("doc_id"), counted.select(F.col("doc_id").alias("key")))
    joined = texts.join(counted, "doc_id").select("text", "toxic")
    sketch = joined.mapInArrow(count_words, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = sketch.toArrow()  # at most 2 * WIDTH + 1 rows
    slot, clean, toxic = (rows.column(i).to_numpy() for i in range(3))
    filled = np.zeros((2, 2 * WIDTH + 1), np.int64)  # slot -1, the totals, is the last one
    filled[0, slot], filled[1, slot] = clean, toxic
    counts = filled[:, :-1]
    small = (counts - np.median(counts, axis=1, keepdims=True).astype(np.int64)).clip(0, 2**31 - 1).astype(np.int32)
    return Odds(small[0], small[1], float(filled[0, -1]), float(filled[1, -1]))


def maximal_segments(starts: list[int], ends: list[int], sums: list[float], befores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, from the runs of positive scores and the sums before them.

    Each candidate knows the nearest earlier one with a smaller sum before it, so that a look back jumps over those
    that can never matter again: linear in the number of runs.
    """
    first, last, low, high, link = [], [], [], [], []
    for a, b, gain, before in zip(starts, ends, sums, befores):
        after = before + gain
        k = len(low) - 1
        while True:
            while k >= 0 and low[k] >= before:
                k = link[k]
            if k < 0 or high[k] >= after:
                break
            a, before = first[k], low[k]  # the candidate and all after it are one with this run
            del first[k:], last[k:], low[k:], high[k:]
            k = link.pop(k) if len(link) == k + 1 else link[k]
            del link[len(low):]
        first.append(a), last.append(b), low.append(before), high.append(after), link.append(k)
    return [(a, b, h - l) for a, b, l, h in zip(first, last, low, high)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence as (first, behind the last, score)."""
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate(([0.0], np.cumsum(scores)))
    return maximal_segments(starts.tolist(), ends.tolist(), (total[ends] - total[starts]).tolist(), total[starts].tolist())


SEGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("raw", pa.float64())])


def scan_texts(batches: Iterator[pa.RecordBatch], odds: Odds) -> Iterator[pa.RecordBatch]:
    """Per text its words and segments, with borders in code points; a last row holds the histogram of all scores."""
    known: dict[str, float] = {}
    bins = np.zeros(BINS, np.int64)
    names = ["doc_id", "n_words", "segments", "bins"]
    for batch in batches:
        counts, found = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            words = WORD.findall(text)
            if len(known) > CACHE:
                known.clear()
            for word in set(words).difference(known):
                known[word] = odds.score(word.lower())
            scores = np.fromiter(map(known.__getitem__, words), float, len(words))
            bins += np.bincount(((scores / BIN).astype(np.int64) + BINS // 2).clip(0, BINS - 1), minlength=BINS)
            own = segments(scores)
            if own:
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                gaps = np.fromiter(map(len, WORD.split(text)), np.int64, len(words) + 1)
                ends = np.cumsum(lengths + gaps[:-1])
                own = [{"start": int(ends[a] - lengths[a]), "end": int(ends[b - 1]), "raw": s} for a, b, s in own]
            counts.append(len(words))
            found.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(SEGMENT)), pa.nulls(len(counts), pa.list_(pa.int64()))], names)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(SEGMENT)), pa.array([bins.tolist()], pa.list_(pa.int64()))], names)


def scanned(docs: DataFrame, odds: Odds) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(odds)  # 16 MB: WIDTH is fixed

    def work(batches):
        return scan_texts(batches, shared.value)

    kind = "doc_id long, n_words long, segments array<struct<start:int,end:int,raw:double>>, bins array<bigint>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, kind)


def decay(histogram: np.ndarray) -> float:
    """lambda of a histogram of scores: the positive root of sum p exp(lambda s) = 1; 1 where there is none."""
    centres = (np.arange(BINS) - BINS // 2 + 0.5) * BIN
    p = histogram / max(histogram.sum(), 1)
    if not (p * centres).sum() < 0 or not p[centres > 0].any():
        return 1.0
    low, high = 0.0, 20.0  # beyond 20 the terms overflow nothing and scores of a corpus never need it
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * centres)).sum() < 1 else (low, middle)
    return max(low, 1e-3)


def evidence(rate: float, offset: float) -> list[Column]:
    """Columns best, length, passages and summed (total, gain, found before the log), from segments and n_words.

    With e-values e1 <= e2 <= ... of the segments of a text, ``best`` is -ln e1, ``total`` the log of one plus the largest of
    ln r! - ln e1 - ... - ln er over r (the sum statistic of the r best segments), 0 where none is above 0; ``gain`` and
    ``found`` are the logs of one plus the sum and the number of the positive -ln e.
    """
    room = F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")) + F.lit(offset)
    surprise = lambda s: s["raw"] * rate - room
    falling = F.sort_array(F.transform("segments", surprise), asc=False)
    state = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "sum", "total", "gain", "found")])

    def step(a: Column, x: Column) -> Column:
        more = a["sum"] + x + F.log(a["r"] + 1)
        above = F.greatest(x, F.lit(0.0))
        return F.struct((a["r"] + 1).alias("r"), more.alias("sum"), F.greatest(a["total"], more).alias("total"),
                        (a["gain"] + above).alias("gain"), (a["found"] + F.signum(above)).alias("found"))

    summed = F.aggregate(falling, state, step)
    best = F.greatest(F.coalesce(F.get(falling, 0), F.lit(NOTHING)), F.lit(NOTHING))
    passages = F.filter(F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), F.exp(-surprise(s)).alias("e_value"))), lambda s: s["e_value"] <= E_VALUE)
    return [best.alias("best"), F.log1p(F.col("n_words").cast("double")).alias("length"), passages.alias("passages"), summed.alias("summed")]


def measured(rows: DataFrame, rate: float, offset: float) -> DataFrame:
    """Adds the columns of FEATURES and passages to rows of :func:`scanned`."""
    return rows.select("*", *evidence(rate, offset)).withColumns({c: F.log1p(f"summed.{c}") for c in ("total", "gain", "found")})


def location(clean: DataFrame, rate: float) -> float:
    """ln K from the best segments of clean texts: the likeliest location of a Gumbel law of scale 1. 0 without any."""
    best = F.array_max(F.transform("segments", lambda s: s["raw"]))
    part = clean.where(F.size("segments") > 0).select((best * rate - F.log(F.col("n_words").cast("double"))).alias("x"))
    mean = part.agg(F.avg(F.exp(-F.col("x")))).first()[0]
    return -math.log(mean) if mean else 0.0


def curve(rows: DataFrame) -> tuple[float, list[float]]:
    """Intercept and weights of the logistic curve over FEATURES; with one class only, the e-value alone decides."""
    classes = rows.groupBy("toxic").count().collect()  # two rows
    if len(classes) < 2:
        return -3.0, [1.0, 0.0, 0.0, 0.0, 0.0]
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select(F.col("toxic").cast("double").alias("label"), "features")
    fitted = LogisticRegression(regParam=0.5 / sum(r["count"] for r in classes), maxIter=50).fit(ready)
    return float(fitted.intercept), [float(w) for w in fitted.coefficients]


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, passages: one row per row of ``docs``, repeated rows included.

    ``passages``: the significant segments in order, each with start and end (code points), raw score and e_value. Null and
    empty texts have none and get the score of a text without words. Rows without an id are never learned from. Labels
    that are null, contradict each other or are neither 0 nor 1 are not used. Without labels of both classes, no word is
    toxic. Other columns of ``docs`` and ``labels`` are not read. An empty table gives no rows.
    """
    known = materialize(agreed(labels.select("doc_id", "toxic")))
    rows = materialize(scanned(docs, word_odds(docs, known)))
    texts = rows.where("bins is null")
    tally = rows.where("bins is not null").select(F.posexplode("bins").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # BINS rows
    histogram = np.zeros(BINS)
    for r in tally:
        histogram[r.i] = r.n
    rate = decay(histogram)
    fold = known.where(calibrates() & F.col("toxic").isin(0, 1))
    marked = materialize(texts.join(fold, "doc_id"))
    offset = location(marked.where("toxic = 0"), rate)
    intercept, weights = curve(measured(marked, rate, offset).select("toxic", *FEATURES))
    ready = measured(texts, rate, offset).withColumn("held_out", held_out())
    total = sum((F.col(c) * w for c, w in zip(FEATURES, weights)), F.lit(intercept))
    out = ready.select("doc_id", "held_out", (1 / (1 + F.exp(-total))).alias("score"), "n_words", "passages")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_words", "passages")
