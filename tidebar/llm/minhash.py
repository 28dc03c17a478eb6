"""Near-duplicate documents by a signature-coordinate inverted join.

Each distinct shingle set gets a MinHash signature. The set is posted under its coordinate-value pairs; two sets with
similarity s collide in about s of the coordinates. A pair must collide in at least ``min_matches`` of the
``coordinates``, so of the pairs ordered by how rare they are, only the first ``coordinates - min_matches + 1`` of
each set need to be merged (prefix); the long lists behind them are skipped, and the collisions of a candidate pair are
counted in the signatures instead, which have further coordinates for that. Pairs above the match threshold are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import thinned
from tidebar.llm.links import components, linked
from tidebar.session import materialize

SHINGLE = 5
COORDINATES = 24
LOSS = 1.3e-6             # chance at most that a pair at the threshold has fewer collisions than are asked for, by either count
CHECKED = 64              # coordinates looked up in candidates, the posted ones included
SKETCH = 256              # sets up to this size are carried whole, as 32-bit hashes
PARITY = 8                # longs of the bits that are told apart by how many shingles fall on them, even or odd
BITS = ["low0", "low1", *[f"odd{i}" for i in range(PARITY)]]
WORD_CACHE = 400_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.random.default_rng(20).integers(1, 2**63, (CHECKED, 2), dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(len(ids) - size + 1, 1)
    h = np.full(n, min(len(ids), size), np.uint64)
    for k in range(min(size, len(ids))):
        h = _mix(h ^ ids[k:k + n])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest value of its hash over the set."""
    return np.array([((shingles * a + b) >> np.uint64(32)).min() for a, b in _ODD], np.uint32).view(np.int32)


def lowest_bits(sig: np.ndarray) -> list[int]:
    """The lowest bit of every coordinate as one long, and the second as another. Coordinates that are equal agree in both."""
    return [int(np.packbits(sig >> j & 1, bitorder="little").view("<i8")[0]) for j in range(2)]


def parity_bits(shingles: np.ndarray) -> list[int]:
    """Whether the number of shingles at each of 64 * PARITY places is odd. Two sets differ in as many shingles at least as in bits."""
    odd = np.bincount((shingles >> np.uint64(64 - (64 * PARITY).bit_length() + 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _signed(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures, sketches, bits = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                raw = xxhash.xxh3_128_digest(s.tobytes())
                digests.append(raw.hex() if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
                bits.append([*lowest_bits(signatures[-1]), *parity_bits(s)] if len(s) else [None] * len(BITS))
                sketches.append((s >> np.uint64(32)).astype(np.uint32).view(np.int32) if 0 < len(s) <= SKETCH else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(signatures, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int32())),
                                              *[pa.array([b[j] for b in bits], pa.int64()) for j in range(len(BITS))]], ["doc_id", "n_shingles", "digest", "signature", "sketch", *BITS])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, digest string, signature array<int>, sketch array<int>, " + ", ".join(f"{b} long" for b in BITS))


def _full_sets(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(work, "id long, shingles array<long>")


def fewest(coordinates: int, percent: int, loss: float = LOSS) -> int:
    """Collisions that a pair at ``percent`` has in so many coordinates but for a chance of ``loss``; one at least."""
    p, m, below = percent / 100, 0, 0.0
    while m < coordinates and (below := below + math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)) <= loss:
        m += 1
    return max(m, 1)


def near_duplicates(docs: DataFrame, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(documents, links). documents: doc_id, n_shingles, component_id, kept; one row per row of ``docs``.

    Documents are linked where ``100 * intersection >= percent * union`` of their shingle sets. component_id is the
    smallest doc_id that links reach. Texts that are null, empty or without words have no shingles and stand alone;
    texts of fewer than five words are one shingle. Sets that are equal form one class from the start and are
    represented by their smallest id. doc_id names a text: rows that repeat an id must repeat its text and get the same
    result. Rows whose doc_id is null come back with component_id null and kept true.
    links: (a, b) confirmed links between class representatives.
    """
    min_matches, min_checked = fewest(COORDINATES, percent), fewest(CHECKED, percent)
    signed = materialize(_signed(docs))
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps = materialize(signed.withColumnRenamed("doc_id", "id").join(classes, ["digest", "id"]).dropDuplicates(["id"]).select("id", "n_shingles", "signature", "sketch", *BITS))
    pairs = reps.select("id", F.posexplode(F.slice("signature", 1, COORDINATES)).alias("coordinate", "value")).select("id", F.xxhash64("coordinate", "value").alias("bucket"))
    common = materialize(pairs.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    listed = pairs.join(common, "bucket").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("lists"))  # 24 entries at most
    # Pairs that no other set has come first in the order and fill places of the prefix.
    prefix = F.slice("lists", F.lit(1), F.greatest(F.size("lists") - F.lit(min_matches - 1), F.lit(0)))
    open_sets = listed.select("id", F.transform(prefix, lambda x: x["bucket"]).alias("keys"), (F.lit(COORDINATES) - F.size("lists")).alias("rank")).where(F.size("keys") > 0)
    items = materialize(open_sets.join(reps, "id"))
    postings = items.select(F.explode("keys").alias("bucket"), "id")
    postings = postings.join(postings.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select("bucket", "id")

    def cheap(a, b):
        """Sizes, a count in the lowest bits that is never below that of equal coordinates, and one of odd bits that is never above that of different shingles."""
        small, large = F.least(a("n_shingles"), b("n_shingles")), F.greatest(a("n_shingles"), b("n_shingles"))
        differ = F.bit_count(a("low0").bitwiseXOR(b("low0")).bitwiseOR(a("low1").bitwiseXOR(b("low1"))))
        apart = sum((F.bit_count(a(f"odd{i}").bitwiseXOR(b(f"odd{i}"))) for i in range(1, PARITY)), F.bit_count(a("odd0").bitwiseXOR(b("odd0"))))
        return (small * 100 >= large * percent) & (differ <= CHECKED - min_checked) & (apart * (100 + percent) <= (small + large) * (100 - percent))

    def likely(a, b):
        matches = F.aggregate(F.zip_with(a("signature"), b("signature"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return matches >= min_checked

    def near(a, b):
        both = F.size(F.array_intersect(a("sketch"), b("sketch")))
        whole = both * 100 >= (a("n_shingles") + b("n_shingles") - both) * percent
        return likely(a, b) & (a("sketch").isNull() | b("sketch").isNull() | whole)

    def verify(found: DataFrame) -> DataFrame:
        ids = materialize(found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct())
        thin = thinned(docs.select("doc_id", "text"), F.col("doc_id"), ids.select(F.col("doc_id").alias("key")))
        texts = thin.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = materialize(_full_sets(texts).withColumn("n", F.size("shingles")))
        both = F.size(F.array_intersect("x.shingles", "y.shingles"))
        return (found.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.id")).join(sets.alias("y"), F.col("p.b") == F.col("y.id"))
                .where(both * 100 >= (F.col("x.n") + F.col("y.n") - both) * percent).select("p.a", "p.b"))

    links = linked(items, postings, ["n_shingles", *BITS], cheap, likely, near, verify)
    groups = components(links)
    member = signed.join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id"))
    placed = member.join(groups, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), links
