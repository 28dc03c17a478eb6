"""Conversation prefix trie by whole-sequence collapse.

Rebuilt conversations that are equal turn by turn are one weighted sequence with a list of the conversations that end there.
Only the smallest conversation of each sequence goes on. A node of the trie is a distinct prefix, told by its depth and
a 128-bit hash (two xors of position-keyed turn hashes), so a prefix is one row of fixed width, whatever the texts. Sequences
that are proper prefixes of others are dropped by an anti-join; the rest are the leaves. Members, leaves and saved bytes
of a node are sums over the sequences that have it as a prefix, so they are aggregations that combine before the shuffle.

No step gathers the rows of one conversation, one sequence or one node: positions and prefix hashes are running
aggregates over blocks, and end lists are written in chunks of bounded length. The one thing that must run in order is
the SHA-256 of an end list: it reads its chunks as a stream, in memory that does not grow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scans import Run, running
from tidebar.session import materialize

BLOCK = 1024              # turns of a conversation that are ordered in one task
CHUNK_BITS = 12           # ids of a chunk of an end list share all but these bits
GROUP, HEADS = 5, 9       # a conversation starts with up to HEADS - 1 turns of the first of its GROUP
NODE = ("depth", "k0", "k1")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t0, t1 (hashes of role and text), bytes of every turn, in order of turn, role, text."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("t0"), F.xxhash64("text", F.lit(1), "role").alias("t1"), F.octet_length("text").cast("long").alias("bytes"), "role", "text")
    # Rows of equal turn are ordered by role and text; the hashes stand in for both, which no count depends on.
    narrow = hashed.select("conv_id", F.coalesce("turn", F.lit(-2**63)).alias("turn"), "t0", "t1", "bytes", F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("x"))
    ordered = running(narrow, ["conv_id"], ["turn", "r", "x", "t0", "t1"], F.floor(F.col("turn") / BLOCK), [Run("pos", "count")])
    return ordered.select("conv_id", "pos", "t0", "t1", "bytes")


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs: conv_id, len; rows: conv_id, pos, x0, x1, bytes): every conversation with the head of its group's first.

    ``turns``: as :func:`turn_rows`. x0 and x1 are hashes of position, role and text.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = lengths.select("conv_id", "own", head_length(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    borrowed = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "t0", "t1", "bytes")
    rest = turns.where(F.col("pos") > head_length(F.col("conv_id"))).join(convs, "conv_id")
    rows = borrowed.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t0", "t1", "bytes"))
    keyed = rows.select("conv_id", "pos", F.xxhash64("pos", "t0", "t1").alias("x0"), F.xxhash64("t1", "pos", "t0").alias("x1"), "bytes")
    return convs.select("conv_id", "len"), materialize(keyed)


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which come one after the other, joined by commas."""
    key, state, out = None, None, []

    def packed(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        for *node, chunk in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if node != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if len(out) >= 4096:
            yield packed(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield packed(out)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k0, k1, ends_sha256 of nodes where conversations end. ``ends``: node and conv_id, each id once."""
    part = F.shiftright("conv_id", CHUNK_BITS)
    chunks = ends.groupBy(*NODE, part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return ordered.mapInArrow(digest_ends, "depth long, k0 long, k1 long, ends_sha256 string")


def sequences(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seqs: seq, weight, depth, k0, k1; digests): the collapsed conversations; seq is the smallest of its equals."""
    whole = rows.groupBy("conv_id").agg(F.bit_xor("x0").alias("k0"), F.bit_xor("x1").alias("k1"))
    keyed = convs.join(whole, "conv_id", "left").select("conv_id", F.col("len").alias("depth"), *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("k0", "k1")])
    keyed = materialize(keyed)
    seqs = keyed.groupBy(*NODE).agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"))
    return materialize(seqs.select("seq", "weight", *NODE)), end_digests(keyed)


def prefixes(seqs: DataFrame, rows: DataFrame) -> DataFrame:
    """seq, weight, len, depth, k0, k1, x0, x1, bytes: every prefix of every sequence, the empty one included."""
    zero = F.lit(0).cast("long")
    turns = rows.join(seqs.select(F.col("seq").alias("conv_id"), "weight", F.col("depth").alias("len")), "conv_id")
    turns = turns.select(F.col("conv_id").alias("seq"), "weight", "len", F.col("pos").alias("depth"), "x0", "x1", "bytes")
    hashed = running(turns, ["seq"], ["depth"], F.floor(F.col("depth") / BLOCK), [Run("k0", "xor", F.col("x0")), Run("k1", "xor", F.col("x1"))])
    roots = seqs.select("seq", "weight", F.col("depth").alias("len"), *[zero.alias(c) for c in ("depth", "x0", "x1", "bytes", "k0", "k1")])
    return materialize(hashed.unionByName(roots))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is empty; a null turn comes first. Rows of equal turn are ordered by role, then text, both as far as
    their first 64 characters, then by hash, so rows that repeat are turns of their own and the order never depends on the
    layout of the table. Rows without a conv_id belong to no conversation. Negative ids group towards zero. Other columns
    are not read. An empty table has no conversation and gives no rows, not even a root.
    """
    convs, rows = rebuilt(materialize(turn_rows(conversations)))
    seqs, digests = sequences(convs, rows)
    steps = prefixes(seqs, rows)
    inner = steps.where("depth < len").select(*NODE).distinct()
    leaves = seqs.join(inner, list(NODE), "left_anti").select("seq", F.lit(1).cast("long").alias("leaf"))
    marked = materialize(steps.join(leaves, "seq", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long"))))
    members = materialize(marked.groupBy(*NODE).agg(F.min("seq").alias("seq"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")))

    # Each node is counted once, in the smallest sequence that has it, so a sum along sequences is one over subtrees.
    owned = marked.join(members.select(*NODE, "seq", F.lit(1).cast("long").alias("own")), [*NODE, "seq"], "left")
    gains = owned.select("seq", *NODE, (-F.col("depth")).alias("up"), (F.col("bytes") * (F.col("weight") - F.coalesce("own", F.lit(0)))).alias("gain"))
    below = running(gains, ["seq"], ["up"], F.floor(F.col("up") / BLOCK), [Run("saved", "sum", F.col("gain"))])
    saved = below.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"))

    firsts = marked.join(members.select(*NODE, "seq"), [*NODE, "seq"], "left_semi").where("depth > 0")
    up = materialize(firsts.select(*NODE, (F.col("depth") - 1).alias("p_depth"), F.col("k0").bitwiseXOR(F.col("x0")).alias("p0"), F.col("k1").bitwiseXOR(F.col("x1")).alias("p1")))
    parent = [F.col("p_depth").alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")]
    children = up.groupBy(*parent).agg(F.count("*").alias("n_children"))
    parents = up.join(members.select(F.col("depth").alias("p_depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("seq").alias("parent_conv_id")), ["p_depth", "p0", "p1"]).select(*NODE, "parent_conv_id")

    on = list(NODE)
    nodes = members.join(saved, on).join(children, on, "left").join(parents, on, "left").join(digests, on, "left")
    return nodes.select(F.col("seq").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
