"""License scan: phrases at word positions, and an exact set-similarity join of text blocks with notice templates.

A template of n words is looked for in blocks of 2n words, one starting at every n-th word, so that each notice lies
whole in a block. A block matches if it holds at least ``threshold`` of the template's distinct words. Words are
ordered by how often the corpus has them, rarest first. A template needs ``need`` of its words, so a block without one
of the first ``size - need + 1`` cannot match (prefix); a block with fewer than ``need`` template words cannot match
(length); nor can one whose words from the common one on are too few (positional). What is left is counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import materialize

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}
THRESHOLD = 0.8

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def scan_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def places(words: list[bytes], phrases: dict[str, list[bytes]]) -> dict[str, list[int]]:
    """Starts of each phrase, overlapping ones included."""
    line, out = b" " + b" ".join(words) + b" ", {}
    for label, phrase in phrases.items():
        wanted, at, seen, counted = b" " + b" ".join(phrase) + b" ", -1, 0, 0
        while (at := line.find(wanted, at + 1)) >= 0:
            seen += line.count(b" ", counted, at)
            counted = at
            out.setdefault(label, []).append(seen)
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of ``docs``.

    score is the largest share of a template's words that a matching block holds, 0 without a match. Null and empty texts
    have no words and no labels (empty strings). Rows that repeat an id and a text get the same result.
    """
    spoken = {k: scan_words(v) for k, v in phrases.items()}
    spelt = {k: scan_words(v) for k, v in templates.items()}
    vocabulary = {w for words in spelt.values() for w in words}
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(filter(vocabulary.__contains__, scan_words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    # One row per template word at most, whatever the size of the corpus.
    counted = {r.word.encode(): r.n for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    sets = {k: sorted({order[w] for w in words}) for k, words in spelt.items()}
    need = {k: math.ceil(threshold * len(s) - 1e-9) for k, s in sets.items()}
    leads: dict[int, set[int]] = {}
    for k, s in sets.items():
        leads.setdefault(len(spelt[k]), set()).update(s[:len(s) - need[k] + 1])
    fewest = {n: min(need[k] for k in spelt if len(spelt[k]) == n) for n in leads}

    def blocks(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        held = [(i, order[w]) for i, w in enumerate(words) if w in order]
        for n, lead in leads.items():
            touched = {b for i, w in held if w in lead for b in (i // n, i // n - 1) if b >= 0}
            if not touched and not (held and any(i < n and w in lead for i, w in held)):
                continue
            inside: dict[int, set[int]] = {b: set() for b in touched}
            for i, w in held:
                for b in (i // n, i // n - 1):
                    if b in inside:
                        inside[b].add(w)
            yield from ((n, sorted(s)) for s in inside.values() if len(s) >= fewest[n])

    found = pa.list_(pa.struct([("n", pa.int32()), ("words", pa.list_(pa.int32()))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = scan_words(t.as_py())
                at = places(words, spoken)
                starts = [i for v in at.values() for i in v]
                rows.append((xxhash.xxh3_64_intdigest(t.as_py() or "") - 2**63, len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(at), [{"n": n, "words": s} for n, s in blocks(words)]))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds))],
                                             ["doc_id", "digest", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    scanned = materialize(docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, digest long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<n:int,words:array<int>>>"))
    rows = [(k, len(spelt[k]), len(s), need[k], s, p + 1, s[p]) for k, s in sets.items() for p in range(len(s) - need[k] + 1)]
    prefixes = spark.createDataFrame(rows, "label string, n int, size int, need int, template array<int>, place int, word int")
    block = scanned.select("doc_id", "digest", F.explode("blocks").alias("b")).select("doc_id", "digest", "b.n", "b.words").distinct()
    posted = block.select("doc_id", "digest", "n", "words", F.posexplode("words").alias("i", "word"))
    both = F.size(F.array_intersect("words", "template"))
    reach = F.least(F.col("size") - F.col("place"), F.size("words") - F.col("i") - 1) + 1
    first = F.array_min(F.array_intersect("words", "template")) == F.col("word")
    pairs = (posted.join(F.broadcast(prefixes), ["n", "word"])  # a few rows per template
             .where(first & (reach >= F.col("need")) & (both >= F.col("need"))).select("doc_id", "digest", "label", (both / F.col("size")).alias("share")))
    matched = pairs.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))
    joined = scanned.alias("s").join(matched.alias("m"), F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.digest") == F.col("m.digest")), "left")
    all_labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select("s.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                         F.array_join(all_labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
