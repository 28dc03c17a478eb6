import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from test_corpus_operators import words

from tidebar.llm import prefix_trie, toxicity, whitening
from tidebar.llm.queries import op13_embedding_whitening

TURNS = "conv_id long, turn long, role string, text string, seq string, depth string, bytes int, k0 long"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in by.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes, kids, below = collections.defaultdict(list), collections.defaultdict(set), {}
    for c, s in out.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved + sum(below[k][1] for k in kids[p]))
    rows = set()
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(out[c]) == len(p))
        rows.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def trie_of(spark, rows):
    table = spark.createDataFrame([(*r, "s", "d", 1, 2) for r in rows], TURNS)
    got = [tuple(r[c] for c in RESULT) for r in prefix_trie.trie(table).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)       # several blocks a conversation
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)  # several chunks an end list
    r = random.Random(3)
    rows = []
    for c in [*range(60), -1, -7, -10, 10**15, 10**15 + 1]:
        for t in range(r.choice([1, 2, 3, 4, 9, 14])):
            rows.append((c, t, ["user", "assistant"][t % 2], r.choice(["", "é", "hello", "longer text"])))
    rows += [(70, None, None, None), (70, None, "user", None), (70, 5, "user", "tie b"), (70, 5, "user", "tie a"), (70, 5, "user", "tie a"), (71, 3, None, ""), (None, 0, "user", "lost")]
    rows += [(c, t, "user", "copy") for c in range(200, 240) for t in range(3)]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == set()


def brute_segments(s, start=0):
    """The best segment, shortest on ties, then the same left and right of it."""
    best = max(((sum(s[i:j]), i - j, -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return brute_segments(s[:i], start) + [(start + i, start + j)] + brute_segments(s[j:], start + j)


def test_segments_equal_brute_force():
    r = random.Random(1)
    for _ in range(600):
        s = [r.choice([-3, -2, -1, 0, 1, 2, 3]) + (r.random() / 128 if r.random() < 0.5 else 0) for _ in range(r.randint(0, 22))]
        got = toxicity.segments(np.array(s, float))
        assert [x[:2] for x in got] == brute_segments(s) or sorted(x[2] for x in got) == pytest.approx(sorted(sum(s[a:b]) for a, b in brute_segments(s)))
        assert all(x[2] == pytest.approx(sum(s[x[0]:x[1]])) for x in got)
    saw = np.tile([1.0, -1.01], 50_000) - np.linspace(0, 0.001, 100_000)
    assert len(toxicity.segments(saw)) == 50_000  # linear time: each look back jumps


def toxic_table(n, seed):
    r = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        w = words(r.randint(30, 200), seed * 10_000 + i)
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(max(1, len(w) // 25)):
                w[r.randrange(len(w))] = "zonk" + r.choice(["ing", "ed", "er", "ish", "ery", "", "able"])
        texts.append(" ".join(w))
        marks.append(int(toxic))
    return texts, marks


def test_toxicity_on_held_out_rows(spark):
    texts, marks = toxic_table(900, 5)
    rows = [(i, t, "x", 1.0, 3, 7) for i, t in enumerate(texts)] + [(2000, None, "x", 1.0, 3, 7), (2001, "", "x", 1.0, 3, 7), (None, "zonkish " * 9, "x", 1.0, 3, 7), (0, texts[0], "x", 1.0, 3, 7), (2002, "plain " * 60_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double, n_words int, segments int")
    labels = spark.createDataFrame([(i, m, "c") for i, m in enumerate(marks)] + [(3, 1 - marks[3], "c"), (4, None, "c"), (None, 1, "c")], "doc_id long, toxic int, text string")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score and by[2000].predicted == 0 and by[2000].passages == []
    assert by[None].predicted == 1 and by[2002].predicted == 0 and by[2002].n_words == 60_000
    spans = [texts[r.doc_id][p.start:p.end] for r in held if marks[r.doc_id] for p in r.passages]
    assert spans and np.mean(["zonk" in s for s in spans]) > 0.95 and all(s == s.strip() for s in spans)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    texts, marks = toxic_table(200, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, m ^ (flip and i in held)) for i, m in enumerate(marks)], "doc_id long, toxic int")
        scores.append({r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()})
    assert scores[0] == pytest.approx(scores[1])


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = "doc_id long, text string", "doc_id long, toxic int"
    some = spark.createDataFrame([(1, "a word"), (2, None)], docs)
    assert toxicity.scored(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count() == 0
    assert [r.predicted for r in toxicity.scored(some, spark.createDataFrame([], labels)).collect()] == [0, 0]
    assert [r.predicted for r in toxicity.scored(some, spark.createDataFrame([(1, 1), (3, 0)], labels)).collect()] == [0, 0]


VECTORS = "vec_id long, embedding array<double>, n int, component string, cells int"


def check_whitening(spark, rows, dropped=(), parts=3):
    """Compares with numpy on the rows but for ``dropped``; the result of Spark."""
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], VECTORS).repartition(parts)
    got = whitening.whitened(table).toPandas()
    kept = [(i, v) for k, (i, v) in enumerate(rows) if k not in dropped]
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(object).astype(np.int64).astype(object) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums).astype(float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(8, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k and set(got["component"]) == set(range(1, k + 1)) and (got["n"] == n).all()
    deviation = collections.Counter((i, str(sum(int(c) ** 2 for c in row))) for (i, _), row in zip(kept, n * x - sums))
    assert collections.Counter((None if i != i else i, str(d)) for i, d in got[got["component"] == 1][["vec_id", "deviation"]].itertuples(index=False)) == deviation
    shares = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(shares, e[:k] / e.sum(), rtol=1e-9) and got["identity_error"].iloc[0] < 1e-9
    return got, centred, e, q, k


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 200)
    draw = np.random.default_rng(2)
    vectors = (draw.normal(size=(150, 12)) * np.linspace(3, 0.2, 12)).tolist()
    rows = list(enumerate(vectors)) + [(900, None), (901, [None] * 12), (902, [math.inf] + [0.0] * 11), (903, [math.nan] * 12), (904, [1.0] * 3), (905, []), (906, [1e300] * 12)]
    got, centred, e, q, k = check_whitening(spark, rows, dropped=range(150, 157))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(150)].to_numpy()
    want = centred @ q[:, :k] / np.sqrt(e[:k])
    assert np.abs(wide - want * np.sign((wide * want).sum(axis=0))).max() < 1e-9


def test_whitening_of_repeated_eigenvalues_and_flat_directions(spark):
    cross = [(i, [float(s * (i == j)) for j in range(5)] + [4.0]) for i in range(5) for s in (1, -1)]  # five equal, one flat
    check_whitening(spark, cross)
    check_whitening(spark, [(1, [float(i), float(2 * i), 0.5]) for i in range(7)] + [(None, [0.0, 0.0, 0.5])] * 3)


def test_whitening_of_few_rows_and_large_entries(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitened(none).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1, "c", 2)] * 3, VECTORS)).count() == 0
    check_whitening(spark, [(i, [float(i) * 1e14, float(i % 3) * 1e13]) for i in range(9)])


def test_query_keeps_deviations_in_longs(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(20)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op13_embedding_whitening(spark, str(tmp_path))
    assert dict(out.dtypes)["deviation"] == "bigint" and out.where("deviation is null or deviation <> deviation_exact").count() == 0
