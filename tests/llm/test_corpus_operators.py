import collections
import random
import re
import unicodedata

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidebar.llm import fuzzy_lines, html, likelihood, licenses, links as linking, minhash, mixing, pieces, quality, sketches, trees, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(200, 1)
    near = base[:100] + ["changed"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(near)), (4, " ".join(words(200, 2))), (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE\ntwo"),
            (10, " ".join(words(30_000, 3))), (11, "x " * 5_000), (-4, "All rights reserved. Released under the MIT License")]
    rows += [(100 + i, " ".join(base[:3 * i] + [f"w{i}"] + base[3 * i + 1:])) for i in range(40)]
    full = [(i, t, None if i == 4 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pieces_equal_the_library():
    codec, library = pieces.PieceCodec(pieces.model_content(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(5)
    letters = list("  \n\tabcdefghijklmnop,.!?<>0x1A") + ["é", "中", "😀", "▁", "\x00", " ", "ﬁ"]
    texts = ["", " ", "  a  ", "<s> </s> <unk> <0x0A>", "a" * 5_000, "\n" * 40] + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(1_500)]
    for t in texts:
        assert codec.encode(t) == library.encode(t)
        assert codec.decode(codec.encode(t)) == library.decode(library.encode(t))
        assert codec.digest(t)[0] == len(library.encode(t))


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs)[0].collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert {i: got[i].component_id for i in sets} == group
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (group[i] == i) for i in sets)


def test_empty_tables_give_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(empty).count() == 0
    assert sketches.fingerprinted(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert pieces.token_digests(empty, MODEL).count() == 0
    assert quality.scored(empty, labels).count() == 0
    assert likelihood.judged(empty, labels).count() == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert len(rows) == docs.count() and None in target
    copies = {r.doc_id: r.copies for r in rows}
    assert mixing.mixed_documents(docs).count() == sum(copies.values())


def test_fingerprints(docs):
    got = {r.doc_id: r for r in sketches.fingerprinted(docs).collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    import hashlib
    for k, i in enumerate(order):
        half, nxt = len(text[i]) // 2, text[order[(k + 1) % len(order)]]
        edited = text[i][:len(text[i]) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint == got[7].fingerprint == ""
    assert got[101].near_next > 0.7 > got[10].near_next


def test_quality_rules_count_as_brute_force(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in likelihood.judged(docs, labels).collect():
        w = re.findall("[^\x20\x09-\x0d]+", text[r.doc_id])
        windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert not (r.kept and r.base_failed)


def test_lines_keep_their_first_occurrence(spark):
    line = "alpha beta gamma delta epsilon zeta"
    rows = [(1, f"{line}\nshort one"), (2, f"ALPHA, {line[6:]} 7\nshort one"), (3, None), (4, ""), (5, f"{line}\n{line}\nother words that are not anywhere else")]
    got = {r.doc_id: (r.text, r["_n_removed"], r.extra) for r in fuzzy_lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))).collect()}
    assert got == {1: (rows[0][1], 0, 1), 2: ("short one", 1, 1), 3: (None, 0, 1), 4: ("", 0, 1), 5: ("other words that are not anywhere else", 2, 1)}


def edit_distance(p, q):
    row = list(range(len(q) + 1))
    for i, c in enumerate(p, 1):
        row, old = [i], row
        for j, d in enumerate(q, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_bounded_edit_distance_equals_brute_force(spark):
    r = random.Random(3)
    texts = [("", ""), ("", "a"), ("aa", "aaa"), ("aba", "aba"), ("é😀x", "é😀yx")]
    for _ in range(150):
        p = "".join(r.choice("abé ") for _ in range(r.randint(0, 30)))
        at = r.randint(0, len(p))
        texts.append((p, p[:at] + "".join(r.choice("abé ") for _ in range(r.randint(0, 5))) + p[at + r.randint(0, 4):]))
    rows = [(p, q, k, edit_distance(p, q) <= k) for p, q in texts for k in (0, 1, 3, 9)]
    pair = F.col("p"), F.col("q"), F.col("k")
    got = spark.createDataFrame(rows, "p string, q string, k int, want boolean").select("want", fuzzy_lines.within(*pair).alias("got"), fuzzy_lines.shares_pieces(*pair).alias("may")).collect()
    assert all(x.want == x.got for x in got)
    assert all(x.may for x in got if x.want) and not all(x.may for x in got)


def test_word_by_word_never_accepts_more_than_the_distance(spark):
    r = random.Random(17)
    rows = []
    for i in range(120):
        p = words(r.randint(1, 12), i)
        q = [w if r.random() < 0.8 else "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for w in p] + ["x"] * (i % 10 == 0)
        rows += [(" ".join(p), " ".join(q), k, edit_distance(" ".join(p), " ".join(q)) <= k) for k in (0, 2, 6, 15)]
    pair = F.col("p"), F.col("q"), F.col("k")
    got = spark.createDataFrame(rows, "p string, q string, k int, want boolean").select("want", fuzzy_lines.word_by_word(*pair).alias("sure"), fuzzy_lines.within(*pair).alias("got")).collect()
    assert all(x.want == x.got for x in got) and all(x.want for x in got if x.sure) and any(x.sure for x in got)


def test_long_texts_within_a_bound_equal_brute_force(spark):
    r = random.Random(18)
    rows = []
    for k in (3, 9, 20, 66, 90):
        p = [r.choice("abcé ") for _ in range(400)]
        for edits in (k - 2, k, k + 1, 2 * k):
            q = p[:]
            for at in r.sample(range(len(q)), edits):
                q[at] = r.choice("xyz")
            rows.append(("".join(p), "".join(q), k, edit_distance(p, q) <= k))
    got = spark.createDataFrame(rows, "p string, q string, k int, want boolean").select("want", fuzzy_lines.within(F.col("p"), F.col("q"), F.col("k")).alias("got")).collect()
    assert all(x.want == x.got for x in got) and len({x.want for x in got}) == 2


def test_smallest_hashes_equal_a_full_sort(spark):
    r = random.Random(19)
    rows = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 7, 8, 40, 64, 65, 300, 4_000)]
    rows += [[r.getrandbits(62) for _ in range(500)], [5] * 900 + [7], [-(1 << 63) + i % 3 for i in range(700)] + [9] * 30]
    frame = spark.createDataFrame([(i, h, h if i % 2 else None) for i, h in enumerate(rows)], "i int, h array<bigint>, g array<bigint>")
    got = {x.i: (x.h, x.g) for x in fuzzy_lines.with_smallest(frame, ["h", "g"]).collect()}
    want = {i: sorted(set(h))[:fuzzy_lines.KEYS] for i, h in enumerate(rows)}
    assert got == {i: (h, h if i % 2 else None) for i, h in want.items()}


def test_many_near_copies_are_linked_with_few_pairs_across(spark, monkeypatch):
    """Copies of one line that are near to some others only meet hubs drawn per bucket, so that few are left to be compared with all."""
    r, lines = random.Random(20), []
    base = words(40, 2_000)
    for _ in range(150):
        w = base[:]
        for at in r.sample(range(40), 2):
            w[at] = "".join(r.choice("abcdefghij") for _ in range(len(w[at])))
        lines.append(" ".join(w))
    tested, similar = [], fuzzy_lines.similar

    def spy(pairs, texts):
        tested.append(pairs.count())
        return similar(pairs, texts)

    monkeypatch.setattr(fuzzy_lines, "similar", spy)
    kept = kept_lines(spark, lines)
    assert set(first_lines(lines)) <= set(kept) and len(kept) < 10
    assert len(tested) == 2 and tested[1] < 150 * 149 // 20


def test_letters_allow_every_pair_within_the_distance(spark):
    r = random.Random(21)
    rows = [("e" * 300, "e" * 330, True), ("eeeeeeeeeeaaaaaaaaaa", "eeeeeeeeeetttaaaaaaaaaa", False)]
    for i in range(150):
        p = " ".join(words(r.randint(3, 30), i))
        q = [c for c in p if r.random() > 0.05] + list("eat" * r.randint(0, 3))
        rows.append((p, "".join(q), edit_distance(p, q) <= max(len(p), len(q)) // 10))
    frame = spark.createDataFrame(rows, "p string, q string, near boolean")
    told = lambda c: F.struct(F.length(c).alias("size"), *fuzzy_lines.counts_of(F.col(c)))
    side = lambda s: lambda name: F.col(f"{s}.{name}")
    got = frame.select("near", told("p").alias("x"), told("q").alias("y")).select("near", fuzzy_lines.same_letters(side("x"), side("y")).alias("may")).collect()
    assert all(x.may for x in got if x.near) and not got[1].may and len({x.near for x in got}) == 2


def majority(hashes):
    """SimHash of 64-bit values, bit by bit."""
    code = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) // 2)
    return code - (1 << 64) if code >> 63 else code


def test_simhash_equals_a_count_of_every_bit(spark):
    r = random.Random(11)
    rows = [([r.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 5, 126, 127, 128, 254, 255, 400, 3_000)] + [([-1] * 127,), ([-1] * 500,), ([0] * 200,)]
    got = spark.createDataFrame(rows, "h array<long>").select("h", fuzzy_lines.simhash(F.col("h")).alias("code")).collect()
    assert len(got) == len(rows) and all(x.code == majority([h & (1 << 64) - 1 for h in x.h]) for x in got)


def test_links_by_parts_equal_all_pairs(spark):
    """Components of items that share a bucket and are near equal those of all such pairs."""
    r = random.Random(12)
    items = [(i, r.randint(0, 60), r.randint(0, 3), r.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(items, "id long, v int, p int, s int")
    near = lambda a, b: F.abs(a("v") - b("v")) <= 1
    links = linking.linked_by_parts(df, F.array(F.struct(F.col("p").alias("part"))), F.array("s"), near, lambda d: d)
    got = {x.id: x.component for x in linking.components(links).collect()}
    root = {i: i for i, *_ in items}
    while True:
        new = {i: min(root[j] for j, w, q, t in items if (p, s) == (q, t) and abs(v - w) <= 1) for i, v, p, s in items}
        if new == root:
            break
        root = new
    assert {i: got.get(i, i) for i in root} == root


def test_links_equal_all_pairs_and_buckets_get_narrow_rows(spark, monkeypatch):
    """Components equal those of all pairs that pass; the wide column is read for pairs that passed the cheap test only, once each."""
    r = random.Random(14)
    items = {i: (r.randint(0, 60), [r.randint(0, 3) for _ in range(3)], sorted(r.sample(range(12), 3))) for i in range(200)}
    df = spark.createDataFrame([(i, v, v, w, k) for i, (v, w, k) in items.items()], "id long, rank int, v int, wide array<int>, keys array<long>")
    seen, write = [], linking.materialize

    def spy(frame):
        seen.append((set(frame.columns), write(frame)))
        return seen[-1][1]

    monkeypatch.setattr(linking, "materialize", spy)
    cheap = lambda a, b: F.abs(a("v") - b("v")) <= 2
    same = lambda a, b: F.get(a("wide"), F.lit(0)) == F.get(b("wide"), F.lit(0))
    postings = df.select(F.explode("keys").alias("bucket"), "id")
    links = linking.linked(df, postings, ["v"], cheap, same, same, lambda d: d)
    got = {x.id: x.component for x in linking.components(links).collect()}
    near = [(i, j) for i in items for j in items if i < j and set(items[i][2]) & set(items[j][2]) and abs(items[i][0] - items[j][0]) <= 2 and items[i][1][0] == items[j][1][0]]
    root = {i: i for i in items}
    for _ in items:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert got == {i: root[i] for pair in near for i in pair} and len(set(got.values())) > 3
    assert not any("wide" in columns for columns, _ in seen)
    pairs = [f for columns, f in seen if columns == {"a", "b"}]
    assert all(f.count() == f.distinct().count() for f in pairs)


def test_lowest_bits_never_count_below_equal_coordinates():
    r = random.Random(15)
    for _ in range(200):
        a = minhash.signature(minhash.shingle_set(" ".join(words(30, r.randint(0, 10**6)))))
        b = a.copy()
        b[r.sample(range(len(b)), r.randint(0, 40))] += r.choice((1, 2, 4, 7, 1 << 20))
        (x, y), (p, q) = minhash.lowest_bits(a), minhash.lowest_bits(b)
        agree = minhash.CHECKED - ((x ^ p | y ^ q) & (1 << 64) - 1).bit_count()
        assert agree >= (a == b).sum() and minhash.lowest_bits(a) == [x, y]


def test_sets_differ_in_as_many_shingles_as_odd_bits():
    r = random.Random(16)
    counts = []
    for n in (1, 5, 60, 300, 3_000):
        base = words(n, n)
        for changed in (0, 1, n // 20, n // 5):
            other = [w if i >= changed else f"new{i}" for i, w in enumerate(base)]
            a, b = minhash.shingle_set(" ".join(base)), minhash.shingle_set(" ".join(other))
            apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(minhash.parity_bits(a), minhash.parity_bits(b), strict=True))
            counts.append((apart, len(set(a.tolist()) ^ set(b.tolist()))))
    assert all(x <= y for x, y in counts) and any(x == y > 5 for x, y in counts)


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[-4]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (8, 1, 0, 0, "reserved", "mit,reserved", 1.0)
    assert got[5].n_words == 0 and got[5].labels == "" and got[5].first_word is None
    assert licenses.places(licenses.scan_words("cc by cc-by, CC  BY"), {"cc-by": [b"cc", b"by"]}) == {"cc-by": [0, 2, 4]}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header><div class="cookie-notice">We use</div>
<article><h1>Title</h1><p>First <b>bold</b> &amp; more<br>next<p>Second
 line<form>Name</form><aside>Side</aside><ul><li>point</ul></article><div id=comments>Nice</div><footer>&copy;</footer><script>var t="</p>";</script></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "Title\nFirst bold & more\nnext\nSecond line\npoint"
    plain = "<body><div><a href=1>One</a><a href=2>Two</a></div><div>" + "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5)) + "<p>End.</p></div><div>ok</div></body>"
    assert html.main_text(plain).split("\n")[-1] == "End." and html.main_text(plain).count("\n") == 5
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<p>" * 20_000 + "deep" + "</b>" * 20_000) == "deep"


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/1"), (4, "https://a.example.com/en/?q"), (5, "http://x.net/es/a#b"), (6, "http://x.org/a"), (7, "http://net/fr/1")]
    rows += [(10 + i, f"http://h{i}.net/{'es' if i % 2 else 'en'}/{i}") for i in range(30)] + [(50 + i, f"http://h{i}.com/p/{i}") for i in range(30)]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert (got[1].host, got[1].path, got[2].host) == ("", "", "")
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (3, 4, 5, 7)] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("x.net", "/es/a", "net/es/", "block"), ("net", "/fr/1", "net/fr/", "block")]
    assert got[6].rule is None and got[6].verdict in ("allow", "block")


def test_quality_learns_from_other_folds_only(spark):
    good = [(i, " ".join(words(80, i)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "***" for w in words(80, i)), 0) for i in range(150)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = quality.scored(table.select("doc_id", "text"), table.select("doc_id", "quality")).join(table.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_tree_text_is_read():
    text = "Model: numTrees=1\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     Predict: -1.0\n    Else (feature 0 > 0.5)\n     Predict: 2.0\n"
    assert trees.parsed(text) == [("split", 0, 0.5, ("leaf", -1.0), ("leaf", 2.0))]
    assert trees.rules_of(trees.parsed(text)[0]) == [((0, True, 0.5),), ((0, False, 0.5),)]


def line_norm(line):
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in line.lower()).split())


def linked_lines(lines):
    """Brute-force groups of normalised lines of ten code points or more at edit similarity 0.9."""
    group = {x: x for x in {line_norm(t) for t in lines} if len(x) >= 10}
    close = [(p, q) for p in group for q in group if p < q and abs(len(p) - len(q)) <= max(len(p), len(q)) // 10 and edit_distance(p, q) <= max(len(p), len(q)) // 10]
    for _ in group:
        for p, q in close:
            group[p] = group[q] = min(group[p], group[q])
    return group


def kept_lines(spark, lines):
    rows = [(i, t) for i, t in enumerate(lines)]
    got = fuzzy_lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(r.doc_id for r in got if r["_n_removed"] == 0)


def first_lines(lines):
    group, seen, out = linked_lines(lines), set(), []
    for i, t in enumerate(lines):
        g = group.get(line_norm(t))
        if g is None or g not in seen:
            out.append(i)
        seen.add(g)
    return out


def test_lines_with_one_word_changed_meet(spark):
    lines = []
    for i in range(25):
        w = words(20 + i, 500 + i)
        lines += [" ".join(w), " ".join(w[:7] + ["ab" if len(w[7]) == 2 else w[7][:-1] + "z"] + w[8:])]
    kept = kept_lines(spark, lines)  # the blocks may miss a pair, but link none that is not near
    assert first_lines(lines) == list(range(0, 50, 2)) and set(kept) >= set(range(0, 50, 2)) and len(kept) <= 25 + 2


def test_lines_are_linked_by_verified_pairs_only(spark):
    r, lines = random.Random(9), []
    for i in range(12):
        w = words(15, 800 + i)
        lines.append(" ".join(w))
        r.shuffle(w)  # word-order permutations share a code
        lines += [" ".join(w), " ".join(w) + " x", " ".join(w) + " yz"]
    lines += [f"{'same ' * 9}{' '.join(words(6, 900 + i // 2))}{' q' * (i % 2)}" for i in range(20)]
    assert kept_lines(spark, lines) == first_lines(lines)


def test_lines_of_few_words_and_digits(spark):
    lines = ["All rights reserved.", "all rights reserved", "short", "short", "我们今天在公园里散步然后回家吃饭看电视", "我们今天在公园里散步然后回家吃饭看电视。",
             "我们今天在公园里散步然后回家吃饭看电影", "row a 10 20 30 40 50 60 70 of the table", "row a 91 82 73 64 55 46 37 of the table", "0123456789 0123456789", "0123456789-0123456789"]
    assert kept_lines(spark, lines) == first_lines(lines) == [0, 2, 3, 4, 7, 8, 9]


def test_every_segment_has_its_rate(spark):
    n = 1_300
    rows = [(i, f"http://a.{'com' if i % 3 else 'net'}/{'es/' if i % 3 == 0 else ''}s{i}/x") for i in range(n)] + [(n + i, f"http://b.com/s{i}/y") for i in range(n)] + [(3 * n, "http://c.org/s7/z"), (3 * n + 1, "http://c.org/none/z")]
    ruled = urls.with_rule(urls.with_parts(spark.createDataFrame(rows, "page_id long, url string")))
    decided = {r.page_id: (r.path.split("/")[1], r.decided) for r in ruled.collect()}
    known = [(s, d == "block") for s, d in decided.values() if d]
    counted, blocked, overall = collections.Counter(s for s, _ in known), collections.Counter(s for s, b in known if b), sum(b for _, b in known) / len(known)
    _, *fitted = urls.fit(ruled)
    got = urls.with_features(ruled, *fitted).collect()
    assert len(counted) > 1_000 and len(got) == len(rows)
    for r in got:
        s = decided[r.page_id][0]
        assert r["_f_segment_rate"] == pytest.approx((blocked[s] + 10 * overall) / (counted[s] + 10))


def test_trusted_counts_cover_every_trusted_document(spark):
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 50, F.lit(" end")).alias("text"))
    got = likelihood.judged(rows, rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).agg(F.max(F.abs("score")), F.count("*")).first()
    assert tuple(got) == (0.0, 20_500)  # both multinomials are the same


def test_article_elements_that_are_teasers():
    body = "".join(f"<p>{'main words here ' * 20}{i}</p>" for i in range(5))
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3><p>Short teaser {i}</p></article>" for i in range(4))
    assert html.main_text(f"<body><div>{body}</div><div>{cards}</div></body>") == "\n".join(f"{'main words here ' * 20}{i}" for i in range(5))
    assert html.main_text(f"<body><article>{body}</article><div>Elsewhere</div></body>").endswith("here 4")


def brute_region(rows):
    """Text by ratios, smoothing, threshold and region, said anew over (depth path, tags, text) lines."""
    import math
    ratio = [len(t) / max(g, 1) for _, g, t in rows]
    smooth = []
    for i in range(len(rows)):
        w = [(math.exp(-(j - i) ** 2 / (2 * 1.5**2)), r) for j, r in enumerate(ratio) if abs(j - i) <= 5]
        smooth.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
    mean = sum(smooth) / len(smooth)
    cut = min(mean, math.sqrt(sum((r - mean) ** 2 for r in smooth) / len(smooth)))
    content = [x for x, r in zip(rows, smooth) if r >= cut]
    whole = sum(len(t) for *_, t in content)
    held = collections.Counter()
    for path, _, t in content:
        for k in range(len(path) + 1):
            held[path[:k]] += len(t)
    region = max((p for p, n in held.items() if n >= 0.8 * whole), key=lambda p: p)
    return "\n".join(t for path, _, t in rows if path[:len(region)] == region)


def test_region_equals_brute_force():
    r = random.Random(9)
    for _ in range(300):
        rows, page, pending, serial = [], [], 0, 0
        for _ in range(r.randint(1, 4)):
            serial += 1
            outer = serial
            page.append("<div>")
            pending += 1
            for _ in range(r.randint(1, 5)):
                serial += 1
                text = " ".join(words(r.choice([1, 2, 30]), serial * 7))
                marks = r.randint(0, 3)
                page.append("<section>" + "<b></b>" * marks + text + "</section>")
                rows.append(((outer, serial), pending + 1 + 2 * marks, text))
                pending = 1
            page.append("</div>")
            pending += 1
        assert html.main_text("".join(page)) == brute_region(rows)


def test_class_names_never_empty_a_page():
    for page in ('<body class="has-sidebar"><p>kept</p>', '<body class="home header-fixed"><p>kept</p>', '<div class="content no-sidebar">kept</div>',
                 '<article class="post category-social">kept</article>', '<html class="menu"><body id="sidebar"><main class="search">kept</main>', '<div class="page-widget"><p>kept</p></div>'):
        assert html.main_text(page) == "kept", page
    assert html.main_text('<div><p>The main text of the page.</p></div><div class="site-footer">Foot</div><div class="ad">Buy</div>') == "The main text of the page."


def test_no_page_breaks_the_parser():
    assert html.main_text("<p>ok</p><![foo[x]]>") == "ok" and html.main_text("<![bad<p>a</p>") is not None
    r = random.Random(4)
    bits = ["<![foo[x]]>", "<![", "<!", "<!DOCTYPE", "<!--", "-->", "<?php", "?>", "</", "<", ">", "<p>", "</p>", '<div class="ad">', '<div id="x-nav">', "</div>", "<ul><li><a href=x>l</a>", "</ul>", "text ", "&amp;",
            "&#x110000;", "&#0;", "&bogus", "<script>", "</script>", "<![CDATA[x]]>", "<![if x]>", "<![endif]-->", "<tr><td>", "<br/>", "<article>", "</article>", '"', "'", "<a b=", "\x00", "<svg/>", "<textarea>", "<plaintext>", "\ud7ff"]
    for _ in range(4_000):
        assert isinstance(html.main_text("".join(r.choice(bits) for _ in range(r.randint(0, 25)))), str)
    assert html.main_text("<div>text" * 20_000).count("\n") == 15_999  # innermost element that holds 0.8 of the text; linear in depth


def test_pages_that_repeat_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t")] * 3 + [(None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html.extracted(pages).collect()) == ["", "a", "a", "a"] and html.extracted(pages.limit(0)).count() == 0


def test_repeated_words_found_by_fours_equal_brute_force(spark):
    r = random.Random(31)
    texts = [[r.choice("abc") for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 12, 30, 80)]
    four, long = [f"f{i}" for i in range(4)], [f"l{i}" for i in range(11)]
    texts += [four + ["x"] + four + ["y"] * 3 + ["z"], long + ["x"] + long, [f"w{i}" for i in range(40)]]  # fours that come again, windows that do, none
    rows = []
    for t in texts:
        windows = [tuple(t[i:i + likelihood.WINDOW]) for i in range(len(t) - likelihood.WINDOW + 1)]
        seen = collections.Counter(windows)
        rows.append((t, len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(likelihood.WINDOW)})))
    hashes = F.transform("t", lambda w: F.xxhash64(w))
    got = spark.createDataFrame(rows, "t array<string>, want int").select("want", likelihood.repeated_words(hashes, likelihood.joined(hashes, 1)).alias("got")).collect()
    assert [x.got for x in got] == [x.want for x in got] and {0} < {x.want for x in got}


def test_hashed_pieces_equal_a_lookup_in_texts(spark):
    """The filter reads numbers made once per line and finds what looking up the pieces in the text does."""
    r = random.Random(32)
    rows = []
    for _ in range(120):
        p = "".join(r.choice("abcdé ") for _ in range(r.randint(0, 90)))
        q = list(p)
        for _ in range(r.randint(0, 14)):
            q.insert(r.randint(0, len(q)), r.choice("xyzß"))
        rows.append((p, "".join(q), len(p) // 10))
    n = fuzzy_lines.PIECE
    want = [len({x for x in (p[i:i + n] for i in range(0, len(p) - n + 1, n)) if x not in q}) <= k for p, q, k in rows]
    frame = spark.createDataFrame(rows, "p string, q string, k int").select("k", fuzzy_lines.pieces_of(F.col("p")).alias("g"), fuzzy_lines.grams_of(F.col("q")).alias("h"))
    assert dict(frame.dtypes)["g"] == "array<int>"
    got = [x[0] for x in frame.select(fuzzy_lines.few_missing(F.col("g"), F.col("h"), F.col("k"))).collect()]
    assert got == want and len(set(want)) == 2


def test_lines_with_letters_changed_all_over_meet(spark):
    r, lines = random.Random(41), []
    for i in range(40):
        line = " ".join(words(15 + i, 1_500 + i))
        q = list(line)
        for at in r.sample([k for k, c in enumerate(q) if c != " "], len(q) // 20):
            q[at] = r.choice("klmnop")
        lines += [line, "".join(q)]
    kept = kept_lines(spark, lines)  # the runs may miss a pair, but link none that is not near
    assert first_lines(lines) == list(range(0, 80, 2)) and set(kept) >= set(range(0, 80, 2)) and len(kept) <= 40 + 12


def test_codes_by_rows_equal_those_inside_a_row(spark):
    r = random.Random(42)
    texts = [" ".join(words(n, n)) for n in (5, 6, 14, 40, 300)] + ["只有几个汉字的一行文字没有空格", "0123456789 0123456789"] + ["ab " * r.randint(5, 60) + "cd" for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_hash long, line string").withColumn("size", F.length("line"))
    line = F.col("line")
    worded, grammed = fuzzy_lines.kinds(F.col("size"), F.size(fuzzy_lines.words_in(line)))
    wanted = rows.select("line_hash", F.when(worded, fuzzy_lines.simhash(F.transform(fuzzy_lines.words_in(line), lambda w: F.xxhash64(w)))), F.when(grammed, fuzzy_lines.simhash(F.transform(fuzzy_lines.trigrams(line), lambda w: F.xxhash64(w))))).collect()
    got = {x.id: (x.word_code, x.gram_code) for x in fuzzy_lines.with_codes(rows).collect()}
    assert got == {x[0]: (x[1], x[2]) for x in wanted} and {None} < {c for pair in got.values() for c in pair}


def test_lines_of_a_key_and_like_length_share_a_bucket(spark):
    r = random.Random(43)
    rows = [(i, r.randint(10, 300), [r.randint(0, 5)]) for i in range(120)] * 2
    met = collections.defaultdict(set)
    for x in fuzzy_lines.meetings(spark.createDataFrame(rows, "line_hash long, size int, keys array<long>")).collect():
        met[x.bucket].add(x.id)
    size, key = {i: n for i, n, _ in rows}, {i: k[0] for i, _, k in rows}
    place = {i: b for b, ids in met.items() for i in ids}
    for i in size:
        near = {j for j in size if j != i and key[i] == key[j] and abs(size[i] - size[j]) <= max(size[i], size[j]) // 10}
        assert (i in place) == bool(near) and all(place[j] == place[i] for j in near)
    assert all(len(ids) > 1 and len({key[i] for i in ids}) == 1 for ids in met.values()) and len(met) > 6
