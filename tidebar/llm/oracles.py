"""SQL twins of the corpus queries that SQL can express."""

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = f"""
WITH base AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), 'mix')) AS digest FROM documents),
sized AS (SELECT *, CAST(floor(log2(size + 1.0) * 4) AS INTEGER) AS class FROM base),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0.0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / w ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, l * w) END AS target
  FROM (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS l FROM levels)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, digest, doc_id, size) AS rank FROM sized),
rates AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(concat('0x', substr(md5(concat('offset:', coalesce(r.source, chr(0) || 'null'))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS offs
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(rank * rate + offs) - floor((rank - 1) * rate + offs), ceil(rate)) AS BIGINT) * size AS taken
FROM rates
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, twoway.b FROM reach JOIN twoway ON reach.r = twoway.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

_CRC_BYTE = "list_reduce(list_prepend(xor(c, ord(b)::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"

TRIE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS t, strlen(coalesce(text, ''))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT DISTINCT conv_id, string_split(conv_id::VARCHAR, '') AS bs FROM turns),
heads AS (
  WITH RECURSIVE step(conv_id, bs, i, c) AS (
    SELECT conv_id, bs, 0, 4294967295::BIGINT FROM digits
    UNION ALL SELECT conv_id, bs, i + 1, {_CRC_BYTE.replace('ord(b)', 'ord(bs[i + 1])')} FROM step WHERE i < len(bs))
  SELECT conv_id, xor(c, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM step WHERE i = len(bs)),
own AS (SELECT conv_id, list(t ORDER BY pos) AS ts, list(bytes ORDER BY pos) AS bs FROM turns GROUP BY conv_id),
seqs AS (
  SELECT h.conv_id, coalesce(b.ts, [])[1:h.h] || o.ts[h.h + 1:] AS ts, coalesce(b.bs, [])[1:h.h] || o.bs[h.h + 1:] AS bs
  FROM heads h JOIN own o ON o.conv_id = h.conv_id LEFT JOIN own b ON b.conv_id = h.base),
steps AS (
  SELECT conv_id, d, len(ts) AS len, sha256(array_to_string(ts[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(ts[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT node, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN d = len THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY node, d),
kids AS (SELECT up AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
rings AS (SELECT DISTINCT a.node, a.d, b.node AS under, b.d AS under_d FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT r.node, r.d, sum((n.n - 1) * n.bytes) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM rings r JOIN nodes n ON n.node = r.under AND n.d = r.under_d LEFT JOIN kids k ON k.node = r.under AND k.d = r.under_d GROUP BY r.node, r.d)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.d = n.d LEFT JOIN nodes p ON p.node = n.up AND p.d = n.d - 1 LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
"""

ORACLES = {"op11_conversation_trie": TRIE, "op7_mixing": MIXING, "op5_minhash_near_dedup": NEAR_DEDUP}
