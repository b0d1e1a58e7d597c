"""The same results as DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Runs with their checksums by a table of bytes, words at distance one by what is left without a letter, chains by recursion.
VARIANTS = r"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, x::BIGINT)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)), lambda z, b: xor(z >> 8, t[(xor(z, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM c, bits),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS del FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.del = b.del AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.del UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.del),
k AS (SELECT a, b, v.n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM p JOIN v ON v.word = b),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 5 * v.n THEN b END AS form, CASE WHEN k.n >= 5 * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON k.a = v.word AND r = 1),
r AS (SELECT word, word AS cur, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.cur WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(cur, step) AS root FROM r GROUP BY word) USING (word)"""

#: Sets of n-grams as text, overlaps by a join of all n-grams, components by reachability.
NGRAM_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id"""

#: Trees level by level, paths by position, and each row folded along its path; the checksum of an id bit by bit.
MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(c, b)), 4294967295), 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS given FROM documents),
a AS (SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
low AS (SELECT s, 0 AS lvl, pos, leaf AS h, n FROM a UNION ALL SELECT s, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY s, lvl, pos // 3, n),
sub AS (SELECT s, h AS subroot FROM low WHERE n = 1),
top AS (SELECT 0 AS lvl, s AS pos, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
path AS (SELECT rid, lvl, low.pos, a.pos // (3 ** lvl)::BIGINT AS own, h FROM a JOIN low ON low.s = a.s AND low.n > 1 AND low.pos // 3 = (a.pos // (3 ** lvl)::BIGINT) // 3 UNION ALL SELECT rid, 1000 + lvl, top.pos, a.s // (3 ** lvl)::BIGINT, h FROM a JOIN top ON top.n > 1 AND top.pos // 3 = (a.s // (3 ** lvl)::BIGINT) // 3),
step AS (SELECT *, dense_rank() OVER (PARTITION BY rid ORDER BY lvl) AS step FROM path),
fold AS (SELECT rid, 0::BIGINT AS step, given AS h FROM a UNION ALL SELECT f.rid, f.step + 1, sha256(string_agg(CASE WHEN p.pos = p.own THEN f.h ELSE p.h END, '' ORDER BY p.pos)) FROM fold f JOIN step p ON p.rid = f.rid AND p.step = f.step + 1 GROUP BY f.rid, f.step),
proof AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY lvl, pos) FILTER (WHERE pos <> own), '')) AS proof FROM path GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified FROM a JOIN sub USING (s) CROSS JOIN root LEFT JOIN proof USING (rid) JOIN (SELECT rid, arg_max(h, step) AS h FROM fold GROUP BY rid) f USING (rid)"""
