"""SQL (DuckDB) for the queries that it can express: each computes the contract's result in the plainest way, over whole tables."""

from __future__ import annotations

from .licenses import FULL, KNOWN, MORE, SPELLINGS

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
comp AS (WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a) SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / coalesce(CASE WHEN q > 0 THEN 1.0::DOUBLE WHEN q <= 0 THEN 0.25::DOUBLE END, 0.25::DOUBLE + 0.75::DOUBLE * length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) / CASE WHEN length(text) > 0 THEN length(text) END, 0.25::DOUBLE) AS key
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS r FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(cap) FROM o p WHERE p.r < o.r), 0)) / (SELECT sum(w) FROM o p WHERE p.r >= o.r) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE cap / w > level ORDER BY r LIMIT 1) * w, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) AS run
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND epochs < 2 AND run - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""


def _canonical(text: str) -> str:
    plain = rf"lower(regexp_replace(coalesce({text}, ''), '(?im)^[^\p{{L}}\p{{N}}\n]*(?:copyright\b|\(c\)\s|\x{{a9}})[^\n]*$', ' ', 'g'))"
    out = rf"' ' || regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
    for odd, even in SPELLINGS:
        out = f"replace({out}, ' {odd} ', ' {even} ')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


_TABLE = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in (*KNOWN, *MORE))
_DIGESTS = ", ".join(f"('{i}', '{d}')" for i, d in FULL)

OP4 = f"""
WITH known AS (SELECT digest, min(id) AS id FROM (SELECT {_canonical("t")} AS digest, i AS id FROM (VALUES {_TABLE}) k(i, t) UNION ALL SELECT d, i FROM (VALUES {_DIGESTS}) f(i, d)) GROUP BY digest),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS ids FROM (SELECT doc_id, {_canonical("line")} AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {_canonical("text")} AS digest FROM documents)
SELECT w.doc_id, w.digest AS text_digest, k.id AS license_id, coalesce(array_to_string(f.ids, ','), '') AS notices, CAST(coalesce(len(f.ids), 0) AS BIGINT) AS n_notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f USING (doc_id)
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH w AS (SELECT doc_id, {WORDS.format(_LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
comp AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a) SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id FROM documents d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
first AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (doc_id)
"""

_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 by its polynomial, a bit at a time; trees a level at a time, the next level while any tree has more than one node
OP11 = f"""
WITH RECURSIVE table_of(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("CAST(n_chars AS HUGEINT) + 1")} AS forged,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, table_of),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
nodes(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM p
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, pos // 2),
subs AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
tops(level, pos, h, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM subs
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY pos // 2),
up(doc, id, leaf, tree, level, pos, h, proof) AS (
  SELECT row_number() OVER (), doc_id, leaf, tree, 0, pos, CASE WHEN crc % 7 = 0 THEN forged ELSE leaf END, '' FROM p
  UNION ALL
  SELECT doc, id, leaf, up.tree, up.level + 1, up.pos // 2, sha256(CASE WHEN s.h IS NULL THEN up.h WHEN up.pos % 2 = 0 THEN up.h || s.h ELSE s.h || up.h END), proof || coalesce(s.h, '')
  FROM up JOIN nodes o ON o.tree = up.tree AND o.level = up.level AND o.pos = up.pos AND o.n > 1 LEFT JOIN nodes s ON s.tree = up.tree AND s.level = up.level AND s.pos = xor(up.pos, 1)),
subbed AS (SELECT up.* FROM up JOIN nodes o ON o.tree = up.tree AND o.level = up.level AND o.pos = up.pos AND o.n = 1),
over(doc, id, leaf, tree, level, pos, h, proof) AS (
  SELECT doc, id, leaf, tree, 0, tree, h, proof FROM subbed
  UNION ALL
  SELECT doc, id, leaf, tree, over.level + 1, over.pos // 2, sha256(CASE WHEN s.h IS NULL THEN over.h WHEN over.pos % 2 = 0 THEN over.h || s.h ELSE s.h || over.h END), proof || coalesce(s.h, '')
  FROM over JOIN tops o ON o.level = over.level AND o.pos = over.pos AND o.n > 1 LEFT JOIN tops s ON s.level = over.level AND s.pos = xor(over.pos, 1)),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT id AS doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, over.h AS folded_root, over.h = root AS verified
FROM over JOIN tops o ON o.level = over.level AND o.pos = over.pos AND o.n = 1 JOIN subs ON subs.tree = over.tree CROSS JOIN root
"""
