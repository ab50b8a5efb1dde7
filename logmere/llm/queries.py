"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_chat, op2_collisions, op3_suffix_dedup, op4_recompression, op5_sentencepiece, op6_jaccard, op7_language_id, op8_mixing, op9_warc, op10_matroska

QUERIES = {
    "op1_chat_formatting": op1_chat.query,
    "op2_embedding_near_dedup": op2_collisions.query,
    "op3_suffix_array_dedup": op3_suffix_dedup.query,
    "op4_substring_dedup": op4_recompression.query,
    "op5_sentencepiece": op5_sentencepiece.query,
    "op6_jaccard_join": op6_jaccard.query,
    "op7_language_id": op7_language_id.query,
    "op8_source_mixing": op8_mixing.query,
    "op9_warc": op9_warc.query,
    "op10_media_columns": op10_matroska.query,
}

_OP3 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, c, substr(h, 200 * c + 1, 298) AS h FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 199) // 200)) AS c FROM t)),
b AS (SELECT doc_id, c, h, CAST(unnest(range(1, least(100, length(h) // 2) + 1)) AS BIGINT) AS j FROM p),
w AS (SELECT doc_id, 100 * c + j AS i, CASE WHEN 2 * j + 98 <= length(h) THEN hash(substr(h, 2 * j - 1, 100)) END AS k, substr(h, 2 * j - 1, 2) AS byte FROM b),
f AS (SELECT k, min(doc_id) AS first FROM w WHERE k IS NOT NULL GROUP BY k),
m AS (SELECT w.doc_id, w.i, w.byte, coalesce(f.first < w.doc_id, false) AS hit FROM w LEFT JOIN f USING (k)),
g AS (SELECT doc_id, i, byte, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 49, false) AS gone FROM m),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""

_OP4 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, ws, CAST(unnest(range(1, len(ws) + 1)) AS BIGINT) AS i FROM t),
w AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN md5_number(array_to_string(ws[i:i + 19], ' ')) END AS k FROM b),
m AS (SELECT doc_id, i, word, CASE WHEN k IS NULL THEN false ELSE row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 END AS hit FROM w),
g AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 19, false) AS gone FROM m),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""

_OP6 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5_number(CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END) AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT s, count(*) AS f FROM g GROUP BY s),
o AS (SELECT g.doc_id, g.s, row_number() OVER (PARTITION BY g.doc_id ORDER BY c.f, g.s) AS pos FROM g JOIN c USING (s)),
p AS (SELECT o.doc_id, o.s, n.n FROM o JOIN n USING (doc_id) WHERE o.pos <= n.n - (n.n * 9 + 9) // 10 + 1),
q AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
i AS (SELECT q.u, q.v, count(*) AS k FROM q JOIN g a ON a.doc_id = q.u JOIN g b ON b.doc_id = q.v AND b.s = a.s GROUP BY q.u, q.v),
l AS (SELECT i.u, i.v FROM i JOIN n a ON a.doc_id = i.u JOIN n b ON b.doc_id = i.v WHERE 100 * i.k >= 90 * (a.n + b.n - i.k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT m.node AS doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM m LEFT JOIN n ON n.doc_id = m.node
"""

SQL = {
    "op1_chat_formatting": op1_chat.SQL,
    "op2_embedding_near_dedup": op2_collisions.SQL,
    "op3_suffix_array_dedup": _OP3,
    "op4_substring_dedup": _OP4,
    "op6_jaccard_join": _OP6,
    "op9_warc": op9_warc.SQL,
}
