"""DuckDB SQL of the contracts that SQL can express; written from the contracts, by no operator's method."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWERED} AS ws FROM documents),
e AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""

OP9 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
v AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM v),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS i FROM h JOIN f ON h.h = f.h WHERE f.first < h.doc_id),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.i = k.i WHERE g.i IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""

_GROUPS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)
OP10 = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS x, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT x, payload_bytes, min(page_id) AS first FROM p GROUP BY 1, 2)
SELECT p.page_id, p.payload_bytes, {_GROUPS.replace("(x,", "(p.x,")} AS payload_digest,
  CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.x = f.x AND p.payload_bytes = f.payload_bytes
"""
