"""SQL of the operators that SQL can express, for an independent engine over the same tables."""

from __future__ import annotations

from lakeweave.llm import license_scan

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Labels by links (a, b) in both directions: the smallest vertex that they lead to.
COMPONENTS = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, least(a, min(b)) AS low FROM reach GROUP BY a)"""

CAP_FILTERS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links(a, b) AS (SELECT p.vec_id, q.vec_id FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
{COMPONENTS}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree d ON d.a = vec_id LEFT JOIN lowest w ON w.a = vec_id"""

DECONTAMINATE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iwin AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT *, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iwin),
dwin AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, d.size, i FROM dwin d JOIN iwin USING (size, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)"""

NGRAM_JOIN = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sets p JOIN sets q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2),
links(a, b) AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id FROM dw d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_cap_filters": CAP_FILTERS, "op4_decontaminate": DECONTAMINATE, "op9_license_scan": license_scan.oracle_sql(), "op10_ngram_join": NGRAM_JOIN}
