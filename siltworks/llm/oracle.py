"""The same results in SQL (of DuckDB), where SQL can express them."""

from __future__ import annotations

_REACH = """u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95),
{_REACH},
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.node = vec_id"""

SHINGLES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS l FROM d),
n AS (SELECT doc_id, len(l) AS n FROM s),
x AS (SELECT doc_id, unnest(l) AS g FROM s),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_REACH}
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM n LEFT JOIN comp ON comp.node = doc_id"""

SUFFIXES = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM h WHERE len(h) >= 200)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
edge AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
run AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edge),
span AS (SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM run GROUP BY doc_id, run),
part AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM span),
cut AS (SELECT doc_id, count(*) AS n, sum(e - b) AS gone, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS head
 FROM part JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)"""

ORACLE_SQL = {"op2_metric_range_join": VECTORS, "op8_suffix_dedup": SUFFIXES, "op10_minhash": SHINGLES}
