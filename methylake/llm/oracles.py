"""DuckDB SQL for the operator queries that SQL can express, written independently of the operators' methods."""

REMOVED_WORDS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING COUNT(*) > 1),
cov AS (SELECT DISTINCT rid, i + k AS p FROM win JOIN rep USING (h), range(35) AS r(k)),
one AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT one.rid, COUNT(cov.p) AS n_removed, string_agg(x, ' ' ORDER BY one.p) FILTER (WHERE cov.p IS NULL) AS t FROM one LEFT JOIN cov ON cov.rid = one.rid AND cov.p = one.p GROUP BY one.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

REMOVED_BYTES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(COALESCE(text, '')) AS t FROM documents),
win AS (SELECT rid, i, md5(hex(t[i:i + 199])) AS h FROM d, unnest(range(1, octet_length(t) - 198)) AS u(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING COUNT(*) > 1),
hit AS (SELECT rid, i, LAG(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM win JOIN rep USING (h)),
run AS (SELECT rid, i, SUM(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM hit),
span AS (SELECT rid, k, MIN(i) AS lo, MAX(i) + 199 AS hi FROM run GROUP BY rid, k),
gap AS (SELECT rid, hi, LEAD(lo, 1, 2000000000) OVER (PARTITION BY rid ORDER BY lo) AS nxt, lo, LAG(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS prev FROM span),
kept AS (SELECT gap.rid, COUNT(*) AS n_spans, SUM(hi - lo + 1) AS n_removed, string_agg(CASE WHEN lo > prev + 1 THEN hex(t[prev + 1:lo - 1]) ELSE '' END, '' ORDER BY lo) || COALESCE(hex(t[MAX(hi) + 1:]), '') AS x FROM gap JOIN d USING (rid) GROUP BY gap.rid, t)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN kept.rid IS NULL THEN t ELSE unhex(x) END) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

CAPTURES = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages), m AS (SELECT *, MIN(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1(h), CAST(1 + 10 * (j // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS BIGINT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""

_GROUPED = """, reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
"""

NEAR_VECTORS = (
    """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95)"""
    + _GROUPED
    + """SELECT v.vec_id, (SELECT COUNT(*) FROM link WHERE a = v.rid) AS n_links, LEAST(v.vec_id, (SELECT MIN(o.vec_id) FROM reach r JOIN v o ON o.rid = r.b WHERE r.a = v.rid)) AS component_id,
v.vec_id = LEAST(v.vec_id, (SELECT MIN(o.vec_id) FROM reach r JOIN v o ON o.rid = r.b WHERE r.a = v.rid)) AS kept FROM v"""
)

NEAR_TEXTS = (
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t, regexp_extract_all(lower(COALESCE(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT rid, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM d, unnest(range(1, GREATEST(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
size AS (SELECT rid, COUNT(*) AS n FROM gram GROUP BY rid),
pairs AS (SELECT x.rid AS a, y.rid AS b, COUNT(*) AS n FROM gram x JOIN gram y ON x.g = y.g AND x.rid <> y.rid GROUP BY x.rid, y.rid),
link AS (SELECT a, b FROM pairs JOIN size s ON s.rid = a JOIN size z ON z.rid = b WHERE 5 * pairs.n >= 4 * (s.n + z.n - pairs.n))"""
    + _GROUPED
    + """, low AS (SELECT r.a AS rid, MIN(o.doc_id) AS m FROM reach r JOIN d o ON o.rid = r.b GROUP BY r.a), deg AS (SELECT a AS rid, COUNT(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, CASE WHEN len(w) = 0 THEN d.doc_id ELSE MIN(d.doc_id) OVER (PARTITION BY t) END AS class_id, CAST(COALESCE(deg.n, 0) AS BIGINT) AS n_links, LEAST(d.doc_id, low.m) AS component_id, d.doc_id = LEAST(d.doc_id, low.m) AS kept
FROM d LEFT JOIN low USING (rid) LEFT JOIN deg USING (rid)"""
)
