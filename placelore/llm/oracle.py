"""SQL equivalents (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from placelore.llm import license_scan

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

JACCARD = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

PASSAGES = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM v) WHERE k > 1
), c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t WHERE len(w) > 0
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS k, count(*) AS n
  FROM words x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.k, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

SPLIT = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
NOTICES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
LICENSES = f"""
WITH tw AS (
  SELECT t, license, w, count(*) AS tf
  FROM (SELECT t, license, unnest({SPLIT.format('text')}) AS w FROM (VALUES {NOTICES}) v(t, license, text)) GROUP BY ALL
), f AS (
  SELECT doc_id, concat('/', coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', CAST(floor(doc_id / 100) AS BIGINT)) AS dir,
         coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f)
), lw AS (
  SELECT doc_id, line, w, count(*) AS tf FROM (SELECT doc_id, line, unnest({SPLIT.format('text')}) AS w FROM l) GROUP BY ALL
), n AS (SELECT count(*) AS n FROM f), d AS (SELECT w, count(DISTINCT doc_id) AS df FROM lw GROUP BY w),
idf AS (
  SELECT w, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS v FROM (SELECT DISTINCT w FROM tw) CROSS JOIN n LEFT JOIN d USING (w)
), tv AS (
  SELECT t, license, w, x / sqrt(sum(x * x) OVER (PARTITION BY t)) AS x
  FROM (SELECT t, license, w, tf * v AS x FROM tw JOIN idf USING (w))
), norms AS (
  SELECT doc_id, line, sqrt(sum(tf * tf * coalesce(v, top) * coalesce(v, top))) AS norm, sum(tf) AS n
  FROM lw LEFT JOIN idf USING (w) CROSS JOIN (SELECT max(v) AS top FROM idf) GROUP BY doc_id, line
), cosines AS (
  SELECT doc_id, line, license, t, round(sum(tf * v * x) / any_value(norm), 9) AS cosine, any_value(norms.n) AS n
  FROM lw JOIN idf USING (w) JOIN tv USING (w) JOIN norms USING (doc_id, line) GROUP BY doc_id, line, license, t
), own AS (
  SELECT doc_id, dir, license, cosine, c.n / total AS share FROM f
  LEFT JOIN (SELECT doc_id, sum(tf) AS total FROM lw GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT * FROM cosines WHERE cosine >= {license_scan.COSINE}
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, line, license) = 1) c USING (doc_id)
), speakers AS (
  SELECT dir AS above, license AS s_license, cosine AS s_cosine, concat(dir, '/', doc_id) AS s_path FROM own
  WHERE license IS NOT NULL AND share >= {license_scan.FILE_SHARE}
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, concat(dir, '/', doc_id)) = 1
), nearest AS (
  SELECT dir, s_license, s_cosine, s_path FROM (SELECT DISTINCT dir FROM own) JOIN speakers ON dir = above OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1
)
SELECT doc_id, concat(dir, '/', doc_id) AS path, coalesce(license, s_license) AS license, round(coalesce(cosine, s_cosine), 6) AS cosine,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN s_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN license IS NOT NULL THEN concat(dir, '/', doc_id) ELSE s_path END AS origin_path
FROM own LEFT JOIN nearest USING (dir)
"""

ORACLE: dict[str, str] = {
    "op3_exact_dedup": EXACT,
    "op5_ngram_jaccard": JACCARD,
    "op8_license": LICENSES,
    "op10_substring_dedup": PASSAGES,
}
