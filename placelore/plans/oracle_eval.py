"""SQL of the queries in ``queries_eval``."""

from __future__ import annotations

from placelore.operators.evaluate import METRICS
from placelore.operators.evidence import EXPLICIT_HEADER, EXPLICIT_TAG, IMPLICIT_TAG
from placelore.plans.oracle_base import IN_TEST, IN_TRAIN, segment
from placelore.plans.settings import *  # noqa: F403
from placelore.plans.sql import statement, view

TOKEN = r"\w+|[^\w\s]"


def tokens(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{TOKEN}')) AS BIGINT)"


LABEL_LIST = "[" + ", ".join(f"'{label}'" for label in LABELS) + "]"
DAY = "strftime({0}, '%Y-%m-%d')"
HEADER = f"concat('{EXPLICIT_HEADER} (', {DAY}, '):')"

view("v_behavior_text", """
SELECT idhash, datestr, string_agg(concat('- ', category_path, ': ', n), chr(10) ORDER BY category_path) AS text
FROM (SELECT idhash, datestr, category_path, count(*) AS n FROM v_clicks JOIN v_poi USING (sid) GROUP BY ALL)
GROUP BY ALL
""")
view("v_review_words", """
SELECT DISTINCT idhash, created_date AS datestr, unnest([lang, source]) AS word FROM v_dedup
""")
view("v_review_text", f"""
SELECT idhash, datestr, concat({HEADER.format('datestr')}, chr(10), string_agg(concat('- ', word), chr(10) ORDER BY word)) AS text
FROM v_review_words GROUP BY idhash, datestr
""")
view("v_daily_text", f"""
SELECT coalesce(i.idhash, e.idhash) AS idhash, coalesce(i.datestr, e.datestr) AS datestr,
       CASE WHEN e.text IS NULL THEN i.text WHEN i.text IS NULL THEN e.text
            ELSE concat('{IMPLICIT_TAG}', chr(10), i.text, chr(10), chr(10), '{EXPLICIT_TAG}', chr(10), e.text) END AS text
FROM v_behavior_text i FULL JOIN v_review_text e ON i.idhash = e.idhash AND i.datestr = e.datestr
""")
view("v_full_text", "SELECT idhash, string_agg(text, chr(10) ORDER BY datestr) AS text FROM v_daily_text GROUP BY idhash")
view("v_prompt_rows", f"""
SELECT *, (row_number() OVER (PARTITION BY idhash, datestr ORDER BY etimestamp, event_id, kind) - 1) // {PROMPT_ROWS} AS part
FROM (
  SELECT idhash, datestr, etimestamp, event_id, 'click' AS kind,
         concat_ws(' ', strftime(etimestamp, '%H:%M:%S'), day_name, title, '<' || top_category || '>', region, review_top_display,
                   CASE WHEN trim(query) <> '' THEN query END) AS line
  FROM v_enriched
  UNION ALL
  SELECT idhash, datestr, etimestamp, event_id, 'save',
         concat_ws(' ', strftime(etimestamp, '%H:%M:%S'), title, '<' || trim(string_split(category_path, '>')[-1]) || '>')
  FROM v_saves LEFT JOIN v_poi_cat USING (sid)
  WHERE (idhash, datestr) IN (SELECT (idhash, datestr) FROM v_clicks))
""")
view("v_chunk_rows", """
SELECT *, row_number() OVER (PARTITION BY idhash ORDER BY write_date_time DESC, place_name DESC, row) AS rn,
       count(*) OVER (PARTITION BY idhash) AS n_reviews
FROM v_review_rows
""")
view("v_extraction_raw", r"""
SELECT *, CASE (conv_id + turn) % 6
  WHEN 0 THEN concat('[{"User_Info": "likes ', word, '"}, {"User_Info": "second", "Rationale": "r"}]')
  WHEN 1 THEN concat('Result: [{"User_Info": "', word, '"}] done')
  WHEN 2 THEN concat('{"User_Info": "', word, '"}')
  WHEN 3 THEN concat('[{"Other": "', word, '"}]')
  WHEN 4 THEN text ELSE '' END AS raw
FROM (SELECT conv_id, turn, text, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS datestr,
             regexp_extract(text, '([A-Za-z]+)', 1) AS word FROM conversations)
""")
view("v_extraction_json", r"""
SELECT *, CASE WHEN json_valid(raw) THEN raw
               WHEN json_valid(regexp_extract(raw, '(?s)\[.*\]')) THEN regexp_extract(raw, '(?s)\[.*\]') END AS source
FROM v_extraction_raw WHERE raw <> ''
""")
view("v_extraction_infos", """
SELECT *, CASE WHEN json_type(source) = 'ARRAY'
  THEN [x for x in json_extract_string(source, '$[*].User_Info') if x IS NOT NULL] ELSE [] END AS infos
FROM v_extraction_json
""")
view("v_clusters", """
SELECT *, row_number() OVER (PARTITION BY idhash, category ORDER BY n DESC, sid) AS rank FROM (
  SELECT idhash, top_category AS category, sid, title, count(*) AS n FROM v_clicks JOIN v_poi_cat USING (sid)
  WHERE top_category IS NOT NULL GROUP BY ALL)
""")
view("v_domain_windows", f"""
SELECT idhash, top_category AS domain, window_start, count(*) AS n, count(DISTINCT datestr) AS days, max(datestr) AS last_day
FROM v_clicks JOIN v_poi_cat USING (sid)
JOIN (SELECT CAST(range AS DATE) AS window_start FROM range(DATE '{FIRST_DAY}', DATE '{LAST_DAY}' + 1, INTERVAL 7 DAY))
  ON datestr BETWEEN window_start AND window_start + 20
WHERE top_category IS NOT NULL GROUP BY ALL
""")
view("v_items", r"""
SELECT idhash, event_id, etimestamp, item, sha256(trim(regexp_replace(lower(item), '\s+', ' ', 'g'))) AS item_hash
FROM (SELECT *, CASE WHEN action = 'click' THEN upper(replace(title, ' ', '  ')) ELSE title END AS item
      FROM v_clicks JOIN v_poi USING (sid))
""")
view("v_lines", r"""
SELECT concat('u', conv_id) AS idhash, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS datestr, turn,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
FROM conversations WHERE (conv_id + turn) % 7 NOT IN (3, 5)
""")
view("v_labels", f"SELECT unnest({LABEL_LIST}) AS category, unnest(range(1, {len(LABELS) + 1})) AS place")
view("v_truth", f"""
SELECT DISTINCT idhash, sub_category AS category FROM v_clicks JOIN v_poi_cat USING (sid)
WHERE {IN_TEST} AND sub_category IS NOT NULL AND idhash IN (FROM v_train_users)
""")
view("v_support", f"""
SELECT idhash, sub_category AS category, count(*) AS n, epoch_us(max(etimestamp)) AS last
FROM v_clicks JOIN v_poi_cat USING (sid)
WHERE {IN_TRAIN} AND sub_category IS NOT NULL AND idhash IN (FROM v_train_users) GROUP BY ALL
""")
view("v_ranked", """
SELECT variant, idhash, category, pos FROM (
  SELECT variant, idhash, l.category,
         row_number() OVER (PARTITION BY variant, idhash ORDER BY CASE variant WHEN 'support' THEN coalesce(n, 0)
           WHEN 'recent' THEN coalesce(last, 0) ELSE 0 END DESC, place) - 1 AS pos
  FROM v_train_users CROSS JOIN (SELECT unnest(['default', 'support', 'recent']) AS variant) CROSS JOIN v_labels l
  LEFT JOIN v_support s USING (idhash, category))
WHERE pos < 10
""")
view("v_hits", """
SELECT r.*, t.category IS NOT NULL AS hit, coalesce(n_truth, 0) AS n_truth
FROM v_ranked r LEFT JOIN v_truth t USING (idhash, category)
LEFT JOIN (SELECT idhash, count(*) AS n_truth FROM v_truth GROUP BY idhash) USING (idhash)
""")
view("v_metrics", """
SELECT variant, idhash,
       round(count(*) FILTER (hit AND pos < 1) / 1.0, 6) AS "precision@1",
       round(count(*) FILTER (hit AND pos < 3) / 3.0, 6) AS "precision@3",
       round(count(*) FILTER (hit AND pos < 5) / 5.0, 6) AS "precision@5",
       round(CASE WHEN max(n_truth) = 0 THEN 0.0 ELSE count(*) FILTER (hit AND pos < 5) / CAST(max(n_truth) AS DOUBLE) END, 6) AS "recall@5",
       round(CASE WHEN max(n_truth) = 0 THEN 0.0
             ELSE coalesce(sum(1.0 / log2(pos + 2)) FILTER (hit), 0.0)
                  / list_sum([1.0 / log2(i + 1) for i in range(1, least(10, max(n_truth)) + 1)]) END, 6) AS "ndcg@10",
       CAST(max(CASE WHEN hit THEN 1 ELSE 0 END) AS DOUBLE) AS "hr@10",
       round(coalesce(1.0 / min(pos + 1) FILTER (hit), 0.0), 6) AS mrr
FROM v_hits GROUP BY variant, idhash
""")
view("v_long", " UNION ALL ".join(
    f"SELECT variant, idhash, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value FROM v_metrics" for m in METRICS
))
view("v_pairs", """
SELECT v.variant, v.metric, v.idhash, b.value AS baseline, v.value AS value
FROM v_long v JOIN v_long b ON v.idhash = b.idhash AND v.metric = b.metric
WHERE b.variant = 'support' AND v.variant <> 'support'
""")
view("v_slots", """
SELECT *, row_number() OVER (PARTITION BY variant, metric ORDER BY idhash) - 1 AS slot,
       count(*) OVER (PARTITION BY variant, metric) AS n, baseline - value AS diff
FROM v_pairs
""")
view("v_draws", f"""
SELECT n, b, pick, count(*) AS times FROM (
  SELECT n, b, CAST(concat('0x', substr(md5(concat(b, '|', slot)), 1, 8)) AS BIGINT) % n AS pick
  FROM (SELECT DISTINCT n, slot FROM v_slots) CROSS JOIN (SELECT range AS b FROM range({BOOTSTRAP_DRAWS})))
GROUP BY n, b, pick
""")
view("v_boot", """
SELECT p.variant, p.metric, d.b, round(sum(d.times * p.diff) / p.n, 9) AS mean
FROM v_draws d JOIN v_slots p ON p.n = d.n AND p.slot = d.pick
GROUP BY p.variant, p.metric, d.b, p.n
""")
view("v_bootstrap", """
SELECT variant, metric, round(quantile_cont(mean, 0.025), 6) AS ci_lower, round(quantile_cont(mean, 0.975), 6) AS ci_upper,
       round(least(1.0, 2.0 * least(avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p_value,
       any_value(mean_diff) AS mean_diff
FROM v_boot JOIN (SELECT variant, metric, round(avg(diff), 6) AS mean_diff FROM v_slots GROUP BY ALL) USING (variant, metric)
GROUP BY variant, metric
""")
view("v_cohen", """
SELECT variant, metric, round(avg(baseline), 6) AS baseline_mean, round(avg(value), 6) AS variant_mean,
       round(CASE WHEN count(*) > 1 AND sqrt((var_samp(baseline) + var_samp(value)) / 2) > 1e-12
             THEN (avg(baseline) - avg(value)) / sqrt((var_samp(baseline) + var_samp(value)) / 2) ELSE 0.0 END, 6) AS cohens_d
FROM v_pairs GROUP BY ALL
""")
view("v_holm", """
SELECT *, NOT EXISTS (
    SELECT 1 FROM v_holm_rank e WHERE e.metric = h.metric AND e.r <= h.r AND e.p_value > 0.05 / (e.m - e.r + 1)
  ) AS significant
FROM v_holm_rank h
""")
view("v_holm_rank", """
SELECT variant, metric, p_value, row_number() OVER (PARTITION BY metric ORDER BY p_value, variant) AS r,
       count(*) OVER (PARTITION BY metric) AS m
FROM v_bootstrap
""")
view("v_parsed", r"""
SELECT idhash, json_extract_string(coalesce(
    CASE WHEN json_valid(raw) THEN json_extract(raw, '$.predictions') END,
    CASE WHEN json_valid(regexp_extract(raw, '(?s)\{.*\}')) THEN json_extract(regexp_extract(raw, '(?s)\{.*\}'), '$.predictions') END,
    CASE WHEN json_valid(regexp_extract(raw, '(?s)\[.*\]')) THEN CAST(regexp_extract(raw, '(?s)\[.*\]') AS JSON) END
  ), '$[*]') AS predictions
FROM (SELECT idhash, CASE idhash % 5
               WHEN 0 THEN concat('{"predictions": ["Brand#', a, '","Brand#', b, '","Brand#', a, '"]}')
               WHEN 1 THEN concat('Sure: {"predictions": ["Brand#', a, '", 7, "', word, '"]} thanks')
               WHEN 2 THEN concat('["Brand#', b, '","', word, '"]') WHEN 3 THEN word ELSE '' END AS raw
      FROM (SELECT conv_id AS idhash, n % 25 + 1 AS a, (n // 25) % 25 + 1 AS b, word
            FROM (SELECT conv_id, sum(length(text)) AS n, min(regexp_extract(text, '([A-Za-z]+)', 1)) AS word FROM conversations GROUP BY conv_id)))
""")
view("v_mentions", f"""
SELECT idhash, category, count(*) AS n FROM (SELECT idhash, unnest(regexp_extract_all(text, '{LABEL_PATTERN}')) AS category FROM v_full_text)
GROUP BY ALL
""")

ALL = ", ".join(f'"{m}"' for m in METRICS)
ORACLE = {
    "daily_text": "FROM v_daily_text",
    "full_text": "FROM v_full_text",
    "implicit_prompt": """
SELECT idhash, datestr, part, concat(coalesce(concat(demo_text, chr(10)), ''), body) AS prompt FROM (
  SELECT idhash, datestr, part, concat('[clicks]', chr(10), coalesce(string_agg(line, chr(10) ORDER BY etimestamp, event_id) FILTER (kind = 'click'), ''),
         chr(10), '[saves]', chr(10), coalesce(string_agg(line, chr(10) ORDER BY etimestamp, event_id) FILTER (kind = 'save'), '')) AS body
  FROM v_prompt_rows GROUP BY idhash, datestr, part)
LEFT JOIN (SELECT idhash, demo_text FROM v_demo_text) USING (idhash)""",
    "explicit_prompt": f"""
SELECT idhash, chunk, concat('examples: ', CASE WHEN n <= 4 THEN '{FEW_SHOT_SPARSE}' ELSE '{FEW_SHOT_RICH}' END, chr(10),
       'demographics: ', coalesce(demo_text, ''), chr(10), 'reviews:', chr(10), lines) AS prompt
FROM (SELECT idhash, (rn - 1) // {CHUNK} AS chunk, max(n_reviews) AS n, max(demo_text) AS demo_text,
             string_agg(concat_ws(' | ', CAST(row AS VARCHAR), CAST(write_date_time AS VARCHAR), CAST(visit_date_time AS VARCHAR), visit_day,
                                  place_name, address, category_path, text_review, keyword_list), chr(10) ORDER BY rn) AS lines
      FROM v_chunk_rows GROUP BY ALL)""",
    "distill_pairs": """
SELECT pair_hash, conv_id, turn, prompt, response,
       CASE WHEN CAST(concat('0x', substr(pair_hash, 1, 8)) AS BIGINT) % 100 < 10 THEN 'eval' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY pair_hash ORDER BY conv_id, turn) AS rn FROM (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response, sha256(concat(sha256(u.text), sha256(a.text))) AS pair_hash
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role <> 'user' AND trim(u.text) <> '' AND trim(a.text) <> ''))
WHERE rn = 1""",
    "explicit_parse": f"""
SELECT conv_id AS idhash, turn, datestr, CASE WHEN len(infos) > 0
       THEN concat({HEADER.format('datestr')}, chr(10), array_to_string([concat('- ', x) for x in infos], chr(10))) ELSE raw END AS text
FROM v_extraction_infos""",
    "token_usage": f"""
SELECT *, prompt_tokens + completion_tokens AS total_tokens,
       round(CAST((prompt_tokens * {PRICES[0]} + completion_tokens * {PRICES[1]}) / 1e6 AS DOUBLE), 6) AS cost
FROM (SELECT conv_id AS idhash, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS datestr, count(*) FILTER (role = 'user') AS calls,
             CAST(coalesce(sum({tokens('text')}) FILTER (role = 'user'), 0) AS BIGINT) AS prompt_tokens,
             CAST(coalesce(sum({tokens('text')}) FILTER (role <> 'user'), 0) AS BIGINT) AS completion_tokens
      FROM conversations WHERE trim(text) <> '' GROUP BY conv_id)""",
    "behavior_clusters": """
SELECT idhash, category, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_places,
       string_agg(concat(title, ' x', n), ', ' ORDER BY rank) FILTER (rank <= 3) AS examples,
       round(sum(n) / CAST(least(count(*), 3) AS DOUBLE), 6) AS reduction
FROM v_clusters GROUP BY idhash, category""",
    "implicit_persona": """
SELECT idhash, string_agg(concat('[', domain, '] ', n, ' events on ', days, ' days, last ', last_day), chr(10)
                          ORDER BY window_start DESC, domain) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY idhash, domain ORDER BY window_start DESC) AS rn FROM v_domain_windows)
WHERE rn = 1 GROUP BY idhash""",
    "item_dedup": """
SELECT idhash, event_id, etimestamp, item, item_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY idhash, item_hash ORDER BY etimestamp, event_id) AS rn FROM v_items) WHERE rn = 1""",
    "read_daily_texts": "SELECT idhash, datestr, arg_max(text, turn) AS text FROM v_lines WHERE text <> '' GROUP BY ALL",
    "parse_predictions": "SELECT idhash, array_to_string(predictions, '|') AS predictions FROM v_parsed",
    "validate_pad": f"""
SELECT idhash, string_agg(category, '|' ORDER BY o) AS predictions FROM (
  SELECT idhash, category, o, row_number() OVER (PARTITION BY idhash ORDER BY o) AS rn FROM (
    SELECT p.idhash, l.category, coalesce(list_position(p.predictions, l.category), 1000 + place) AS o FROM v_parsed p CROSS JOIN v_labels l))
WHERE rn <= 10 GROUP BY idhash""",
    "category_baseline": """
SELECT idhash, string_agg(category, '|' ORDER BY rn) AS predictions FROM (
  SELECT u.idhash, l.category, row_number() OVER (PARTITION BY u.idhash ORDER BY coalesce(n, 0) DESC, place) AS rn
  FROM v_full_text u CROSS JOIN v_labels l LEFT JOIN v_mentions m ON m.idhash = u.idhash AND m.category = l.category)
WHERE rn <= 10 GROUP BY idhash""",
    "prediction_prompt": f"""
SELECT idhash, concat('memory:', chr(10), text, chr(10), 'categories: {", ".join(LABELS)}', chr(10), 'answer with ten categories') AS prompt
FROM v_full_text""",
    "precision_recall": 'SELECT variant, idhash, "precision@1", "precision@3", "precision@5", "recall@5" FROM v_metrics',
    "ndcg": 'SELECT variant, idhash, "ndcg@10" FROM v_metrics',
    "hit_rate": 'SELECT variant, idhash, "hr@10" FROM v_metrics',
    "mrr": "SELECT variant, idhash, mrr FROM v_metrics",
    "all_metrics": f"SELECT variant, idhash, {ALL} FROM v_metrics",
    "pairwise_eval": """
WITH s AS (
  SELECT u.idhash, l.category, coalesce(n, 0) AS score, t.category IS NOT NULL AS visited
  FROM (SELECT DISTINCT idhash FROM v_support WHERE idhash IN (SELECT idhash FROM v_truth)) u CROSS JOIN v_labels l
  LEFT JOIN v_support p ON p.idhash = u.idhash AND p.category = l.category
  LEFT JOIN v_truth t ON t.idhash = u.idhash AND t.category = l.category)
SELECT a.idhash, count(*) AS n_pairs,
       round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS accuracy
FROM s a JOIN s b ON a.idhash = b.idhash AND a.visited AND NOT b.visited GROUP BY a.idhash""",
    "variant_summary": """
SELECT variant, metric, count(*) AS n_users, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM v_long GROUP BY ALL""",
    "align_variants": "FROM v_pairs",
    "paired_bootstrap": "FROM v_bootstrap",
    "cohens_d": "FROM v_cohen",
    "holm": "SELECT variant, metric, p_value, significant FROM v_holm",
    "compare_variants": """
SELECT variant, metric, baseline_mean, variant_mean, mean_diff, ci_lower, ci_upper, p_value, cohens_d, significant
FROM v_bootstrap JOIN v_cohen USING (variant, metric) JOIN (SELECT variant, metric, significant FROM v_holm) USING (variant, metric)""",
    "full_context_gap": """
SELECT idhash, metric, baseline AS full_value, value AS structured_value, round(value - baseline, 6) AS gap
FROM v_pairs WHERE variant = 'recent'""",
}
ORACLE = {name: statement(sql) for name, sql in ORACLE.items()}
