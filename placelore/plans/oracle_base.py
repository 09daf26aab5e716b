"""SQL of the queries in ``queries_base``; written from the definitions, in the plainest form."""

from __future__ import annotations

from datetime import timedelta

from placelore.operators.enrich import GRADE_BOUNDS, NO_GRADE
from placelore.plans.settings import *  # noqa: F403
from placelore.plans.sql import statement, view

W = WINDOWS
IN_TRAIN = f"datestr BETWEEN DATE '{W.train_start}' AND DATE '{W.train_end}'"
IN_TEST = f"datestr BETWEEN DATE '{W.test_start}' AND DATE '{W.test_end}'"
IN_BOTH = f"datestr BETWEEN DATE '{W.train_start}' AND DATE '{W.test_end}'"


def segment(path: str, i: int) -> str:
    """Trimmed path segment, 0-based; NULL when missing."""
    return f"trim(string_split({path}, '>')[{i + 1}])"


view("v_clicks", """
SELECT event_id, user_id AS idhash, ts AS etimestamp, CAST(ts AS DATE) AS datestr, k AS sid,
       CASE event_type WHEN 'click' THEN concat('q', CAST(k % 7 AS VARCHAR)) WHEN 'view' THEN '  ' END AS query,
       event_type AS action
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
view("v_saves", "SELECT event_id, idhash, sid, etimestamp, datestr FROM v_clicks WHERE action = 'purchase'")
view("v_poi", """
SELECT p_partkey AS sid, p_partkey AS place_id, p_name AS title,
       CASE WHEN p_partkey % 17 = 0 THEN 'root' ELSE concat('root > ', p_type, ' > ', p_brand) END AS category_path,
       concat('region', CAST(p_partkey % 5 AS VARCHAR), ' street') AS road_addr,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS place_review_count
FROM part
""")
view("v_poi_cat", f"""
SELECT *, {segment('category_path', 1)} AS top_category, {segment('category_path', 2)} AS sub_category,
       string_split(road_addr, ' ')[1] AS region
FROM v_poi
""")
view("v_demo", "SELECT c_custkey AS idhash, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer")
view("v_reviews", """
SELECT doc_id AS review_id, CAST(floor(sqrt(doc_id)) AS BIGINT) AS idhash, (doc_id * 7) % 200 AS place_id,
       CAST(floor(doc_id / 2) AS BIGINT) AS review_group_id, created_date,
       created_date - CAST(doc_id % 3 AS INTEGER) AS visit_date,
       CAST(created_date AS TIMESTAMP) + to_hours(CAST(doc_id % 24 AS INTEGER)) AS updated_time,
       text AS text_review, lang, source, doc_id % 13 = 0 AS is_deleted,
       doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_negative
FROM (SELECT *, DATE '2024-01-01' + CAST(floor((doc_id % 30) / 3) * 3 AS INTEGER) AS created_date FROM documents)
""")
view("v_train_users", f"""
SELECT idhash FROM v_clicks WHERE {IN_TRAIN} GROUP BY idhash HAVING count(*) >= {MIN_CLICKS}
""")
view("v_clean", r"""
SELECT * EXCLUDE (text_review), trim(regexp_replace(text_review, '[\n\t\r]+', ' ', 'g')) AS text_review
FROM v_reviews
WHERE NOT is_deleted AND text_review IS NOT NULL AND trim(regexp_replace(text_review, '[\n\t\r]+', ' ', 'g')) <> ''
""")
view("v_dedup", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY review_group_id ORDER BY created_date DESC, review_id DESC) AS rn FROM v_clean
) WHERE rn = 1
""")
GRADE = "CASE " + " ".join(f"WHEN {{0}} <= {b} THEN '{g}'" for b, g in GRADE_BOUNDS) + f" ELSE '{NO_GRADE}' END"
view("v_enriched", f"""
SELECT *, {GRADE.format('review_pct_rank')} AS review_top_display FROM (
  SELECT c.*, strftime(c.etimestamp, '%a') AS day_name, p.title, p.category_path, p.region, p.top_category,
         p.place_review_count, d.segment, d.nation,
         round(percent_rank() OVER (PARTITION BY p.region, p.top_category
                                    ORDER BY p.place_review_count DESC NULLS LAST) * 100, 1) AS review_pct_rank
  FROM v_clicks c LEFT JOIN v_poi_cat p ON c.sid = p.sid LEFT JOIN v_demo d ON c.idhash = d.idhash)
""")
view("v_poi_grade", f"""
SELECT sid, pct_poi, {GRADE.format('pct_poi')} AS grade_poi FROM (
  SELECT sid, round(percent_rank() OVER (PARTITION BY region, top_category
                                         ORDER BY place_review_count DESC NULLS LAST) * 100, 1) AS pct_poi
  FROM v_poi_cat)
""")
view("v_demo_text", "SELECT idhash, concat('segment: ', segment, ', nation: ', nation) AS demo_text FROM v_demo")
view("v_review_rows", """
SELECT r.idhash, row_number() OVER (PARTITION BY r.idhash ORDER BY created_date DESC, r.place_id DESC, review_id DESC) AS row,
       created_date AS write_date_time, visit_date AS visit_date_time, strftime(visit_date, '%a') AS visit_day,
       title AS place_name, road_addr AS address, category_path, text_review,
       concat('[', lang, ', ', source, ']') AS keyword_list, coalesce(demo_text, '') AS demo_text
FROM v_dedup r JOIN v_poi p ON r.place_id = p.place_id LEFT JOIN v_demo_text d ON r.idhash = d.idhash
""")
LEXICON = r"least(1.0, len(regexp_extract_all(lower(text_review), '\b(?:{0})\b')) * 100.0 / greatest(length(text_review), 1) / 5.0)"
view("v_quality_raw", f"""
SELECT review_id, idhash, CAST(least(1.0, length(text_review) / 200.0) AS DOUBLE) AS text_score,
       CAST(2 / 5.0 AS DOUBLE) AS engagement_score,
       CAST(CASE source {' '.join(f"WHEN '{s}' THEN {w}" for s, w in SOURCE_WEIGHTS.items())} ELSE 0.5 END AS DOUBLE) AS source_score,
       CAST({LEXICON.format('|'.join(OPINION_WORDS))} AS DOUBLE) AS opinion_score,
       CAST({LEXICON.format('|'.join(MENU_WORDS))} AS DOUBLE) AS menu_score,
       CAST(least(1.0, greatest(0.0, 1.0 - (DATE '{LAST_DAY}' - created_date) / 90.0)) AS DOUBLE) AS decay_score
FROM v_clean
""")
view("v_quality", """
SELECT review_id, idhash, round(text_score, 6) AS text_score, round(engagement_score, 6) AS engagement_score,
       round(source_score, 6) AS source_score, round(opinion_score, 6) AS opinion_score,
       round(menu_score, 6) AS menu_score, round(decay_score, 6) AS decay_score,
       round(0.3 * text_score + 0.2 * engagement_score + 0.15 * source_score + 0.15 * opinion_score
             + 0.1 * menu_score + 0.1 * decay_score, 6) AS score
FROM v_quality_raw
""")


def _hash_of(condition: str) -> str:
    words = ", ".join(
        f"CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(4)
    )
    return f"""
SELECT idhash, sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {words})) AS sha256
FROM (SELECT idhash, sha256(concat(coalesce(CAST(epoch_us(etimestamp) AS VARCHAR), '~'), '|', coalesce(CAST(sid AS VARCHAR), '~'))) AS h FROM v_clicks WHERE {condition})
GROUP BY idhash
"""


def _days(lo, hi) -> str:
    return f"datestr BETWEEN DATE '{lo}' AND DATE '{hi}'"


view("v_hash_now", _hash_of(_days(LAST_DAY - timedelta(days=20), LAST_DAY)))
view("v_hash_then", _hash_of(_days(W.test_start - timedelta(days=20), W.test_start)))

view("v_session_rows", f"""
SELECT *, sum(opens) OVER (PARTITION BY idhash ORDER BY etimestamp, event_id) AS session_id FROM (
  SELECT *, CASE WHEN epoch_us(etimestamp) - epoch_us(lag(etimestamp) OVER w) <= {SESSION_GAP_MINUTES * 60000000}
                  AND ((trim(query) <> '' AND query = lag(query) OVER w) OR top_category = lag(top_category) OVER w)
                 THEN 0 ELSE 1 END AS opens
  FROM v_enriched WINDOW w AS (PARTITION BY idhash ORDER BY etimestamp, event_id))
""")

_ACTIVE = "SELECT idhash, count(*) AS n_clicks FROM v_clicks WHERE {0} GROUP BY idhash HAVING count(*) >= {1}"
_DIVERSITY = f"""
SELECT idhash, count(DISTINCT top_category) AS n_categories FROM v_clicks JOIN v_poi_cat USING (sid)
WHERE {IN_TEST} GROUP BY idhash HAVING count(DISTINCT top_category) >= 2
"""
view("v_diversity", _DIVERSITY)
_FLAGS = f"""
SELECT idhash, CAST(max(CASE WHEN query IS NOT NULL AND trim(query) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS has_search,
       CAST(max(CASE WHEN query IS NULL OR trim(query) = '' THEN 1 ELSE 0 END) AS BIGINT) AS has_browse
FROM v_clicks WHERE {IN_BOTH} GROUP BY idhash
"""
view("v_flags", _FLAGS)

REVIEW_COLUMNS = "review_id, idhash, place_id, review_group_id, created_date, text_review"

ORACLE = {
    "clicks_in_window": f"SELECT etimestamp, idhash, sid, query FROM v_clicks WHERE {IN_TRAIN} AND idhash IN (FROM v_train_users)",
    "temporal_split": f"""
SELECT event_id, idhash, datestr, CASE WHEN {IN_TRAIN} THEN 'train' ELSE 'test' END AS split FROM v_clicks WHERE {IN_BOTH}""",
    "sliding_windows": f"""
SELECT idhash, window_start, count(*) AS n FROM v_clicks
JOIN (SELECT CAST(range AS DATE) AS window_start FROM range(DATE '{FIRST_DAY}', DATE '{LAST_DAY}' + 1, INTERVAL 1 DAY))
  ON datestr BETWEEN window_start AND window_start + 20
GROUP BY ALL""",
    "active_users": _ACTIVE.format(IN_TEST, MIN_CLICKS),
    "category_diversity": "FROM v_diversity",
    "stream_flags": "FROM v_flags",
    "select_users": f"""
SELECT idhash, train_clicks, test_clicks, n_categories, has_search + has_browse AS has_both,
       train_clicks + test_clicks AS total_clicks
FROM (SELECT idhash, count(*) AS train_clicks FROM v_clicks WHERE {IN_TRAIN} GROUP BY idhash HAVING count(*) >= {MIN_CLICKS})
JOIN (SELECT idhash, count(*) AS test_clicks FROM v_clicks WHERE {IN_TEST} GROUP BY idhash HAVING count(*) >= {MIN_CLICKS}) USING (idhash)
JOIN v_diversity USING (idhash) LEFT JOIN v_flags USING (idhash)
ORDER BY has_both DESC, total_clicks DESC, idhash LIMIT 2000""",
    "ground_truth": f"""
SELECT DISTINCT idhash, top_category AS category FROM v_clicks LEFT JOIN v_poi_cat USING (sid)
WHERE {IN_TEST} AND top_category IS NOT NULL AND idhash IN (FROM v_train_users)""",
    "recency": f"""
SELECT idhash, round(CAST(least(1.0, greatest(0.0, 1.0 - (DATE '{LAST_DAY}' - max(datestr)) / 30.0)) AS DOUBLE), 6) AS recency
FROM v_clicks GROUP BY idhash""",
    "engagement_score": f"""
WITH u AS (
  SELECT idhash, coalesce(n_clicks, 0) AS n_clicks, coalesce(recency, 0.0) AS recency, coalesce(n_reviews, 0) AS n_reviews,
         coalesce(n_saves, 0) AS n_saves, coalesce(n_categories, 0) AS n_categories
  FROM (SELECT idhash, count(*) AS n_clicks,
               CAST(least(1.0, greatest(0.0, 1.0 - (DATE '{LAST_DAY}' - max(datestr)) / 30.0)) AS DOUBLE) AS recency
        FROM v_clicks GROUP BY idhash) c
  FULL JOIN (SELECT idhash, count(*) AS n_reviews FROM v_reviews GROUP BY idhash) r USING (idhash)
  FULL JOIN (SELECT idhash, count(*) AS n_saves FROM v_saves GROUP BY idhash) s USING (idhash)
  LEFT JOIN (SELECT idhash, count(DISTINCT top_category) AS n_categories FROM v_clicks JOIN v_poi_cat USING (sid) GROUP BY idhash) g USING (idhash)
), n AS (
  SELECT idhash, recency,
    CASE WHEN max(n_clicks) OVER () > min(n_clicks) OVER () THEN (n_clicks - min(n_clicks) OVER ()) / CAST(max(n_clicks) OVER () - min(n_clicks) OVER () AS DOUBLE) ELSE 0.0 END AS clicks,
    CASE WHEN max(n_reviews) OVER () > min(n_reviews) OVER () THEN (n_reviews - min(n_reviews) OVER ()) / CAST(max(n_reviews) OVER () - min(n_reviews) OVER () AS DOUBLE) ELSE 0.0 END AS reviews,
    CASE WHEN max(n_saves) OVER () > min(n_saves) OVER () THEN (n_saves - min(n_saves) OVER ()) / CAST(max(n_saves) OVER () - min(n_saves) OVER () AS DOUBLE) ELSE 0.0 END AS saves,
    n_categories / CAST((SELECT count(DISTINCT top_category) FROM v_poi_cat) AS DOUBLE) AS diversity
  FROM u
)
SELECT idhash, round(clicks, 6) AS clicks, round(reviews, 6) AS reviews, round(saves, 6) AS saves,
       round(diversity, 6) AS diversity, round(recency, 6) AS recency,
       round(0.2 * clicks + 0.3 * reviews + 0.15 * saves + 0.2 * diversity + 0.15 * recency, 6) AS score
FROM n ORDER BY score DESC, idhash LIMIT 10000""",
    "daily_activity_rollup": """
SELECT idhash, datestr, top_category AS l2, sub_category AS l3, action, count(*) AS n
FROM v_clicks JOIN v_poi_cat USING (sid) WHERE sub_category IS NOT NULL GROUP BY ALL
UNION ALL
SELECT idhash, datestr, top_category, NULL, action, count(*)
FROM v_clicks JOIN v_poi_cat USING (sid) WHERE top_category IS NOT NULL GROUP BY ALL
UNION ALL
SELECT idhash, datestr, NULL, NULL, action, count(*) FROM v_clicks GROUP BY ALL""",
    "exploratory_vs_confirmed": """
SELECT idhash, top_category AS category, count(*) FILTER (action IN ('click', 'view')) AS exploratory,
       count(*) FILTER (action IN ('purchase', 'signup')) AS confirmed
FROM v_clicks JOIN v_poi_cat USING (sid) WHERE top_category IS NOT NULL GROUP BY ALL""",
    "user_hash": _hash_of("true"),
    "change_status": """
SELECT coalesce(a.idhash, b.idhash) AS idhash,
       CASE WHEN b.idhash IS NULL THEN 'new' WHEN a.idhash IS NULL THEN 'gone'
            WHEN a.sha256 = b.sha256 THEN 'unchanged' ELSE 'changed' END AS status
FROM v_hash_now a FULL JOIN v_hash_then b ON a.idhash = b.idhash""",
    "resume_pending": "SELECT DISTINCT idhash AS user_id FROM v_clicks WHERE idhash NOT IN (SELECT conv_id FROM conversations)",
    "demo_dedup": """
SELECT idhash, household, occupation, updated, record_id FROM (
  SELECT o_custkey AS idhash, o_orderstatus AS household, o_orderpriority AS occupation, CAST(o_orderdate AS DATE) AS updated,
         o_orderkey AS record_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""",
    "enrich_clicks": "FROM v_enriched",
    "enrich_saves": f"""
SELECT s.*, p.title, p.category_path, trim(string_split(p.category_path, '>')[-1]) AS category
FROM v_saves s LEFT JOIN v_poi p ON s.sid = p.sid""",
    "enrich_reviews": """
SELECT review_id, r.idhash, r.place_id, p.title AS place_name, p.road_addr AS address, p.category_path, segment, nation
FROM v_clean r JOIN v_poi p ON r.place_id = p.place_id LEFT JOIN v_demo d ON r.idhash = d.idhash""",
    "review_rank_pct": """
SELECT DISTINCT sid, region, top_category, review_pct_rank AS pct_click, review_top_display AS grade_click, pct_poi, grade_poi
FROM v_enriched LEFT JOIN v_poi_grade USING (sid)""",
    "sessions": """
SELECT idhash, CAST(session_id AS BIGINT) AS session_id, min(etimestamp) AS start_ts, max(etimestamp) AS end_ts, count(*) AS n_clicks,
       first(day_name ORDER BY etimestamp, event_id) AS day_name, first(query ORDER BY etimestamp, event_id) AS query,
       first(title ORDER BY etimestamp, event_id) AS title, first(top_category ORDER BY etimestamp, event_id) AS top_category,
       first(region ORDER BY etimestamp, event_id) AS region,
       first(review_top_display ORDER BY etimestamp, event_id) AS review_top_display
FROM v_session_rows GROUP BY idhash, session_id""",
    "place_sessions": f"""
SELECT idhash, sid, min(etimestamp) AS start_ts, max(etimestamp) AS end_ts, count(*) AS n_clicks
FROM (SELECT *, sum(opens) OVER (PARTITION BY idhash, sid ORDER BY etimestamp, event_id) AS visit
      FROM (SELECT *, CASE WHEN etimestamp - lag(etimestamp) OVER (PARTITION BY idhash, sid ORDER BY etimestamp, event_id) <= INTERVAL {SESSION_GAP_MINUTES} MINUTE
                           THEN 0 ELSE 1 END AS opens
            FROM v_clicks WHERE idhash IS NOT NULL AND sid IS NOT NULL AND event_id IS NOT NULL AND etimestamp IS NOT NULL))
GROUP BY idhash, sid, visit""",
    "reviews_for_day": f"""
SELECT idhash, review_id, review_group_id, place_id, created_date, text_review, concat(lang, ',', source) AS keywords
FROM v_reviews WHERE CAST(updated_time AS DATE) = DATE '{REVIEW_DAY}' AND idhash IN (FROM v_train_users)""",
    "review_clean": f"SELECT {REVIEW_COLUMNS} FROM v_clean",
    "review_dedup": f"SELECT {REVIEW_COLUMNS} FROM v_dedup",
    "review_rows": "FROM v_review_rows",
    "review_chunks": f"""
SELECT idhash, review_id, rn, (rn - 1) // {CHUNK} AS chunk, count(*) OVER (PARTITION BY idhash) AS n_reviews
FROM (SELECT *, row_number() OVER (PARTITION BY idhash ORDER BY created_date DESC, place_id DESC, review_id DESC) AS rn FROM v_dedup)""",
    "review_quality": "FROM v_quality",
    "review_eligible": """
WITH long AS (SELECT d.*, top_category FROM v_dedup d LEFT JOIN v_poi_cat p ON d.place_id = p.place_id WHERE length(text_review) >= 30)
SELECT idhash, review_id FROM long
WHERE idhash IN (SELECT idhash FROM long GROUP BY idhash HAVING count(*) >= 3 AND count(DISTINCT top_category) >= 2)""",
    "review_sample": """
SELECT idhash, review_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY idhash ORDER BY score DESC, review_id) AS rank FROM v_quality) WHERE rank <= 10""",
}
ORACLE = {name: statement(sql) for name, sql in ORACLE.items()}
