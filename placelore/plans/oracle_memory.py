"""SQL of the queries in ``queries_memory``."""

from __future__ import annotations

from datetime import timedelta

from placelore.operators.context import KEYWORDS_LABEL, SUMMARY_LABEL, USER_INFO_LABEL
from placelore.operators.evaluate import METRICS
from placelore.plans.oracle_base import IN_TEST
from placelore.plans.oracle_eval import TOKEN, tokens
from placelore.plans.settings import *  # noqa: F403
from placelore.plans.sql import same_over, statement, view

W = WINDOWS


def level(path: str) -> str:
    return f"len(string_split({path}, ' > '))"


def prefix(path: str, n: int) -> str:
    return f"array_to_string(string_split({path}, ' > ')[1:{n}], ' > ')"


def parent(path: str) -> str:
    return f"array_to_string(string_split({path}, ' > ')[1:-2], ' > ')"


view("v_taxonomy", """
SELECT 'root' AS path UNION SELECT concat('root > ', p_type) FROM part
UNION SELECT concat('root > ', p_type, ' > ', p_brand) FROM part WHERE regexp_matches(p_brand, '^Brand#[1-9]$')
""")
view("v_implicit_daily", """
SELECT idhash, string_split(title, ' ')[-1] AS item, category_path AS path,
       CASE WHEN action = 'error' THEN -1 ELSE 1 END AS polarity, datestr, count(*) AS support
FROM v_clicks JOIN v_poi USING (sid) GROUP BY ALL
""")
view("v_profile", f"""
SELECT c.idhash, 'user_info' AS axis, unnest([{", ".join(f"concat('{a}: ', {a})" for a in ATTRIBUTES)}]) AS item, 'root' AS path,
       CAST(1 AS BIGINT) AS polarity, c.datestr, CAST(1 AS BIGINT) AS support
FROM v_demo d JOIN (SELECT idhash, min(datestr) AS datestr FROM v_clicks GROUP BY idhash) c ON c.idhash = d.idhash
UNION ALL
SELECT idhash, 'explicit', item, path, polarity, datestr, count(*) FROM (
  SELECT idhash, unnest(list_distinct([lang, source])) AS item, category_path AS path,
         CAST(CASE WHEN is_negative THEN -1 ELSE 1 END AS BIGINT) AS polarity, created_date AS datestr
  FROM v_dedup r JOIN v_poi p ON r.place_id = p.place_id) GROUP BY ALL
UNION ALL
SELECT idhash, 'implicit', item, path, CAST(polarity AS BIGINT), datestr, support FROM v_implicit_daily
WHERE (idhash, item) IN (SELECT (idhash, item) FROM v_implicit_daily GROUP BY idhash, item
                         HAVING sum(support) >= 3 AND count(DISTINCT datestr) >= 2)
""")


def routed(name: str, items: str, existing: str | None) -> None:
    """Views ``name`` (routed items) and helpers; ``existing`` is a view with (idhash, path, item)."""
    held = existing or "(SELECT NULL::BIGINT AS idhash, NULL::VARCHAR AS path, NULL::VARCHAR AS item WHERE false)"
    view(f"{name}_wanted", f"SELECT DISTINCT idhash, path, item FROM {items} WHERE axis <> 'user_info'")
    view(f"{name}_groups", f"""
SELECT g.*, {prefix('g.path', 2)} AS domain,
       EXISTS (SELECT 1 FROM {held} e WHERE e.idhash = g.idhash AND e.path = g.path) AS known,
       g.path IN (FROM v_taxonomy) AS listed, {prefix('g.path', 2)} IN (SELECT path FROM v_taxonomy WHERE {level('path')} = 2) AS in_domain
FROM (SELECT idhash, path, count(*) AS n FROM {name}_wanted GROUP BY ALL) g
""")
    view(f"{name}_best", f"""
SELECT idhash, path, sibling FROM (
  SELECT *, row_number() OVER (PARTITION BY idhash, path ORDER BY shared DESC, sibling) AS rn FROM (
    SELECT w.idhash, w.path, e.path AS sibling, g.n, count(DISTINCT w.item) AS shared
    FROM {name}_wanted w JOIN {name}_groups g ON g.idhash = w.idhash AND g.path = w.path
    JOIN {held} e ON e.idhash = w.idhash AND e.item = w.item AND {level('e.path')} = 3 AND {prefix('e.path', 2)} = g.domain
    WHERE NOT known AND NOT listed AND in_domain AND {level('g.path')} = 3 GROUP BY ALL)
  WHERE shared >= 0.5 * n) WHERE rn = 1
""")
    view(f"{name}_route", f"""
SELECT g.*, sibling, CASE WHEN known THEN 'existing' WHEN listed THEN 'taxonomy' WHEN sibling IS NOT NULL THEN 'sibling'
       WHEN in_domain AND {level('g.path')} = 3 AND n >= 2 THEN 'new' WHEN in_domain THEN 'domain' ELSE 'fallback' END AS route
FROM {name}_groups g LEFT JOIN {name}_best b ON b.idhash = g.idhash AND b.path = g.path
""")
    view(name, f"""
SELECT i.idhash, i.axis, i.item, i.polarity, i.datestr, i.support,
       CASE WHEN axis = 'user_info' THEN 'root' WHEN route = 'sibling' THEN sibling WHEN route = 'domain' THEN domain
            WHEN route = 'fallback' THEN 'root' ELSE i.path END AS path,
       CASE WHEN axis = 'user_info' THEN 'demographics' ELSE route END AS route
FROM {items} i LEFT JOIN {name}_route r ON i.axis <> 'user_info' AND r.idhash = i.idhash AND r.path = i.path
""")


def routed_daily(name: str, items: str) -> None:
    """View ``name``: the days of ``items`` routed one after the other, each against the notes of the days before."""
    days = [FIRST_DAY + timedelta(days=n) for n in range((LAST_DAY - FIRST_DAY).days + 1)]
    for n, day in enumerate(days):
        view(f"{name}_in{n}", f"SELECT * FROM {items} WHERE datestr = DATE '{day}'")
        if n > 1:
            view(f"{name}_held{n}", f"SELECT * FROM {name}_held{n - 1} UNION SELECT idhash, path, item FROM {name}_day{n - 1}")
        elif n:
            view(f"{name}_held1", f"SELECT DISTINCT idhash, path, item FROM {name}_day0")
        routed(f"{name}_day{n}", f"{name}_in{n}", f"{name}_held{n}" if n else None)
    view(name, " UNION ALL ".join(f"SELECT * FROM {name}_day{n}" for n in range(len(days))))


RANK = "CASE axis WHEN 'user_info' THEN 3 WHEN 'explicit' THEN 2 ELSE 1 END"


def state(name: str, source: str, key: str = "idhash") -> None:
    """Views ``name``_items and ``name``_notes: the day-by-day fold without backward pass, in closed form."""
    view(f"{name}_days", f"""
SELECT {key}, path, item, datestr, max(rank * 10 + polarity) AS value, sum(support) AS support
FROM (SELECT *, {RANK} AS rank FROM {source}) GROUP BY ALL
""")
    view(f"{name}_line", f"""
SELECT *, lag(value) OVER (PARTITION BY {key}, path, item ORDER BY datestr) AS before FROM {name}_days
""")
    view(f"{name}_items", f"""
SELECT {key}, path, item, CASE WHEN v > 25 THEN 'user_info' WHEN v > 15 THEN 'explicit' ELSE 'implicit' END AS axis,
       CAST(CASE WHEN v % 10 = 1 THEN 1 ELSE -1 END AS BIGINT) AS polarity, last_seen, support
FROM (SELECT {key}, path, item, arg_max(value, datestr) AS v, max(datestr) AS last_seen, CAST(sum(support) AS BIGINT) AS support
      FROM {name}_days GROUP BY ALL)
""")
    view(f"{name}_notes", f"""
SELECT {key}, path, count(DISTINCT datestr) AS updated_count, max(datestr) AS recently_updated
FROM {name}_line WHERE before IS NULL OR before <> value GROUP BY ALL
""")


def with_content(notes: str, items: str) -> str:
    return f"""
SELECT n.idhash, n.path, n.updated_count, n.recently_updated, coalesce(content, '') AS content
FROM {notes} n LEFT JOIN (
  SELECT idhash, path, string_agg(concat(axis, ':', item, ':', polarity), ', ' ORDER BY concat(axis, ':', item, ':', polarity)) AS content
  FROM {items} GROUP BY idhash, path) c ON c.idhash = n.idhash AND c.path = n.path"""


view("v_train_profile", f"SELECT * FROM v_profile WHERE datestr <= DATE '{W.train_end}'")
view("v_test_profile", f"SELECT * FROM v_profile WHERE {IN_TEST}")
view("v_day_profile", f"SELECT * FROM v_profile WHERE datestr = DATE '{W.test_start}'")
routed("v_rtrain", "v_train_profile", None)
state("v_train", "v_rtrain")
routed("v_rtest", "v_test_profile", "v_train_items")
routed("v_rday", "v_day_profile", "v_train_items")
view("v_rupto", "SELECT * FROM v_rtrain UNION ALL SELECT * FROM v_rday")
state("v_upto", "v_rupto")
view("v_rafter", "SELECT * FROM v_rtrain UNION ALL SELECT * FROM v_rtest")
state("v_after", "v_rafter")
routed_daily("v_rall", "v_profile")
state("v_all", "v_rall")
view("v_rbase", "SELECT * FROM v_rall WHERE path IN (FROM v_taxonomy)")
state("v_base", "v_rbase")

# lifting, one level at a time
def collapsed(source: str) -> str:
    best = f"ORDER BY last_seen DESC, {RANK} DESC, polarity DESC"
    return f"""
SELECT idhash, new_path AS path, item, first(axis {best}) AS axis, first(polarity {best}) AS polarity,
       max(last_seen) AS last_seen, CAST(sum(support) AS BIGINT) AS support
FROM {source} GROUP BY idhash, new_path, item"""


def lifted(name: str, items: str, notes: str) -> None:
    """Views ``name``_items and ``name``_notes: traits of two siblings move to the parent, from the third level up."""
    for source, lv, out in ((items, 3, f"{name}_3"), (f"{name}_3", 2, f"{name}_items")):
        view(f"{name}_up{lv}", f"""
SELECT *, CASE WHEN {level('path')} = {lv} AND count(*) OVER (PARTITION BY idhash, {parent('path')}, item, polarity) >= 2
          THEN {parent('path')} ELSE path END AS new_path
FROM {source}
""")
        view(out, collapsed(f"{name}_up{lv}"))
    view(f"{name}_notes", f"""
SELECT idhash, path, updated_count, recently_updated FROM {notes}
UNION ALL
SELECT idhash, path, 1, max(last_seen) FROM {name}_items
WHERE (idhash, path) NOT IN (SELECT (idhash, path) FROM {notes}) GROUP BY idhash, path
""")


STALE = f"(updated_count <= 2 AND DATE '{LAST_DAY}' - recently_updated > {MAX_AGE})"


def pruned(name: str, items: str, notes: str) -> None:
    """Views ``name``_notes and ``name``_items without stale leaves."""
    view(f"{name}3", f"SELECT * FROM {notes} WHERE NOT ({level('path')} = 3 AND {STALE})")
    view(f"{name}_notes", f"""
SELECT * FROM {name}3 p WHERE NOT ({level('path')} = 2 AND {STALE}
  AND NOT EXISTS (SELECT 1 FROM {name}3 c WHERE c.idhash = p.idhash AND {level('c.path')} = 3 AND {parent('c.path')} = p.path))
""")
    view(f"{name}_items", f"SELECT * FROM {items} WHERE (idhash, path) IN (SELECT (idhash, path) FROM {name}_notes)")


lifted("v_lift", "v_all_items", "v_all_notes")
pruned("v_prune", "v_all_items", "v_all_notes")


# merging siblings
def leaf_elements(name: str, items: str, notes: str, key: str) -> None:
    view(f"{name}_leaves", f"""
SELECT * FROM {notes} n WHERE {level('path')} > 1
  AND ({key}, path) NOT IN (SELECT ({key}, {parent('path')}) FROM {notes} WHERE {level('path')} > 1)
""")
    view(name, f"""
SELECT {', '.join('i.' + k.strip() for k in key.split(','))}, {parent('i.path')} AS parent, i.path, l.updated_count, concat(item, '|', polarity) AS element,
       count(*) OVER (PARTITION BY {', '.join('i.' + k.strip() for k in key.split(','))}, i.path) AS n
FROM {items} i JOIN {name}_leaves l ON {' AND '.join(f'i.{k.strip()} = l.{k.strip()}' for k in key.split(','))} AND i.path = l.path
""")
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    keys_a = ", ".join(f"a.{k.strip()}" for k in key.split(","))
    view(f"{name}_pairs", f"""
SELECT {keys_a}, a.parent, a.path AS path_a, b.path AS path_b, count(*) / CAST(any_value(a.n + b.n) - count(*) AS DOUBLE) AS jaccard,
       any_value(a.updated_count) AS count_a, any_value(b.updated_count) AS count_b
FROM {name} a JOIN {name} b ON {same} AND a.parent = b.parent AND a.element = b.element AND a.path <> b.path
GROUP BY {keys_a}, a.parent, a.path, b.path
""")


def merged(name: str, items: str, notes: str, key: str) -> None:
    """Views ``name``_moves (full merges), ``name``_items and ``name``_notes (after partial merges)."""
    ks = [k.strip() for k in key.split(",")]

    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)

    leaf_elements(f"{name}_el", items, notes, key)
    # UNION drops repeated rows, so the recursion ends when nothing new is reached
    view(f"{name}_reach", f"""
SELECT {key}, path_a AS path, path_b AS other FROM {name}_el_pairs WHERE jaccard >= 0.5
UNION
SELECT {', '.join('r.' + k for k in ks)}, r.path, p.path_b FROM {name}_reach r JOIN {name}_el_pairs p ON {on('r', 'p')} AND r.other = p.path_a AND p.jaccard >= 0.5
""")
    view(f"{name}_moves", f"""
SELECT {', '.join('r.' + k for k in ks)}, r.path, arg_min(r.other, (-n.updated_count, r.other)) AS target
FROM {name}_reach r JOIN {notes} n ON {on('r', 'n')} AND r.other = n.path
GROUP BY {', '.join('r.' + k for k in ks)}, r.path HAVING r.path <> target
""")
    best = f"ORDER BY last_seen DESC, {RANK} DESC, polarity DESC"
    view(f"{name}_full", f"""
SELECT {', '.join('i.' + k for k in ks)}, coalesce(target, i.path) AS path, item, first(axis {best}) AS axis, first(polarity {best}) AS polarity,
       max(last_seen) AS last_seen, CAST(sum(support) AS BIGINT) AS support
FROM {items} i LEFT JOIN {name}_moves m ON {on('i', 'm')} AND i.path = m.path GROUP BY {', '.join('i.' + k for k in ks)}, coalesce(target, i.path), item
""")
    view(f"{name}_notes", f"""
SELECT {', '.join('i.' + k for k in ks)}, coalesce(target, i.path) AS path, CAST(sum(updated_count) AS BIGINT) AS updated_count, max(recently_updated) AS recently_updated
FROM {notes} i LEFT JOIN {name}_moves m ON {on('i', 'm')} AND i.path = m.path GROUP BY {', '.join('i.' + k for k in ks)}, coalesce(target, i.path)
""")
    leaf_elements(f"{name}_pel", f"{name}_full", f"{name}_notes", key)
    view(f"{name}_pmoves", f"""
SELECT {', '.join('p.' + k for k in ks)}, p.path_a AS path, a.element, arg_min(p.path_b, (-p.count_b, p.path_b)) AS target
FROM {name}_pel_pairs p JOIN {name}_pel a ON {on('p', 'a')} AND a.path = p.path_a
JOIN {name}_pel b ON {on('p', 'b')} AND b.path = p.path_b AND b.element = a.element
WHERE p.jaccard >= 0.25 AND p.jaccard < 0.5 AND (count_b > count_a OR (count_b = count_a AND path_b < path_a))
GROUP BY {', '.join('p.' + k for k in ks)}, p.path_a, a.element
""")
    view(f"{name}_items", f"""
SELECT {', '.join('i.' + k for k in ks)}, coalesce(target, i.path) AS path, item, first(axis {best}) AS axis, first(polarity {best}) AS polarity,
       max(last_seen) AS last_seen, CAST(sum(support) AS BIGINT) AS support
FROM {name}_full i LEFT JOIN {name}_pmoves m ON {on('i', 'm')} AND i.path = m.path AND concat(item, '|', polarity) = m.element
GROUP BY {', '.join('i.' + k for k in ks)}, coalesce(target, i.path), item
""")


merged("v_merge", "v_all_items", "v_all_notes", "idhash")
# one whole consolidation: merge, lift, prune
lifted("v_bpl", "v_merge_items", "v_merge_notes")
pruned("v_bp", "v_bpl_items", "v_bpl_notes")

# formatted notes and budget
view("v_health_profile", f"""
SELECT p.*, run_date FROM v_profile p JOIN (SELECT unnest([{', '.join(f"DATE '{x}'" for x in HEALTH_DATES)}]) AS run_date) ON datestr <= run_date
""")


def formatted(name: str, notes: str, items: str) -> None:
    def names(condition: str) -> str:
        return f"coalesce(string_agg(item, ', ' ORDER BY item) FILTER ({condition}), '')"

    view(f"{name}_content", f"""
SELECT n.idhash, n.path, {names("axis <> 'user_info' AND polarity > 0")} AS likes, {names("axis <> 'user_info' AND polarity < 0")} AS dislikes,
       {names("axis = 'user_info'")} AS user_info, {names("axis <> 'user_info'")} AS keywords
FROM {notes} n LEFT JOIN {items} i ON i.idhash = n.idhash AND i.path = n.path GROUP BY n.idhash, n.path
""")
    view(f"{name}_text", f"""
SELECT idhash, path, row_number() OVER (PARTITION BY idhash ORDER BY string_split(path, ' > ')) AS dfs, {level('path')} AS depth,
       concat('[', path, ']', chr(10), '{SUMMARY_LABEL}: ', concat_ws('; ', CASE WHEN likes <> '' THEN concat('likes ', likes) END,
              CASE WHEN dislikes <> '' THEN concat('dislikes ', dislikes) END), chr(10), '{USER_INFO_LABEL}: ', user_info, chr(10),
              '{KEYWORDS_LABEL}: ', keywords, chr(10)) AS text
FROM {name}_content
""")
    view(f"{name}_tokens", f"""
SELECT *, sum(tokens) OVER (PARTITION BY idhash)
          - coalesce(sum(tokens) OVER (PARTITION BY idhash ORDER BY depth DESC, dfs DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
FROM (SELECT *, {tokens('text')} AS tokens FROM {name}_text)
""")
    view(f"{name}_kept", f"SELECT idhash, path, text, dfs, depth, tokens FROM {name}_tokens WHERE depth = 1 OR remaining <= {BUDGET}")


formatted("v_fmt", "v_all_notes", "v_all_items")
formatted("v_bfmt", "v_base_notes", "v_base_items")
view("v_facts", """
SELECT idhash, path AS fact, item AS value, CAST(sum(support) AS BIGINT) AS support,
       row_number() OVER (PARTITION BY idhash ORDER BY sum(support) DESC, path, item) AS rank
FROM v_profile GROUP BY idhash, path, item QUALIFY rank <= 30
""")


def words(text: str) -> str:
    """All tokens in lower case, each between blanks."""
    return f"concat(' ', array_to_string(regexp_extract_all(lower({text}), '{TOKEN}'), ' '), ' ')"


def cut(text: str) -> str:
    return (
        f"CASE WHEN {tokens(text)} <= {BUDGET} THEN {text} "
        f"ELSE array_to_string(regexp_extract_all({text}, '\\s*(?:{TOKEN})')[1:{BUDGET}], '') END"
    )


# retrieval
view("v_purpose", """
SELECT idhash, concat_ws(' ', title, category_path) AS purpose FROM (
  SELECT *, row_number() OVER (PARTITION BY idhash ORDER BY etimestamp DESC, event_id DESC) AS rn FROM v_clicks) JOIN v_poi USING (sid)
WHERE rn = 1
""")
view("v_note_docs", """
SELECT n.idhash AS scope, n.path AS doc, concat_ws(' ', n.path, string_agg(item, ' ' ORDER BY item)) AS text
FROM v_all_notes n LEFT JOIN v_all_items i ON i.idhash = n.idhash AND i.path = n.path GROUP BY n.idhash, n.path
""")
view("v_note_queries", "SELECT idhash AS scope, idhash AS query, purpose AS text FROM v_purpose")


def bm25_views(name: str, docs: str, queries: str) -> None:
    view(f"{name}_tf", rf"""
SELECT scope, doc, term, count(*) AS tf FROM (SELECT scope, doc, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM {docs}) GROUP BY ALL
""")
    view(f"{name}_len", rf"SELECT scope, doc, len(regexp_extract_all(lower(text), '\w+')) AS length FROM {docs}")
    view(f"{name}_df", f"SELECT term, count(*) AS df FROM {name}_tf GROUP BY term")
    view(f"{name}_terms", rf"SELECT DISTINCT scope, query, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM {queries}")
    view(f"{name}_scores", f"""
SELECT query, scope, doc, round(sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / c.mean))), 6) AS score
FROM {name}_tf t JOIN {name}_terms q USING (scope, term) JOIN {name}_df USING (term) JOIN {name}_len USING (scope, doc)
CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean FROM {name}_len) c GROUP BY query, scope, doc
""")


bm25_views("v_nb", "v_note_docs", "v_note_queries")
view("v_paths_ranked", f"""
SELECT n.idhash, n.path, coalesce(s.score, 0.0) AS score,
       row_number() OVER (PARTITION BY n.idhash ORDER BY {level('n.path')} = 1 DESC, coalesce(s.score, 0.0) DESC, n.path) AS rank
FROM v_all_notes n LEFT JOIN v_nb_scores s ON s.scope = n.idhash AND s.doc = n.path WHERE n.idhash IN (SELECT idhash FROM v_purpose)
""")
view("v_paths", "SELECT * FROM v_paths_ranked WHERE rank <= 8 AND (score > 0 OR rank <= 3)")
view("v_traits", """
SELECT *, row_number() OVER (PARTITION BY idhash ORDER BY support DESC, item) AS rank,
       row_number() OVER (PARTITION BY idhash, observed ORDER BY support DESC, item) AS observed_rank
FROM (SELECT idhash, item, sum(support) AS support, bool_or(axis = 'implicit') AS observed FROM v_all_items
      WHERE axis <> 'user_info' AND polarity > 0 AND (idhash, path) IN (SELECT (idhash, path) FROM v_paths) GROUP BY idhash, item)
""")
view("v_queries_vec", "SELECT 0 AS scope, vec_id AS query FROM embeddings WHERE vec_id % 50 = 0")
view("v_dense", """
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
  SELECT q.query, e.vec_id AS doc, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS score
  FROM v_queries_vec q JOIN embeddings x ON x.vec_id = q.query JOIN embeddings e ON e.vec_id <> q.query)
""")
view("v_rrf_docs", "SELECT 0 AS scope, vec_id AS doc, text FROM embeddings JOIN documents ON doc_id = vec_id")
view("v_rrf_queries", "SELECT q.scope, q.query, d.text FROM v_queries_vec q JOIN documents d ON d.doc_id = q.query")
bm25_views("v_rb", "v_rrf_docs", "v_rrf_queries")
view("v_lexical", """
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM v_rb_scores WHERE doc <> query
""")
view("v_fused", """
SELECT query, doc, round(sum(1.0 / (60 + rank)), 6) AS score FROM (
  SELECT query, doc, rank FROM v_lexical UNION ALL SELECT query, doc, rank FROM v_dense) GROUP BY query, doc
""")
view("v_terms", f"SELECT idhash, path, item FROM v_all_items WHERE axis <> 'user_info' AND {level('path')} > 1")
view("v_links", f"""
SELECT a.idhash, a.path, b.path AS linked_path,
       count(*) / CAST((SELECT count(*) FROM v_terms x WHERE x.idhash = a.idhash AND x.path = a.path)
                     + (SELECT count(*) FROM v_terms y WHERE y.idhash = a.idhash AND y.path = b.path) - count(*) AS DOUBLE) AS score
FROM v_terms a JOIN v_terms b ON a.idhash = b.idhash AND a.item = b.item AND a.path <> b.path AND {prefix('a.path', 2)} <> {prefix('b.path', 2)}
GROUP BY a.idhash, a.path, b.path
""")

# versions
for _i, _day in enumerate(HEALTH_DATES):
    view(f"v_h{_i}_routed", f"SELECT * FROM v_rall WHERE datestr <= DATE '{_day}'")
    state(f"v_h{_i}", f"v_h{_i}_routed")
    merged(f"v_h{_i}m", f"v_h{_i}_items", f"v_h{_i}_notes", "idhash")
view("v_version_items", " UNION ".join(
    f"SELECT idhash, DATE '{day}' AS run_date, item, polarity FROM v_h{i}_items WHERE axis <> 'user_info'" for i, day in enumerate(HEALTH_DATES)
))
view("v_version_steps", """
SELECT idhash, run_date, lag(run_date) OVER (PARTITION BY idhash ORDER BY run_date) AS previous
FROM (SELECT DISTINCT idhash, run_date FROM v_version_items)
""")

# the experiment: contexts at the end of the train window, predictions, metrics
view("v_rexp", f"SELECT * FROM v_rall WHERE datestr <= DATE '{W.train_end}'")
state("v_exp", "v_rexp")
view("v_rexpbase", "SELECT * FROM v_rexp WHERE path IN (FROM v_taxonomy)")
state("v_expbase", "v_rexpbase")
formatted("v_expfmt", "v_exp_notes", "v_exp_items")
formatted("v_expbfmt", "v_expbase_notes", "v_expbase_items")
same_over("v_exp", ["v_facts"], {"v_profile": "v_train_profile"})
view("v_exp_contexts", f"""
SELECT variant, idhash, coalesce(context, '') AS context
FROM (SELECT unnest({UNCONSOLIDATED}) AS variant) CROSS JOIN v_train_users LEFT JOIN (
  SELECT 'full_context' AS variant, idhash, {cut('text')} AS context FROM (
    SELECT idhash, string_agg(text, chr(10) ORDER BY datestr) AS text FROM v_daily_text WHERE datestr <= DATE '{W.train_end}' GROUP BY idhash)
  UNION ALL SELECT 'flat_memory', idhash, {cut('text')} FROM (
    SELECT idhash, string_agg(concat('- ', fact, ': ', value), chr(10) ORDER BY rank) AS text FROM v_expv_facts GROUP BY idhash)
  UNION ALL SELECT 'fixed_hierarchy', idhash, string_agg(text, chr(10) ORDER BY dfs) FROM v_expbfmt_kept GROUP BY idhash
  UNION ALL SELECT 'ablation_backward', idhash, string_agg(text, chr(10) ORDER BY dfs) FROM v_expfmt_kept GROUP BY idhash
) USING (variant, idhash)
""")
view("v_exp_ranked", f"""
SELECT variant, idhash, category, pos FROM (
  SELECT c.variant, c.idhash, l.category,
         row_number() OVER (PARTITION BY c.variant, c.idhash
                            ORDER BY len([x for x in regexp_extract_all(context, '{LABEL_PATTERN}') if x = l.category]) DESC, place) - 1 AS pos
  FROM v_exp_contexts c CROSS JOIN v_labels l)
WHERE pos < 10
""")
same_over(
    "v_exp",
    ["v_hits", "v_metrics", "v_long", "v_pairs", "v_slots", "v_draws", "v_boot", "v_bootstrap", "v_cohen", "v_holm", "v_holm_rank"],
    {"v_ranked": "v_exp_ranked", "support": "ablation_backward"},
)

ORACLE = {
    "extract_profile": "FROM v_profile",
    "axis_filter": """
SELECT variant, idhash, axis, item, path, datestr FROM v_profile CROSS JOIN (SELECT unnest(['all', 'implicit_only', 'explicit_only']) AS variant)
WHERE NOT (variant = 'implicit_only' AND axis = 'explicit') AND NOT (variant = 'explicit_only' AND axis = 'implicit')""",
    "base_path_filter": "SELECT idhash, axis, item, path, datestr FROM v_profile WHERE path IN (FROM v_taxonomy)",
    "route_items": "SELECT DISTINCT idhash, axis, item, path, route FROM v_rtest",
    "assign_group": """
SELECT idhash, path, """ + ", ".join(
        f"coalesce(string_agg(DISTINCT item, ', ' ORDER BY item) FILTER (axis = '{a}'), '') AS {a}" for a in ("user_info", "explicit", "implicit")
    ) + " FROM v_rtest GROUP BY idhash, path",
    "demo_root_only": f"""
SELECT idhash, path, CASE WHEN {level('path')} = 1 THEN info ELSE '' END AS user_info,
       {level('path')} > 1 AND coalesce(info, '') <> '' AS violation
FROM (SELECT DISTINCT idhash, path FROM v_rtest)
LEFT JOIN (SELECT idhash, string_agg(DISTINCT item, ', ' ORDER BY item) AS info FROM v_profile WHERE axis = 'user_info' GROUP BY idhash) USING (idhash)""",
    "path_validate": f"""
SELECT path, CAST({level('path')} AS BIGINT) AS level, CASE WHEN path NOT LIKE 'root%' THEN 'unknown_root' WHEN {level('path')} > 3 THEN 'too_deep'
       WHEN {level('path')} = 3 AND {prefix('path', 2)} NOT IN (SELECT path FROM v_taxonomy WHERE {level('path')} = 2) THEN 'unknown_domain' ELSE '' END AS violation
FROM (SELECT category_path AS path FROM v_poi UNION SELECT concat(category_path, ' > ', title) FROM v_poi UNION SELECT concat('other > ', title) FROM v_poi)""",
    "update_notes": with_content("v_upto_notes", "v_upto_items"),
    "memory_closed_form": with_content("v_all_notes", "v_all_items"),
    "memory_ops": f"""
SELECT coalesce(o.idhash, n.idhash) AS idhash, coalesce(o.path, n.path) AS path, coalesce(o.item, n.item) AS item,
       CASE WHEN o.item IS NULL THEN 'ADD' WHEN n.item IS NULL OR (o.axis = n.axis AND o.polarity = n.polarity) THEN 'NO_CHANGE'
            WHEN o.polarity > 0 AND n.polarity < 0 THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM v_train_items o FULL JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idhash, path, item ORDER BY datestr DESC, {RANK} DESC, polarity DESC) AS rn FROM v_rtest) WHERE rn = 1
) n ON o.idhash = n.idhash AND o.path = n.path AND o.item = n.item""",
    "memory_upsert": "FROM v_after_items",
    "merge_siblings": with_content("v_merge_notes", "v_merge_items"),
    "lift_common_traits": with_content("v_lift_notes", "v_lift_items"),
    "compression_gain": """
SELECT idhash, items_before, chars_before, items_after, chars_after, items_before - items_after AS saved
FROM (SELECT idhash, count(*) AS items_before, CAST(sum(length(item)) AS BIGINT) AS chars_before FROM v_all_items GROUP BY idhash)
JOIN (SELECT idhash, count(*) AS items_after, CAST(sum(length(item)) AS BIGINT) AS chars_after FROM v_lift_items GROUP BY idhash) USING (idhash)""",
    "backward_pass": with_content("v_bp_notes", "v_bp_items"),
    "prune_stale": with_content("v_prune_notes", "v_prune_items"),
    "hierarchy_nodes": f"""
WITH nodes AS (SELECT DISTINCT idhash, unnest([{prefix('path', 1)}, {prefix('path', 2)}, {prefix('path', 3)}]) AS path FROM v_all_notes)
SELECT idhash, path, CAST({level('path')} AS BIGINT) AS level, CASE WHEN path <> 'root' THEN {parent('path')} END AS parent,
       coalesce((SELECT string_agg(string_split(c.path, ' > ')[-1], ', ' ORDER BY string_split(c.path, ' > ')[-1]) FROM nodes c
                 WHERE c.idhash = n.idhash AND c.path <> 'root' AND {parent('c.path')} = n.path), '') AS children
FROM nodes n""",
    "dfs_order": "SELECT idhash, path, row_number() OVER (PARTITION BY idhash ORDER BY string_split(path, ' > ')) AS dfs FROM v_all_notes",
    "budget_truncate": "SELECT * REPLACE (CAST(depth AS BIGINT) AS depth) FROM v_fmt_kept",
    "note_context": "SELECT idhash, string_agg(text, chr(10) ORDER BY dfs) AS context FROM v_fmt_kept GROUP BY idhash",
    "flat_top_facts": "FROM v_facts",
    "flat_memory": f"""
SELECT idhash, {cut('text')} AS context FROM (SELECT idhash, string_agg(concat('- ', fact, ': ', value), chr(10) ORDER BY rank) AS text FROM v_facts GROUP BY idhash)""",
    "full_context": f"SELECT idhash, {cut('text')} AS context FROM v_full_text",
    "item_recall_gap": f"""
SELECT idhash, n_items, round(full_found / n_items, 6) AS full_recall, round(notes_found / n_items, 6) AS structured_recall,
       round(notes_found / n_items - full_found / n_items, 6) AS gap
FROM (
  SELECT i.idhash, count(*) AS n_items, CAST(count(*) FILTER (contains(f.words, i.phrase)) AS DOUBLE) AS full_found,
         CAST(count(*) FILTER (contains(n.words, i.phrase)) AS DOUBLE) AS notes_found
  FROM (SELECT DISTINCT idhash, {words('item')} AS phrase FROM v_profile WHERE axis <> 'user_info' AND {tokens('item')} > 0) i
  LEFT JOIN (SELECT idhash, {words('context')} AS words FROM (SELECT idhash, {cut('text')} AS context FROM v_full_text)) f ON f.idhash = i.idhash
  LEFT JOIN (SELECT idhash, {words('context')} AS words
             FROM (SELECT idhash, string_agg(text, chr(10) ORDER BY dfs) AS context FROM v_fmt_kept GROUP BY idhash)) n ON n.idhash = i.idhash
  WHERE f.idhash IS NOT NULL OR n.idhash IS NOT NULL
  GROUP BY i.idhash)""",
    "fixed_hierarchy": "SELECT idhash, string_agg(text, chr(10) ORDER BY dfs) AS context FROM v_bfmt_kept GROUP BY idhash",
    "persona_paths": "FROM v_paths",
    "persona": f"""
SELECT idhash, concat('user with ', n, ' areas, mainly ', coalesce(main_path, '-')) AS overview, coalesce(traits, '') AS traits, coalesce(patterns, '') AS patterns
FROM (SELECT idhash, count(*) AS n, arg_min(path, rank) FILTER ({level('path')} > 1) AS main_path FROM v_paths GROUP BY idhash)
LEFT JOIN (SELECT idhash, string_agg(item, ', ' ORDER BY rank) FILTER (rank <= 5) AS traits,
                  string_agg(item, ', ' ORDER BY rank) FILTER (observed AND observed_rank <= 3) AS patterns FROM v_traits GROUP BY idhash) USING (idhash)""",
    "cross_links": f"SELECT idhash, path, linked_path, round(score, 6) AS score FROM v_links WHERE score >= {LINK_THRESHOLD}",
    "surprise_priority": f"""
SELECT idhash, path, item, round(novelty, 6) AS novelty, round(contradiction, 6) AS contradiction, round(novelty + contradiction, 6) AS score
FROM (
  SELECT n.idhash, n.path, n.item,
         -ln((coalesce(in_domain, 0) + 1) / CAST(coalesce(in_memory, 0) + (SELECT count(*) FROM v_taxonomy WHERE {level('path')} = 2) AS DOUBLE)) AS novelty,
         coalesce(CASE WHEN n.polarity > 0 THEN dislikes WHEN n.polarity < 0 THEN likes END, 0.0) / (1 + coalesce(likes, 0.0) + coalesce(dislikes, 0.0)) AS contradiction
  FROM (SELECT *, row_number() OVER (PARTITION BY idhash, path, item ORDER BY datestr DESC, {RANK} DESC, polarity DESC) AS rn
        FROM v_rtest WHERE axis <> 'user_info') n
  LEFT JOIN (SELECT idhash, {prefix('path', 2)} AS domain, sum(support) AS in_domain FROM v_train_items WHERE axis <> 'user_info' GROUP BY ALL) d
    ON d.idhash = n.idhash AND d.domain = {prefix('n.path', 2)}
  LEFT JOIN (SELECT idhash, sum(support) AS in_memory FROM v_train_items WHERE axis <> 'user_info' GROUP BY idhash) m ON m.idhash = n.idhash
  LEFT JOIN (
    SELECT idhash, item, coalesce(sum(weight) FILTER (polarity > 0), 0.0) AS likes, coalesce(sum(weight) FILTER (polarity < 0), 0.0) AS dislikes
    FROM (SELECT *, support * pow(0.5, greatest(DATE '{W.test_end}' - last_seen, 0) / CAST({HALF_LIFE} AS DOUBLE)) AS weight
          FROM v_train_items WHERE axis <> 'user_info') GROUP BY idhash, item) h ON h.idhash = n.idhash AND h.item = n.item
  WHERE n.rn = 1)""",
    "rerank": f"""
SELECT idhash, sid, score, row_number() OVER (PARTITION BY idhash ORDER BY score DESC, sid) AS rank FROM (
  SELECT c.idhash, c.sid, round(CAST(coalesce(sum(support * polarity * (CASE WHEN i.path = c.category_path AND {level('i.path')} = 3 THEN 1.0
         WHEN {level('i.path')} >= 2 AND {level('c.category_path')} >= 2 AND {prefix('i.path', 2)} = {prefix('c.category_path', 2)} THEN 0.5 ELSE 0.25 END)), 0.0) AS DOUBLE), 6) AS score
  FROM (SELECT DISTINCT idhash, sid, title, category_path FROM v_clicks JOIN v_poi USING (sid) WHERE {IN_TEST}) c
  LEFT JOIN v_train_items i ON i.idhash = c.idhash AND i.axis <> 'user_info' AND list_contains(string_split(c.title, ' '), i.item)
  GROUP BY c.idhash, c.sid)""",
    "persona_consistency": """
SELECT idhash, run_date, round(shared / CAST(n + n_previous - shared AS DOUBLE), 6) AS consistency FROM (
  SELECT s.idhash, s.run_date, (SELECT count(*) FROM v_version_items a WHERE a.idhash = s.idhash AND a.run_date = s.run_date) AS n,
         (SELECT count(*) FROM v_version_items b WHERE b.idhash = s.idhash AND b.run_date = s.previous) AS n_previous,
         (SELECT count(*) FROM v_version_items a JOIN v_version_items b ON a.idhash = b.idhash AND a.item = b.item AND a.polarity = b.polarity
          WHERE a.idhash = s.idhash AND a.run_date = s.run_date AND b.run_date = s.previous) AS shared
  FROM v_version_steps s WHERE previous IS NOT NULL)""",
    "structural_health": " UNION ALL ".join(f"""
SELECT DATE '{day}' AS run_date, round(avg({level('path')}), 6) AS mean_depth, round(count(*) / CAST(count(DISTINCT idhash) AS DOUBLE), 6) AS nodes_per_user,
       round(avg(CASE WHEN updated_count <= 2 AND DATE '{day}' - recently_updated > {MAX_AGE} THEN 1.0 ELSE 0.0 END)
         FILTER (NOT EXISTS (SELECT 1 FROM v_h{i}_notes c WHERE c.idhash = t.idhash AND starts_with(c.path, t.path || ' > '))), 6) AS stale_ratio,
       round((SELECT count(*) FROM v_h{i}m_moves) / CAST(count(*) AS DOUBLE), 6) AS merge_rate
FROM v_h{i}_notes t""" for i, day in enumerate(HEALTH_DATES)),
    "bm25": """
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM v_nb_scores QUALIFY rank <= 10""",
    "dense_topk": "SELECT query, doc, score, rank FROM v_dense WHERE rank <= 10",
    "rrf": "SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM v_fused QUALIFY rank <= 10",
}
ORACLE |= {
    "experiment_results": f"SELECT variant, idhash, {', '.join(chr(34) + m + chr(34) for m in METRICS)} FROM v_expv_metrics",
    "experiment_summary": """
SELECT variant, metric, count(*) AS n_users, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM v_expv_long GROUP BY ALL""",
    "experiment_comparison": """
SELECT variant, metric, baseline_mean, variant_mean, mean_diff, ci_lower, ci_upper, p_value, cohens_d, significant
FROM v_expv_bootstrap JOIN v_expv_cohen USING (variant, metric)
JOIN (SELECT variant, metric, significant FROM v_expv_holm) USING (variant, metric)""",
    "experiment_gap": """
SELECT idhash, metric, value AS full_value, baseline AS structured_value, round(baseline - value, 6) AS gap
FROM v_expv_pairs WHERE variant = 'full_context'""",
}
ORACLE = {name: statement(sql) for name, sql in ORACLE.items()}
