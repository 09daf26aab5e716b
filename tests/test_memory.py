import random
from datetime import date, timedelta
from itertools import combinations
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage, shared_folder
from placelore.operators import backward, context, evaluate, memory, notes, persona, profile, routing, variants

D = date(2024, 1, 1)
ITEMS = "idhash bigint, path string, item string, axis string, polarity bigint, last_seen date, support bigint"
NOTES = "idhash bigint, path string, updated_count bigint, recently_updated date"
DAILY = "idhash bigint, axis string, item string, path string, polarity bigint, datestr date, support bigint"
NEW_ITEMS = "idhash bigint, axis string, item string, path string, polarity int, datestr date"
TAXONOMY = ["root", "root > Dining", "root > Dining > Korean", "root > Dining > Chinese", "root > Sports", "root > Sports > Tennis"]


def day(n):
    return D + timedelta(days=n)


def daily(spark, rows):
    """rows: (user, axis, item, path, polarity, day number)"""
    return spark.createDataFrame([(*r[:5], day(r[5]), 1) for r in rows], DAILY)


def state(spark, content, counts=None, seen=0):
    """content: {path: [items]} of user 1"""
    counts = counts or {}
    items = [(1, p, i, "implicit", 1, day(seen), 1) for p, names in content.items() for i in names]
    tree = [(1, p, *counts.get(p, (1, day(seen)))) for p in content]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(tree, NOTES)


def content_of(items):
    out = {}
    for r in items.collect():
        out.setdefault(r.path, set()).add(r.item)
    return out


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([(p,) for p in TAXONOMY], "path string")


def tables(*dfs):
    return [sorted(map(tuple, df.select(sorted(df.columns)).collect())) for df in dfs]


# -- forward ------------------------------------------------------------------------------


def test_newer_information_wins_and_only_changes_count(spark):
    p = "root > Dining"
    rows = [
        (1, "implicit", "spicy", p, 1, 0),
        (1, "implicit", "spicy", p, 1, 1),  # known: no change
        (1, "implicit", "spicy", p, -1, 2),  # turned around
        (1, "explicit", "spicy", p, 1, 2),  # same day: the stated preference wins
        (1, "implicit", "soup", p, 1, 3),
    ]
    items, tree = notes.apply_batch(daily(spark, rows))
    spicy = items.filter("item = 'spicy'").first()
    assert (spicy.axis, spicy.polarity, spicy.last_seen, spicy.support) == ("explicit", 1, day(2), 4)
    assert tuple(tree.first())[2:] == (3, day(3))


def test_same_batch_twice_changes_no_note(spark):
    batch = daily(spark, [(1, "implicit", "a", "root", 1, 0), (1, "explicit", "b", "root", -1, 1)])
    items, tree = notes.apply_batch(batch)
    again_items, again = notes.apply_batch(batch, items, tree)
    assert tables(tree) == tables(again)
    assert tables(items.drop("support")) == tables(again_items.drop("support"))


def test_late_rows_do_not_override_newer_state(spark):
    items, tree = notes.apply_batch(daily(spark, [(1, "implicit", "a", "root", 1, 5)]))
    late = daily(spark, [(1, "explicit", "a", "root", -1, 3)])
    new_items, new_tree = notes.apply_batch(late, items, tree)
    assert new_items.first().polarity == 1 and tables(tree) == tables(new_tree)


def random_daily(spark, seed, n=250):
    rng = random.Random(seed)
    rows = {
        (rng.randrange(3), rng.choice(["implicit", "explicit"]), rng.choice("abcdef"), rng.choice(TAXONOMY), rng.choice([1, 1, -1]), rng.randrange(12))
        for _ in range(n)
    }
    return daily(spark, sorted(rows))


def test_closed_form_equals_updating_day_by_day(spark, taxonomy):
    rows = random_daily(spark, 5).cache()
    items = tree = None
    for d in range(12):
        items, tree = map(cut_lineage, notes.apply_batch(rows.filter(F.col("datestr") == F.lit(day(d))), items, tree, materialize=cut_lineage))
    assert tables(*memory.memory_closed_form(rows, taxonomy)) == tables(items, tree)


def test_fold_without_backward_equals_closed_form(spark, taxonomy):
    rows = random_daily(spark, 6).cache()
    options = memory.MemoryOptions(backward_every=5, backward=F.lit(False))
    items, tree, logs = memory.build_memory(rows, taxonomy, D, day(11), options=options)
    assert tables(items, tree) == tables(*memory.memory_closed_form(rows, taxonomy))


def folded_by_tables(items, taxonomy, end, keys, options):
    """The fold with the operators on tables, period by period."""
    state, logs, first = None, [], 0
    while first <= end:
        last = min(first + options.backward_every - 1, end)
        batch = cut_lineage(items.filter(F.col("datestr").between(F.lit(day(first)), F.lit(day(last)))))
        old_items, old_notes = state or (None, None)
        existing = old_items if state else batch.select(*keys, "path", "item").limit(0)
        routed = routing.route_over_time(batch, taxonomy, existing, keys, with_route=False)
        routed = routed.filter(options.dynamic).unionByName(routing.base_path_filter(routed.filter(~options.dynamic), taxonomy).select(routed.columns))
        new = [cut_lineage(df) for df in notes.apply_batch(routed, old_items, old_notes, keys, cut_lineage)]
        if state:
            active = cut_lineage(batch.select(keys).distinct().join(old_notes.select(keys).distinct(), keys).filter(options.backward))
            done = backward.backward_pass(
                *[df.join(active, keys, "left_semi") for df in new], day(last), keys, options.lift, options.tau, options.min_updates, options.max_age
            )
            new = [cut_lineage(df.join(active, keys, "left_anti").unionByName(done_df.select(df.columns))) for df, done_df in zip(new, done)]
            logs.append(cut_lineage(done[2].withColumn("run_date", F.lit(day(last)))))
        state = new
        first = last + 1
    return *state, logs


@pytest.mark.parametrize("every", [1, 3])
def test_stream_of_days_equals_the_operators_on_tables(spark, taxonomy, every):
    """A user, words and polarities that are NULL; presets as switches."""
    rng = random.Random(every)
    users, paths, words = [0, 1, 2, 3, 4, 5, None], [*TAXONOMY, *UNLISTED, "root > Nowhere > X"], [*"abcdefghij", None]
    rows = {
        (rng.choice(users), rng.choice(["implicit", "explicit", "user_info"]), rng.choice(words), rng.choice(paths), rng.choice([1, 1, 1, -1, None]), d)
        for d in range(5) for _ in range(40)
    }
    items = daily(spark, sorted(rows, key=str)).withColumn("variant", F.explode(F.array(*map(F.lit, "pqrs")))).filter("rand(3) < 0.9")
    items = cut_lineage(items)
    flag = F.col("variant")
    options = memory.MemoryOptions(
        backward_every=every, dynamic=flag != "q", backward=flag != "r", lift=flag != "s", tau=0.4, min_updates=2, max_age=2
    )
    keys = ["variant", "idhash"]
    *want, want_logs = folded_by_tables(items, taxonomy, 4, keys, options)
    folder = Path(urlparse(shared_folder(spark)).path)
    before = len(list(folder.iterdir()))
    *got, got_logs = memory.build_memory(items, taxonomy, D, day(4), keys, options)
    assert len(list(folder.iterdir())) - before == 2  # paths and result, however many periods there are
    for one, other in zip((*got, *got_logs), (*want, *want_logs), strict=True):
        assert sorted(map(str, one.select(other.columns).collect())) == sorted(map(str, other.collect()))


UNLISTED = ["root > Dining > New", "root > Dining > Other", "root > Dining > Third", "root > Space > Moon", "root > Dining"]


@pytest.mark.parametrize("seed", [1, 2])
def test_routing_over_time_equals_routing_day_by_day(spark, taxonomy, seed):
    rng = random.Random(seed)
    rows = {
        (rng.randrange(2), rng.choice(["implicit", "explicit"]), rng.choice("abcdefgh"), rng.choice(UNLISTED * 2 + TAXONOMY), 1, rng.randrange(6))
        for _ in range(90)
    }
    rows = cut_lineage(daily(spark, sorted(rows)))
    state = tree = None
    want = []
    for d in range(6):
        batch = rows.filter(F.col("datestr") == F.lit(day(d)))
        existing = state if state is not None else rows.select("idhash", "path", "item").limit(0)
        routed = cut_lineage(routing.route_items(batch, taxonomy, existing))
        want.append(routed)
        state, tree = map(cut_lineage, notes.apply_batch(routed, state, tree, materialize=cut_lineage))
    got = routing.route_over_time(rows, taxonomy, rows.select("idhash", "path", "item").limit(0))
    everything = want[0]
    for part in want[1:]:
        everything = everything.unionByName(part)
    assert sorted(map(str, got.select(everything.columns).collect())) == sorted(map(str, everything.collect()))
    assert {"new", "sibling", "existing", "taxonomy", "domain"} <= {r.route for r in got.collect()}
    assert tables(*memory.memory_closed_form(rows, taxonomy)) == tables(state, tree)
    halves = cut_lineage(routing.route_over_time(rows.filter(F.col("datestr") < F.lit(day(3))), taxonomy, existing.limit(0)))
    later = routing.route_over_time(rows.filter(F.col("datestr") >= F.lit(day(3))), taxonomy, halves.select("idhash", "path", "item").distinct())
    both = halves.unionByName(later.select(halves.columns))
    assert sorted(map(str, both.select(everything.columns).collect())) == sorted(map(str, everything.collect()))


# -- routing ------------------------------------------------------------------------------


def test_routing_rules_in_order(spark, taxonomy):
    existing = spark.createDataFrame(
        [(1, "root > Dining > Thai", "curry"), (1, "root > Dining > Thai", "rice"), (1, "root > Zoo > Cats", "cat")],
        "idhash bigint, path string, item string",
    )
    rows = [
        (1, "user_info", "age: 3", "root > Dining", 1, 0),
        (1, "implicit", "cat", "root > Zoo > Cats", 1, 0),
        (1, "implicit", "x", "root > Dining > Korean", 1, 0),
        (1, "implicit", "curry", "root>Dining> Indian > Goa", 1, 0),
        (1, "implicit", "new", "root > Dining > Indian", 1, 0),
        (1, "implicit", "p", "root > Dining > French", 1, 0),
        (1, "implicit", "q", "root > Dining > French", 1, 0),
        (1, "implicit", "lonely", "root > Sports > Chess", 1, 0),
        (1, "implicit", "y", "root > Space", 1, 0),
    ]
    out = routing.route_items(daily(spark, rows), taxonomy, existing).collect()
    assert {r.item: (r.route, r.path) for r in out} == {
        "age: 3": ("demographics", "root"),
        "cat": ("existing", "root > Zoo > Cats"),
        "x": ("taxonomy", "root > Dining > Korean"),
        "curry": ("sibling", "root > Dining > Thai"),
        "new": ("sibling", "root > Dining > Thai"),
        "p": ("new", "root > Dining > French"),
        "q": ("new", "root > Dining > French"),
        "lonely": ("domain", "root > Sports"),
        "y": ("fallback", "root"),
    }
    assert len(out) == len(rows)


def test_hierarchy_has_implied_ancestors(spark):
    tree = spark.createDataFrame([(1, "root > A > b"), (1, "root > A > a"), (1, "root > C")], "idhash bigint, path string")
    out = {r.path: (r.level, r.parent, r.children) for r in routing.hierarchy_nodes(tree).collect()}
    assert out["root"] == (1, None, "A, C") and out["root > A"] == (2, "root", "a, b") and len(out) == 5


# -- backward -----------------------------------------------------------------------------


def test_lift_example(spark):
    items, tree = state(spark, {
        "root": [], "root > Dining": [], "root > Dining > Korean": ["spicy", "soup"],
        "root > Dining > Chinese": ["spicy"], "root > Sports": ["walk"],
    })
    lifted, tree2 = backward.lift_common_traits(items, tree)
    assert content_of(lifted) == {"root > Dining": {"spicy"}, "root > Dining > Korean": {"soup"}, "root > Sports": {"walk"}}
    assert tables(tree) == tables(tree2)  # the emptied child stays until pruned
    gain = backward.compression_gain(items, lifted).first()
    assert (gain.items_before, gain.items_after, gain.saved) == (4, 3, 1)


def test_traits_rise_to_the_root(spark):
    items, tree = state(spark, {f"root > {a} > {b}": ["x"] for a in "AB" for b in "cd"})
    lifted, tree2 = backward.lift_common_traits(items, tree)
    assert content_of(lifted) == {"root": {"x"}}
    assert "root" in {r.path for r in tree2.collect()}


def test_lift_leaves_no_shared_item_and_loses_none(spark):
    rng = random.Random(2)
    tree = {f"root > {a} > {b}": sorted(set(rng.choices("pqrstuv", k=3))) for a in "ABC" for b in "xyz"}
    items, nodes = state(spark, tree)
    after = content_of(backward.lift_common_traits(items, nodes)[0])
    assert set().union(*after.values()) == set().union(*map(set, tree.values()))
    for a, b in combinations(after, 2):
        if a.rsplit(" > ", 1)[0] == b.rsplit(" > ", 1)[0]:
            assert not after[a] & after[b]


def test_prune_cascades_and_needs_both_conditions(spark):
    old, fresh = day(0), day(200)
    items, tree = state(
        spark,
        {p: ["i"] for p in ("root", "root > A", "root > A > x", "root > B", "root > B > y", "root > C", "root > C > z")},
        {
            "root": (1, old), "root > A": (1, old), "root > A > x": (2, old), "root > B": (1, old), "root > B > y": (3, old),
            "root > C": (1, fresh), "root > C > z": (1, old),
        },
    )
    pruned_items, pruned = backward.prune_stale(items, tree, day(201))
    kept = {"root", "root > B", "root > B > y", "root > C"}
    assert {r.path for r in pruned.collect()} == kept == set(content_of(pruned_items))
    assert tables(*backward.prune_stale(pruned_items, pruned, day(201))) == tables(pruned_items, pruned)
    assert backward.prune_stale(items, tree, day(120))[1].count() == 7  # age 120 is not over 120


def test_merge_full_and_partial(spark):
    items, tree = state(
        spark,
        {
            "root > D > a": ["1", "2", "3"], "root > D > b": ["2", "3", "4"], "root > D > c": ["3", "8", "9"],
            "root > D > same1": ["m"], "root > D > same2": ["m"], "root > D > same3": ["m"], "root > D > alone": ["z"],
        },
        {"root > D > a": (2, day(1)), "root > D > b": (5, day(0)), "root > D > c": (1, day(0))},
    )
    merged, tree2, log = backward.merge_siblings(items, tree)
    # c shares one of six items with the merged note: below both thresholds
    assert content_of(merged) == {
        "root > D > b": {"1", "2", "3", "4"}, "root > D > c": {"3", "8", "9"}, "root > D > same1": {"m"}, "root > D > alone": {"z"},
    }
    assert {r.path: (r.updated_count, r.recently_updated) for r in tree2.collect()}["root > D > b"] == (7, day(1))
    assert {(r.path, r.target, r.kind) for r in log.collect()} == {
        ("root > D > a", "root > D > b", "full"), ("root > D > same2", "root > D > same1", "full"),
        ("root > D > same3", "root > D > same1", "full"),
    }
    items, tree = state(spark, {"root > D > a": ["1", "2", "3"], "root > D > b": ["2", "8", "9"]}, {"root > D > b": (5, day(0))})
    assert content_of(backward.merge_siblings(items, tree, partial=0.2)[0]) == {"root > D > a": {"1", "3"}, "root > D > b": {"2", "8", "9"}}


def test_only_leaves_merge(spark):
    items, tree = state(spark, {"root > A": ["x"], "root > A > k": ["y"], "root > B": ["x"]})
    assert backward.merge_siblings(items, tree)[2].count() == 0


def test_backward_pass_restricted_lift(spark):
    items, tree = state(spark, {"root > A > x": ["i", "p", "q"], "root > A > y": ["i", "r", "s"]})
    kept, _, _ = backward.backward_pass(items, tree, day(0), lift_where=F.lit(False), tau=0.9)
    lifted, _, _ = backward.backward_pass(items, tree, day(0), tau=0.9)
    assert "root > A" not in content_of(kept) and content_of(lifted)["root > A"] == {"i"}


# -- reading ------------------------------------------------------------------------------


def test_budget_example(spark):
    sizes = {"root": 40, "root > a": 30, "root > a > x": 20, "root > a > y": 25, "root > b": 10}
    formatted = spark.createDataFrame([(1, p, "w " * n) for p, n in sizes.items()], "idhash bigint, path string, text string")

    def kept(budget):
        return {r.path for r in context.budget_truncate(formatted, budget).collect()}

    assert kept(85) == {"root", "root > a", "root > b"}
    assert kept(125) == set(sizes)
    assert kept(0) == {"root"}


def test_depth_first_order(spark):
    paths = ["root", "root > a", "root > a > z", "root > a b", "root > b"]
    tree = spark.createDataFrame([(1, p) for p in reversed(paths)], "idhash bigint, path string")
    assert [r.path for r in context.dfs_order(tree).orderBy("dfs").collect()] == paths


def test_full_context_stops_at_the_budget(spark):
    rows = [(1, day(i), f"a{i} b{i} c{i}") for i in range(4)]
    texts = spark.createDataFrame(rows, "idhash bigint, datestr date, text string")
    assert context.full_context(texts, 5).first().context == "a0 b0 c0\na1 b1"
    assert context.full_context(texts, 6).first().context == "a0 b0 c0\na1 b1 c1"


def test_cross_links_against_all_pairs(spark):
    rng = random.Random(4)
    tree = {f"root > {a} > {b}": sorted(set(rng.choices("abcdefgh", k=rng.randrange(1, 6)))) for a in "XYZ" for b in "123"}
    for threshold in (0.3, 0.5, 1.0):
        expected = set()
        for p, q in combinations(tree, 2):
            a, b = set(tree[p]), set(tree[q])
            if p.split(" > ")[1] != q.split(" > ")[1] and len(a & b) / len(a | b) >= threshold:
                expected |= {(p, q), (q, p)}
        found = persona.cross_links(state(spark, tree)[0], threshold).collect()
        assert {(r.path, r.linked_path) for r in found} == expected and len(found) == len(expected)


def test_surprise_of_a_new_domain_is_higher(spark, taxonomy):
    items, _ = state(spark, {"root > Dining > Korean": ["a", "b"]})
    new = spark.createDataFrame(
        [(1, "implicit", "n", "root > Dining", 1, D), (1, "implicit", "n", "root > Sports", 1, D)], NEW_ITEMS
    )
    scores = {r.path: r for r in persona.surprise_priority(items, new, taxonomy, D).collect()}
    assert scores["root > Sports"].score > scores["root > Dining"].score > 0
    assert all(r.contradiction == 0 and r.score == r.novelty for r in scores.values())


def test_contradiction_weighs_the_opposite_by_support_and_age(spark):
    held = spark.createDataFrame(
        [
            (1, "root > A", "tea", "implicit", 1, D - timedelta(10), 8),
            (1, "root > B", "tea", "explicit", -1, D, 3),
            (1, "root > A", "jazz", "user_info", 1, D, 9),
            (2, "root > A", "tea", "implicit", 1, D + timedelta(5), 1),
        ],
        "idhash bigint, path string, item string, axis string, polarity int, last_seen date, support bigint",
    )
    new = spark.createDataFrame(
        [
            (1, "implicit", "tea", "root > A", 1, D - timedelta(1)),
            (1, "implicit", "tea", "root > A", -1, D),  # the newest day decides
            (1, "implicit", "tea", "root > C", 1, D),
            (1, "implicit", "jazz", "root > A", -1, D),
            (1, "user_info", "x", "root > A", -1, D),
            (2, "implicit", "tea", "root > A", -1, D),
        ],
        NEW_ITEMS,
    )
    got = {(r.idhash, r.path, r.item): r.contradiction for r in persona.conflict(held, new, D, half_life=5).collect()}
    assert got == {
        (1, "root > A", "tea"): pytest.approx(2 / 6),  # likes 8 / 4 = 2, dislikes 3
        (1, "root > C", "tea"): pytest.approx(3 / 6),
        (1, "root > A", "jazz"): 0.0,  # demographics are no preferences
        (2, "root > A", "tea"): pytest.approx(1 / 2),  # not weighed up for being newer than the day
    }
    assert persona.conflict(held.filter("false"), new, D).filter("contradiction <> 0").count() == 0


# -- variants -----------------------------------------------------------------------------


def test_variants_in_one_run(spark, taxonomy):
    rows = random_daily(spark, 9).withColumn("path", F.regexp_replace("path", "Korean", "Cat1")).cache()
    users = spark.createDataFrame([(0,), (1,), (99,)], "idhash bigint")
    texts = spark.createDataFrame([(1, D, "Cat2 Cat2 Cat1")], "idhash bigint, datestr date, text string")
    truth = spark.createDataFrame([(1, "Cat2"), (0, "Cat1")], "idhash bigint, category string")
    names = ["no_memory", "full_context", "flat_memory", "fixed_hierarchy", "ours", "ablation_no_implicit"]
    out = variants.run_variants(
        users, rows, texts, taxonomy, truth, D, day(11), ["Cat1", "Cat2", "Cat3"], "Cat[0-9]", names=names, options={"backward_every": 6}
    ).collect()
    assert len(out) == len(names) * 3 and set(evaluate.METRICS) < set(out[0].asDict())
    by = {(r.variant, r.idhash): r for r in out}
    assert by["full_context", 1]["precision@1"] == 1.0 and by["no_memory", 1]["precision@1"] == 0.0
    assert by["ours", 99]["mrr"] == 0.0
    assert all(0.0 <= r[m] <= 1.0 for r in out for m in evaluate.METRICS)


def test_the_query_consolidates_all_presets_after_every_day(spark, taxonomy, monkeypatch):
    from placelore.plans import queries_memory

    rows = daily(spark, [(1, "implicit", "a", "root > Dining", 1, 0)])
    made = {"base.train_users": rows.select("idhash"), "profile_items": rows, "ev.daily_text": rows, "ev.truth": rows, "t.taxonomy": taxonomy}
    for name, df in made.items():
        monkeypatch.setattr(f"{queries_memory.__name__}.{name}", lambda spark, d, df=df: df)
    asked = []
    monkeypatch.setattr(variants, "run_variants", lambda *args, **settings: asked.append(settings) or rows)
    queries_memory.run_variants(spark, "")
    assert asked[0]["options"]["backward_every"] == 1 and asked[0]["names"] is None


def test_versions_are_read_from_intervals(spark):
    rows = cut_lineage(random_daily(spark, 9))
    items = cut_lineage(notes.item_versions(rows))
    tree = cut_lineage(notes.note_versions(items))
    runs = [day(2), day(7), day(11)]
    held_items, held_notes = (cut_lineage(notes.versions_on(v, runs)) for v in (items, tree))
    for run in runs:
        want = notes.apply_batch(rows.filter(F.col("datestr") <= F.lit(run)))
        now = F.col("run_date") == F.lit(run)
        assert tables(*want) == tables(held_items.filter(now).select(want[0].columns), held_notes.filter(now).select(want[1].columns))


def test_consistency_of_versions(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 1), (1, 1, "a", 1), (1, 1, "b", -1), (1, 1, "c", 1), (2, 1, "a", 1)]
    versions = spark.createDataFrame([(u, day(d), i, "implicit", p) for u, d, i, p in rows], "idhash bigint, run_date date, item string, axis string, polarity bigint")
    assert [tuple(r) for r in persona.persona_consistency(versions).collect()] == [(1, day(1), 0.25)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_consolidation_broadcasts_no_table_of_users(spark):
    items = spark.createDataFrame(
        [(1, "root > a > b", "x", "implicit", 1, date(2024, 1, 1), 1)],
        "idhash bigint, path string, item string, axis string, polarity bigint, last_seen date, support bigint",
    )
    state = spark.createDataFrame([(1, "root > a > b", 1, date(2024, 1, 1))], "idhash bigint, path string, updated_count bigint, recently_updated date")
    for table in backward.prune_stale(items, state, date(2024, 1, 2)):
        assert "Broadcast" not in _plan(table)


def test_fold_reads_only_items_that_an_open_group_shares(spark, monkeypatch):
    taxonomy = spark.createDataFrame([("root",), ("root > a",), ("root > a > listed",)], "path string")
    rows = [(1, "implicit", f"i{n}", "root > a > listed", 1, date(2024, 1, 1), 1) for n in range(9)]
    rows += [(1, "implicit", "i3", "root > a > open", 1, date(2024, 1, 2), 1)]
    items = spark.createDataFrame(rows, "idhash bigint, axis string, item string, path string, polarity bigint, datestr date, support bigint")
    seen, fold = [], routing._fold_subtrees

    def counted(events, *args):
        seen.append(events.count())
        return fold(events, *args)

    monkeypatch.setattr(routing, "_fold_subtrees", counted)
    found = routing.route_over_time(items, taxonomy, items.select("idhash", "path", "item").limit(0))
    assert {(r.item, r.route) for r in found.filter("datestr = '2024-01-02'").collect()} == {("i3", "sibling")}
    assert seen == [2]


def test_only_subtrees_whose_notes_move_are_folded(spark):
    """User 1 asks for one item a day and reads listed notes; user 2 makes a note of two items; user 3 asks for a note that is there."""
    held = [(1, "root > a", "root > a > n", "x", 2), (1, "root > a", "root > a > m", "x", 4), (3, "root > a", "root > a > o", "y", 0)]
    asks = [(1, "root > a", "root > a > o", "x", d) for d in (2, 3, 5)] + [(1, "root > a", "root > a > p", "z", 3)]
    asks += [(2, "root > a", "root > a > o", i, 1) for i in "xy"] + [(2, "root > a", "root > a > p", "y", d) for d in (1, 2)]
    asks += [(3, "root > a", "root > a > o", "z", 1), (3, "root > a", "root > a > p", "z", 2)]
    events = spark.createDataFrame(
        [(*r[:4], day(r[4]), False) for r in held] + [(*r[:4], day(r[4]), True) for r in asks],
        "idhash bigint, _domain string, path string, item string, datestr date, asks boolean",
    )
    judged = []

    def kept(rows):
        judged.extend(rows.collect())
        return rows

    found = routing._fold_subtrees(events, ["idhash", "_domain"], 0.5, 2, kept)
    answers = {(r.idhash, r._wanted[-1], r.datestr, r._answer[-1]) for r in found.collect()}
    assert answers == {
        (1, "o", day(3), "n"), (1, "o", day(5), "m"), (2, "o", day(1), "o"), (2, "p", day(2), "o"), (3, "o", day(1), "o"), (3, "p", day(2), "o"),
    }
    assert {r["_k0"] for r in judged if r["_moves"]} == {2, 3}


def test_daily_items_rank_only_places_that_the_logs_name(spark, monkeypatch):
    """Earlier every place of the catalogue was ranked and shuffled, once for clicks and once for reviews."""
    poi = spark.createDataFrame(
        [(n, n, f"old p{n}", "root > a > b", "x", n) for n in range(50)] + [(1, 1, "a first", "root > a > c", "x", 0)],
        "sid bigint, place_id bigint, title string, category_path string, road_addr string, place_review_count bigint",
    )
    clicks = spark.createDataFrame(
        [(1, 1, "view", day(d)) for d in (1, 1, 2)] + [(1, 2, "view", day(d)) for d in (1, 1, 1)] + [(1, 99, "view", day(1))],
        "idhash bigint, sid bigint, action string, datestr date",
    )
    ranked, places_of = [], profile.places_of

    def counted(rows, *args):
        ranked.append(sorted(r.sid for r in rows.collect()))
        return places_of(rows, *args)

    monkeypatch.setattr(profile, "places_of", counted)
    rows = profile._implicit(clicks, poi, "error", 3, 2).collect()
    assert sorted((r.item, r.path, r.polarity, r.datestr, r.support, r.axis) for r in rows) == [
        ("p1", "root > a > b", 1, day(1), 2, "implicit"), ("p1", "root > a > b", 1, day(2), 1, "implicit"),
    ]
    assert ranked == [[1, 1, 2]]


def test_routing_over_time_stores_items_once_and_counts_equal_items_once(spark):
    """One item of two axes on one day is no group of two; the table of judged items is the only one beside that of the paths."""
    taxonomy = spark.createDataFrame([("root",), ("root > a",), ("root > a > n",)], "path string")
    rows = [(1, "implicit", "x", "root > a > n", 1, day(1), 1), (2, "implicit", "x", "root > a > o", 1, day(2), 1)]
    rows += [(1, axis, "x", "root > a > o", 1, day(2), 1) for axis in ("implicit", "explicit")]
    rows += [(3, "implicit", i, "root > a > o", 1, day(2), 1) for i in "xy"]
    items = spark.createDataFrame(rows, "idhash bigint, axis string, item string, path string, polarity bigint, datestr date, support bigint")
    kept = []

    def stored(df):
        kept.append(df.collect())
        return df

    found = routing.route_over_time(items, taxonomy, items.select("idhash", "path", "item").limit(0), materialize=stored).collect()
    answers = [(r.idhash, r.path, r.route) for r in found if r.datestr == day(2)]
    assert sorted(answers) == [(1, "root > a > n", "sibling")] * 2 + [(2, "root > a", "domain")] + [(3, "root > a > o", "new")] * 2
    assert len(kept) == 2 and len(kept[1]) == len(rows)
    assert {r["idhash"] for r in kept[1] if r["_moves"]} == {3}


def test_paths_of_notes_without_their_days(spark, taxonomy):
    rows = [(1, "implicit", i, p, 1, day(d), 1) for i, p, d in (("x", "root > a > n", 1), ("x", "root > a > o", 2), ("y", "root > a > o", 2), ("z", None, 3))]
    items = spark.createDataFrame(rows, "idhash bigint, axis string, item string, path string, polarity bigint, datestr date, support bigint")
    whole = memory.memory_closed_form(items, taxonomy)[1].select("idhash", "path").collect()
    paths = memory.memory_paths(items, taxonomy)
    assert sorted(paths.collect()) == sorted(whole)
    assert "support" not in _plan(paths)
