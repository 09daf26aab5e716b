"""The fold of one user's days into the note tree, as one sorted stream per partition.

``Tree`` does on the notes of one user what ``routing.route_over_time``, ``notes.apply_batch`` and ``backward.backward_pass`` do on the
tables of all users. Only the notes of one user and the rows of one period (of a day, before the user is consolidated) are held; the
rows stream past, however many there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from placelore.functions.text import SEP
from placelore.operators.routing import MAX_LEVEL

NO_POLARITY = -(2**63) - 1  # NULL comes before all others
ROWS_PER_BATCH = 10_000
#: What the fold reads of a row besides its keys; rows come in the order of the days.
COLUMNS = ["day", "item", "rank", "polarity", "support", "wanted", "fixed", "asks", "in_base", "dynamic", "backward", "lift"]
ITEM, NOTE, LOG = 0, 1, 2  # kinds of rows that the fold gives


def _parent(path: str) -> str | None:
    return path.rpartition(SEP)[0] if SEP in path else None


def _domain(path: str) -> str:
    return SEP.join(path.split(SEP)[:2])


def _added(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else a + b


class Tree:
    """``content``: path -> item -> (last day, rank, polarity, support); ``counters``: path -> (updates, last day)."""

    def __init__(self) -> None:
        self.content: dict[str, dict[str | None, tuple]] = {}
        self.counters: dict[str, tuple[int, int]] = {}

    def _put(self, path: str, item: str | None, value: tuple) -> None:
        """``notes.collapse_items`` of what is held and ``value``."""
        held = self.content.setdefault(path, {})
        old = held.get(item)
        held[item] = value if old is None else (*max(old[:3], value[:3]), _added(old[3], value[3]))

    # -- routing ------------------------------------------------------------------------------

    def unshared(self, asked: dict[str, set]) -> set[str]:
        """Third-level notes without an item that a group of their subtree asks with; ``asked``: items by subtree."""
        return {
            path
            for path, held in self.content.items()
            if path.count(SEP) == MAX_LEVEL - 1 and asked.get(_domain(path), held.keys()).isdisjoint(held)
        }

    def answers(self, groups: dict[str, set], others: dict[str, set], hidden: set[str], overlap: float, min_new: int) -> dict[str, str]:
        """Path of each group that asks for an unlisted one, as in ``routing._fold_subtrees``; ``others`` are routed beside the tree.

        ``hidden`` are notes of earlier periods that the tables' fold does not read (``unshared``).
        """
        found = {}
        for domain in {_domain(wanted) for wanted in groups}:
            known: dict[str, set] = defaultdict(set)
            for source in (self.content, others):
                for path, items in source.items():
                    if items and path.count(SEP) == MAX_LEVEL - 1 and _domain(path) == domain:
                        known[path].update(items)
            holders = defaultdict(list)
            for path, items in known.items():
                for item in items:
                    holders[item].append(path)
            for wanted, items in groups.items():
                if _domain(wanted) == domain and (wanted not in known or wanted in hidden):
                    shared = Counter(path for item in items for path in holders.get(item, ()))
                    best = min(((-n, path) for path, n in shared.items() if n >= overlap * len(items)), default=None)
                    found[wanted] = best[1] if best else wanted if len(items) >= min_new else domain
        return found

    # -- forward ------------------------------------------------------------------------------

    def update(self, day: int, rows: list[tuple]) -> None:
        """``notes.apply_batch`` of one day; ``rows``: (path, item, rank, polarity, support)."""
        today: dict[tuple, list] = {}
        for path, item, rank, polarity, support in rows:
            value = (rank, polarity)
            seen = today.get((path, item))
            if seen is None:
                today[path, item] = [value, support]
            else:
                seen[0], seen[1] = max(seen[0], value), _added(seen[1], support)
        changed = set()
        for (path, item), (value, support) in today.items():
            held = self.content.setdefault(path, {})
            old = held.get(item)
            if old is None or old[1:3] != value:
                changed.add(path)
            held[item] = (day, *value, support if old is None else _added(old[3], support))
        for path in changed:
            self.counters[path] = (self.counters.get(path, (0,))[0] + 1, day)

    # -- backward -----------------------------------------------------------------------------

    def _leaf_elements(self) -> dict[str, list[tuple[str, str | None]]]:
        """(element, item) of the non-root leaves' contents, as in ``backward._leaf_elements``."""
        parents = {_parent(path) for path in self.counters}
        return {
            path: [("|".join(str(v) for v in (item, value[2]) if v is not None and v != NO_POLARITY), item) for item, value in held.items()]
            for path, held in self.content.items()
            if held and SEP in path and path not in parents and path in self.counters
        }

    @staticmethod
    def _jaccards(elements: dict[str, list[tuple]]) -> dict[tuple[str, str], float]:
        """Of sibling pairs that share an element."""
        holders = defaultdict(list)
        for path in sorted(elements):
            parent = _parent(path)
            for element, _ in elements[path]:
                holders[parent, element].append(path)
        shared = Counter(pair for paths in holders.values() if len(paths) > 1 for pair in combinations(paths, 2) if pair[0] != pair[1])
        size = {path: len(rows) for path, rows in elements.items()}
        return {(a, b): n / (size[a] + size[b] - n) for (a, b), n in shared.items()}

    def merge(self, tau: float, partial: float) -> list[tuple[str, str, str]]:
        """``backward.merge_siblings``; returns (path, target, kind) of its moves."""
        elements = self._leaf_elements()
        first: dict[tuple, str] = {}
        label = {}
        for path in sorted(elements):
            label[path] = first.setdefault((_parent(path), frozenset(e for e, _ in elements[path])), path)
        pairs = self._jaccards({path: rows for path, rows in elements.items() if label[path] == path})
        for (a, b), jaccard in pairs.items():
            if jaccard >= tau:
                low, high = sorted((label[a], label[b]))
                if low != high:
                    label = {path: low if at == high else at for path, at in label.items()}
        members = defaultdict(list)
        for path, at in label.items():
            members[at].append(path)
        log = []
        for linked in members.values():
            target = min(linked, key=lambda path: (-self.counters[path][0], path)) if len(linked) > 1 else linked[0]
            for path in linked:
                if path != target:
                    for item, value in self.content.pop(path).items():
                        self._put(target, item, value)
                    both = self.counters.pop(path), self.counters[target]
                    self.counters[target] = (both[0][0] + both[1][0], max(both[0][1], both[1][1]))
                    log.append((path, target, "full"))
        if log:
            elements = self._leaf_elements()
            pairs = self._jaccards(elements)
        moves: dict[tuple[str, str], tuple] = {}
        for pair, jaccard in pairs.items():
            if partial <= jaccard < tau:
                strong, weak = sorted(pair, key=lambda path: (-self.counters[path][0], path))
                rank = (-self.counters[strong][0], strong)
                for element in {e for e, _ in elements[strong]} & {e for e, _ in elements[weak]}:
                    moves[weak, element] = min(moves.get((weak, element), rank), rank)
        moved = [
            (path, moves[path, element][1], item, self.content[path].pop(item))
            for path in {path for path, _ in moves} for element, item in elements[path] if (path, element) in moves
        ]
        for _, target, item, value in moved:
            self._put(target, item, value)
        return log + [(*ends, "partial") for ends in sorted({(path, target) for path, target, _, _ in moved})]

    def lift(self) -> None:
        """``backward.lift_common_traits``."""
        for depth in (2, 1):
            holders = defaultdict(list)
            for path, held in self.content.items():
                if path.count(SEP) == depth:
                    parent = _parent(path)
                    for item, value in held.items():
                        holders[parent, item, value[2]].append(path)
            for (parent, item, _), paths in holders.items():
                if len(paths) > 1:
                    for path in paths:
                        self._put(parent, item, self.content[path].pop(item))
        for path, held in self.content.items():
            if held and path not in self.counters:
                self.counters[path] = (1, max(value[0] for value in held.values()))

    def prune(self, today: int, min_updates: int, max_age: int) -> None:
        """``backward.prune_stale``."""
        stale = [path for path, (updates, day) in self.counters.items() if updates <= min_updates and today - day > max_age]
        for path in stale:
            if path.count(SEP) == 2:
                del self.counters[path]
        parents = {_parent(path) for path in self.counters if path.count(SEP) == 2} if stale else ()
        for path in stale:
            if path.count(SEP) == 1 and path not in parents:
                del self.counters[path]
        self.content = {path: held for path, held in self.content.items() if held and path in self.counters}


def fold_days(
    rows: DataFrame, keys: Sequence[str], start: int, end: int, backward_every: int, overlap: float = 0.5, min_new: int = 2,
    tau: float = 0.5, partial: float = 0.25, min_updates: int = 2, max_age: int = 120,
) -> DataFrame:
    """(keys, kind, path, item, rank, polarity, day, number, target, move) of the folded items, notes and merges.

    ``rows`` have the keys and ``COLUMNS``; days are whole numbers in [start, end]. After every ``backward_every`` days users with new items
    and older notes are consolidated. Users without a whole key are not, nor do their subtrees with moving notes take other paths: tables
    are joined by the keys.
    """
    keys = list(keys)
    ordered = rows.select(*keys, *COLUMNS).repartition(*keys).sortWithinPartitions(*keys, "day")
    schema = StructType([
        *[rows.schema[k] for k in keys], StructField("kind", IntegerType()), StructField("path", StringType()), StructField("item", StringType()),
        StructField("rank", IntegerType()), StructField("polarity", LongType()), StructField("day", IntegerType()), StructField("number", LongType()),
        StructField("target", StringType()), StructField("move", StringType()),
    ])

    def moving(tree: Tree, period: list[tuple]) -> set[str]:
        """Subtrees whose notes change in the period, as in ``routing._judge_subtrees``."""
        groups = defaultdict(set)
        for row in period:
            if row[7]:
                groups[row[0], row[5]].add(row[1])
        return {_domain(wanted) for (_, wanted), items in groups.items() if len(items) > 1 or tree.content.get(wanted)}

    def forward(tree: Tree, day: int, today: list[tuple], beside: dict[str, set], hidden: set[str], still: set[str]) -> None:
        groups = defaultdict(set)
        for row in today:
            if row[7]:
                groups[row[5]].add(row[1])
        answers = tree.answers(groups, beside, hidden, overlap, min_new) if groups else {}
        hidden.difference_update(answers.values())
        routed = []
        for _, item, rank, polarity, support, wanted, fixed, asks, in_base, dynamic, _, _ in today:
            path = fixed
            if asks:
                if _domain(wanted) not in still:
                    path = answers.get(wanted, wanted)
                in_base = path not in unlisted
            if dynamic or (dynamic is not None and in_base):
                routed.append((path, item, rank, NO_POLARITY if polarity is None else polarity, support))
            else:
                beside.setdefault(path, set()).add(item)
        tree.update(day, routed)

    unlisted: set[str] = set()  # paths that the current user asked for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, tree, period, last, had, beside, waiting, flags = None, Tree(), None, None, False, {}, [], (False, False)

        def close() -> None:
            """Ends the period of the current user."""
            if waiting:
                asked = defaultdict(set)
                for row in waiting:
                    if row[7]:
                        asked[_domain(row[5])].add(row[1])
                hidden = tree.unshared(asked) if asked else set()
                still = moving(tree, waiting) if None in current else set()
                for day, today in groupby(waiting, key=lambda row: row[0]):
                    forward(tree, day, list(today), beside, hidden, still)
                waiting.clear()
            beside.clear()
            if had and flags[0] and None not in current:
                for path, target, move in tree.merge(tau, partial):
                    out.append((*current, LOG, path, None, None, None, last, None, target, move))
                if flags[1]:
                    tree.lift()
                tree.prune(last, min_updates, max_age)

        def give() -> None:
            for path, held in tree.content.items():
                for item, (day, rank, polarity, support) in held.items():
                    out.append((*current, ITEM, path, item, rank, None if polarity == NO_POLARITY else polarity, day, support, None, None))
            out.extend((*current, NOTE, path, None, None, None, day, updates, None, None) for path, (updates, day) in tree.counters.items())

        def days() -> Iterator[tuple[tuple, int, list[tuple]]]:
            """(key, day, rows), also where a day goes on in the next batch."""
            key, today = None, []
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for (k, day), some in groupby(zip(zip(*columns[: len(keys)]), zip(*columns[len(keys) :])), key=lambda row: (row[0], row[1][0])):
                    if key != (k, day):
                        if today:
                            yield (*key, today)
                        key, today = (k, day), []
                    today.extend(row for _, row in some)
            if today:
                yield (*key, today)

        for key, day, today in days():
            number = (day - start) // backward_every
            if key != current or number != period:
                if current is not None:
                    close()
                if key != current:
                    if current is not None:
                        give()
                    current, tree = key, Tree()
                    unlisted.clear()
                period, last, had = number, min(start + (number + 1) * backward_every - 1, end), bool(tree.counters)
                flags = today[0][10], today[0][11]
            unlisted.update(row[5] for row in today if row[7])
            if had or None in key:
                waiting.extend(today)
            else:
                forward(tree, day, today, beside, set(), set())
            if len(out) >= ROWS_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)
                out.clear()
        if current is not None:
            close()
            give()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)

    types = to_arrow_schema(schema)
    return ordered.mapInArrow(run, schema)
