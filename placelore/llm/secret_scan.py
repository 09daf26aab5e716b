"""Secrets by three fixed patterns and by the formats that labelled credentials have in common.

1. Labelled credentials: what the patterns find in the corpus, its kind as the label (at most ``MAX_LABELLED`` distinct values of a kind,
   smallest hash first, none longer than ``LONGEST``). A value is read as a sequence of letter classes.
2. Grammar inference per kind: a prefix tree of the sequences with counts; states are taken in breadth-first order and merged with
   the first state whose ending and continuing frequencies, and those of all common successors, are
   statistically compatible (Hoeffding bound). The result is a deterministic probabilistic automaton.
3. A candidate is a run of credential letters that no fixed pattern touches. The background is a bigram model of the classes of all candidates
   in all documents (counted by Spark).
4. Every candidate is scored by the best automaton's
   log-likelihood minus the background's; from ``ODDS`` on its place is added with kind ``format``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.functions.skew import top_per_key
from placelore.llm.common import id_and_text, stored

KINDS = ("assign", "access", "hex", "format")  # fixed order of kinds
MAX_LABELLED = 2000
LONGEST = 200
ALPHA = 0.05  # error of the compatibility test
ODDS = 16.0  # log of how much likelier the format must be than the background

_KEYWORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{8,}={0,2}")


def _class_of(c: str) -> str:
    """d digit, h/H letter that is also a hexadecimal digit, l/U other letter (lower, upper), else the symbol itself."""
    if c.isdigit():
        return "d"
    if c.isalpha():
        return ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "U")
    return c


_CLASSES = str.maketrans({chr(i): _class_of(chr(i)) for i in range(128)})
END = "$"

Span = tuple[int, int, int]  # start, kind as place in KINDS, end (exclusive)


def base_spans(text: str) -> list[tuple[Span, str]]:
    """Places of the fixed patterns by start, then kind, with the credential itself; leftmost matches per kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [((m.start(), 0, m.end()), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [((m.start(), 1, m.end()), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for run in _CANDIDATE.finditer(text):  # a long run of hexadecimal digits lies in a run of credential letters
        if run.end() - run.start() >= 32:
            out += [((m.start(), 2, m.end()), m[0]) for m in _HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= 32]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, str]]:
    """Start, end and letters of every run of credential letters that ``base`` does not touch; dots and hyphens around it are left out."""
    for m in _CANDIDATE.finditer(text):
        if base and any(m.start() < end and start < m.end() for start, _, end in base):
            continue
        run = m[0]
        if run[-1] in ".-" or run[0] in ".-":
            bare = run.lstrip(".-")
            start = m.start() + len(run) - len(bare)
            bare = bare.rstrip(".-")
            if len(bare) >= 8:
                yield start, start + len(bare), bare
        else:
            yield m.start(), m.end(), run


class Automaton:
    """Deterministic probabilistic automaton of counted sequences."""

    def __init__(self, sequences: Iterable[str], alpha: float = ALPHA):
        self.edges: list[dict[str, list[int]]] = [{}]  # symbol -> [target, count]
        self.ends: list[int] = [0]
        for sequence in sequences:
            state = 0
            for symbol in sequence:
                edge = self.edges[state].get(symbol)
                if edge is None:
                    edge = self.edges[state][symbol] = [len(self.edges), 0]
                    self.edges.append({})
                    self.ends.append(0)
                edge[1] += 1
                state = edge[0]
            self.ends[state] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.logs = [
            {s: (t, math.log(n / self.total(q))) for s, (t, n) in e.items()} for q, e in enumerate(self.edges)
        ]
        self.end_logs = [math.log(n / self.total(q)) if n else -math.inf for q, n in enumerate(self.ends)]

    def total(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.edges[state].values())

    def _differ(self, a: int, of_a: int, b: int, of_b: int) -> bool:
        return abs(a / of_a - b / of_b) > self.width * (1 / math.sqrt(of_a) + 1 / math.sqrt(of_b))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the frequencies of ``a`` and of the tree below ``b`` may come from one state."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            of_a, of_b = self.total(a), self.total(b)
            if self._differ(self.ends[a], of_a, self.ends[b], of_b):
                return False
            for symbol in self.edges[a].keys() | self.edges[b].keys():
                left, right = self.edges[a].get(symbol), self.edges[b].get(symbol)
                if self._differ(left[1] if left else 0, of_a, right[1] if right else 0, of_b):
                    return False
                if left and right:
                    todo.append((left[0], right[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """The tree below ``b`` counted into ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for symbol, (target, n) in self.edges[b].items():
                mine = self.edges[a].get(symbol)
                if mine is None:
                    self.edges[a][symbol] = [target, n]
                else:
                    mine[1] += n
                    todo.append((mine[0], target))

    def _merge(self) -> None:
        if not self.total(0):
            return
        kept, known = [0], {0}
        todo = deque((0, s) for s in sorted(self.edges[0]))
        while todo:
            parent, symbol = todo.popleft()
            state = self.edges[parent][symbol][0]
            if state in known:
                continue
            same = next((q for q in kept if self._compatible(q, state)), None)
            if same is None:
                kept.append(state)
                known.add(state)
                todo.extend((state, s) for s in sorted(self.edges[state]))
            else:
                self.edges[parent][symbol][0] = same
                self._fold(same, state)
                # Folding may have given kept states new successors.
                todo.extend((q, s) for q in kept for s in sorted(self.edges[q]) if self.edges[q][s][0] not in known)
        number = {q: k for k, q in enumerate(kept)}
        self.edges = [{s: [number[t], n] for s, (t, n) in self.edges[q].items()} for q in kept]
        self.ends = [self.ends[q] for q in kept]

    def log_likelihood(self, sequence: str) -> float:
        state, out = 0, 0.0
        for symbol in sequence:
            step = self.logs[state].get(symbol)
            if step is None:
                return -math.inf
            state = step[0]
            out += step[1]
        return out + self.end_logs[state]


@dataclass
class Model:
    automata: dict[str, Automaton]  # by kind
    background: dict[str, float]  # log-probability of the second class after the first

    def odds(self, letters: str) -> float:
        """Log-likelihood of the best automaton minus the background's; minus infinity where no automaton takes the sequence."""
        sequence = letters.translate(_CLASSES)
        best = max((a.log_likelihood(sequence) for a in self.automata.values()), default=-math.inf)
        if best == -math.inf:
            return best
        rest = self.background
        return best - sum(rest.get(p, rest[""]) for p in pairs_of(sequence))

    def spans(self, text: str) -> list[Span]:
        base = [s for s, _ in base_spans(text)]
        return sorted(base + [(start, 3, end) for start, end, letters in candidates(text, base) if self.odds(letters) >= ODDS])


def pairs_of(sequence: str) -> list[str]:
    """Neighbouring classes, the borders of the sequence included."""
    framed = f"{END}{sequence}{END}"
    return [framed[i : i + 2] for i in range(len(framed) - 1)]


def background_of(counts: dict[str, int]) -> dict[str, float]:
    """Smoothed log-probabilities of class pairs; '' holds the least, for pairs not in the table."""
    classes = sorted({_class_of(chr(i)) for i in range(128) if _CANDIDATE.fullmatch(chr(i) * 8)} | {"=", END})
    after = Counter()
    for pair, n in counts.items():
        after[pair[0]] += n
    out = {a + b: math.log((counts.get(a + b, 0) + 1) / (after[a] + len(classes))) for a in classes for b in classes}
    return out | {"": min(out.values())}


def evidence(docs: DataFrame) -> DataFrame:
    """Rows (kind, value, n): labelled credentials of the corpus, and with an empty kind the class pairs of all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            found: Counter = Counter()
            for raw in batch.column(1).to_pylist():
                text = raw.decode()
                base = base_spans(text)
                for (_, kind, _), value in base:
                    if len(value) <= LONGEST:
                        found[KINDS[kind], value] += 1
                words = Counter(letters.translate(_CLASSES) for _, _, letters in candidates(text, [s for s, _ in base]))
                for sequence, n in words.items():
                    for pair in pairs_of(sequence):
                        counts[pair] += n
            if found:
                yield _evidence_rows((k, v, n) for (k, v), n in found.items())
        if counts:
            yield _evidence_rows(("", p, n) for p, n in counts.items())

    rows = id_and_text(docs).mapInArrow(run, "kind string, value string, n long")
    return rows.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def _evidence_rows(rows: Iterable[tuple[str, str, int]]) -> pa.RecordBatch:
    kinds, values, counts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], ["kind", "value", "n"]
    )


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Automata of the kinds met in ``docs`` and the background; only bounded samples and a table of class pairs reach the driver."""
    rows = stored(evidence(docs))
    counts = {r["value"]: r["n"] for r in rows.filter("kind = ''").collect()}  # at most one row per pair of classes
    labelled = top_per_key(rows.filter("kind != ''"), ["kind"], [F.xxhash64("value"), F.col("value")], max_labelled)
    values: dict[str, list[str]] = {}
    for r in labelled.collect():
        values.setdefault(r["kind"], []).append(r["value"].translate(_CLASSES))
    return Model({k: Automaton(sorted(values[k])) for k in KINDS if k in values}, background_of(counts))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are left out): doc_id and spans, an array of (start, kind, end) in code
    points, end exclusive, by start, then kind in the order of ``KINDS``.

    NULL counts as empty: no spans. Whole texts are read; repeated rows are kept apart; an empty table gives an empty table.
    """
    schema = "doc_id long, spans array<struct<start: long, kind: string, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.spans(t.decode()) if t else [] for t in batch.column(1).to_pylist()]
            spans = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind_of_span))], ["doc_id", "spans"])

    kind_of_span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
    return id_and_text(docs).mapInArrow(run, schema)


def secrets(docs: DataFrame) -> DataFrame:
    """``scan`` with automata and background learned from the same rows."""
    return scan(docs, fit(docs))
