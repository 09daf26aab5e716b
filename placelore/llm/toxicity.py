"""Toxicity by a subsequence string kernel and a linear support vector machine over Nyström landmarks.

The kernel of two strings sums over all common subsequences of ``ORDER`` letters that span at most ``SPAN`` letters, each
weighted by ``DECAY`` to the length it spans in either string, and is normalised. Inserted letters stretch a
subsequence instead of breaking it, so disguised spellings stay close to the plain ones; symbols
inside a token are ignored and single letters written apart are joined.

1. Landmarks: letter runs of labelled documents whose document frequency tells the classes apart.
2. A sentence has, for each landmark, the largest kernel value of its words (values below ``FLOOR``
   count as zero). The Nyström map whitens this vector by the kernel matrix of the landmarks.
3. The machine is trained on labelled sentences: those of a document that are most like landmarks
   carry its label; of a toxic document the one that scores highest is kept, chosen anew in each
   round.
4. A document scores as its highest sentence; a logistic curve turns that into 0..1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import claim, distinct, held_out, stored

ORDER, SPAN, DECAY, FLOOR = 3, 6, 0.6, 0.2
LANDMARKS = 64
MAX_LABELLED = 4000  # labelled documents of each class the model is fitted on
SENTENCES = 3  # sentences of a training document sent to the driver
BLOCK = 512  # texts looked at together
SLICE = 20_000  # letters of new words whose subsequences are laid out together
TOKENS_HELD = 200_000  # tokens a worker keeps
GRAMS_HELD = 100_000  # letter runs a task counts before it sends them on
PIECE = 24  # longer words are looked at in overlapping pieces of this length
_LETTERS = re.compile(r"[\W_]+")
_SINGLE = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All subsequences of the words: owner (number of the word), the three letters in one integer, weight."""
    apart = "\0" * (SPAN - 1)
    letters = np.frombuffer((apart.join(words) + 2 * apart).encode("utf-32-le"), np.uint32).astype(np.uint64)
    number = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + SPAN - 1)
    n = len(number)
    owners, codes, weights = [], [], []
    for last in range(2, SPAN):
        inside = np.flatnonzero((letters[:n] != 0) & (letters[last : last + n] != 0))
        high, low = letters[inside] << np.uint64(42), letters[inside + last]
        for middle in range(1, last):
            owners.append(number[inside])
            codes.append(high | letters[inside + middle] << np.uint64(21) | low)
            weights.append(np.full(len(inside), DECAY ** (last + 1)))
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)


def _summed(owner: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per word and subsequence, in order."""
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[: len(owner)])
    return owner[first], code[first], np.add.reduceat(weight, first) if len(first) else weight


class Kernel:
    """Normalised kernel with fixed landmarks; only subsequences that a landmark has are looked up.

    Values below ``FLOOR`` are given as zero.
    """

    def __init__(self, landmarks: list[str]):
        owner, code, weight = _summed(*_features(landmarks))
        self.codes = distinct(code)
        self.weights = np.zeros((len(self.codes), len(landmarks)))
        self.weights[np.searchsorted(self.codes, code), owner] = weight
        self.weights /= np.maximum(np.sqrt((self.weights**2).sum(0)), 1e-12)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self._slot(self.codes)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.weights.shape[1]), np.float32)
        if not words or not len(self.codes):
            return out
        owner, code, weight = _features(words)
        maybe = np.flatnonzero(self.sieve[self._slot(code)])
        at = np.minimum(np.searchsorted(self.codes, code[maybe]), len(self.codes) - 1)
        hit = self.codes[at] == code[maybe]
        if not hit.any():
            return out
        rows, at, value = owner[maybe[hit]], at[hit], weight[maybe[hit]]
        order = np.argsort(rows, kind="stable")
        rows, at, value = rows[order], at[order], value[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        found = rows[first]
        raw = np.add.reduceat(value[:, None] * self.weights[at], first)
        # a word's norm is at least what its subsequences have without repeats, which its length tells
        length = np.array([len(words[i]) for i in found])
        least = np.sqrt(sum(np.maximum(length - last, 0) * (last - 1) * DECAY ** (2 * last + 2) for last in range(2, SPAN)))
        near = raw.max(axis=1) >= FLOOR * least * (1 - 1e-9)
        found, raw = found[near], raw[near]
        mine = np.zeros(len(words), bool)
        mine[found] = True
        own = mine[owner]
        o, _, w = _summed(owner[own], code[own], weight[own])
        norm = np.sqrt(np.bincount(o, weights=w * w, minlength=len(words)))[found]
        similar = raw / np.maximum(norm, 1e-12)[:, None]
        out[found] = np.where(similar >= FLOOR, similar, 0)
        return out


def _pieces(token: str) -> list[str]:
    if token.isalnum():
        word = token
    elif token[:-1].isalnum():
        word = token[:-1]
    else:
        word = _LETTERS.sub("", token)
    if len(word) <= PIECE:
        return [word] if len(word) >= ORDER else []
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def _tokens(text: str) -> list[str]:
    """Lower-case tokens; a line break ends a sentence; letters written apart are also joined."""
    lowered = text.lower().replace("\n", " . ")
    joined = " ".join(m.group().replace(" ", "") + " ." for m in _SINGLE.finditer(lowered))
    return (lowered + " . " + joined if joined else lowered).split()


class _Numbers(dict):
    """Numbers tokens in the order they are met; the new ones are kept aside."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        value = self[token] = len(self)
        self.new.append(token)
        return value


class _Vectors:
    """Kernel rows of the tokens a worker has met; tokens unlike all landmarks share row 0."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.kernel, self.numbers = landmarks, Kernel(landmarks), _Numbers()
        self.codes = np.zeros(0, np.int64)  # by token: twice its row, plus one where it ends a sentence
        self.rows = np.zeros((1024, len(landmarks)), np.float32)  # grows in steps; ``n_rows`` are in use
        self.n_rows = 1

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The codes of the tokens of each text."""
        if len(self.numbers) > TOKENS_HELD:
            self.numbers, self.codes, self.n_rows = _Numbers(), self.codes[:0], 1
        numbered = [np.fromiter(map(self.numbers.__getitem__, text), np.int64, len(text)) for text in texts]
        new, self.numbers.new = self.numbers.new, []
        if new:
            codes = np.fromiter((t[-1] in ".!?" for t in new), np.int64, len(new))
            owners, pieces, letters = [], [], 0
            for i, token in enumerate(new):
                parts = _pieces(token)
                owners += [i] * len(parts)
                pieces += parts
                letters += sum(map(len, parts))
                if letters >= SLICE:
                    self._add(codes, owners, pieces)
                    owners, pieces, letters = [], [], 0
            self._add(codes, owners, pieces)
            self.codes = np.concatenate([self.codes, codes])
        return [self.codes[n] for n in numbered]

    def _add(self, codes: np.ndarray, owners: list[int], pieces: list[str]) -> None:
        """Kernel rows of the tokens ``owners``, whose pieces follow each other; their row numbers go into ``codes``."""
        values = self.kernel(pieces)
        hit = np.flatnonzero(values.any(axis=1))
        if not len(hit):
            return
        owner = np.array(owners)[hit]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        stop = self.n_rows + len(first)
        if stop > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n_rows], np.zeros((max(stop, len(self.rows)), self.rows.shape[1]), np.float32)])
        codes[owner[first]] += 2 * np.arange(self.n_rows, stop)
        self.rows[self.n_rows : stop] = np.maximum.reduceat(values[hit], first)
        self.n_rows = stop


_CACHE: dict[tuple, _Vectors] = {}


def _sentences(texts: list[str], landmarks: list[str]) -> list[np.ndarray]:
    """Per text the kernel vectors of the sentences that are like any landmark, (sentences, landmarks)."""
    key = tuple(landmarks)
    claim("toxicity", _CACHE.clear)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = _Vectors(landmarks)
    vectors, out = _CACHE[key], []
    for at in range(0, len(texts), BLOCK):
        for codes in vectors.of([_tokens(t) for t in texts[at : at + BLOCK]]):
            hit = np.flatnonzero(codes > 1)
            if not len(hit):
                out.append(np.zeros((0, len(landmarks)), np.float32))
                continue
            sentence = (np.cumsum(codes & 1) - (codes & 1))[hit]
            starts = np.flatnonzero(np.diff(sentence, prepend=-1))
            out.append(np.maximum.reduceat(vectors.rows[codes[hit] >> 1], starts))
    return out


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: np.ndarray  # over the kernel values: Nyström map and machine in one
    bias: float
    slope: float
    shift: float

    def margins(self, sentences: list[np.ndarray]) -> np.ndarray:
        return np.array([(s @ self.weights).max(initial=0.0) + self.bias for s in sentences])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        z = self.slope * self.margins(_sentences(texts, list(self.landmarks))) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _counted(counts: Counter, label: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "gram": pa.array(list(counts), pa.string()),
            "label": pa.array([label] * len(counts), pa.int32()),
            "n": pa.array(list(counts.values()), pa.int64()),
        }
    )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of letter runs, in parts of bounded size that Spark adds up."""
    claim("toxicity", _CACHE.clear)
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            found = set()
            for word in {_LETTERS.sub("", t) for t in _tokens(text or "")}:
                for n in (4, 5, 6, 7):
                    found.update(word[i : i + n] for i in range(len(word) - n + 1))
            counts[label].update(found)
            if len(counts[label]) > GRAMS_HELD:
                yield _counted(counts[label], label)
                counts[label].clear()
    for label in (0, 1):
        yield _counted(counts[label], label)


def _pick(ranked: list[str], most: int) -> list[str]:
    """Best runs first, leaving out those that overlap a chosen one in three letters of a row."""
    chosen, seen = [], set()
    for gram in ranked:
        parts = {gram[i : i + 3] for i in range(len(gram) - 2)}
        if not parts & seen:
            chosen.append(gram)
            seen |= parts
            if len(chosen) == most:
                break
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge * weight.sum()] * x.shape[1] + [1e-6])
    for _ in range(25):
        inside = y * (z @ w) < 1
        a = z[inside] * weight[inside, None]
        new = np.linalg.solve(z[inside].T @ a + penalty, a.T @ y[inside])
        if np.abs(new - w).max(initial=0) < 1e-8:
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, targets softened as by Platt."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3
        w -= np.clip(np.linalg.solve(h, z.T @ (p - target) + 1e-3 * w), -2, 2)
    return float(w[0]), float(w[1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, remainder: int) -> DataFrame:
    """Columns text and label of at most ``most`` documents per class (smallest hash of the id first), held-out ids excluded."""
    usable = labels.filter(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder)
    ).select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    taken = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        taken = part if taken is None else taken.unionByName(part)
    ids = F.broadcast(stored(taken))  # at most 2 * most pairs of numbers
    text = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.join(ids, "_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, landmarks: int = LANDMARKS) -> Model:
    """Fits on ``labels.toxic``; rows whose crc32 of the id leaves 0 modulo 5 are never learned from.

    Without labelled documents of both classes every text scores the share of class 1 (0.5 without any label).
    """
    rows = stored(labelled(docs, labels, "toxic", max_labelled, 5, 0))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return Model((), np.zeros(0), 0.0, 0.0, prior)
    share_1, share_0 = F.col("p") / pos, F.col("q") / neg
    ranked = (
        rows.mapInArrow(_grams, "gram string, label int, n long")
        .groupBy("gram")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"),
        )
        .filter((F.col("p") >= 2) & (share_1 > 4 * share_0))
        .withColumn("gain", (share_1 - share_0) * F.log((share_1 + 0.5 / pos) / (share_0 + 0.5 / neg)))
        .orderBy(F.desc("gain"), F.desc(F.length("gram")), "gram")
        .limit(40 * landmarks)
        .select("gram")
    )
    marks = _pick([r["gram"] for r in ranked.collect()], landmarks)
    if not marks:
        return Model((), np.zeros(0), 0.0, 0.0, prior)

    def suspicious(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, label = [], []
            for s, y in zip(_sentences(batch.column("text").to_pylist(), marks), batch.column("label").to_pylist()):
                best = np.argsort(-s.sum(1), kind="stable")[:SENTENCES]
                vectors.append(s[best].ravel().tolist())
                label.append(y)
            yield pa.RecordBatch.from_pydict(
                {"v": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}
            )

    found = rows.mapInArrow(suspicious, "v array<float>, label int").collect()  # 2 * max_labelled rows at most
    bags = [np.array(r["v"], np.float32).reshape(-1, len(marks)) for r in found]
    y = np.array([1.0 if r["label"] else -1.0 for r in found])
    k = Kernel(marks)(marks).astype(float)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel values to Nyström features
    chosen = [b[0] if len(b) else np.zeros(len(marks), np.float32) for b in bags]
    for _ in range(4):
        x = np.stack(chosen) @ root
        weight = np.where(y > 0, 0.5 / pos, 0.5 / neg) * len(y)
        w, bias = _machine(x, y, weight)
        score = root @ w
        chosen = [b[int(np.argmax(b @ score))] if len(b) else c for b, c in zip(bags, chosen)]
    model = Model(tuple(marks), score, bias, 1.0, 0.0)
    slope, shift = _logistic(model.margins(bags), y)
    return Model(tuple(marks), score, bias, slope, shift)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its ``text``; NULL and empty texts score as a text without insults.

    A column of ``docs`` named as ``out`` is replaced. Texts of any length are read whole; ties and repeated rows
    score alike, an empty table gives an empty table.
    """
    kept = docs.drop(out)
    shared = kept.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [t or "" for t in part.column(at).to_pylist()]
                values = pa.array(shared.value.scores(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, out])

    schema = kept.withColumn(out, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return score(plain, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
