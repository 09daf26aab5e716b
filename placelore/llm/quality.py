"""Quality by a vote of nearest labelled neighbours in a latent semantic space.

1. Terms of a text are its hashed byte trigrams (square root of the frequency, times idf over all documents) and soft bins
   of surface shares over the whole text: repeated words, distinct words, capitals, symbols, digits, word and line lengths.
2. The latent space is the span of the leading right singular vectors of the labelled documents' term matrix.
3. The labelled vectors, at most 2 x ``MAX_LABELLED``, are broadcast. Every document is compared with all of them,
   block by block, by exact cosine products; its ``NEIGHBOURS`` nearest vote with their similarity as weight.
4. A monotone map moves the vote that separates the classes best, with each labelled document left out of its own
   vote, to the decision threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import held_out, stored
from placelore.llm.toxicity import labelled

MAX_LABELLED = 3000  # labelled documents of each class
LATENT, NEIGHBOURS, THRESHOLD = 48, 25, 0.7
BUCKETS, BINS, BLOCK = 1024, 12, 256
SHARES = 10
PIECE = 1 << 20
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 symbol, 4 white space
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[[b for b in range(33, 127) if not (chr(b).isalnum() or chr(b) in ".,'-")]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def _shares(text: bytes, kinds: np.ndarray) -> list[float]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x]
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        again / n,
        len(set(words)) / n,
        kinds[1] / size,
        min(1.0, 4 * kinds[3] / size),
        min(1.0, 4 * kinds[2] / size),
        min(1.0, size / n / 20),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(size / max(1, len(lines))) / 10),
        min(1.0, np.log1p(len(words)) / 12),
        max(Counter(words).values(), default=0) / n,
    ]


def _hashed(wide: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of some bytes."""
    mixed = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
    return mixed >> np.uint32(22)


def terms(texts: list[bytes]) -> np.ndarray:
    """Term rows of some texts: trigram frequencies (square roots, unit length), then soft bins of the shares."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    kinds = np.zeros((len(texts), 5), np.int64)
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data), PIECE):  # bounded memory for texts of any length
            wide = data[at : at + PIECE + 2].astype(np.uint32)
            kinds[i] += np.bincount(_KIND[data[at : at + PIECE]], minlength=5)
            counts[i] += np.bincount(_hashed(wide), minlength=BUCKETS)
    grams = np.sqrt(counts.astype(np.float32))
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-6)
    shares = np.array([_shares(t, k) for t, k in zip(texts, kinds)])
    centres = np.linspace(0, 1, BINS)
    bins = np.exp(-0.5 * ((shares[:, :, None] - centres) * BINS) ** 2).reshape(len(texts), -1)
    return np.hstack([grams, bins / np.sqrt(SHARES)]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # terms to latent space, idf included
    vectors: np.ndarray  # labelled documents, unit length
    labels: np.ndarray
    weight: float  # of a neighbour of class 0, which balances the classes
    cut: float  # vote that becomes the threshold
    prior: float

    def vote(self, similar: np.ndarray) -> np.ndarray:
        k = min(NEIGHBOURS, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, 1), 0) ** 8 + 1e-9
        labels = self.labels[near]
        weight *= np.where(labels > 0, 1.0, self.weight)
        return (weight * labels).sum(1) / weight.sum(1)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = rows @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        vote = self.vote(self.latent(terms(texts)) @ self.vectors.T)
        below = vote / max(self.cut, 1e-9) * THRESHOLD
        above = 1 - (1 - vote) / max(1 - self.cut, 1e-9) * (1 - THRESHOLD)
        return np.clip(np.where(vote < self.cut, below, above), 0.0, 1.0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows = terms(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows], pa.binary()), part.column("label")], ["row", "label"]
            )


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of documents and of those with each bucket, one row a task."""
    found, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            data = np.frombuffer(text.as_py(), np.uint8)
            seen = np.zeros(BUCKETS, bool)
            for at in range(0, len(data), PIECE):
                seen[_hashed(data[at : at + PIECE + 2].astype(np.uint32))] = True
            found += seen
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([found.tolist()], pa.list_(pa.int64()))], ["n", "found"])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents and how many of them hold each bucket of trigrams, over all rows."""
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = texts.mapInArrow(_present, "n long, found array<long>").select("n", F.posexplode("found").alias("at", "v"))
    rows = counts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # BUCKETS rows
    present = np.zeros(BUCKETS, np.int64)
    for r in rows:
        present[r["at"]] = r["v"]
    return (rows[0]["n"] if rows else 0), present


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from at most ``max_labelled`` documents of each class whose crc32 of the id does not leave 2 modulo 4.

    Without labels of both classes every text scores the share of class 1 (0.5 without any label).
    """
    found = stored(
        labelled(docs, labels, "quality", max_labelled, 4, 2)
        .select(F.col("text").cast("binary").alias("text"), "label")
        .mapInArrow(_rows, "row binary, label int")
    ).orderBy("row", "label").collect()  # 2 * max_labelled rows of fixed width at most
    y = np.array([r["label"] for r in found], float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((0, 0)), np.zeros((0, 0)), y, 1.0, THRESHOLD, prior)
    x = np.stack([np.frombuffer(r["row"], np.float32) for r in found])
    total, present = document_frequencies(docs)
    idf = np.ones(x.shape[1], np.float32)
    idf[:BUCKETS] += np.log((total + 1) / (present + 1)).astype(np.float32)
    values, vectors = np.linalg.eigh((x * idf).T @ (x * idf))
    projection = idf[:, None] * vectors[:, ::-1][:, :LATENT].astype(np.float32)
    z = x @ projection
    z = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    model = Model(projection.astype(np.float32), z, y, float(y.sum() / (1 - y).sum()), 0.5, prior)
    votes = np.empty(len(y))
    for at in range(0, len(y), BLOCK):
        similar = z[at : at + BLOCK] @ z.T
        similar[similar > 1 - 1e-6] = -1  # itself and its copies
        votes[at : at + BLOCK] = model.vote(similar)
    order = np.argsort(votes, kind="stable")
    right = np.cumsum(np.where(y[order] > 0, -1 / y.sum(), 1 / (1 - y).sum()))  # gain of a cut behind each vote
    best = int(np.argmax(right))
    cut = votes[order[best]] if best + 1 == len(y) else (votes[order[best]] + votes[order[best + 1]]) / 2
    return Model(model.projection, z, y, model.weight, float(np.clip(cut, 1e-6, 1 - 1e-6)), prior)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its ``text`` (NULL as empty), from the text alone.

    Texts are read whole; repeated rows score alike; a column named as ``out`` is replaced; an empty table gives an
    empty table.
    """
    kept = docs.drop(out)
    shared = kept.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                values = pa.array(shared.value.scores(texts).astype(float), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return score(plain, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
