"""Alignment of two tokenizations of the same texts: where both cut, which tokens end together, how usual each pair is.

Tokenizer A is a byte-level ``tokenizers`` file and reads a space and the text; tokenizer B is a ``sentencepiece`` model, which
adds the space itself. Per stretch of a text:

1. Coarse cuts: the character offsets of A's encoding and the spans of B's proto (its immutable form; the installed release
   returns the same spans as ``return_type="proto"``) give the ends of the tokens that cover whole characters.
2. Refinement: A's tokens inside one character and B's byte-fallback tokens have no end of their own there; their ends
   follow from the decoded bytes of the tokens.
3. Ends that both have in common cut the tokens into groups; the last A and B token of a group are a link.

A text is cut before a space that follows other than white space, where neither tokenizer joins anything (checked for the given files;
else texts stay whole), so that each distinct stretch is encoded once per worker. The links of the corpus are counted by
Spark; counts go back to the documents by broadcast joins in blocks of bounded size, never by a shuffle of links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placelore.llm.common import claim, collector_off, id_and_text, stored
from placelore.llm.token_counts import _byte_symbols

STRETCHES_HELD = 800_000  # stretches a worker keeps
LONGEST_HELD = 64  # letters of a stretch that is kept
BLOCK = 2_000_000  # bytes of text looked at together
TOGETHER = 3_000  # letters of new stretches encoded as one text
PAIRS = 2_000_000  # id pairs broadcast at once
B_IDS = 1 << 24  # a pair is the long a * B_IDS + b
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_RUN = re.compile(r"\s |^ ")
Aligned = tuple[str, int, int, bytes]  # written groups, tokens of A, tokens of B, pairs of the links (64 bits each)


class Aligner:
    """Two tokenizers and the alignments of the stretches met so far."""

    def __init__(self, byte_tokenizer: str, piece_model: str):
        self.a = Tokenizer.from_file(byte_tokenizer)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):  # others never come out of ordinary text
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.a_sizes = np.array([len(b) for b in self.a_bytes])
        self.a_names = np.array([(f"{i},", f"{i}|") for i in range(len(self.a_bytes))], dtype=object)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.fallback)
        ]
        self.b_sizes = np.array([len(b) for b in self.b_bytes])
        self.b_names = np.array([(f"{i},", f"{i};") for i in range(len(pieces))], dtype=object)
        # Neither side may join letters in front of a space with the space.
        self.cuts = (
            spec["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split["use_regex"]
            and not split["add_prefix_space"]
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )
        self.held: dict[str, Aligned | None] = {}

    def stretches(self, text: str) -> list[str]:
        """Parts of a space and the text that are encoded apart."""
        if not self.cuts:
            return [" " + text]
        if text[-1] != " " and not _RUN.search(text):  # every space is a cut
            return (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else _CUT.split(" " + text)
        return _CUT.split(" " + text)

    def ends(self, whole: str, a, b) -> tuple | None:
        """Ids of A, ids of B and the byte where each token ends; None when either side's bytes are not those of ``whole``."""
        raw = whole.encode()
        list_a, list_b = a.ids, [p.id for p in b]
        if b"".join([self.a_bytes[i] for i in list_a]) != raw or b"".join([self.b_bytes[i] for i in list_b]) != raw:
            return None
        ids_a, ids_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        stops_b = np.array([p.end for p in b], np.int64)
        # A: an offset is the end of its token unless the next token begins inside the same character.
        starts, stops = np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2).T
        if len(raw) > len(whole):
            letters = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            widths = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800) + (letters >= 0x10000)
            stops_a = np.append(0, np.cumsum(widths))[stops]
        else:
            stops_a = stops
        inside = np.append(starts[1:] < stops[:-1], False)
        ends_a = _refined(stops_a, inside, self.a_sizes[ids_a])
        # B: spans count bytes of the text behind the added space; a byte of a character has an end of its own.
        ends_b = _refined(stops_b + 1, self.fallback[ids_b], self.b_sizes[ids_b])
        return ids_a, ends_a, ids_b, ends_b

    def learn(self, stretches: list[str], into: dict[str, Aligned | None]) -> None:
        """Alignment of each stretch, encoded together as one text where the cuts between them hold."""
        whole = "".join(stretches)
        found = self.ends(whole, self.a.encode(whole, add_special_tokens=False), self.b.encode(whole[1:], return_type="proto").pieces)
        if found is None:
            if len(stretches) == 1:
                into[whole] = None
            else:
                for s in stretches:
                    self.learn([s], into)
            return
        ids_a, ends_a, ids_b, ends_b = found
        size = int(ends_a[-1]) + 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        last_a, last_b = at_b[ends_a], at_a[ends_b]  # the last tokens of the groups
        of_group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        order = np.argsort(of_group, kind="stable")
        names = np.concatenate([self.a_names[ids_a, last_a.astype(int)], self.b_names[ids_b, last_b.astype(int)]])[order].tolist()
        pairs = (ids_a[last_a] * B_IDS + ids_b[last_b]).tobytes()
        bounds = np.cumsum([len(s.encode()) for s in stretches])
        till_a, till_b = np.searchsorted(ends_a, bounds, "right").tolist(), np.searchsorted(ends_b, bounds, "right").tolist()
        till = np.searchsorted(ends_a[last_a], bounds, "right").tolist()
        a, b, g = 0, 0, 0
        for s, a_stop, b_stop, stop in zip(stretches, till_a, till_b, till):
            into[s] = ("".join(names[a + b : a_stop + b_stop]), a_stop - a, b_stop - b, pairs[8 * g : 8 * stop])
            a, b, g = a_stop, b_stop, stop

    def align(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The alignments of each text's stretches, in order; None for a text without tokens."""
        cut = [self.stretches(t) if t else [] for t in texts]
        held = self.held
        if len(held) > STRETCHES_HELD:
            held.clear()
        new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in held]
        together, size = [], 0
        for s in new:
            if not self.cuts or s[-1].isspace() or "▁" in s:  # nothing may follow, or no cut holds
                self.learn([s], held)
                continue
            together.append(s)
            size += len(s)
            if size >= TOGETHER:
                self.learn(together, held)
                together, size = [], 0
        if together:
            self.learn(together, held)
        out = []
        for stretches in cut:
            found = [held[s] for s in stretches]
            out.append(None if not found or None in found else found)
        for s in new:
            if len(s) > LONGEST_HELD:
                del held[s]
        return out


def _refined(stops: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of the tokens: the coarse ``stops``, but for tokens ``inside`` a character the end before plus decoded bytes."""
    if not inside.any():
        return stops
    total = np.cumsum(sizes)
    anchor = np.maximum.accumulate(np.where(inside, -1, np.arange(len(stops))))
    base = np.where(anchor >= 0, stops[anchor] - total[anchor], 0)
    return np.where(inside, base + total, stops)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``BLOCK`` bytes of text."""
    for batch in batches:
        sizes = np.fromiter((len(t) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
        block = np.cumsum(sizes) // BLOCK
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def token_groups(docs: DataFrame, byte_tokenizer: str, piece_model: str, written: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are left out): doc_id, n_a, n_b, n_groups, groups, links.

    ``groups`` is written as ``a1,a2|b1;a3|b2,b3`` (with ``written=False`` as the lower-case SHA-256 of that); ``links`` has one
    struct (pair, times) per distinct id pair of the text. A text that is NULL, empty, or whose tokens do not decode to a space
    and the text on both sides has no tokens: zeros, '' and no links. Rows with equal or NULL doc_id are kept apart.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<struct<pair: long, times: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("alignment", _ALIGNERS.clear)
        tool = _ALIGNERS.get((byte_tokenizer, piece_model))
        if tool is None:
            tool = _ALIGNERS[byte_tokenizer, piece_model] = Aligner(byte_tokenizer, piece_model)
        for batch in _blocks(batches):
            n_a, n_b, n_groups, groups, pairs, times = [], [], [], [], [], []
            with collector_off():
                aligned = tool.align([t.decode() for t in batch.column(1).to_pylist()])
            for found in aligned:
                found = found or []
                text = "".join([f[0] for f in found])[:-1]
                groups.append(text if written or not text else hashlib.sha256(text.encode()).hexdigest())
                n_a.append(sum([f[1] for f in found]))
                n_b.append(sum([f[2] for f in found]))
                linked = np.frombuffer(b"".join([f[3] for f in found]), np.int64)
                n_groups.append(len(linked))
                linked, counts = np.unique(linked, return_counts=True)
                pairs.append(linked)
                times.append(counts)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
            fields = [pa.field("pair", pa.int64()), pa.field("times", pa.int64())]
            links = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype(np.int64))], fields=fields)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)),
                    pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(pa.array(starts), links),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
            )

    return id_and_text(docs).mapInArrow(run, schema)


def link_counts(found: DataFrame) -> DataFrame:
    """Per id pair (``pair``) its links in all rows of ``found`` (``count``) and whether no other pair of its B id has more (``is_best``)."""
    counts = (
        found.select(F.explode("links").alias("l"))
        .groupBy(F.col("l.pair").alias("pair"))
        .agg(F.sum("l.times").alias("count"))
        .withColumn("b", F.pmod("pair", F.lit(B_IDS)))
    )
    counts = stored(counts)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # one row per id of B's vocabulary
    return counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("is_best"))


def align(docs: DataFrame, byte_tokenizer: str, piece_model: str, written: bool = True, pairs_at_once: int = PAIRS) -> DataFrame:
    """``token_groups`` with n_links, n_best (links whose pair is the most usual of its B id, ties included) and count_sum (their counts added up).

    The pair table may be any size: it is cut by the hash of the pair into blocks of about ``pairs_at_once`` rows, and each block is broadcast
    to the stored links. An empty table gives an empty table.
    """
    found = token_groups(docs, byte_tokenizer, piece_model, written)
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()))
    counts = link_counts(found).persist()
    blocks = -(-counts.count() // pairs_at_once) or 1
    links = found.select("_row", F.explode("links").alias("l")).select("_row", "l.pair", "l.times")
    sums = None
    for k in range(blocks):
        block = counts if blocks == 1 else counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)
        part = (
            links.join(F.broadcast(block), "pair")
            .groupBy("_row")
            .agg(
                F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
                F.sum(F.col("times") * F.col("count")).alias("count_sum"),
            )
        )
        sums = part if sums is None else sums.unionAll(part)
    if blocks > 1:
        sums = sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (
        found.join(sums, "_row", "left")
        .withColumns(
            {
                "n_links": F.col("n_groups"),
                "n_best": F.coalesce("n_best", F.lit(0)),
                "count_sum": F.coalesce("count_sum", F.lit(0)),
            }
        )
        .drop("_row", "links")
    )
