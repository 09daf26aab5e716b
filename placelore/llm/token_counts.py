"""Token counts of byte-pair encoding, without making tokens.

The symbols of a word stand in a linked list; a heap holds the ranks of adjacent pairs. The lowest pair is popped,
merged, and its new neighbours are pushed, until no ranked pair is left. The count of the word is its
initial symbols minus the merges made; no identifier is emitted. Words are counted once per worker.

The tokenizer file gives the normalizer, the pattern of words, the merges and the special strings. Supported are files
of byte-level merges with a word-end suffix, as ``Tokenizer`` below checks.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import CACHE_ENTRIES, claim


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, following = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(following))
            following += 1
    return out


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, lowest rank first, leftmost first among equals."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = symbols[:]
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = following[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one side has been merged since
        merges += 1
        symbols[i], symbols[j] = left + right, ""
        k = following[i] = following[j]
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return n - merges


class Tokenizer:
    """What the count needs of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("a byte-level tokenizer with NFC, white space and lower-case steps is needed")
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.words = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.strings = special
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.symbols = _byte_symbols()
        self.counts: dict[str, int] = _Counts(self)

    def word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return count_merged(symbols, self.ranks)

    def count(self, text: str) -> int:
        """Tokens of a text; special strings count one token each and are looked for before anything else."""
        total, parts = 0, [text]
        if any(s in text for s in self.strings):
            parts = self.special.split(text)
            total = len(parts) - 1
        counts = self.counts.__getitem__
        for part in parts:
            if not part.isascii():
                part = lower(unicodedata.normalize("NFC", part))
            else:
                part = part.lower()
            total += sum(map(counts, self.words.findall(part)))
        return total


def lower(text: str) -> str:
    """Lower case letter by letter; Python's own lowering makes a final sigma depend on its neighbours."""
    return "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()


class _Counts(dict):
    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = self.tokenizer.word(word)
        return value


_TOKENIZERS: dict[str, Tokenizer] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """All columns of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit.

    ``tokenizer`` is the path of the file on every executor. NULL counts as empty: no bytes, no tokens. Texts are
    counted whole, repeated rows alike; columns of ``docs`` with the new names are replaced; an
    empty table gives an empty table.
    """
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    at = kept.columns.index("text")
    schema = kept.withColumn("n_tokens", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", _TOKENIZERS.clear)
        tool = _TOKENIZERS.get(tokenizer)
        if tool is None:
            tool = _TOKENIZERS[tokenizer] = Tokenizer(tokenizer)
        for batch in batches:
            counts = np.fromiter((tool.count(t) if t else 0 for t in batch.column(at).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], [*batch.schema.names, "n_tokens"])

    return kept.mapInArrow(run, schema).withColumns(
        {
            "n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
