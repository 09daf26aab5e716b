"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

The pieces of a text form a lattice. A forward Viterbi pass gives the best score of every prefix; these scores are an
exact heuristic for a backward A* search, so complete segmentations leave the queue best first. No piece
crosses the boundary before a space mark that follows another character (checked when the model is
loaded), so the lattice of a text is a chain of word lattices. The forward pass over each distinct word also gives the score of its second best
segmentation; only the words of a text that lose least by it can differ within the N best, and the A* search runs on
these. The N best of the text are merged from their alternatives.

Scores are those of the model's pieces, added up. A character without a piece is a node of its own that scores ``PENALTY``
below the worst piece and is written as byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import claim, collector_off

SPACE, PENALTY, BEST = "▁", 10.0, 3
WORDS = 200_000  # words a worker keeps (about 320 bytes each); results do not depend on it
SHORT, TOGETHER = 40, 10_000  # letters and number of stretches searched together
ROWS, LETTERS = 1024, 2_000_000  # texts whose words are looked up together
BUCKETS = np.uint64(44)  # bits of a hash below its bucket
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(29))


def _hash(piece: str) -> np.uint64:
    """64-bit hash of the letters, the same as the difference of two prefixes in ``viterbi_of``."""
    code = 0
    for letter in piece:
        code = (code * int(_BASE) + ord(letter)) & (2**64 - 1)
    return _mixed(np.array([code], np.uint64))[0]


def _read(content: bytes) -> str:
    """Decoded text without the space of the dummy prefix."""
    text = content.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.id))
        # letter by letter: (score of the piece that ends here or None, what may follow)
        self.tree: dict[str, list] = {}
        for piece, value in self.score.items():
            following = self.tree
            for letter in piece:
                node = following.setdefault(letter, [None, {}])
                following = node[1]
            node[0] = value
        # neighbours inside some piece; between all others the lattice falls apart
        pairs = np.array([(ord(a), ord(b)) for a, b in {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}], np.uint32)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.unknown = min(self.score.values()) - PENALTY
        crossing = [p for p in self.id if SPACE in p.lstrip(SPACE)]
        if crossing or len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed, without pieces that continue behind a space mark")
        self._hashed = None
        # bytes of every id, for decoding
        self.raw = [t.replace(SPACE, " ").encode() for t in self.text]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.column = pa.array(self.raw, pa.large_binary())

    @staticmethod
    def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return _mixed((before.astype(np.uint64) << np.uint64(21)) | after) >> np.uint64(42)

    def joined(self, letters: np.ndarray) -> np.ndarray:
        """Whether a piece may cross the place before each letter. No crossing is missed; a sieve lets a few other pairs pass,
        which then stay in one stretch. The place before the first letter is not crossed."""
        out = np.zeros(len(letters), bool)
        out[1:] = self.sieve[self._pair(letters[:-1], letters[1:])]
        return out

    def lattice(self, word: str) -> tuple[list[list[tuple[int, float]]], list[float]]:
        """Edges (start, score) by end position, and the best score of each prefix."""
        n, score, longest = len(word), self.score, self.longest
        edges: list[list[tuple[int, float]]] = [[]]
        best = [0.0]
        for end in range(1, n + 1):
            here = []
            for start in range(max(0, end - longest), end):
                value = score.get(word[start:end])
                if value is not None:
                    here.append((start, value))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown))
            edges.append(here)
            best.append(max(best[start] + value for start, value in here))
        return edges, best

    def viterbi(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """Cut positions and score of the best segmentation, and the score of the second best (-inf if there is one only)."""
        n, longest, unknown = len(word), self.longest, self.unknown
        best, second, back = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1), [0] * (n + 1)
        for start in range(n):
            here, runner, end, following = best[start], second[start], start, self.tree
            for letter in word[start : start + longest]:
                node = following.get(letter)
                end += 1
                if node is None:
                    if end > start + 1:
                        break
                    value, following = unknown, {}
                else:
                    value, following = node
                    if value is None:  # a mere beginning of pieces
                        if end > start + 1:
                            continue
                        value = unknown
                total = here + value
                if total > best[end]:
                    other = runner + value
                    second[end] = best[end] if best[end] > other else other
                    best[end], back[end] = total, start
                elif total > second[end]:
                    second[end] = total
        cuts, at = [], len(word)
        while at:
            at = back[at]
            cuts.append(at)
        return tuple(reversed(cuts)), best[-1], second[-1]

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted hashes of the plain pieces, their scores and ids, where each bucket of the hashes begins (-1: empty) and its largest size."""
        if self._hashed is None:
            hashes = np.array([_hash(p) for p in self.id], np.uint64)
            order = np.argsort(hashes)
            bucket, begins, sizes = np.unique(hashes[order] >> BUCKETS, return_index=True, return_counts=True)
            first = np.full(1 << (64 - int(BUCKETS)), -1, np.int32)
            first[bucket] = begins
            scores, ids = np.array(list(self.score.values())), np.array(list(self.id.values()), np.int32)
            self._hashed = hashes[order], scores[order], ids[order], first, int(sizes.max())
        return self._hashed

    def viterbi_of(self, words: list[str]) -> list[tuple[list[int], float, float]]:
        """Ids, score of the best segmentation and of the second best for many short words, position by position for all of them at once."""
        hashes, scores, ids, first, deepest = self.hashed()
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        words = [words[k] for k in order]
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width, columns = int(sizes[-1]), np.arange(n)
        letters = np.zeros((width, n), np.uint64)  # by position, then word
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(columns, sizes)] = flat
        prefix = np.zeros((width + 1, n), np.uint64)
        powers = [np.uint64(1)]
        for k in range(width):
            prefix[k + 1] = prefix[k] * _BASE + letters[k]
            powers.append(np.uint64(int(powers[-1]) * int(_BASE) % 2**64))
        best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        begin = np.searchsorted(sizes, np.arange(width + 1)).tolist()  # words from here on reach a position
        for end in range(1, width + 1):
            lo = begin[end]
            here, runner, from_, named = best[end, lo:], second[end, lo:], back[end, lo:], piece[end, lo:]
            for start in range(max(0, end - self.longest), end):
                code = _mixed(prefix[end, lo:] - prefix[start, lo:] * powers[end - start])
                place = first[code >> BUCKETS]
                at = np.flatnonzero(place >= 0)
                place, code = place[at], code[at]
                hit = hashes[place] == code
                for _ in range(deepest - 1):  # the next hash of the same bucket
                    place = np.where(hit, place, np.minimum(place + 1, len(hashes) - 1))
                    hit = hashes[place] == code
                at, place = at[hit], place[hit]
                value, name = scores[place], ids[place]
                if start == end - 1:  # a letter without a piece goes by its bytes
                    known, names = np.full(n - lo, self.unknown), np.full(n - lo, -1, np.int32)
                    known[at], names[at] = value, name
                    at, value, name = columns[: n - lo], known, names
                total, other = best[start, lo:][at] + value, second[start, lo:][at] + value
                before = here[at]
                wins = total > before
                runner[at] = np.where(wins, np.maximum(before, other), np.maximum(runner[at], total))
                won = at[wins]
                here[won], from_[won], named[won] = total[wins], start, name[wins]
        # traces of all words, last piece first
        steps, at = [], sizes
        while at.any():
            steps.append(np.where(at > 0, piece[at, columns], -2))
            at = back[at, columns].astype(np.int64)
        found = np.array(steps[::-1], np.int32).T
        spelled = np.flatnonzero((found == -1).any(1)).tolist()
        content = found[found != -2].tolist()
        ends = np.cumsum((found != -2).sum(1)).tolist()
        out = [content[a:b] for a, b in zip([0, *ends], ends)]
        for k in spelled:
            cuts, at = [], int(sizes[k])
            while at:
                at = int(back[at, k])
                cuts.append(at)
            out[k] = self.ids(words[k], tuple(reversed(cuts)))
        results = zip(out, best[sizes, columns].tolist(), second[sizes, columns].tolist())
        return [result for _, result in sorted(zip(order, results), key=itemgetter(0))]

    def n_best(self, word: str, most: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to ``most`` segmentations (score, cut positions), best first; equal scores: the earliest cuts first."""
        edges, best = self.lattice(word)
        queue = [(-best[-1], (), len(word), 0.0)]  # bound, cuts from the left, position, score of the suffix
        out: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(out) < most:
            bound, cuts, at, suffix = heapq.heappop(queue)
            if at == 0:
                out.append((-bound, cuts))
                continue
            for start, value in edges[at]:
                total = suffix + value
                heapq.heappush(queue, (-(best[start] + total), (start, *cuts), start, total))
        return out

    def ids(self, word: str, cuts: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for start, end in zip(cuts, (*cuts[1:], len(word))):
            piece = word[start:end]
            i = self.id.get(piece)
            out.extend([i] if i is not None else [self.bytes[b] for b in piece.encode()])
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids; the space of the dummy prefix is taken off."""
        return _read(b"".join(map(self.raw.__getitem__, ids)))

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of several sequences laid end to end; sequence k is ids[ends[k] : ends[k + 1]]."""
        taken = self.column.take(pa.array(ids))
        _, places, content = taken.buffers()
        at = np.frombuffer(places, np.int64, len(ids) + 1)[ends].tolist()
        whole = memoryview(content) if content is not None else memoryview(b"")
        return [_read(bytes(whole[a:b])) for a, b in zip(at, at[1:])]


class _Words(dict):
    """Chunk without its leading space mark to (ids of its best segmentation as bytes, their score, loss of the second best)."""

    def __init__(self, pieces: Pieces, most: int):
        self.pieces, self.most, self.others, self.parts = pieces, most, {}, {}

    def learn(self, words: list[str]) -> None:
        """Makes room and adds the words not met before; their stretches are searched together."""
        if len(self) >= WORDS:
            self.clear()
        if len(self.parts) >= WORDS // 4:
            self.parts.clear()
        fresh = [word for word in dict.fromkeys(words) if word not in self]
        if not fresh:
            return
        whole = SPACE + SPACE.join(fresh)
        begins = np.cumsum([0, *(len(word) + 1 for word in fresh)])
        # no piece crosses such a cut; words differ in punctuation more often than in the stretches between
        cut = ~self.pieces.joined(np.frombuffer(whole.encode("utf-32-le"), np.uint32))
        cut[begins[:-1]] = True
        cuts = np.append(np.flatnonzero(cut), len(whole))
        places = cuts.tolist()
        stretches = [whole[a:b] for a, b in zip(places, places[1:])]
        found = {c: self.parts.get(c) for c in stretches}
        new = sorted((c for c, known in found.items() if known is None), key=len)
        short = [c for c in new if len(c) <= SHORT]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            for chunk, (ids, best, second) in zip(some, self.pieces.viterbi_of(some)):
                found[chunk] = array("i", ids).tobytes(), best, second - best
        for chunk in new[len(short) :]:
            found[chunk] = self.searched(chunk)
        # a word's ids are those of its stretches, its second best differs in one of them
        known = [found[c] for c in stretches]
        first = np.searchsorted(cuts, begins)
        several = np.repeat(np.diff(first) > 1, np.diff(first)).tolist()
        self.parts.update((c, entry) for c, entry, kept in zip(stretches, known, several) if kept)
        content = b"".join([ids for ids, _, _ in known])
        at = np.cumsum([0, *(len(ids) for ids, _, _ in known)])[first].tolist()
        best = np.add.reduceat([score for _, score, _ in known], first[:-1]).tolist()
        loss = np.maximum.reduceat([gap for _, _, gap in known], first[:-1]).tolist()
        self.update(zip(fresh, zip([content[a:b] for a, b in zip(at, at[1:])], best, loss)))

    def __missing__(self, word: str):
        self.learn([word])
        return self[word]

    def searched(self, chunk: str) -> tuple[bytes, float, float]:
        cuts, best, second = self.pieces.viterbi(chunk)
        return array("i", self.pieces.ids(chunk, cuts)).tobytes(), best, second - best

    def alternatives(self, word: str) -> list[tuple[float, bytes | None]]:
        """Losses and ids of the best segmentations, the best of all first."""
        found = self.others.get(word)
        if found is None:
            if len(self.others) >= WORDS // 16:
                self.others.clear()
            ids, best, _ = self[word]
            chunk = SPACE + word
            made = ((s - best, array("i", self.pieces.ids(chunk, cuts)).tobytes()) for s, cuts in self.pieces.n_best(chunk, self.most))
            found = self.others[word] = [(0.0, None), *[m for m in made if m[1] != ids][: self.most - 1]]
        return found


def split_words(text: str) -> list[str]:
    """Chunks of the lattice without their first character, which is always a space mark (the first is the dummy prefix)."""
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return [chunk[1:] for chunk in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts (as ``split_words`` gives them) laid end to end, and where those of each text end (0 first)."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring(texts, SPACE), pc.match_substring_regex(texts, "  |^ | $|^$"))
    # a text that needs care travels as an empty one, whose only chunk makes room for its own
    parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    flat, ends = parts.flatten(), np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    ends = ends - ends[0]
    pieces, grown, done = [], np.diff(ends), 0
    for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        text = texts[k].as_py()
        own = pa.array(split_words(text) if text else [], flat.type)
        pieces += flat.slice(done, ends[k] - done), own
        grown[k], done = len(own), ends[k + 1]
    return pa.concat_arrays([*pieces, flat.slice(done)]), np.concatenate([[0], np.cumsum(grown)])


def _merged(
    ids: bytes, score: float, losses: np.ndarray, places: np.ndarray, word: Callable[[int], str], cache: _Words, most: int
) -> list[tuple[float, bytes]]:
    """The ``most`` best segmentations of a text from its best one (``ids`` begin at ``places`` for each word)."""
    out = [(score, ids)]
    # only the words with the smallest gaps can change in the best few; of equal ones the first
    gaps, few = losses.copy(), []
    for _ in range(min(most - 1, len(gaps))):
        i = int(gaps.argmax())
        if gaps[i] == -math.inf:
            break
        few.append(i)
        gaps[i] = -math.inf
    options = [cache.alternatives(word(i)) for i in few]
    queue = [(0.0, (0,) * len(few))]
    seen = {queue[0][1]}
    while queue and len(out) < most:
        loss, choice = heapq.heappop(queue)
        if any(choice):
            changed, at = [], 0
            for i, other in sorted((few[j], options[j][c][1]) for j, c in enumerate(choice) if c):
                changed += ids[at : places[i]], other
                at = places[i + 1]
            out.append((score - loss, b"".join([*changed, ids[at:]])))
        for j, c in enumerate(choice):
            if c + 1 < len(options[j]):
                following = (*choice[:j], c + 1, *choice[j + 1 :])
                if following not in seen:
                    seen.add(following)
                    total = -sum(options[i][k][0] for i, k in enumerate(following))
                    heapq.heappush(queue, (total, following))
    return out


def segmentations(words: list[str], cache: _Words, most: int) -> list[tuple[float, bytes]]:
    """The ``most`` best segmentations of a text (score, ids), best first; ties go to the earlier word."""
    if not words:
        return [(0.0, b"")]
    parts, scores, losses = zip(*map(cache.__getitem__, words))
    places = np.cumsum([0, *map(len, parts)])
    return _merged(b"".join(parts), float(sum(scores)), np.array(losses), places, words.__getitem__, cache, most)


def segmented(texts: pa.Array, cache: _Words, most: int) -> list[list[tuple[float, bytes]]]:
    """``segmentations`` of several texts; each distinct word is looked up once."""
    flat, ends = flat_words(texts)
    coded = flat.dictionary_encode()
    words, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    cache.learn(words)
    known = [cache[word] for word in words]
    _, places, content = pa.array([ids for ids, _, _ in known], pa.large_binary()).take(pa.array(number)).buffers()
    places = np.frombuffer(places, np.int64, len(number) + 1)
    content = memoryview(content) if content is not None else memoryview(b"")
    scores = np.array([score for _, score, _ in known])[number].tolist()
    losses = np.array([loss for _, _, loss in known])[number]
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if a == b:
            out.append([(0.0, b"")])
            continue
        own = places[a : b + 1] - places[a]
        ids = bytes(content[places[a] : places[b]])
        out.append(_merged(ids, float(sum(scores[a:b])), losses[a:b], own, lambda i: words[number[a + i]], cache, most))
    return out


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows and about ``LETTERS`` bytes of text."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))])
    start = 0
    while start < batch.num_rows:
        fits = int(np.searchsorted(total, total[start] + LETTERS, "right")) - 1
        stop = max(start + 1, min(start + ROWS, fits))
        yield batch.slice(start, stop - start)
        start = stop


_TOOLS: dict[tuple, tuple[Pieces, _Words]] = {}


def _tools(path: str, most: int) -> tuple[Pieces, _Words]:
    claim("sentencepiece", _TOOLS.clear)
    if (path, most) not in _TOOLS:
        pieces = Pieces(path)
        _TOOLS[path, most] = pieces, _Words(pieces, most)
    return _TOOLS[path, most]


def encode(docs: DataFrame, model: str, most: int = BEST) -> DataFrame:
    """All columns of ``docs`` with ``ids`` (best segmentation), ``best`` (array of score, n_pieces, ids_sha256 of the N best
    segmentations, best first) and ``decoded`` (text made from ``ids``).

    ``model`` is the path of the model file on every executor. NULL and empty texts have no ids, one empty
    segmentation of score 0 and decode to the empty text. U+2581 in a text decodes to a space, as the format
    defines. Texts are encoded whole; repeated rows get equal results; columns of ``docs`` with the new
    names are replaced; an empty table gives an empty table.
    """
    names = ("ids", "best", "decoded")
    kept = docs.drop(*names)
    at = kept.columns.index("text")
    best_type = "array<struct<score:double,n_pieces:bigint,ids_sha256:string>>"
    schema = kept.withColumns(
        {"ids": F.lit(None).cast("array<int>"), "best": F.lit(None).cast(best_type), "decoded": F.lit(None).cast("string")}
    ).schema
    best_arrow = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = _tools(model, most)
        for batch in batches:
            for part in _blocks(batch, at):
                with collector_off():
                    found = segmented(part.column(at), cache, most)
                ids = [np.frombuffer(f[0][1], np.int32) for f in found]
                best = [
                    [{"score": s, "n_pieces": len(b) // 4, "ids_sha256": hashlib.sha256(b).hexdigest()} for s, b in f] for f in found
                ]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(ends, pa.array(flat)),
                        pa.array(best, best_arrow),
                        pa.array(pieces.decode_many(flat, ends), pa.string()),
                    ],
                    [*part.schema.names, *names],
                )

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``encoded`` with the text of its id sequences; NULL sequences give NULL."""
    kept = encoded.drop(out)
    at = kept.columns.index(ids)
    schema = kept.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _tools(model, 1)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
