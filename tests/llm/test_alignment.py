"""Groups, links and their counts compared with two plain loops over whole encodings."""

import hashlib
import random
from collections import Counter

import pytest

from placelore.llm import alignment
from placelore.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, op13_alignment
from test_texts import frame

TOOL = alignment.Aligner(BYTE_TOKENIZER, PIECE_MODEL)
LETTERS = [" ", "  ", "a", "the", "é", "日", "\U00012345", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "1", "<s>", "<0x0A>", "<|endoftext|>", ".", "x"]


def brute(text):
    """Groups as lists of ids, from the bytes of whole encodings; None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = TOOL.a.encode(" " + text, add_special_tokens=False).ids, TOOL.b.encode(text)
    bytes_a, bytes_b = [TOOL.a_bytes[i] for i in a], [TOOL.b_bytes[i] for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    out, group, i, j, x, y = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            x, i = x + len(bytes_a[i]), group[0].append(a[i]) or i + 1
        else:
            y, j = y + len(bytes_b[j]), group[1].append(b[j]) or j + 1
        if x == y:
            out.append(group)
            group = ([], [])
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or [])


def awkward(rng, with_marks=False):
    letters = LETTERS + ["▁", "\x00"] * with_marks
    return "".join(rng.choice(letters) for _ in range(rng.randrange(14)))


def test_groups_equal_those_of_whole_encodings():
    rng = random.Random(1)
    texts = [awkward(rng, k % 5 == 0) for k in range(6000)]
    for k in range(0, len(texts), 50):
        for text, found in zip(texts[k : k + 50], TOOL.align(texts[k : k + 50])):
            want = brute(text)
            assert (found is None) == (want is None), repr(text)
            assert "".join(f[0] for f in found or [])[:-1] == written(want), repr(text)


def test_bytes_inside_characters_are_cut():
    found = TOOL.align(["\U00012345"])[0]
    assert found[0][0].count(";") > 1  # common ends inside the one character
    assert brute("a▁b") is None and TOOL.align(["a▁b", "c"])[0] is None


def test_whole_texts_where_no_cut_holds():
    tool = alignment.Aligner(BYTE_TOKENIZER, PIECE_MODEL)
    tool.cuts = False
    assert "".join(f[0] for f in tool.align(["the cat, the \n dog"])[0])[:-1] == written(brute("the cat, the \n dog"))


@pytest.mark.parametrize("at_once", [2_000_000, 7])
def test_counts_equal_brute_force(spark, at_once):
    rng = random.Random(2)
    rows = [(k, awkward(rng, k % 9 == 0) * rng.randrange(1, 4)) for k in range(120)]
    rows += [(None, None), (3, ""), (3, "the the"), (3, "the the"), (-5, "the cat " * 9000), (-6, "w" * 60_000)]
    docs = frame(spark, rows).withColumnRenamed("n_tokens", "links").withColumnRenamed("score", "n_best")
    got = alignment.align(docs, BYTE_TOKENIZER, PIECE_MODEL, pairs_at_once=at_once).collect()
    links = [[(a[-1], b[-1]) for a, b in brute(t) or []] for _, t in rows]
    counts = Counter(p for found in links for p in found)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = [
        (
            i, sum(len(a) for a, _ in brute(t) or []), sum(len(b) for _, b in brute(t) or []), written(brute(t)), len(found), len(found),
            sum(counts[p] == top[p[1]] for p in found), sum(counts[p] for p in found),
        )
        for (i, t), found in zip(rows, links)
    ]
    names = ["doc_id", "n_a", "n_b", "groups", "n_groups", "n_links", "n_best", "count_sum"]
    assert sorted(map(repr, ([r[n] for n in names] for r in got))) == sorted(map(repr, map(list, want)))
    assert alignment.align(docs.filter("false"), BYTE_TOKENIZER, PIECE_MODEL).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in op13_alignment(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        text = written(brute(d["text"]))
        assert rows[d["doc_id"]]["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
