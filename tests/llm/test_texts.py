"""Decontamination, SentencePiece, token counts, toxicity, quality, licences and personal data."""

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex

from placelore.llm import decontaminate, license_scan, pii, quality, sentencepiece, token_counts, toxicity
from placelore.llm.queries import PIECE_MODEL

SCHEMA = "doc_id long, text string, score double, ids string, coverage int, n_tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", 1, "y") for i, t in rows], SCHEMA)


# decontamination

def best_tiling(item, text, seed):
    """Common blocks of at least ``seed`` words, by plain greedy search: the longest, then the first in the item, then in the text."""
    item, text, found = list(item), list(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] is not None:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return found
        found.append((i, j, n))
        item[i : i + n], text[j : j + n] = [object()] * n, [None] * n


def test_tiling_marks_longest_matches_first():
    rng = random.Random(3)
    for n in range(1500):
        letters, seed = rng.choice([("ab", 2), ("abcdefgh", 3), ("abc", 1)])
        item = [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
        parts = [item[k : k + 7] for k in range(0, len(item), 7)]
        rng.shuffle(parts)
        text = [w for p in parts for w in [*p, rng.choice([*letters, "x", None])]]
        assert decontaminate.tiles(item, text, seed) == best_tiling(item, text, seed)
    assert decontaminate.tiles(list("abbbbababbabbbbabbbaaaa"), list("baaabbb"), 2) == best_tiling("abbbbababbabbbbabbbaaaa", "baaabbb", 2)


def test_contamination_both_ways(spark):
    rng = random.Random(5)
    words = [f"q{i}" for i in range(300)]
    item = [rng.choice(words) for _ in range(40)]
    moved = item[20:] + ["und"] + item[:20]
    half = item[:20] + [rng.choice(words) for _ in range(30)]
    rows = [(1, " ".join(item).upper()), (2, "x, " + ", ".join(moved)), (3, " ".join(half)), (4, None), (5, ""), (None, "tiny item here"), (1, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (9, "Tiny item"), (8, None), (None, "a b"), (10, "")], "item_id long, text string")
    docs = frame(spark, rows)
    for limit in (1_000_000, 0):
        found = decontaminate.contamination(docs, bench, local_words=limit)
        assert sorted(found.columns) == sorted(["doc_id", "text", "score", "ids", "n_tokens", "coverage", "item_id"])
        got = sorted((r["doc_id"] or 0, round(r["coverage"], 3), r["item_id"]) for r in found.collect())
        assert got[0] == (0, 1.0, 9) and got[1] == got[2] == (1, 1.0, 7) and got[3] == (2, 1.0, 7)
        assert got[4][0] == 3 and 0.4 < got[4][1] < 0.7
        assert [g[1:] for g in got[5:]] == [(0.0, None)] * 2
        assert decontaminate.contamination(frame(spark, []), bench, local_words=limit).count() == 0
    assert decontaminate.contamination(docs, bench.filter("false")).filter("coverage > 0").count() == 0


# SentencePiece

def all_segmentations(pieces, word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in pieces.score or len(p) == 1 for p in parts):
            yield sum(pieces.score.get(p, pieces.unknown) for p in parts), tuple(at[:-1])


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.Pieces(PIECE_MODEL)


@pytest.mark.parametrize("word", ["▁the", "▁thinking", "▁größe", "a漢b", "▁▁▁x", "▁", "▁😀🤖z"])
def test_n_best_equals_enumeration(pieces, word):
    want = sorted(((s, c) for s, c in all_segmentations(pieces, word)), key=lambda x: -x[0])
    got = pieces.n_best(word, 5)
    assert [s for s, _ in got] == [s for s, _ in want[:5]]
    assert all((s, c) in want for s, c in got) and len({c for _, c in got}) == len(got)
    cuts, best, second = pieces.viterbi(word)
    assert (best, cuts) in want and best == want[0][0] and second == (want[1][0] if len(want) > 1 else float("-inf"))


def test_words_searched_together_equal_words_searched_alone(pieces):
    rng = random.Random(6)
    letters = ["▁", "th", "e", "a", "s", "漢", "ß", "\U0001F600", "ing", "x", "1", ".", "st"]
    words = ["▁" + "".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for word, (ids, best, second) in zip(words, pieces.viterbi_of(words)):
        cuts, want, want_second = pieces.viterbi(word)
        assert (ids, best, second) == (pieces.ids(word, cuts), want, want_second), word


def test_words_do_not_depend_on_what_was_learned_before(pieces):
    words = ["the", "of,", "x.y", "a" * 60, "日本", "the", ""]
    together, alone = sentencepiece._Words(pieces, 3), sentencepiece._Words(pieces, 3)
    together.learn(words)
    assert [together[w] for w in words] == [alone[w] for w in words]


@pytest.mark.parametrize("text", ["aa bbb the", "the the", "x", "in  on"])
def test_text_n_best_equals_enumeration(pieces, text):
    words = sentencepiece.split_words(text)
    whole = "".join("▁" + w for w in words)
    assert whole == "▁" + text.replace(" ", "▁")
    want = sorted((s for s, _ in all_segmentations(pieces, whole)), reverse=True)[:6]
    got = sentencepiece.segmentations(words, sentencepiece._Words(pieces, 6), 6)
    assert [s for s, _ in got] == pytest.approx(want)
    assert len({i for _, i in got}) == len(got)


def test_texts_of_a_block_equal_texts_alone(pieces):
    rng = random.Random(7)
    words = ["the", "of,", "x.y", "", "日本", "▁a", "größe!", "a" * 50, "\n", "1\t2", "Nd.\nA"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(300)] + [None, " ", "", "  a", "a▁"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    parts = list(sentencepiece._blocks(batch.slice(3), 0))
    assert sum(p.num_rows for p in parts) == len(texts) - 3
    flat, ends = sentencepiece.flat_words(batch.column(0))
    split = [sentencepiece.split_words(t) if t else [] for t in texts]
    assert [flat[a:b].to_pylist() for a, b in zip(ends, ends[1:])] == split
    found = sentencepiece.segmented(batch.column(0).slice(3), sentencepiece._Words(pieces, 4), 4)
    alone = [sentencepiece.segmentations(w, sentencepiece._Words(pieces, 4), 4) for w in split[3:]]
    assert found == alone
    ids = [np.frombuffer(f[0][1], np.int32) for f in found]
    assert pieces.decode_many(np.concatenate(ids), np.cumsum([0, *map(len, ids)])) == [pieces.decode(i.tolist()) for i in ids]


def test_encode_and_decode(spark):
    texts = ["Hello  world", "  x\t\n", "", None, "漢字 \U0001F600 á", "word " * 3000, " "]
    docs = frame(spark, list(enumerate(texts)))
    found = sentencepiece.encode(docs, PIECE_MODEL)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(rows[i]["decoded"] == (t or "") for i, t in enumerate(texts))
    assert rows[2]["ids"] == [] and rows[3]["ids"] == []
    again = sentencepiece.decode(found.select("doc_id", "ids", "text"), PIECE_MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in again} == {i: t or "" for i, t in enumerate(texts)}
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECE_MODEL)
    assert all(model.decode(list(rows[i]["ids"])) == (t or "") for i, t in enumerate(texts))
    assert sentencepiece.encode(frame(spark, []), PIECE_MODEL).count() == 0


# token counts

def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = "abcdefgxyzéßñ漢字ΣσİK0123 .,'<|>\n\t ́​😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["It's we'll <|endoftext|>x<|startoftext|><|endoftext|>", "ΑΣ ΑΣΑ", "İstanbul", "", None, "a" * 5000, "<|endoftext", "\r\n \x85 x y"]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 2048)
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


# toxicity and quality

def subsequences(word):
    out = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i < toxicity.SPAN:
            key = word[i] + word[j] + word[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_equals_its_definition():
    marks, words = ["idiot", "moron", "aaaa"], ["idiot", "i1d1i1o1t", "banana", "ab", "moronisch", "aaaaaa", "ümoroñ"]
    got = toxicity.Kernel(marks)(words)
    for w, row in zip(words, got):
        for z, value in zip(marks, row):
            a, b = subsequences(w), subsequences(z)
            dot = sum(v * b.get(u, 0) for u, v in a.items())
            norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            want = dot / norm if norm else 0
            assert value == pytest.approx(want if want >= toxicity.FLOOR else 0, abs=1e-6)


def labelled_corpus(n, bad):
    rng = random.Random(4)
    syllables = ["ta", "ri", "mo", "ne", "lu", "ka", "so", "vi"]

    def sentence():
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(8)) + "."

    rows = []
    for i in range(n):
        text = " ".join(sentence() for _ in range(rng.randrange(1, 6)))
        label = int(rng.random() < 0.4)
        rows.append((i, bad(text, rng) if label else text, label))
    return rows


def measured(found, rows, held):
    score = {r["doc_id"]: r for r in found}
    hit = [(score[i]["predicted"], y) for i, _, y in rows if score[i]["held_out"] == held]
    return sum(p == y for p, y in hit) / len(hit)


def test_toxicity_on_held_out_rows(spark):
    insults = ["grolpig", "zwurxel", "plixnog", "g.r.o.l.p.i.g", "zwurrxel", "p l i x n o g", "grolpigen"]

    def bad(text, rng):
        words = text.split(" ")
        words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    rows = labelled_corpus(400, bad)
    extra = [(1000, None), (1001, ""), (1002, "x" * 100_000), (None, "ta ri")]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + extra)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 404 and all(0 <= r["score"] <= 1 for r in found)
    assert measured(found, rows, True) > 0.95
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in found)  # held-out labels have no part
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.filter("false")).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    def bad(text, rng):
        if rng.random() < 0.5:
            return text.upper().replace(" ", "!! ")
        return " ".join(w for w in text.split() for _ in range(6))

    rows = [(i, t, 1 - y) for i, t, y in labelled_corpus(500, bad)]
    extra = [(1000, None), (1001, ""), (1002, "x" * 100_000), (None, "ta ri")]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + extra)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, quality int, toxic int")
    found = quality.quality(docs, labels).collect()
    assert len(found) == 504 and all(0 <= r["score"] <= 1 for r in found)
    assert measured(found, rows, True) > 0.95
    assert quality.quality(frame(spark, []), labels).count() == 0
    assert {r["predicted"] for r in quality.quality(docs, labels.filter("false")).collect()} == {0}


def test_quality_counts_whole_texts_and_all_documents(spark):
    text = b" ".join(w for i in range(34) for w in (b"x%d" % i, b"same"))
    for t in (text, b"front " + text):
        shares = quality._shares(t, quality.np.zeros(5, int))
        assert shares[-1] == t.split().count(b"same") / len(t.split())
    # unlabelled documents count too
    total, present = quality.document_frequencies(frame(spark, [(i, "abc") for i in range(5)] + [(9, "xyz"), (10, None)]))
    assert total == 7 and sorted(present[present > 0]) == [1, 5]


# licences

def test_licences_are_inherited_from_the_nearest_directory(spark):
    prose = "Lorem ipsum dolor sit amet the and of. " * 30
    files = [
        ("/a/LICENSE", "Released under the MIT License."),
        ("/a/b/x.txt", prose), ("/a/b/c/y.txt", "# Licensed under the Apache License, Version 2.0.\n" + prose),
        ("/a/d/notice.txt", "LICENSED under the Apache License Version 2.0"), ("/a/d/e/f/z.txt", prose),
        ("/q/r.txt", prose), ("/q/null", None), (None, prose), ("/a/b/x.txt", prose), ("top", "All rights reserved."),
    ] + [(f"/p/{i}.txt", prose) for i in range(60)]
    table = spark.createDataFrame([(p, t, "own", "l") for p, t in files], "path string, text string, origin string, license string")
    got = {r["path"]: (r["license"], r["origin"], r["origin_path"]) for r in license_scan.scan(table, license_scan.templates(spark)).collect()}
    assert got["/a/LICENSE"] == ("MIT", "own", "/a/LICENSE")
    assert got["/a/b/x.txt"] == ("MIT", "inherited", "/a/LICENSE")
    assert got["/a/b/c/y.txt"] == ("Apache-2.0", "own", "/a/b/c/y.txt")
    assert got["/a/d/e/f/z.txt"] == ("Apache-2.0", "inherited", "/a/d/notice.txt")
    # the licence of the root directory ("top") holds where nothing nearer does
    assert got["/q/r.txt"] == got["/q/null"] == ("Proprietary", "inherited", "top")
    assert len(got) == 68
    empty = license_scan.scan(table, license_scan.templates(spark).filter("false"))
    assert {r["origin"] for r in empty.collect()} == {"none"}
    assert license_scan.scan(table.filter("false"), license_scan.templates(spark)).count() == 0


def own_line(spark, texts):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    return {int(r["path"]): (r["license"], r["cosine"]) for r in license_scan.own_licenses(files, license_scan.templates(spark)).collect()}


def test_verbatim_notices_have_cosine_one_whatever_is_common(spark):
    notices = [t for _, t in license_scan.TEMPLATES]
    # 'mit' stands in most texts; one notice stands in a third of them
    found = own_line(spark, notices + ["wir gehen mit dem hund the of"] * 60 + [f"x\n{notices[3]}\nmit der und"] * 36)
    assert all(found[i] == (name, pytest.approx(1)) for i, (name, _) in enumerate(license_scan.TEMPLATES))
    assert all(found[i] == (None, None) for i in range(12, 72)) and all(found[i] == ("GPL-3.0", pytest.approx(1)) for i in range(72, 108))


# personal data

PYTHON = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PYTHON.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (459) 555-7415", "+12", "é", "😀", " ",
            "_", "z@q.r_s@t.u", "007.08.9.10.11", "+49.30.1234567", "12 34", "-", "\n", "word", "%", "4111111111111111", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "a" * 50_000 + "@b.c", "1" * 50_000]
    found = pii.find(frame(spark, list(enumerate(texts))))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.written(pii.base_only(found["spans"])).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert pii.find(frame(spark, [])).count() == 0


def test_terms_that_disclose_are_generalised_or_removed(spark):
    rows = [(i, f"calm words before zorblatt quimby, mail joe@x.org zorbing after {i}") for i in range(4)]
    rows += [(10 + i, f"plain words before mail other{i}@x.org after zorro and calm things") for i in range(40)]
    rows += [(100 + i, "calm words and nothing else to see here, mail after before") for i in range(400)]
    docs = frame(spark, rows)
    found = pii.find(docs)
    one = {r["doc_id"]: r["spans"] for r in found.collect()}
    text = dict(rows)
    terms = {text[0][s["start"] : s["end"]]: s["replacement"] for s in one[0] if s["kind"] == "term"}
    assert terms["quimby"] == "" and terms["zorblatt"] == "zor*" and "before" not in terms and "mail" not in terms
    assert all(s["kind"] != "term" for i in range(100, 140) for s in one[i])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, found).collect()}
    assert clean[0] == "calm words before zor* , mail [email] zor* after 0" and clean[100] == text[100]


def test_terms_disclose_in_the_whole_text_and_for_sparse_entities(spark):
    far = "calm words " * 30
    rows = [(i, f"mail joe@x.org {far} zorblatt {far} zorblatt ends") for i in range(4)]
    rows += [(10 + i, f"quimbus team, mail user{i}@quim.org after") for i in range(5)]  # every address stands once
    rows += [(100 + i, "calm words and nothing else to see here, mail after before team ends") for i in range(400)]
    found = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    text = dict(rows)

    def terms(i):
        return [text[i][s["start"] : s["end"]] for s in found[i] if s["kind"] == "term"]

    assert all(terms(i).count("zorblatt") == 2 for i in range(4))
    assert all("quimbus" in terms(10 + i) for i in range(5)) and all(not terms(100 + i) for i in range(400))


def disclosing_spans(texts, disclosure, support):
    """The term spans of each text, from the definitions alone: every entity against every term."""
    spans = [[(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base_spans(t).split(",") if s)] for t in texts]
    words = [
        [
            (m.group().lower(), m.start(), m.end())
            for m in regex.finditer(r"[\p{L}\p{M}\p{N}]{2,}", t or "")
            if not any(a < m.end() and b > m.start() for _, a, b in s)
        ]
        for t, s in zip(texts, spans)
    ]
    terms = [{w for w, _, _ in ws} | {w[:3] + "*" for w, _, _ in ws} for ws in words]
    own, wide = [], []
    for t, s in zip(texts, spans):
        own.append({}), wide.append(set())
        for kind, a, b in s:
            value = t[a:b].lower() if kind in ("email", "ip") else regex.sub("[^0-9]", "", t[a:b])
            outer = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:3])}.get(kind, value[:6])
            own[-1][kind, value] = ("class", kind, outer)
            wide[-1].add(("class", kind, outer))
    holders = {}
    for i in range(len(texts)):
        for e in {*own[i], *wide[i]}:
            holders.setdefault(e, set()).add(i)
    n = len(texts)

    def share(e, w):
        both = sum(w in terms[i] for i in holders[e])
        if both < support or len(holders[e]) == n:
            return 0.0
        return 1 - math.log(sum(w in ts for ts in terms) / both) / math.log(n / len(holders[e]))

    out = []
    for i in range(n):
        judges = {e if len(holders[e]) >= support else c for e, c in own[i].items()}
        out.append(sorted({
            (a, b, min("" if share(e, w[:3] + "*") >= disclosure else w[:3] + "*" for e in judges if share(e, w) >= disclosure))
            for w, a, b in words[i] if any(share(e, w) >= disclosure for e in judges)
        }))
    return out


def test_term_spans_equal_the_definition(spark, monkeypatch):
    rng = random.Random(21)
    names = ["zorblatt", "zora", "quimby", "Li", "李明", "agent7", "7788", "ordinary", "order", "calm", "sea", "é", "x"]
    people = ["joe@x.org", "ann@x.org", "10.2.3.4", "10.2.3.9", "4111 1111 1111 1111", "+49 30 1234567", "li@q.cn"]
    texts = []
    for i in range(160):
        who = rng.choice([*people, None, None, None, None, None])
        near = names[people.index(who) : people.index(who) + 2] if who else []
        parts = [rng.choice(names[7:]) for _ in range(rng.randrange(6))] + [w for w in near for _ in range(rng.randrange(3))]
        parts += [who] if who else []
        rng.shuffle(parts)
        texts.append("".join(rng.choice(["({}) ", "'{}' ", "{}-man ", "{}, ", "{} ", "«{}»"]).format(p) for p in parts))
    texts += [None, "", texts[0], texts[1]]
    want = disclosing_spans(texts, 0.6, 3)
    assert sum(map(len, want)) > 20 and {r[2] == "" for w in want for r in w} == {True, False}
    for limit in (pii.BROADCAST_TERMS, 0):  # looked up in a broadcast table, and joined by a shuffle
        monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
        found = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, list(enumerate(texts))), 0.6).collect()}
        got = [sorted((s["start"], s["end"], s["replacement"]) for s in found[i] if s["kind"] == "term") for i in range(len(texts))]
        assert got == want
