"""Patterns against a plain reading of their definition, automata against their definition, odds against plain sums."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from placelore.llm import secret_scan
from placelore.llm.queries import op12_secrets
from test_texts import frame

CREDENTIAL = "A-Za-z0-9+/_.=-"


def plain_base(text):
    """Every kind by its own full pattern, failing matches dropped."""
    out = []
    for m in re.finditer(rf"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{CREDENTIAL}]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def awkward(rng):
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", "\"", "'", ":", "=", " ", "  ", "abcdefgh", "12345678", "AKIA", "K9X2M4P7Q1Z8",
             "0123456789abcdef", "ABCDEF", ".", "-", "é", "日本", "ſecret", "\n", "+/", "x"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(30)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    some = 0
    for _ in range(20_000):
        text = awkward(rng)
        got = [s for s, _ in secret_scan.base_spans(text)]
        some += len(got)
        assert got == plain_base(text), repr(text)
    assert some > 3000


def test_automaton_merges_compatible_states():
    rng = random.Random(1)
    words = []
    for _ in range(4000):  # (ab)* with a fixed chance to end
        words.append("ab" * min(30, int(math.log(rng.random()) / math.log(0.7))))
    found = secret_scan.Automaton(words)
    assert len(found.edges) <= 3  # the two states, at most one more by chance
    for k in range(5):
        assert abs(math.exp(found.log_likelihood("ab" * k)) - 0.3 * 0.7**k) < 0.05
    assert found.log_likelihood("aab") == -math.inf
    fixed = secret_scan.Automaton(["HUUH" + "d" * 16] * 500 + ["HUUH" + "U" * 16] * 500)
    assert fixed.log_likelihood("HUUH" + "d" * 16) > math.log(0.2) and fixed.log_likelihood("dUUH" + "d" * 16) == -math.inf


def test_merging_keeps_every_count():
    rng = random.Random(2)
    words = ["".join(rng.choice("hd") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    found = secret_scan.Automaton(words)
    assert sum(found.ends) == len(words)
    assert sum(n for e in found.edges for _, n in e.values()) == sum(map(len, words))
    for logs, end in zip(found.logs, found.end_logs):
        assert abs(sum(math.exp(p) for _, p in logs.values()) + math.exp(end) - 1) < 1e-9
    assert all(found.log_likelihood(w) > -math.inf for w in words)


def plain_model(texts):
    counts, values = Counter(), {}
    for text in texts:
        for (_, kind, _), value in secret_scan.base_spans(text):
            values.setdefault(secret_scan.KINDS[kind], set()).add(value)
        for _, _, letters in secret_scan.candidates(text, plain_base(text)):
            counts.update(secret_scan.pairs_of(letters.translate(secret_scan._CLASSES)))
    automata = {k: secret_scan.Automaton(sorted(v.translate(secret_scan._CLASSES) for v in values[k])) for k in secret_scan.KINDS if k in values}
    return secret_scan.Model(automata, secret_scan.background_of(counts))


def corpus(rng):
    texts = []
    for k in range(300):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 14))) for _ in range(60)]
        words += [w.upper() for w in words[:20]] + [str(rng.randrange(10**11)) for _ in range(9)]
        if k % 3 == 0:
            words.insert(20, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)))
        if k % 3 == 1:
            words.insert(7, 'token = "%s"' % "".join(rng.choice("0123456789abcdef") for _ in range(40)))
        if k % 50 == 2:
            words.insert(9, "ASIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)))
        texts.append(" ".join(words))
    return texts


def test_fit_equals_plain_counting_and_finds_related_formats(spark):
    texts = corpus(random.Random(3))
    model, want = secret_scan.fit(frame(spark, list(enumerate(texts)))), plain_model(texts)
    assert model.background == pytest.approx(want.background) and sorted(model.automata) == sorted(want.automata)
    for kind, automaton in model.automata.items():
        assert automaton.edges == want.automata[kind].edges and automaton.ends == want.automata[kind].ends
    caught = 0
    for k, text in enumerate(texts):
        added = [text[s:e] for s, kind, e in model.spans(text) if kind == 3]
        assert [(s, kind, e) for s, kind, e in model.spans(text) if kind < 3] == plain_base(text)
        assert all(a.startswith("ASIA") for a in added)
        caught += len(added)
        for _, _, letters in secret_scan.candidates(text, plain_base(text)):
            sequence = letters.translate(secret_scan._CLASSES)
            best = max(a.log_likelihood(sequence) for a in want.automata.values())
            odds = best - sum(want.background[p] for p in secret_scan.pairs_of(sequence)) if best > -math.inf else best
            assert model.odds(letters) == pytest.approx(odds)
    assert caught >= 5  # a key of letters alone is like an ordinary word


def test_awkward_rows(spark):
    rows = [(None, None), (1, ""), (2, "AKIA" + "Z" * 50_000), (2, "AKIA" + "Z" * 50_000), (3, "password: short"), (4, "é token=abcd1234")]
    docs = frame(spark, rows).withColumnRenamed("n_tokens", "spans")
    got = sorted((r["doc_id"] or 0, [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in secret_scan.secrets(docs).collect())
    assert got == [(0, []), (1, []), (2, [(0, "access", 50_004)]), (2, [(0, "access", 50_004)]), (3, []), (4, [(2, "assign", 16)])]
    assert secret_scan.secrets(docs.filter("false")).count() == 0


def test_query_equals_plain_reading(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    model = plain_model([d["text"] or "" for d in docs])
    rows = {r["doc_id"]: r for r in op12_secrets(spark, folder).collect()}
    for d in docs:
        base = plain_base(d["text"] or "")
        row = rows[d["doc_id"]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        written = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert row["spans"] == ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in model.spans(d["text"] or ""))
