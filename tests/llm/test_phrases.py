import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases


def brute(rows, least, most, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall(r"[^\x20\t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}

    def inside(short, long):
        return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))

    out = {}
    for (lang, p), a in found.items():
        if any(m == lang and len(q) > len(p) and b >= a and inside(p, q) for (m, q), b in found.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, rows in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(rows)[:first])}


def got(spark, rows, **kw):
    df = spark.createDataFrame([(t, l, "x", 1, 2) for t, l in rows], "text string, lang string, phrase string, n int, `hash` int").repartition(3)
    return {tuple(r) for r in phrases.collocations(df, **kw).collect()}


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = ["a", "B", "c.", "d", "é", "f,", "g", "H"]
    rows = [(" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None])) for _ in range(n)]
    rows += [("one two three four five six\tseven", "en")] * 9 + [("Same same same SAME same same", "und")] * 4
    return rows + [(None, "en"), ("", None), (" \t\n.,", "de"), ("d " * 3000 + "\x0cg g\rg\x1cg g\x1cg", "de"), ("x" * 5000 + " y", "en")]


@pytest.mark.parametrize("shard_words, at_once", [(150_000, 2_000_000), (7, 60), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, shard_words, at_once):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", at_once)
    rows = corpus(60)
    assert got(spark, rows, least=5, shard_words=shard_words) == brute(rows, 5, 5, 2000)


def test_full_sieves_lose_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "sieve_of", lambda frequent: phrases.Sieve(np.full(4096, 255, np.uint8)))
    rows = corpus(25)
    assert got(spark, rows, least=4, most_words=3, first=5) == brute(rows, 4, 3, 5)


def test_automaton_counts_all_phrases():
    rng = random.Random(1)
    for letters in (2, 3, 9):
        runs = [[rng.randrange(letters) for _ in range(rng.randrange(0, 30))] for _ in range(20)]
        own, every = phrases.Automaton(), [w for r in runs for w in r]
        for r in runs:
            own.add(r)
        found = {(k, tuple(every[e - k + 1 : e + 1])): n for k, ends, times in own.phrases(range(1, 6)) for e, n in zip(ends.tolist(), times.tolist())}
        want = Counter((k, tuple(r[i : i + k])) for r in runs for k in range(1, 6) for i in range(len(r) - k + 1))
        assert found == want


def test_windows_hold_each_position_once():
    rng = random.Random(2)
    for letters in (1, 2, 3, 9):
        for most in (2, 3, 5):
            runs = [[rng.randrange(letters) for _ in range(rng.randrange(2, 30))] for _ in range(20)]
            own, every = phrases.Automaton(), [w for r in runs for w in r]
            for r in runs:
                own.add(r, heads=most - 1)
            found = {tuple(every[e - k + 1 : e + 1]): n for k, ends, times in own.windows(most) for e, n in zip(ends.tolist(), times.tolist())}
            assert found == Counter(tuple(r[max(0, i - most) : i]) for r in runs for i in range(2, len(r) + 1))


def test_a_word_sends_one_row_at_most(spark, monkeypatch):
    by_shards, sent = phrases.by_shards, []

    def seen(docs, task, schema, at_once):
        out = by_shards(docs, task, schema, at_once)
        if schema.startswith("phrase"):
            sent.append(tuple(out.selectExpr("count(*)", "sum(n)").first()))
        return out

    monkeypatch.setattr(phrases, "by_shards", seen)
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcdefghijkl") for _ in range(50)), "en") for _ in range(40)]
    assert got(spark, rows, least=5) == brute(rows, 5, 5, 2000)
    ((n, times),) = sent
    assert n <= times <= 40 * 50


def test_edges(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, None), ("a b", "en")]) == set()
    assert got(spark, [("a b", "en")] * 100) == {("en", 1, "a b", 100, 100, 100, 200, 2000)}


def test_products_beyond_64_bits(spark):
    big = 4 * 10**12
    table = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    original, phrases.counts = phrases.counts, lambda *a: (table, totals)
    try:
        (row,) = phrases.collocations(None).collect()
    finally:
        phrases.counts = original
    assert row.score == 1000 * (big - 1) * 9 * 10**15 // (big * big)
