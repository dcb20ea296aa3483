import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as li
from tidemark.llm.common import crc_mod

SYLLABLES = {"aa": "ka to mi ru sha ne".split(), "bb": "strä gen öld ung ver sch".split(), "cc": "ão ção nho lha que es".split(), "дд": "про ста ние ого ешь жи".split()}


def corpus(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 4]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words).capitalize() + "!", lang))
    return rows


def brute_grams(text):
    """By plain string operations over words padded with a space."""
    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    if not any(unicodedata.category(c)[0] == "L" for c in letters):
        return Counter()
    out = Counter()
    for w in letters.split(" "):
        if w:
            out.update(w)
            out.update((f" {w} ")[i : i + 3] for i in range(len(w)))
            out.update((f" {w} ")[i : i + 2] for i in range(len(w) + 1))
    return out


@pytest.mark.parametrize("text", [None, "", "7 %\n", "a", "Ab ça, l'été\t\tİß — नमस्ते x2y 𝒜b", "word " * 1000, "- a -"])
def test_n_grams_equal_strings(text):
    def name(number):
        return chr(number) if number < 1 << li.BITS else name(number >> li.BITS) + chr(number & ((1 << li.BITS) - 1))

    assert Counter(map(name, li.n_grams(text).tolist())) == brute_grams(text)


def test_document_frequencies_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(li, "KEYS_AT_ONCE", 50)
    rows = [*corpus(40), (50, None, "aa"), (51, "", "aa"), (1, "Ka ka", "aa"), (1, "Ka ka", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {(r.lang, r.gram): r.n for r in li.document_frequencies(df).collect()}
    want = Counter()
    for _, text, lang in rows:
        want.update((lang, g) for g in set(li.n_grams(text).tolist()) | {-1})
    assert got == want


def test_features_are_found_exactly():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(1, 1 << 62, 5000))
    features = li.Features(grams, np.ones(len(grams)))
    order = rng.permutation(len(grams))
    other = np.setdiff1d(rng.integers(1, 1 << 62, 5000), grams)
    assert sorted(features.numbers(np.concatenate([grams[order], other])).tolist()) == list(range(len(grams)))
    assert (features.numbers(grams[:1]) == [0]).all()
    assert len(li.Features(np.zeros(0, np.int64), np.zeros(0)).numbers(grams)) == 0


def test_steps_equal_the_closed_form():
    """After each step the weights minimise the sum of all linearised losses and penalties."""
    rng = np.random.default_rng(2)
    model = li.Model(3, ["a", "b"])
    z, n = np.zeros((4, 2)), np.zeros((4, 2))
    for _ in range(30):
        at, values, lang = np.flatnonzero(rng.random(3) < 0.7), rng.random(3), int(rng.integers(2))
        x = np.append(np.where(np.isin(range(3), at), values, 0), 1)
        w = np.zeros((4, 2))
        for i in range(4):
            for j in range(2):
                l1 = li.L1 if i < 3 else 0
                if abs(z[i, j]) > l1:
                    w[i, j] = -(z[i, j] - np.sign(z[i, j]) * l1) / ((li.BETA + n[i, j] ** 0.5) / li.ALPHA + li.L2)
        p = np.exp(x @ w) / np.exp(x @ w).sum()
        g = np.outer(x, p - (np.arange(2) == lang))
        sigma = (np.sqrt(n + g**2) - np.sqrt(n)) / li.ALPHA
        z, n = z + g - sigma * w, n + g**2
        model.learn(at, values[at], lang)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(400)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 -- 3", "cc"), (None, "ka to", "aa"), (1003, "ſtrange ꙮ", None), (0, rows[0][1], "aa"), (1004, "shakato " * 40_000, None), (1005, "ω" * 50, None)]
    df = spark.createDataFrame([(i, t, l, "x", 0.5, b"y") for i, t, l in rows + odd], "doc_id long, text string, lang string, source string, score double, at binary")
    learn = df.filter(crc_mod(F.col("doc_id"), 4) != 2)
    features, model = li.fit(learn)
    out = li.predict(df, features, model).toPandas()
    assert len(out) == len(rows) + len(odd) and out.score.between(0, 1).all()
    by_id = out.drop_duplicates("doc_id").set_index("doc_id")
    assert all(by_id.lang_pred[i] == "und" for i in (1000, 1001, 1002))
    assert by_id.lang_pred[1004] == "aa" and by_id.lang_pred[1005] in SYLLABLES
    held = {r.doc_id for r in df.filter(crc_mod(F.col("doc_id"), 4) == 2).collect()}
    hits = [by_id.lang_pred[i] == lang for i, _, lang in rows if i in held]
    assert len(hits) > 50 and np.mean(hits) > 0.97
    # reruns agree, whatever the partitions
    again = li.predict(df.repartition(5), *li.fit(learn.repartition(7))).toPandas()
    key = ["doc_id", "lang_pred", "score"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, out[key].values.tolist()))


def test_without_training_documents(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], schema)
    assert {(r.lang_pred, r.score) for r in li.predict(docs, *li.fit(docs)).collect()} == {("und", 0.0)}
    empty = spark.createDataFrame([], schema)
    assert li.predict(empty, *li.fit(empty)).count() == 0
    one = spark.createDataFrame([(1, "ab ab", "zz"), (2, "ab", "zz"), (3, "9", "zz")], schema)
    assert {(r.doc_id, r.lang_pred) for r in li.predict(one, *li.fit(one)).collect()} == {(1, "zz"), (2, "zz"), (3, "und")}


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    features, model = li.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    assert (model.weights[:-1] == 0).mean() > 0.1  # the L1 penalty leaves weights at zero
    held = docs.filter(crc_mod(F.col("doc_id"), 4) == 2).filter("lang is not null")
    out = li.predict(held, features, model).join(held.select("doc_id", "lang"), "doc_id").filter("lang_pred <> 'und'")
    assert out.count() > 200 and out.filter("lang = lang_pred").count() > 0.98 * out.count()
