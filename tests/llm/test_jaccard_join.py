import random

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj
from tidemark.llm.common import lower_words
from tidemark.llm.components import connected_components


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = lower_words(text)
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 20, 60, 150, 400]))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.2:
            words = passage + words[:5]
        out.append((i * 3, " ".join(words)))
    return out


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 4), (5, 80, 4), (3, 90, 0), (1, 70, 0)])
def test_components_equal_brute_force(spark, size, percent, seed):
    rows = corpus(size * percent + seed, 240) + [(1, ""), (2, "  \n "), (4, "one"), (5, "ONE"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jj.jaccard_components(df, size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_signatures_meet_for_linked_sets():
    rng = np.random.default_rng(1)
    for percent in (70, 80, 90):
        for n in (1, 2, 3, 5, 9, 10, 11, 37, 190, 900):
            for _ in range(15):
                a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
                cut = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
                b = np.sort(rng.permutation(a)[cut:])
                extra = 0
                while 100 * len(b) >= percent * (len(a) + extra + 1):
                    extra += 1
                b = np.unique(np.concatenate([b, rng.integers(1 << 60, 1 << 62, int(rng.integers(0, extra + 1))).astype(np.uint64)]))
                owner, sig = jj.signatures([a, b], percent)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_edges(spark):
    schema = "doc_id long, text string, component_id string, node string"
    assert jj.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", "x", "y"), (9, None, "x", None), (8, "a b c", None, "z"), (8, "a b c", None, "z"), (3, "A B  c", "", "")]
    got = sorted(map(tuple, jj.jaccard_components(spark.createDataFrame(rows, schema), 3, 90).collect()), key=str)
    assert got == sorted([(None, 1, None), (9, 0, 9), (8, 1, 3), (8, 1, 3), (3, 1, 3)], key=str)
    kept = jj.one_of_each(spark.createDataFrame(rows, schema), 3, 90)
    assert kept.columns == ["doc_id", "text", "component_id", "node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (900, 900)], "a long, b long")
    got = {tuple(r) for r in connected_components(links).collect()}
    assert got == {(i, 0) for i in range(201)} | {(500, 500), (501, 500), (900, 900)}


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        for n in (10, 60, 500, 3000):
            for _ in range(10):
                a = rng.integers(0, 1 << 60, n).astype(np.uint64)
                b = np.concatenate([a[int(rng.integers(0, n // 15 + 1)) :], rng.integers(1 << 60, 1 << 62, int(rng.integers(0, n // 15 + 1))).astype(np.uint64)])
                common = len(np.intersect1d(a, b))
                apart = len(a) + len(b) - 2 * common
                bits = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(jj.sketch(a).tolist(), jj.sketch(b).tolist(), strict=True))
                assert bits <= apart
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert (100 + percent) * bits <= (100 - percent) * (len(a) + len(b))
