import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney as kn
from tidemark.llm.common import crc_mod, lower_words


def brute(train, texts):
    seqs = [[kn.START, *lower_words(t), kn.END] for t in train]
    c = Counter(p for s in seqs for p in zip(s, s[1:]))
    uni = Counter(w for s in seqs for w in s[1:])
    total, vocab = sum(uni.values()), len(uni)
    left = Counter(v for _, v in c)
    ctx, kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), n in c.items():
        ctx[u] += n
        kinds[u][min(n, 3)] += 1
    count_of = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    dp, dw = kn.discounts(count_of(c.values())), kn.discounts(count_of(left.values()))
    rest = sum(dw[min(n, 3)] for n in left.values()) / len(c) if c else 1.0

    def p1(v):
        return (max(left[v] - dw[min(left[v], 3)], 0) / len(c) if c else 0) + rest / (vocab + 1)

    def p(u, v):
        if not ctx[u]:
            return p1(v)
        g = sum(dp[k] * kinds[u][k] for k in (1, 2, 3)) / ctx[u]
        return (c[u, v] - dp[min(c[u, v], 3)]) / ctx[u] + g * p1(v)

    out = []
    for t in texts:
        s = [kn.START, *lower_words(t), kn.END]
        base = sum(math.log10((uni[v] + 0.5) / (total + 0.5 * (vocab + 1))) for v in s[1:])
        out.append((len(s) - 1, sum(uni[v] > 0 for v in s[1:]), total, base, sum(math.log10(p(u, v)) for u, v in zip(s, s[1:]))))
    return out, p, uni


@pytest.mark.parametrize(("at_once", "shard_bytes", "bits"), [(4_000_000, 24_000_000, None), (200, 500, None), (200, 500, 45)])
def test_equals_brute_force(spark, monkeypatch, at_once, shard_bytes, bits):
    """In many small pieces and shards too, and with word numbers far beyond 32 bits."""
    real = kn.write_vocabulary
    monkeypatch.setattr(kn, "write_vocabulary", lambda *a: max(real(*a), bits or 0))
    monkeypatch.setattr(kn, "TOKENS_AT_ONCE", at_once)
    monkeypatch.setattr(kn, "SHARD_BYTES", shard_bytes)
    rng = random.Random(5)
    word = lambda: rng.choice("the the the of of And an a thing Thing x1 y2 z3 q".split() + [f"r{rng.randrange(300)}"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(150)] + [(500, None), (501, ""), (502, "unseen words only"), (None, "the thing"), (3, "the of the"), (4, "the the " * 900)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    model = kn.train(docs.filter(crc_mod(F.col("doc_id"), 5) != 1))
    got = sorted(map(tuple, kn.score(docs, model).collect()), key=str)
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    want, p, uni = brute(train, [t for _, t in rows])
    for g, w in zip(got, sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    assert sum(p(b"the", v) for v in [*uni, b"never"]) == pytest.approx(1)


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in kn.score(docs, kn.train(docs.filter("false"))).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].score == 0 and got[1].base_score == 0
    assert kn.score(docs.filter("false"), kn.train(docs)).count() == 0


def test_copies_from_a_store_leave_nothing_behind(tmp_path, monkeypatch):
    import tempfile

    import numpy as np

    scratch = tmp_path / "scratch"
    scratch.mkdir()
    monkeypatch.setattr(tempfile, "tempdir", str(scratch))
    store = kn.SharedFiles(f"file://{tmp_path}/model")
    store.local = None  # as if it were not mounted
    array = np.arange(100_000, dtype="<i8")
    store.write("a", array)
    store.write("none", array[:0])
    got = store.map("a", "<i8")
    assert list(scratch.iterdir()) == [] and (got == array).all() and (got[99_990:] == array[99_990:]).all()
    assert len(store.map("none", "<i8")) == 0 and len(store.map_or_empty("missing", "<i8")) == 0
