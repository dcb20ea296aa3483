import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import weighted_kmeans as wk


def brute(rows, d, k=16, rounds=3):
    """Plain Lloyd over all rows, copies included, with Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(64 * float(x))) for x in v]
            if all(abs(x) <= wk.LIMIT for x in q):
                kept.append((i, q))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centres = [q for _, q in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for j, members in groups.items():
            centres[j] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, c, away in out:
        inertia[c] += away
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, away, inertia[c], sum(inertia.values()), sha[c]) for i, c, away in out), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in wk.clusters(df, **kw).drop("centroid").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("hot_share", [4096, 1])
def test_equals_lloyd_over_all_rows(spark, monkeypatch, hot_share):
    monkeypatch.setattr(wk, "HOT_SHARE", hot_share)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((9, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + 0.4 * rng.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a hot vector
    rows += [rows[5], rows[5], (None, rows[6][1]), (7, rows[8][1])]  # repeated rows, a null id, an id with two vectors
    rows += [(2000, [300.0] + [0.0] * 7), (2001, [-1.0e5] + [1.0] * 7)]  # two and four bytes
    bad = [(3000, None), (3001, []), (3002, [1.0] * 7), (3003, [None] + [1.0] * 7), (3004, [float("nan")] * 8), (3005, [float("inf")] + [0.0] * 7), (3006, [1e38] * 8), (3007, [float(wk.LIMIT)] * 8)]
    df = spark.createDataFrame([(i, v, b"x", 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<float>, vector binary, n int, distance double")
    assert got(df, d=8) == brute(rows + bad, 8)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 21) + 1, 1 << 21, 8) + rng.random(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert got(df, d=8) == brute(rows, 8)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert got(spark.createDataFrame([], schema)) == []
    assert got(spark.createDataFrame([(1, None)], schema)) == []
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]  # two equal centroids at first: the later one stays empty
    assert got(spark.createDataFrame(few, schema)) == brute(few, 64)
    beyond = spark.createDataFrame([(1, [1e300] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert [r[0] for r in got(beyond)] == [2]


def test_packing_round_trip():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    q = np.concatenate([rng.integers(-b, b, (20, 5)) for b in (2, 128, 129, 40_000, wk.LIMIT)])
    packed = wk.pack(q)
    assert {len(p) // 5 for p in packed} == {1, 2, 4}
    assert (wk.unpack(pa.array(packed, pa.binary()), 5) == q).all()
