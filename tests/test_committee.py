"""Committees against direct computation and planted regimes."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import committee as op

DAY = dt.date(2022, 1, 1)
FEATURES = ["f0", "f1", "f2", "f3"]
CANDIDATES = [
    op.Candidate("stored", "column", ("given",)), op.Candidate("own", "ridge", ("f0", "f1")), op.Candidate("other", "ridge", ("f2", "f3")), op.Candidate("wide", "ridge", tuple(FEATURES), 0.2),
    op.Candidate("chances", "target_stop", ("f0", "f1")), op.Candidate("tree", "column", ("outside",), external=True),
]


@pytest.fixture(scope="module")
def samples(spark):
    """Market A follows f0 at short and its opposite at long horizons; B follows f2; C has too few rows."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        for market, horizon in (("A", 3), ("A", 40), ("B", 10), *([("C", 5)] if i < 20 else [])):
            x = rng.standard_normal(4)
            signal = {"A": (1 if horizon == 3 else -1) * x[0], "B": x[2], "C": 0.0}[market]
            y = 3 * signal + rng.standard_normal()
            rows.append((DAY + dt.timedelta(days=i // 2), market, horizon, float(y), float(y > 2), float(y < -2), *map(float, x), float(rng.normal()), float(y + 3 * rng.normal()), DAY + dt.timedelta(days=i // 2 + 2)))
    schema = "day date, market string, horizon int, y double, target double, stop double, " + ", ".join(f"{f} double" for f in FEATURES) + ", given double, outside double, resolved date"
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="module")
def trained(samples):
    out = op.train(samples, "market", "horizon", "day", "y", "target", "stop", FEATURES, CANDIDATES, resolved="resolved")
    return out.candidates.toPandas().set_index(["scope", "candidate"]), out.scopes.toPandas().set_index("scope")


def frame(samples, scope):
    d = samples.toPandas()
    market, bucket = scope.split("|")
    d = d[d.market == market]
    d = d[(bucket == "all") | (d.horizon.map(lambda h: "short" if h <= 7 else "mid" if h <= 25 else "long") == bucket)].sort_values("day", ignore_index=True)
    before = d.day.map(d.groupby("day").size().sort_index().cumsum().shift(fill_value=0))
    d["tenth"] = (before * 10 // len(d)).astype(int)
    starts = d.groupby("tenth").day.min()
    d["learn"] = [t + 1 not in starts or r < starts[t + 1] for t, r in zip(d.tenth, d.resolved)]
    d["y"] = d.y.clip(-24, 24)
    return d


def closed_ridge(d, window, columns, penalty):
    t = d[(d.tenth < window) & d.learn]
    x, y = t[columns].to_numpy(), t.y.to_numpy()
    c, s = x.mean(0), x.std(0)
    z = (x - c) / s
    w = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(len(columns)), z.T @ (y - y.mean()) / len(z))
    return lambda rows: np.clip(y.mean() + (rows[columns].to_numpy() - c) / s @ w, -18, 18)


def test_scopes_and_planted_regimes(trained):
    candidates, scopes = trained
    assert set(scopes.index) == {"A|all", "A|short", "A|long", "B|all", "B|mid"}
    assert np.allclose(candidates.weight.groupby("scope").sum(), 1) and (candidates.weight >= -1e-12).all()
    for scope in ("A|short", "A|long"):
        assert candidates.weight[scope][["own", "wide", "chances"]].sum() > 0.8 and candidates.weight[scope, "other"] < 0.1
        assert scopes.active[scope] and scopes.hit_rate[scope] > 80 and candidates.stable[scope, "own"]
    assert candidates.weight["B|mid"][["other", "wide"]].sum() > 0.8
    assert scopes.hit_rate["A|all"] < 70  # the regimes of the two horizons cancel out
    assert (candidates.xs("tree", level=1).weight <= 0.08 + 1e-9).all()


def test_models_and_folds_equal_direct_fits(samples, trained):
    candidates, _ = trained
    for scope in ("A|short", "B|all"):
        d = frame(samples, scope)
        test = d[d.tenth >= 8]
        for name, columns, penalty in (("own", ["f0", "f1"], 0.12), ("wide", FEATURES, 0.2)):
            p = closed_ridge(d, 6, columns, penalty)(test)
            assert np.isclose(candidates.mse[scope, name], ((p - test.y) ** 2).mean())
            assert np.isclose(candidates.hit_rate[scope, name], 100 * ((p >= 0) == (test.y >= 0)).mean())
            gains = []
            for t in range(5, 10):
                e = d[d.tenth == t]
                base = ((e.given.clip(-18, 18) - e.y) ** 2).mean()
                gains.append(100 * (base - ((closed_ridge(d, t, columns, penalty)(e) - e.y) ** 2).mean()) / base)
            assert candidates.folds[scope, name] == 5 and np.isclose(candidates.gain[scope, name], np.mean(gains))


def test_chances_are_at_the_minimum_of_their_loss(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3)) * [1, 5, 1] + [0, 9, 0]
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    tenth = np.arange(300) // 30
    rows = spark.createDataFrame([(0, int(t), True, float(v), float(v), [float(f) for f in r]) for t, v, r in zip(tenth, y, x)], "at int, tenth int, learn boolean, y double, target double, x array<double>").repartition(3)
    grams = op.gram_matrices(rows, 1, 3)
    z1 = np.column_stack([np.ones(300), x, y])
    assert np.allclose(grams[0].sum(0), z1.T @ z1)
    found = op.logistic_models(rows, "target", grams, np.array([True, True, False]), 0.12)
    for w in op.WINDOWS:
        m, here = found[0, w], tenth < w
        z = (x[here][:, :2] - x[here][:, :2].mean(0)) / x[here][:, :2].std(0)
        e = 1 / (1 + np.exp(-m.raw(x[here]))) - y[here]
        assert abs(e.mean()) < 1e-6 and np.allclose(e @ z / here.sum() + 2 * 0.12 * m.weights[:2], 0, atol=1e-6) and m.weights[2] == 0


def test_gate_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [("s", float(rng.normal()), [float(v) for v in rng.normal(size=3) * rng.random() * 3]) for _ in range(90)] + [("t", 1.0, [0.1, 0.1, 0.1])] * 5
    weights = {"s": [0.5, 0.3, 0.2], "t": [1.0, 0.0, 0.0]}
    d = spark.createDataFrame(rows, "scope string, y double, main array<double>")
    got = {r.scope: r for r in op.reject_gate(op.blended(d, [(s, "selected", w) for s, w in weights.items()])).collect()}
    for s, w in weights.items():
        own = [(y, np.array(m)) for k, y, m in rows if k == s]
        p = np.array([m @ w for _, m in own])
        spread = np.array([np.sqrt(((m - v) ** 2) @ w) for (_, m), v in zip(own, p)])
        cut = max(0.75, np.quantile(spread, 0.72))
        if (spread <= cut).sum() < max(4, int(len(own) * 0.35)):
            cut = np.quantile(spread, 0.85)
        hit = 100 * np.mean([(v >= 0) == (y >= 0) for (y, _), v, e in zip(own, p, spread) if e <= cut])
        assert np.isclose(got[s].threshold, cut) and got[s].accepted == (spread <= cut).sum() and np.isclose(got[s].accepted_hit_rate, hit)


def test_external_models_stay_small():
    w = op.capped_external(np.array([0.1, 0.2, 0.3, 0.4]), [False, False, True, True])
    assert np.isclose(w.sum(), 1) and np.allclose(w[2:], 0.06) and np.isclose(w[1] / w[0], 2)
    assert np.allclose(op.capped_external(np.array([0.0, 0.0, 0.5, 0.5]), [False, False, True, True]), [0.44, 0.44, 0.06, 0.06])
    assert np.allclose(op.capped_external(np.array([2.0, 2.0]), [False, False]), 0.5)


def test_edges(spark, samples):
    none = samples.limit(0)
    out = op.train(none, "market", "horizon", "day", "y", "target", "stop", FEATURES, CANDIDATES)
    assert out.candidates.count() == 0 and out.scopes.count() == 0
    one_day = samples.withColumn("day", samples.day.cast("string").substr(1, 4))  # a single date: all rows in the first tenth
    out = op.train(one_day, "market", "horizon", "day", "y", "target", "stop", FEATURES, CANDIDATES)
    assert out.scopes.count() == 0


def test_equal_rows_are_read_once_by_newton_steps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(0, int(t), True, float(t % 3), float(rng.random() < 0.3 + 0.1 * a), [float(a), float(b), 1.0 * i]) for i, (t, a, b) in enumerate(zip(rng.integers(0, 10, 600), rng.integers(0, 4, 600), rng.integers(0, 3, 600)))]
    d = spark.createDataFrame(rows, "at int, tenth int, learn boolean, y double, target double, x array<double>")
    grams, read, whole = op.gram_matrices(d, 1, 3), [], op.totals
    monkeypatch.setattr(op, "totals", lambda rows, *args: (read.append(rows.count()), whole(rows, *args))[1])
    found = {}
    for share in (-1.0, 1.0):
        read.clear()
        monkeypatch.setattr(op, "COUNTED", share)
        found[share] = op.logistic_models(d, "target", grams, np.array([True, True, False]), 0.12), max(read)
    assert found[-1.0][1] == 600 and found[1.0][1] <= 240
    for key, m in found[-1.0][0].items():
        assert np.allclose(m.weights, found[1.0][0][key].weights) and np.isclose(m.intercept, found[1.0][0][key].intercept)
