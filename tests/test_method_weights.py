"""Learned method weights against a numpy run over the rows."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import method_weights as op
from tidemark.operators.models import simplex_projection

DAY = dt.date(2020, 1, 1)
METHODS = ["good", "half", "noise"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(500):
        for market in ("A", "B"):
            good, noise, e = rng.normal(size=3) * 3
            y = good + 0.3 * e if market == "A" else e  # nothing can be forecast in B
            out.append((DAY + dt.timedelta(days=i // 2), market, 3, float(y), float(good), float(good / 2 + noise / 9) if i % 9 else None, float(noise), float(rng.random() + 0.2), DAY + dt.timedelta(days=i // 2 + 4)))
    return out + [(DAY, "C", 3, 1.0, 1.0, 1.0, 1.0, 1.0, DAY)] * 10


@pytest.fixture(scope="module")
def learned(spark, rows):
    df = spark.createDataFrame(rows, "day date, market string, horizon int, y double, good double, half double, noise double, weight double, resolved date").repartition(4)
    methods, scopes = op.calibrate(df, "market", "horizon", "day", "y", METHODS, "weight", "resolved")
    return methods.toPandas().set_index(["scope", "method"]), scopes.toPandas().set_index("scope")


def numpy_run(rows, market):
    d = sorted((r for r in rows if r[1] == market), key=lambda r: r[0])
    days = [r[0] for r in d]
    before = {day: days.index(day) for day in days}
    cut = np.array([before[day] * op.SLICES // len(d) for day in days])
    starts = {c: min(day for day, k in zip(days, cut) if k == c) for c in cut}
    learn = np.array([c + 1 not in starts or r[8] < starts[c + 1] for r, c in zip(d, cut)])
    x, y, w = np.array([[v or 0.0 for v in r[4:7]] for r in d]), np.array([r[3] for r in d]), np.array([max(0.05, r[7]) for r in d])

    def fit(window, penalty):
        here = (cut >= window[0]) & (cut < window[1]) & learn
        u, prior = w[here] / w[here].sum(), np.full(3, 1 / 3)
        v = prior.copy()
        for _ in range(op.STEPS):
            error = x[here] @ v - y[here]
            v = simplex_projection(v - op.RATE / 3 * (2 * penalty * (v - prior) + 2 * ((u * error) @ x[here])), op.CAP)
        return v

    def score(v, window):
        here = (cut >= window[0]) & (cut < window[1])
        p = x[here] @ v
        return np.average((p - y[here]) ** 2, weights=w[here]), 100 * np.average((p >= 0) == (y[here] >= 0), weights=w[here])

    out = []
    for train, valid, test in op.WINDOWS:
        tried = [fit(train, p) for p in op.PENALTIES]
        ranks = [score(v, valid)[0] - 0.012 * score(v, valid)[1] for v in tried]
        best = tried[int(np.argmin(ranks))]
        own, base = score(best, test), score(np.full(3, 1 / 3), test)
        out.append((best, own[0], own[1], (base[0] - own[0]) / base[0] * 100, own[1] - base[1]))
    return out, score


@pytest.mark.parametrize("market", ["A", "B"])
def test_equal_to_a_numpy_run(rows, learned, market):
    methods, scopes = learned
    (first, *folds), score = numpy_run(rows, market)
    for scope in (f"{market}|all", f"{market}|short"):
        assert np.allclose(methods.weight[scope][METHODS], first[0])
        r = scopes.loc[scope]
        assert np.allclose([r.mse, r.hit_rate, r.gain, r["lift"]], first[1:])
        for i, m in enumerate(METHODS):
            assert np.allclose((methods.mse[scope, m], methods.hit_rate[scope, m]), score(np.eye(3)[i], op.WINDOWS[0][2]))
        assert r.stable == scopes.stable[f"{market}|all"] and 0 <= r.stability <= 100


def test_planted_methods(learned):
    methods, scopes = learned
    assert set(scopes.index) == {"A|all", "A|short", "B|all", "B|short"}  # C has too few rows
    assert methods.weight["A|all", "good"] > 0.4 and methods.weight["A|all", "noise"] < 0.25
    assert scopes.active["A|all"] and 0.2 <= scopes.blend["A|all"] <= 0.76 and not scopes.active["B|all"] and scopes.blend["B|all"] == 0
    assert np.allclose(methods.weight.groupby("scope").sum(), 1) and (methods.weight <= op.CAP + 1e-9).all()


def test_empty(spark):
    none = spark.createDataFrame([], "day date, market string, horizon int, y double, good double, half double, noise double, weight double, resolved date")
    assert [t.count() for t in op.calibrate(none, "market", "horizon", "day", "y", METHODS)] == [0, 0]


def test_equal_rows_are_read_once(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "day date, market string, horizon int, y double, good double, half double, noise double, weight double, resolved date").repartition(4)
    read, whole = [], op.totals
    monkeypatch.setattr(op, "STEPS", 2)
    monkeypatch.setattr(op, "totals", lambda rows, *args: (read.append(rows.count()), whole(rows, *args))[1])
    for copies in (1, 3):
        op.calibrate(df.crossJoin(spark.range(copies)), "market", "horizon", "day", "y", METHODS, "weight", "resolved")
    assert read[0] == read[2] and read[1] == read[3]
