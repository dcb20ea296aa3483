"""Gates, calibrators and direction models against direct loops and planted cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, selection as op

DAY = dt.date(2020, 1, 1)
NAMES = [f"f{i}" for i in range(12)]


@pytest.fixture(scope="module")
def panel(spark):
    """f0 and f1 carry signal; f8 to f11 carry it before place 240 and its opposite after, so models without them do better late."""
    rng = np.random.default_rng(7)
    rows = []
    for place in range(300):
        for s in range(12):
            x = rng.standard_normal(12)
            up = rng.random() < 1 / (1 + math.exp(-1.5 * x[0] - 1.0 * x[1]))
            x[8:] += (1.2 if place < 170 else -1.2) * (2 * up - 1)
            rows.append((DAY + dt.timedelta(days=place), f"S{s}", float(up), float(rng.random() + 0.5), *map(float, x)))
    schema = "day date, symbol string, up double, weight double, " + ", ".join(f"{n} double" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(5)


def frame(panel):
    out = panel.toPandas().sort_values(["day", "symbol"], ignore_index=True)
    out["place"] = pd.factorize(out.day, sort=True)[0]
    return out


def loop_fit(d, columns, train, judged, penalty, epochs):
    """One fit by models.linear_kernel, and its scores by plain sums."""
    t, j = d[d.place.between(train[0], train[1] - 1)], d[d.place.between(judged[0], judged[1] - 1)]
    coef, b, centre, scale = models.linear_kernel(t[columns].to_numpy(), t.up.to_numpy(), t.weight.to_numpy(), "logistic", penalty, epochs)
    p = 1 / (1 + np.exp(-np.clip(b + (j[columns].to_numpy() - centre) / scale @ coef, -18, 18)))
    a, w = j.up.to_numpy(), np.maximum(0.05, j.weight.to_numpy())
    brier = (w * (p - a) ** 2).sum() / w.sum()
    rate = (w * a).sum() / w.sum()
    baseline = (w * (rate - a) ** 2).sum() / w.sum()
    recall, other = ((p >= 0.5) & (a == 1)).sum() / (a == 1).sum(), ((p < 0.5) & (a == 0)).sum() / (a == 0).sum()
    return brier, (baseline - brier) / baseline, 50 * (recall + other)


def test_fits_equal_a_direct_loop_and_harmful_family_goes(spark, panel):
    placed, n = op.with_places(panel, "day")
    families = {"late_reversal": set(NAMES[8:]), "noise": set(NAMES[4:8]), "macro": {"f2", "f3"}}
    rows = op.packed(placed, NAMES, "up", "weight", "weight").persist()
    kept, found = op.family_gate(rows, NAMES, n, families, specialist=("macro",), least_features=4)
    assert n == 300 and kept == [c for c in NAMES[:8] if c not in ("f2", "f3")]
    by = {r["family"]: r for r in found}
    assert by["late_reversal"]["excluded"] and not by["noise"]["excluded"] and by["macro"]["excluded"] and by["macro"]["removed"] == 2
    d, size = frame(panel), min(120, max(60, n // 5))
    for family, r in by.items():
        columns = [c for c in NAMES if c not in families["macro"] | (families[family] if family != "macro" else set())]
        brier, _, accuracy = loop_fit(d, columns, (0, n - size - 7), (n - size, n), 0.24, 24)
        got = (r["full_brier"], r["full_accuracy"]) if family == "macro" else (r["brier"], r["accuracy"])
        assert np.allclose(got, (brier, accuracy))
    rows.unpersist()


def test_profile_gate_equals_a_direct_loop(spark, panel):
    placed, n = op.with_places(panel, "day")
    rows = op.packed(placed, NAMES, "up", "weight", "weight").persist()
    profiles = {"compact": set(NAMES[:8]), "wide": set(NAMES), "small": {"f0"}}
    chosen, found = op.profile_gate(rows, NAMES, n, profiles, least_features=4, least_dates=100)
    assert chosen == "compact" and [r["profile"] for r in found] == ["compact", "wide"]
    d, windows = frame(panel), op.inner_windows(n, 60, 7, 100)
    assert len(windows) == 3
    for r in found:
        columns = [c for c in NAMES if c in profiles[r["profile"]]]
        runs = [loop_fit(d, columns, *w, 0.28, 28) for w in windows]
        brier, skill, accuracy = (sum(x) / 3 for x in zip(*runs))
        negative = sum(s <= 0 for _, s, _ in runs)
        assert np.allclose((r["brier"], r["skill"], r["balanced_accuracy"]), (brier, skill, accuracy)) and r["negative_windows"] == negative
        assert math.isclose(r["score"], brier + 0.00075 * negative + max(0, 50 - accuracy) / 1000)
    assert op.profile_gate(rows, NAMES, n, profiles, least_dates=300) == (None, [])
    rows.unpersist()


def test_ablation_shows_what_a_family_adds(spark, panel):
    placed, n = op.with_places(panel, "day")
    rows = op.packed(placed, NAMES, "up").persist()
    full, *rest = op.family_ablation(rows, NAMES, 160, {"strong": set(NAMES[8:]), "noise": set(NAMES[4:8]), "all": set(NAMES)}, first_test=120, purge=5)
    assert full["brier_delta"] == 0 and [r["name"] for r in rest] == ["strong", "noise"]  # nothing is left without all
    assert rest[0]["brier_delta"] > 0.003 and rest[0]["accuracy_delta"] < 0 and rest[1]["brier_delta"] < 0
    rows.unpersist()


def test_stability_gate(spark, panel):
    placed, n = op.with_places(panel.withColumn("f5", F.when(F.col("day") > DAY + dt.timedelta(days=150), F.col("f5") + 3).otherwise(F.col("f5"))), "day")
    drift = op.stability(placed, NAMES[:8], n)
    assert {r.window for r in drift.select("window").distinct().collect()} == {0, 1, 2, 3}
    assert {r.feature for r in op.stable_features(drift, least=3).filter("not kept").collect()} == {"f5"}
    assert op.stable_features(drift, limit=1e-9, least=3).filter("kept").count() == 3


def direct_calibrator(method, p, y, dates):
    """Parameters of one method by loops over rows."""
    if method == "shrinkage":
        prior, cap = min(max(y.mean(), 0.001), 0.999), min(max(dates / 120, 0.1), 1.0)
        grid = [cap * s / 20 for s in range(21)]
        return prior, min(grid, key=lambda a: (round(((prior + a * (p - prior) - y) ** 2).mean(), 13), a))
    if method == "platt":
        rate = min(max(y.mean(), 0.001), 0.999)
        a, b, x = math.log(rate / (1 - rate)), 1.0, np.log(p / (1 - p))
        for _ in range(30):
            q = 1 / (1 + np.exp(-(a + b * x)))
            c = np.maximum(1e-8, q * (1 - q))
            step = np.linalg.solve([[c.sum() + 1e-8, (c * x).sum()], [(c * x).sum(), (c * x * x).sum() + 0.02 + 1e-8]], [(q - y).sum(), ((q - y) * x).sum() + 0.02 * (b - 1)])
            a, b = np.clip(a - step[0], -20, 20), np.clip(b - step[1], 0.02, 4)
            if np.abs(step).sum() < 1e-7:
                break
        return a, b
    return ()


def apply(method, m, p):
    if method == "shrinkage":
        return np.clip(m[0] + m[1] * (p - m[0]), 0.001, 0.999)
    return 1 / (1 + np.exp(-(m[0] + m[1] * np.log(p / (1 - p))))) if method == "platt" else p


@pytest.fixture(scope="module")
def forecasts(spark):
    """good: true chances; flat: drawn too wide; wrong: their opposite; noise: nothing; null values count as 0.5."""
    rng = np.random.default_rng(9)
    rows = []
    for place in range(260):
        for _ in range(8):
            z = rng.normal()
            y = float(rng.random() < 1 / (1 + math.exp(-z)))
            s = lambda v: 1 / (1 + math.exp(-v))
            rows.append((DAY + dt.timedelta(days=place), y, float(rng.random() * 2), s(z), s(3 * z + 1), None if rng.random() < 0.1 else s(-z), float(rng.random())))
    return spark.createDataFrame(rows, "day date, y double, weight double, good double, wide double, wrong double, noise double").repartition(3)


def test_nested_scores_equal_a_direct_loop(spark, forecasts):
    names, methods = ["good", "wide", "wrong", "noise"], ("identity", "shrinkage", "platt")
    got = {(r.model, r.window): r for r in op.nested_scores(forecasts, names, "y", "weight", "day", methods=methods).collect()}
    d = forecasts.toPandas().sort_values("day", ignore_index=True)
    place = pd.factorize(d.day, sort=True)[0]
    windows = op.inner_windows(260, 60, 7, 120)
    assert len(windows) == 2 and len(got) == 8
    for i, (train, judged) in enumerate(windows):
        for m in names:
            p, y = d[m].fillna(0.5).clip(0.001, 0.999).to_numpy(), d.y.to_numpy()
            n = train[1]
            cut = max(10, min(n - 10, int(n * 0.8)))
            early, late, all_ = place < cut, (place >= cut) & (place < n), place < n
            loss = [((apply(k, direct_calibrator(k, p[early], y[early], cut), p[late]) - y[late]) ** 2).mean() for k in methods]
            best = methods[int(np.argmin(loss))]
            here = (place >= judged[0]) & (place < judged[1])
            q, w = apply(best, direct_calibrator(best, p[all_], y[all_], n), p[here]), np.maximum(0.05, d.weight.to_numpy()[here])
            rate = (w * y[here]).sum() / w.sum()
            r = got[m, i]
            assert r.calibrator == best
            assert math.isclose(r.brier, (w * (q - y[here]) ** 2).sum() / w.sum(), rel_tol=1e-9) and math.isclose(r.baseline, (w * (rate - y[here]) ** 2).sum() / w.sum(), rel_tol=1e-9)
    assert op.nested_scores(forecasts.limit(50), names, "y", "weight", "day") is None


def test_champion_rule(spark):
    def selected(skills, **kw):
        rows = [(m, i, v) for m, values in skills.items() for i, v in enumerate(values)]
        out = op.champions(spark.createDataFrame(rows, "model string, window int, skill double"), **kw)
        return {r.model for r in out.filter("selected").collect()}

    assert selected({"a": [0.1, 0.1, 0.1], "b": [0.2, 0.1, -0.1], "c": [0.3, -0.1, -0.1]}) == {"a"}  # two able: the best of them
    assert selected({"a": [0.1, 0.1, 0.1], "b": [0.2, 0.1, -0.1], "c": [0.3, 0.1, -0.1], "d": [-1.0, -1.0, -1.0]}) == {"a", "b", "c"}
    assert selected({"a": [-0.1, -0.1], "b": [-0.2, -0.3]}) == {"a"}
    assert selected({"a": [0.5, -0.1], "b": [0.1, 0.1]}) == {"b"}  # both of two windows are asked for


def test_isotonic_is_chosen_where_the_curve_bends(spark):
    rng = np.random.default_rng(3)
    p = rng.random(9000)
    y = rng.random(9000) < np.where(p < 0.5, 0.1, 0.9)
    rows = spark.createDataFrame([("g", int(i // 45), float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))], "`group` string, place int, p double, y double")
    method, (xs, ys) = op.choose_calibrators(rows, {"g": 200})["g"]
    assert method == "isotonic" and all(a <= b for a, b in zip(ys, ys[1:])) and all(a < b for a, b in zip(xs, xs[1:]))
    ask = [0.001, xs[0], xs[2], (xs[2] + xs[3]) / 2, xs[-1], 0.999]
    out = op.calibrated(spark.createDataFrame([("g", float(v)) for v in ask], "`group` string, p double"), op.parameter_table(spark, [("g", method, (xs, ys))])).collect()
    assert np.allclose([r.q for r in out], np.interp(ask, xs, ys))
    few = rows.filter("place < 5")
    assert op.choose_calibrators(few, {"g": 5, "none": 3})["none"] == ("identity", ()) and op.choose_calibrators(few, {"g": 5})["g"][0] == "shrinkage"


def test_pooling_equals_direct_least_squares():
    rng = np.random.default_rng(1)
    y = rng.random(40)
    xs, ys = op.pooled([(i * 1.0, float(v), 1) for i, v in enumerate(y)])
    best = [max(min(y[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]  # the max-min form
    fitted = np.repeat(ys, [sum(1 for v in best if math.isclose(v, b)) for b in ys])
    assert np.allclose(fitted, best)


def test_trade_gate_takes_all_only_where_a_regime_has_no_selector(spark):
    from tidemark.operators import agents

    items = spark.createDataFrame([(1, "momentum", "r1", True, True), (2, "momentum", "r2", True, True), (3, "momentum", "r3", True, True), (4, "reversion", "r3", True, True), (5, None, "r1", True, True), (6, "momentum", "r4", True, False)], "id int, style string, regime string, policy_eligible boolean, model_eligible boolean")
    selectors = spark.createDataFrame([("r1", "breakout"), ("r2", None), ("r4", ""), ("all", "reversion")], "regime string, selected_style string")
    got = {r.id: r.reason for r in agents.trade_gate(items, selectors).collect()}
    assert got == {1: "other_style", 2: "passed", 3: "other_style", 4: "passed", 5: "other_style", 6: "model"}


def test_crossover_blends_are_means_and_gates_keep_zero(spark):
    from tidemark.operators import alpha

    d = spark.createDataFrame([("S", DAY + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate([(1, 2), (3, -1), (-2, 0)])], "symbol string, day date, a double, b double")
    e = [("blend", ("col", "a"), ("col", "b")), ("gated", ("col", "a"), ("col", "b"))]
    out = alpha.with_expressions(d, e, ["symbol"], ["day"]).orderBy("day").select(*map(alpha.name_of, e)).collect()
    assert [tuple(r) for r in out] == [(1.5, 1.0), (1.0, -3.0), (-1.0, -2.0)]


def test_blend_is_chosen_without_the_test_dates(spark):
    from tidemark.operators import learners

    rng = np.random.default_rng(12)
    blends = {"rank-only": {"rank": 1.0}, "early": {"early": 1.0}, "late": {"late": 1.0}}
    rows = []
    for day in range(100):
        for s in range(20):
            y = rng.normal()
            rows.append((DAY + dt.timedelta(days=day), f"S{s:02}", float(y), float(y > 0), float(rng.normal()), float(y if day < 80 else -y), float(-y if day < 80 else y)))
    d = spark.createDataFrame(rows, "day date, symbol string, ret double, up double, pct_rank double, pct_early double, pct_late double").repartition(3)
    got = {r.blend: r for r in learners.chosen_blend(d, "day", "ret", "up", ["symbol"], blends, top=3).collect()}
    assert [b for b, r in got.items() if r.selected] == ["early"]  # the best one of the inner dates, though it fails later
    assert got["early"].test_top_return < 0 < got["late"].test_top_return and not got["late"].admissible
    parts = {r.part: (r.a, r.b) for r in learners.inner_block(d, "day").groupBy("part").agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    assert parts == {"inner": (DAY + dt.timedelta(days=60), DAY + dt.timedelta(days=74)), "test": (DAY + dt.timedelta(days=80), DAY + dt.timedelta(days=99))}


def test_isotonic_keeps_what_lies_beyond_0_and_1(spark):
    rows = [(-0.5, 0), (-0.1, 0), (0.2, 1), (0.2, 0), (0.7, 1), (1.0, 1), (1.5, 1), (None, 1)]
    knots = models.isotonic(spark.createDataFrame(rows, "p double, y int"), "p", "y", bins=10)
    assert knots == sorted(knots) and math.isclose(knots[0][0], -0.3) and math.isclose(knots[-1][0], 1.25) and [y for _, y in knots] == [0.0, 0.5, 1.0, 1.0]


def test_equal_rows_are_calibrated_once(spark, monkeypatch):
    """Copies of rows change neither scores nor the number of rows that calibrators read."""
    rng = np.random.default_rng(4)
    rows = []
    for place in range(260):
        for _ in range(8):
            p = float(rng.integers(0, 11)) / 10
            rows.append((DAY + dt.timedelta(days=place), float(rng.random() < 0.2 + 0.5 * p), 0.7, p, 1 - p))
    d = spark.createDataFrame(rows, "day date, y double, weight double, a double, b double").repartition(3)
    whole, read = op.choose_calibrators, []

    def watched(rows, *args):
        read.append(rows.count())
        return whole(rows, *args)

    monkeypatch.setattr(op, "choose_calibrators", watched)
    scores = [sorted(tuple(r) for r in op.nested_scores(x, ["a", "b"], "y", "weight", "day").collect()) for x in (d, d.crossJoin(spark.range(5)))]
    assert read[0] == read[1] < 2 * 2 * 260 * 8
    for one, copied in zip(*scores, strict=True):
        assert one[:2] == copied[:2] and one[2] in op.METHODS and abs(one[3] - copied[3]) < 1e-3
