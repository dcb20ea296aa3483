"""Boosted trees against a direct run and planted signals."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as op

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 3)).round(2)
    y = np.where((x[:, 0] > 0.3) & (x[:, 1] < 0.5), 4.0, -1.0) + rng.standard_normal(1200) * 0.3
    rows = [(DAY + dt.timedelta(days=i // 20), *map(float, v), float(t), float(rng.random() + 0.5)) for i, (v, t) in enumerate(zip(x, y))]
    rows += [(DAY, None, float("nan"), 0.0, -1.0, 1.0)] * 3 + [(DAY, 0.0, 0.0, 0.0, None, 1.0)]
    return spark.createDataFrame(rows, "day date, a double, b double, c double, y double, w double").repartition(4)


def direct(x, y, w, kind, alpha, scale, base, trees, depth, bins, rate, ridge, least):
    """The same trees by recursion over rows and exhaustive search."""
    p = np.full(len(y), base)
    for _ in range(trees):
        g = w * (p - y) if kind == "mean" else w * scale * np.where(y > p, -alpha, 1 - alpha)
        step = np.zeros(len(y))

        def grow(here, level):
            if level == depth:
                step[here] = -rate * g[here].sum() / (w[here].sum() + ridge)
                return
            best = (1e-9, None)
            for f in range(x.shape[1]):
                for b in range(bins - 1):
                    left = here & (x[:, f] <= b)
                    right = here & ~left
                    if left.sum() >= least and right.sum() >= least:
                        part = lambda m: g[m].sum() ** 2 / (w[m].sum() + ridge)
                        gain = part(left) + part(right) - part(here)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            for side in best[1] or (here,):
                grow(side, level + 1)

        grow(np.ones(len(y), bool), 0)
        p = p + step
    return p


@pytest.mark.parametrize("kind, alpha", [("mean", 0.5), ("quantile", 0.9)])
def test_equal_to_direct_trees(data, kind, alpha):
    model = op.boost(data, ["a", "b", "c"], "y", kind, weight="w", alpha=alpha, trees=3, depth=2, bins=8, least=10)
    d = data.filter("y is not null").withColumn("p", model.score()).toPandas()
    x = np.column_stack([np.searchsorted(e, np.where(np.isnan(d[f]), -np.inf, d[f]), "left") for f, e in zip("abc", model.edges)])
    want = direct(x, d.y.to_numpy(), d.w.to_numpy(), kind, alpha, d.y.std(ddof=0), model.base, 3, 2, 8, 0.3, 1.0, 10)
    assert np.allclose(d.p, want)
    assert set(data.select(op.binned("a", model.edges[0]).alias("n")).distinct().toPandas().n) <= set(range(8))


def test_trees_find_a_step_that_a_line_does_not(data):
    from tidemark.operators import panel

    model = op.boost(data, ["a", "b", "c"], "y", trees=15, depth=2)
    d = data.filter("y is not null and a is not null")
    line = panel.ridge(d.withColumnRenamed("y", "label"), ("a", "b", "c"))
    loss = d.select(F.avg((model.score() - F.col("y")) ** 2).alias("t"), F.var_pop("y").alias("v")).first()
    assert line and loss.t < 0.1 * loss.v  # a line explains less than half
    x, y = (lambda p: (p[["a", "b", "c"]].to_numpy(), p.y.to_numpy()))(d.toPandas())
    z = np.column_stack([x, np.ones(len(x))])
    assert ((z @ np.linalg.lstsq(z, y, rcond=None)[0] - y) ** 2).mean() > 5 * loss.t


def test_quantiles_cover_their_share(data):
    shares = {}
    for alpha in (0.1, 0.9):
        model = op.boost(data, ["a", "b", "c"], "y", "quantile", alpha=alpha, trees=12, depth=2)
        shares[alpha] = data.filter("y is not null").select(F.avg((F.col("y") <= model.score()).cast("double"))).first()[0]
    assert abs(shares[0.1] - 0.1) < 0.09 and abs(shares[0.9] - 0.9) < 0.09


def test_rankings_order_the_rows_of_a_date(spark):
    rng = np.random.default_rng(6)
    rows = []
    for day in range(40):
        level = rng.normal() * 50  # dates differ by more than their rows do
        for _ in range(15):
            a, b = rng.normal(size=2)
            rows.append((DAY + dt.timedelta(days=day), float(a), float(b + level), float(2 * (a > 0.5) + (a > -0.5))))
    d = spark.createDataFrame(rows + [(None, 0.0, 0.0, 1.0)], "day date, a double, b double, grade double").repartition(3)
    model = op.boost(d, ["a", "b"], "grade", "rank", date="day", trees=10, depth=2, least=10)
    p = d.filter("day is not null").withColumn("p", model.score()).toPandas()
    assert p.groupby("day")[["p", "grade"]].apply(lambda g: g.p.corr(g.grade, method="pearson")).mean() > 0.9
    assert all(t.feature[0] == 0 for t in model.trees[:3])
    with pytest.raises(ValueError):
        op.boost(d, ["a"], "grade", "other")


def test_empty(spark):
    none = spark.createDataFrame([], "a double, y double")
    model = op.boost(none, ["a"], "y", trees=1, depth=1)
    assert model.base == 0.0 and spark.createDataFrame([(1.0,)], "a double").select(model.score().alias("p")).first().p == 0.0
