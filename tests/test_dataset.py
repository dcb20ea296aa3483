"""The training panel against direct computation."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset as op
from tidemark.operators import labels

DAY = dt.date(2023, 1, 2)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(6):
        close = 50.0
        for i in range(110 if s else 60):  # the first symbol has too few bars
            o, close = close, close * math.exp(rng.normal(0, 0.02))
            rows.append(("US" if s < 4 else "CN", f"S{s}", "a", DAY + dt.timedelta(days=i), o, max(o, close) * 1.01, min(o, close) * 0.99, close, float(rng.integers(50, 5000)), 3))
    return spark.createDataFrame(rows, "market string, symbol string, sector string, day date, open double, high double, low double, close double, volume double, trade_count long")


@pytest.fixture(scope="module")
def panel(bars):
    return op.market_dataset(bars, [2, 7], 5.0, 4.0, 0.1).persist()


def test_labels_equal_those_of_one_horizon(bars, panel):
    for h in (2, 7):
        want = labels.labelled(bars, h, 5.0, 4.0, 0.1).filter("symbol <> 'S0'").toPandas().set_index(["symbol", "day"]).sort_index()
        got = panel.filter(F.col("horizon") == h).toPandas().set_index(["symbol", "day"]).sort_index()
        assert list(got.index) == list(want.index) and len(got) == 5 * (110 - 55 - h)
        for c in ("entry", "target_pct", "stop_pct", "forward_return", "max_upside", "max_drawdown", "confidence"):
            assert np.allclose(got[c], want[c])
        assert ((got.barrier_class == 2) == (want.y_target == 1)).all() and ((got.barrier_class == 0) == (want.y_stop == 1)).all()


def test_ranks_and_weights_equal_direct_ones(bars, panel):
    d = panel.toPandas()
    own = {}
    for (s,), g in bars.toPandas().sort_values("day").groupby(["symbol"]):
        middle = np.median(g.volume[g.volume > 0])
        for i, (day, v) in enumerate(zip(g.day, g.volume)):
            own[s, day] = (min(1, max(0.25, math.sqrt(v / max(1, middle)))), 0.85 + 0.15 * i / (len(g) - 1))
    clip = lambda x, a, b: min(b, max(a, x))
    quality = 1.0
    for (_, _), g in d.groupby(["market", "horizon"]):
        t, s = (g.barrier_class == 2).mean(), (g.barrier_class == 0).mean()
        weight = []
        for r in g.itertuples():
            liquid, recent = own[r.symbol, r.day]
            quality = r.evaluation_weight / liquid if 0.05 < r.evaluation_weight < 1 else quality
            w = clip(r.evaluation_weight * clip(r.confidence, 0.2, 1) * recent, 0.05, 1.35)
            weight.append(clip(w * (min(2, 0.5 / t) if r.barrier_class == 2 else min(2, 0.5 / s) if r.barrier_class == 0 else 1), 0.05, 1.5))
        g = g.assign(w=weight)
        mass = g.groupby("day").w.sum()
        scale = (mass.median() / mass).clip(0.25, 4)
        assert np.allclose(g.training_weight, [clip(w * scale[day], 0.02, 2) for w, day in zip(g.w, g.day)])
        for _, e in g.groupby("day"):
            order = e.sort_values(["forward_return", "symbol"])
            assert np.allclose(order.return_rank, np.arange(len(e)) / max(1, len(e) - 1) if len(e) > 1 else 0.5)
            down = e.sort_values(["volatility_10", "symbol"], ascending=[False, True])
            assert np.allclose(down.rank_volatility, np.arange(len(e)) / max(1, len(e) - 1) * 2 - 1)
            assert np.isclose(e.breadth.iloc[0], (e.momentum_5 > 0).mean())


def test_events_are_taken_in_where_enough_symbols_have_some(spark, bars):
    some = spark.createDataFrame([("US", f"S{i}", DAY + dt.timedelta(days=80), 0.5) for i in (1, 2, 3)] + [("CN", "S4", DAY + dt.timedelta(days=80), 0.7)], "market string, symbol string, day date, sentiment double")
    with_events = op.market_dataset(bars, [2], events=some)
    assert with_events.filter("sentiment <> 0").count() == 4 and with_events.filter("event_coverage = 1").count() == 4 and with_events.filter("sentiment is null").count() == 0
    few = op.market_dataset(bars, [2], events=some.filter("market = 'CN'"))
    assert "sentiment" not in few.columns and few.count() == with_events.count()


def test_version_names_the_rows(panel):
    want = {r.market: (r.row_count, r.version) for r in op.version(panel).collect()}
    assert {r.market: (r.row_count, r.version) for r in op.version(panel.orderBy(F.rand(3)).repartition(7)).collect()} == want
    other = op.version(panel.withColumn("direction", F.when((F.col("symbol") == "S1") & (F.col("horizon") == 2) & (F.col("day") == F.lit(DAY + dt.timedelta(days=70))), 1 - F.col("direction")).otherwise(F.col("direction"))))
    got = {r.market: (r.row_count, r.version) for r in other.collect()}
    assert got["CN"] == want["CN"] and got["US"][0] == want["US"][0] and got["US"][1] != want["US"][1]
    assert op.version(panel.filter("false")).count() == 0


def test_correlations_of_rows_that_have_both(spark):
    import pandas as pd

    from tidemark.operators import panel as panels

    rng = np.random.default_rng(8)
    x = pd.DataFrame(rng.standard_normal((200, 3)) * [1, 50, 2] + [0, 900, 5], columns=["a", "b", "c"])
    x["b"] += 30 * x.a
    x["d"] = 7.0
    x.loc[::7, "a"] = np.nan
    x.loc[::5, "c"] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x.to_numpy()], "a double, b double, c double, d double").repartition(3)
    got = {(r.left, r.right): r.correlation for r in panels.correlations(df, ("a", "b", "c", "d")).collect()}
    assert len(got) == 6
    for (i, j), c in got.items():
        assert np.isclose(c, 0.0 if j == "d" else x[i].corr(x[j]))
    assert {r.correlation for r in panels.correlations(df.filter("false"), ("a", "b")).collect()} == {0.0}
