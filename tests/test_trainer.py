"""Accumulated descent and block bootstrap against numpy."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, trainer

DAY = dt.date(2021, 1, 1)


def numpy_run(x, y, place, n, horizon, batches, accumulate, epochs):
    end, ve = int(n * 0.68), int(n * 0.84)
    fv, ft = end + horizon, ve + horizon
    t = place < end
    c, s, cy, sy = x[t].mean(0), x[t].std(0), y[t].mean(), y[t].std()
    s[s == 0] = 1
    z, g = np.clip((x - c) / s, -6, 6), np.clip((y - cy) / sy, -6, 6)
    batch = np.where(t, place * batches // end, -1)

    def score(here, w, b):
        p, a = (b + z[here] @ w) * sy + cy, y[here]
        hits, mae, ic = 100 * ((p >= 0) == (a >= 0)).mean(), np.abs(p - a).mean(), np.corrcoef(p, a)[0, 1] if p.std() > 1e-12 else 0.0
        return hits * 0.55 + max(0, ic) * 35 - mae * 2.4

    w, b, best, stale, out, kept = np.zeros(x.shape[1]), 0.0, -999.0, 0, [], None
    for epoch in range(1, epochs + 1):
        for start in range(0, batches, accumulate):
            gw, gb = [], []
            for i in range(start, min(batches, start + accumulate)):
                e = b + z[batch == i] @ w - g[batch == i]
                gw.append(e @ z[batch == i] / len(e))
                gb.append(e.mean())
            w, b = w - 0.025 * np.clip(np.mean(gw, 0) + 0.002 * w, -3, 3), b - 0.025 * np.clip(np.mean(gb), -3, 3)
        if epoch == 1 or epoch % 5 == 0:
            out.append((epoch, score((place >= fv) & (place < ve), w, b)))
            if out[-1][1] > best + 0.15:
                best, stale, kept = out[-1][1], 0, (w, b)
            else:
                stale += 1
            if stale >= 4:
                break
    return out, kept, score(place >= ft, *kept)


def test_training_equals_a_numpy_run(spark):
    rng = np.random.default_rng(2)
    n = 120
    place = np.repeat(np.arange(n), 6)
    x = np.column_stack([rng.standard_normal((len(place), 3)), np.ones(len(place))])  # the last feature never varies
    y = np.where(place < 90, 1.0, -1.0) * 2 * x[:, 0] - x[:, 1] + rng.standard_normal(len(place))
    rows = [(DAY + dt.timedelta(days=int(p)), *map(float, v), float(t)) for p, v, t in zip(place, x, y)]
    df = spark.createDataFrame(rows, "day date, a double, b double, c double, d double, y double").repartition(3)
    got = trainer.train(df, ["a", "b", "c", "d"], "y", "day", horizon=3, batches=5, accumulate=2, epochs=12)
    want, (w, b), test = numpy_run(x, y, place, n, 3, 5, 2, 12)
    assert [(c["epoch"], round(c["score"], 8)) for c in got.checkpoints] == [(e, round(s, 8)) for e, s in want]
    assert np.allclose(got.weights, w) and np.isclose(got.bias, b) and np.isclose(got.test["score"], test)
    assert got.checkpoints[1]["steps"] == 15 and got.rollback == (max(want, key=lambda c: c[1]) is not want[-1])
    assert trainer.train(df.filter(F.col("day") < DAY + dt.timedelta(days=60)), ["a"], "y", "day", horizon=3) is None


def test_training_stops_early_and_rolls_back(spark, monkeypatch):
    scores = iter([5.0, 9.0, 9.1, 8.0, 7.0, 6.0, 100.0, 0.0])
    monkeypatch.setattr(trainer, "_metrics", lambda *a: {"mae": 0.0, "hit_rate": 0.0, "ic": 0.0, "score": next(scores)})
    monkeypatch.setattr(trainer, "totals", lambda rows, kernel, size: np.ones(size))
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), float(i % 7), float(i % 5)) for i in range(100)], "day date, a double, y double")
    got = trainer.train(df, ["a"], "y", "day", horizon=2)
    assert [c["epoch"] for c in got.checkpoints] == [1, 5, 10, 15, 20, 25] and got.rollback  # 9.1 is no gain over 9
    assert got.weights[0] < 0 and got.test["score"] == 100.0


@pytest.mark.parametrize("blocks", [12, 4])
def test_block_bootstrap_equals_numpy_on_the_same_draws(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 49 else DAY + dt.timedelta(days=int(i % blocks)), float(rng.random() < 0.6), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "day date, hit double, gain double")
    got = {r.statistic: r for r in metrics.resampled_blocks(df, "day", {"n": F.lit(1), "hits": F.col("hit"), "sum": F.col("gain")}, {"rate": F.col("hits") / F.col("n"), "mean": F.col("sum") / F.col("n"), "never": F.lit(None)}, samples=80, seed=5).collect()}
    if blocks < 5:
        assert got == {}
        return
    days = sorted({d for d, _, _ in rows if d})
    part = {d: np.array([[1, h, g] for e, h, g in rows if e == d]).sum(0) for d in days}
    draws = [sum(part[days[int(hashlib.md5(f"5:{s}:{t}".encode()).hexdigest()[:8], 16) % blocks]] for t in range(blocks)) for s in range(80)]
    assert got.keys() == {"rate", "mean"}
    for name, at in (("rate", 1), ("mean", 2)):
        v = sorted(d[at] / d[0] for d in draws)
        assert np.isclose(got[name].low, v[int(80 * 0.025)]) and np.isclose(got[name].high, v[int(80 * 0.975)]) and got[name].blocks == blocks and got[name].samples == 80
