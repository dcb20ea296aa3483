"""A linear model by mini-batches of dates with accumulated gradients, early stopping and rollback."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.operators.selection import totals, with_places
from tidemark.sources.stored import stored

RATE, L2, LIMIT, GAIN, PATIENCE = 0.025, 0.002, 6.0, 0.15, 4
VALIDATION, TEST = -1, -2


@dataclass
class Training:
    """Checkpoints (epoch, steps, mae, hit rate, ic, score), the best one's weights for features less centre over scale, and its test metrics."""

    checkpoints: list[dict] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    test: dict | None = None
    rollback: bool = False


def _metrics(rows: DataFrame, weights: np.ndarray, bias: float, centre: float, scale: float) -> dict:
    """Mean absolute error, share of equal signs, correlation and the score, in the label's own units, from one aggregate."""

    def sums(place, y, w, v, x):
        p, a = (bias + x @ weights) * scale + centre, v
        return np.array([len(a), np.abs(p - a).sum(), ((p >= 0) == (a >= 0)).sum(), p.sum(), a.sum(), p @ p, a @ a, p @ a], float)

    n, error, hits, sp, sa, spp, saa, spa = totals(rows, sums, 8)
    if not n:
        return {"mae": 0.0, "hit_rate": 0.0, "ic": 0.0, "score": -999.0}
    across = (spp / n - (sp / n) ** 2) * (saa / n - (sa / n) ** 2)
    ic = (spa / n - sp * sa / n**2) / np.sqrt(across) if across > 1e-24 else 0.0
    return {"mae": error / n, "hit_rate": 100 * hits / n, "ic": ic, "score": 55 * hits / n + max(0.0, ic) * 35 - error / n * 2.4}


def train(df: DataFrame, features: list[str], y: str, date: str, horizon: int, batches: int = 9, accumulate: int = 3, epochs: int = 60) -> Training | None:
    """Train on the first 68 % of the dates, stop on the next ones, test on those after 84 %; `horizon` dates are left out before each part.

    A batch is a run of training dates. The gradients of `accumulate` batches are averaged (each batch's own mean first) before a step, which is
    one aggregate over those batches only, as rows are stored by batch. A checkpoint at the first and every fifth epoch; the best one so far
    must be beaten by GAIN, and PATIENCE checkpoints without that end the training. None where a part has too few dates.
    """
    placed, n = with_places(df.filter(F.col(y).isNotNull()), date)
    end, purge = int(n * 0.68), max(1, horizon)
    first_valid, valid_end = end + purge, int(n * 0.84)
    first_test = valid_end + purge
    if end < 50 or valid_end - first_valid < 10 or n - first_test < 8:
        return None
    k, train_rows, place = len(features), placed.filter(F.col("place") < end), F.col("place")
    m = train_rows.agg(*(F.avg(c) for c in (*features, y)), *(F.stddev_pop(c) for c in (*features, y))).first()
    centre, scale = [v or 0.0 for v in m[: k + 1]], [v or 1.0 for v in m[k + 1 :]]
    part = F.when(place < end, F.floor(place * batches / end)).when((place >= first_valid) & (place < valid_end), F.lit(VALIDATION)).when(place >= first_test, F.lit(TEST))
    z = F.array(*(clamp((F.coalesce(F.col(c).cast("double"), F.lit(centre[i])) - centre[i]) / scale[i], -LIMIT, LIMIT) for i, c in enumerate(features)))
    goal = clamp((F.col(y) - centre[k]) / scale[k], -LIMIT, LIMIT)
    rows = placed.select(part.cast("int").alias("batch"), goal.alias("y"), F.lit(1.0).alias("w"), F.col(y).cast("double").alias("v"), z.alias("x")).filter("batch is not null")
    out, best, stale, steps = Training(), -np.inf, 0, 0
    weights, bias = np.zeros(k), 0.0
    with stored(rows, "batch") as kept:
        kept = kept.withColumn("place", F.col("batch"))
        for epoch in range(1, epochs + 1):
            for start in range(0, batches, accumulate):
                own = list(range(start, min(batches, start + accumulate)))
                now, level = weights, bias

                def slopes(place, y, w, v, x):
                    s = np.zeros((len(own), k + 2))
                    error = level + x @ now - y
                    for i, b in enumerate(own):
                        here = place == b
                        s[i] = [*(error[here] @ x[here]), error[here].sum(), here.sum()]
                    return s.ravel()

                s = totals(kept.filter(F.col("batch").isin(own)), slopes, len(own) * (k + 2)).reshape(len(own), k + 2)
                mean = (s[:, :-1] / np.maximum(1, s[:, -1:])).mean(0)
                weights = weights - RATE * np.clip(mean[:k] + L2 * weights, -3, 3)
                bias -= RATE * float(np.clip(mean[k], -3, 3))
                steps += 1
            if epoch == 1 or epoch % 5 == 0:
                found = _metrics(kept.filter(F.col("batch") == VALIDATION), weights, bias, centre[k], scale[k])
                out.checkpoints.append({"epoch": epoch, "steps": steps, **found})
                if found["score"] > best + GAIN:
                    best, stale, out.weights, out.bias = found["score"], 0, weights, bias
                else:
                    stale += 1
                if stale >= PATIENCE:
                    break
        out.test = _metrics(kept.filter(F.col("batch") == TEST), out.weights, out.bias, centre[k], scale[k])
    out.rollback = max(out.checkpoints, key=lambda c: c["score"]) is not out.checkpoints[-1]
    return out
