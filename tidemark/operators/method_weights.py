"""Weights of forecasting methods by market and horizon: projected descent over a path of penalties, with folds of stability.

Two passes over the rows serve all scopes: one sums weighted Gram matrices of the methods and the outcome by slices of time,
from which every fit and every squared error of every window follows; one counts the hits of all candidate weightings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.committee import learnable, places
from tidemark.operators.models import simplex_projection
from tidemark.operators.selection import LEAST_WEIGHT, totals
from tidemark.sources.stored import stored

SLICES = 25
PENALTIES = (0.0, 0.006, 0.02, 0.06, 0.14, 0.32)
CAP, STEPS, RATE = 0.48, 420, 0.0012
LEAST_ROWS = 36
#: (fit, validation, test) as ranges of slices: the holdout first, then the folds, whose validation is the last fifth before them.
WINDOWS = (((0, 14), (14, 20), (20, 25)), *(((0, s - s // 5), (s - s // 5, s), (s, s + 3)) for s in (10, 13, 16, 19, 22)))


def descend(gram: np.ndarray, penalty: float, cap: float = CAP) -> np.ndarray:
    """Weights from equal ones by projected steps against the weighted squared error and penalty |w - equal|^2; gram: means of products of (methods, outcome)."""
    k = len(gram) - 1
    prior = np.full(k, 1 / k)
    w, a, b = prior.copy(), gram[:k, :k], gram[:k, k]
    for _ in range(STEPS):
        w = simplex_projection(w - RATE / k * (2 * penalty * (w - prior) + 2 * (a @ w - b)), cap)
    return w


def squared_error(gram: np.ndarray, w: np.ndarray) -> float:
    """Mean weighted squared error of a weighting, from a Gram matrix of (methods, outcome, 1) sums; the last entry is the weight."""
    v = np.append(w, -1.0)
    n = gram[-1, -1]
    return float(v @ gram[:-1, :-1] @ v / n) if n > 0 else 0.0


def calibrate(df: DataFrame, market: str, horizon: str, day: str, y: str, methods: list[str], weight: str | None = None, resolved: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(methods, scopes): each method's weight, error and hit rate on the last fifth; each scope's penalty, gains, stability and whether it is active.

    A penalty is chosen by the error less 0.012 of the hit rate on the validation slices. Null forecasts count as 0, weights as 1 and at least
    LEAST_WEIGHT; rows whose outcome (`resolved`) is known only after the next slice began are judged but not learned from. Scopes with fewer than
    LEAST_ROWS rows, or a window without rows, are left out.
    """
    spark, k = df.sparkSession, len(methods)
    rows = learnable(df.filter(F.col(y).isNotNull()), market, horizon, day, resolved, LEAST_ROWS, SLICES)
    w = F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.col(weight).cast("double"), F.lit(1.0))) if weight else F.lit(1.0)
    rows = rows.select("scope", "tenth", "learn", F.col(y).cast("double").alias("y"), w.alias("w"), F.array(*(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in methods)).alias("x"))
    # weights only add up, so rows that are equal in all else are one row with their weight
    with stored(rows.groupBy("scope", "tenth", "learn", "y", "x").agg(F.sum("w").alias("w"))) as kept:
        scopes = [r.scope for r in kept.select("scope").distinct().orderBy("scope").collect()]  # a few a market
        n, kept = len(scopes), kept.withColumn("at", places(scopes))

        def grams(at, tenth, learn, y, w, x):
            out = np.zeros((2, n * SLICES, k + 2, k + 2))
            z, cell = np.column_stack([x, y, np.ones(len(y))]), at * SLICES + tenth
            for side, here in enumerate((learn, np.ones(len(y), bool))):
                for c in np.unique(cell[here]):
                    own = (cell == c) & here
                    out[side, c] = (z[own] * w[own, None]).T @ z[own]
            return out.ravel()

        learned, seen = totals(kept, grams, 2 * n * SLICES * (k + 2) ** 2, ("at", "tenth", "learn", "y", "w", "x")).reshape(2, n, SLICES, k + 2, k + 2)
        span = lambda table, s, t: table[s, t[0] : t[1]].sum(0)
        vectors = np.zeros((n, len(WINDOWS) * len(PENALTIES) + 1 + k, k))
        for s in range(n):
            fitted = []
            for fit, _, _ in WINDOWS:
                g = span(learned, s, fit)
                g = g[:-1, :-1] / max(g[-1, -1], 1e-12)
                fitted += [descend(g, p) for p in PENALTIES]
            vectors[s] = [*fitted, np.full(k, 1 / k), *np.eye(k)]

        def hits(at, tenth, y, w, x):
            out = np.zeros((n, SLICES, vectors.shape[1]))
            for s in np.unique(at):
                own = at == s
                hit = ((x[own] @ vectors[s].T >= 0) == (y[own] >= 0)[:, None]) * w[own, None]
                np.add.at(out[s], tenth[own], hit)
            return out.ravel()

        found = totals(kept, hits, n * SLICES * vectors.shape[1], ("at", "tenth", "y", "w", "x")).reshape(n, SLICES, vectors.shape[1])
    by_method, about = [], []
    for s, scope in enumerate(scopes):
        if any(span(seen, s, t)[-1, -1] <= 0 for window in WINDOWS for t in window):
            continue
        score = lambda v, t: (squared_error(span(seen, s, t), vectors[s, v]), 100 * found[s, t[0] : t[1], v].sum() / span(seen, s, t)[-1, -1])  # noqa: B023, E731
        equal = len(WINDOWS) * len(PENALTIES)
        chosen, gains, lifts, rates, mass = [], [], [], [], []
        for i, (_, valid, test) in enumerate(WINDOWS):
            best = min(range(len(PENALTIES)), key=lambda p: (lambda e: e[0] - 0.012 * e[1])(score(i * len(PENALTIES) + p, valid)))  # noqa: B023
            own, base = score(i * len(PENALTIES) + best, test), score(equal, test)
            chosen.append(i * len(PENALTIES) + best)
            gains.append((base[0] - own[0]) / base[0] * 100 if base[0] > 1e-9 else 0.0)
            lifts.append(own[1] - base[1])
            rates.append(own[1])
            mass.append(max(1.0, span(seen, s, test)[-1, -1]))
        share = np.array(mass[1:]) / sum(mass[1:])
        folds = vectors[s, chosen[1:]]
        drift = float(np.abs(folds - share @ folds).sum(1).mean())
        gain, lift, up, along = share @ gains[1:], share @ lifts[1:], np.mean(np.array(gains[1:]) > 0), np.mean(np.array(lifts[1:]) >= -0.25)
        stability = float(np.clip(52 + gain * 0.9 + lift * 1.7 + (up - 0.5) * 24 + (along - 0.5) * 20 - drift * 18, 0, 100))
        stable = bool(stability >= 52 and gain >= -1.5 and lift >= -1.5 and min(rates[1:]) >= 42 and (up >= 0.45 or along >= 0.5) and drift <= 0.52)
        active = bool(((gains[0] >= 2 and lifts[0] >= -1 and rates[0] >= 50) or lifts[0] >= 3) and stable)
        blend = float(np.clip((0.35 + min(0.35, max(0.0, gains[0]) / 100) + min(0.2, max(0.0, lifts[0]) / 100)) * np.clip(stability / 100, 0.5, 1), 0.2, 0.76)) if active else 0.0
        test = WINDOWS[0][2]
        error, rate = score(chosen[0], test)
        about.append((scope, PENALTIES[chosen[0]], error, float(rate), float(gains[0]), float(lifts[0]), drift, stability, stable, active, blend))
        for j, m in enumerate(methods):
            e, h = score(equal + 1 + j, test)
            by_method.append((scope, m, float(vectors[s, chosen[0], j]), e, float(h)))
    return (
        spark.createDataFrame(by_method, "scope string, method string, weight double, mse double, hit_rate double"),
        spark.createDataFrame(about, "scope string, penalty double, mse double, hit_rate double, gain double, lift double, drift double, stability double, stable boolean, active boolean, blend double"))
