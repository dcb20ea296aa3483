"""Choices that training makes on its own dates: features by stability, family and profile; calibrators; direction models.

All of them look at inner windows of the training dates only. Rows carry `place`, the number of their
date. Many fits share each pass over the rows: a step of descent or of Newton's method is one aggregate
for all models and windows at once, and only tables of the size of the models reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, logit, sigmoid
from tidemark.operators import metrics
from tidemark.sources.stored import stored

W = Window
LEAST_WEIGHT = 0.05


def with_places(df: DataFrame, date: str) -> tuple[DataFrame, int]:
    """df with place (0, 1, .. by date), and the number of dates."""
    dates = df.select(date).filter(F.col(date).isNotNull()).distinct().withColumn("place", F.row_number().over(W.orderBy(date)) - 1)  # one row a date
    return df.join(dates, date), dates.count()


@dataclass(frozen=True)
class Fit:
    """A logistic model of some columns on the places [train) that is judged on the places [judged)."""

    name: str
    window: int
    columns: tuple[str, ...]
    train: tuple[int, int]
    judged: tuple[int, int]


@dataclass(frozen=True)
class Linear:
    """Weights over all features (0 where a fit does not use one), for features less centre over scale."""

    weights: np.ndarray
    intercept: float
    centre: np.ndarray
    scale: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + (x - self.centre) / self.scale @ self.weights, -18, 18)))


def totals(rows: DataFrame, kernel: Callable[..., np.ndarray], size: int, columns: tuple[str, ...] = ("place", "y", "w", "v", "x")) -> np.ndarray:
    """Sums over all rows of what kernel(*columns) gives for a batch (arrays become matrices); `size` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                own = (batch.column(c) for c in columns)
                total += kernel(*(c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in own))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "part"])

    out = np.zeros(size)
    for r in rows.select(*columns).mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
        out[r["at"]] = r["part"]
    return out


def _inside(place: np.ndarray, window: tuple[int, int]) -> np.ndarray:
    return (place >= window[0]) & (place < window[1])


def descend(rows: DataFrame, features: list[str], fits: list[Fit], penalty: float, epochs: int) -> list[Linear]:
    """All fits by the same full-batch descent on standardised features; one aggregate over the rows is a step of all of them."""
    k, windows = len(features), sorted({f.train for f in fits})
    sums = totals(rows, lambda place, y, w, v, x: np.concatenate([np.concatenate([[u.sum(), u @ y], u @ x]) for u in (w * _inside(place, t) for t in windows)]), len(windows) * (k + 2)).reshape(len(windows), k + 2)
    total = np.where(sums[:, 0] > 0, sums[:, 0], 1.0)
    centre = sums[:, 2:] / total[:, None]
    spread = totals(rows, lambda place, y, w, v, x: np.concatenate([(w * _inside(place, t)) @ (x - c) ** 2 for t, c in zip(windows, centre, strict=True)]), len(windows) * k).reshape(len(windows), k)
    scale = np.sqrt(spread / total[:, None])
    scale = np.where(scale > 1e-12, scale, 1.0)
    base = np.clip(sums[:, 1] / total, 0.02, 0.98)
    own = [[i for i, f in enumerate(fits) if f.train == t] for t in windows]
    window_of = np.array([windows.index(f.train) for f in fits])
    used = np.array([[c in f.columns for c in features] for f in fits], float)
    weights, intercept = np.zeros((len(fits), k)), np.log(base / (1 - base))[window_of]
    step = 0.045 / np.maximum(1, used.sum(1))
    for _ in range(max(30, epochs)):
        now, level = weights, intercept

        def slopes(place: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(fits), k + 1))
            for t, c, s, n, mine in zip(windows, centre, scale, total, own, strict=True):
                here = _inside(place, t)
                z, u, goal = (x[here] - c) / s, w[here] / n, y[here]
                for i in mine:
                    error = (1 / (1 + np.exp(-np.clip(level[i] + z @ now[i], -18, 18))) - goal) * u
                    out[i, :k], out[i, k] = error @ z, error.sum()
            return out.ravel()

        slope = totals(rows, slopes, len(fits) * (k + 1)).reshape(len(fits), k + 1)
        intercept = intercept - step * slope[:, k]
        weights = weights - step[:, None] * (2 * penalty * weights + slope[:, :k]) * used
    return [Linear(weights[i], float(intercept[i]), centre[window_of[i]], scale[window_of[i]]) for i in range(len(fits))]


def judge(rows: DataFrame, fits: list[Fit], models: list[Linear]) -> list[dict]:
    """Brier score, skill against the window's own base rate, balanced accuracy and F1 of each fit on its judged window, in one aggregate."""

    def sums(place: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = []
        for f, m in zip(fits, models, strict=True):
            here = _inside(place, f.judged)
            p, a, u = m.scores(x[here]), y[here], v[here]
            hit, real = p >= 0.5, a >= 0.5
            out += [here.sum(), u.sum(), u @ a, u @ a**2, u @ (p - a) ** 2, (hit & real).sum(), (~hit & ~real).sum(), (hit & ~real).sum(), (~hit & real).sum()]
        return np.array(out, float)

    out = []
    for f, (n, w, wy, wyy, loss, tp, tn, fp, fn) in zip(fits, totals(rows, sums, 9 * len(fits)).reshape(-1, 9), strict=True):
        w = w or 1.0
        brier, baseline = loss / w, wyy / w - (wy / w) ** 2
        precision, recall, other = tp / max(1, tp + fp), tp / max(1, tp + fn), tn / max(1, tn + fp)
        out.append({
            "name": f.name, "window": f.window, "features": len(f.columns), "rows": int(n), "brier": brier, "baseline": baseline, "skill": (baseline - brier) / baseline if baseline > 0 else 0.0,
            "balanced_accuracy": 50 * (recall + other), "f1": 100 * 2 * precision * recall / max(1e-12, precision + recall),
        })
    return out


def packed(df: DataFrame, features: list[str], y: str, weight: str | None = None, judge_weight: str | None = None) -> DataFrame:
    """place, y, w, v, x: what the fits read; null features count as 0, rows without a label go."""
    w = F.coalesce(F.col(weight), F.lit(1.0)).cast("double") if weight else F.lit(1.0)
    v = F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.col(judge_weight), F.lit(1.0)).cast("double")) if judge_weight else F.lit(1.0)
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))
    return df.filter(F.col(y).isNotNull()).select(F.col("place").cast("int").alias("place"), (F.col(y) >= 0.5).cast("double").alias("y"), w.alias("w"), v.alias("v"), x.alias("x"))


def stability_windows(n: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of windows of n training dates: early against late, and each quarter against the next, where they hold 40 dates."""
    split = max(40, min(n - 40, int(n * 0.70)))
    edges = [round(i * n / 4) for i in range(5)]
    quarters = [((edges[i], edges[i + 1]), (edges[i + 1], edges[i + 2])) for i in range(3)]
    return [((0, split), (split, n)), *((a, b) for a, b in quarters if a[1] - a[0] >= 40 and b[1] - b[0] >= 40)]


def stability(df: DataFrame, features: list[str], n: int) -> DataFrame:
    """feature, window, psi for each pair of windows of the training dates (rows with place); each side is read once for all windows."""
    pairs = stability_windows(n)

    def side(k: int) -> DataFrame:
        inside = [(F.col("place") >= pair[k][0]) & (F.col("place") < pair[k][1]) for pair in pairs]
        return df.select(*(F.when(t, F.col(f)).alias(f"{i}|{f}") for i, t in enumerate(inside) for f in features))

    out = metrics.psi(side(0), side(1), [f"{i}|{f}" for i in range(len(pairs)) for f in features])
    at = F.split("feature", r"\|", 2)
    return out.select(at[1].alias("feature"), at[0].cast("int").alias("window"), "psi")


def stable_features(drift: DataFrame, limit: float = 0.25, least: int = 8) -> DataFrame:
    """feature, worst psi over the windows, kept: below the limit, or among the `least` steadiest where fewer are."""
    worst = drift.groupBy("feature").agg(F.max("psi").alias("psi"))
    every = W.partitionBy()  # one row a feature
    steady = F.col("psi") < limit
    enough = F.sum(steady.cast("int")).over(every) >= least
    place = F.row_number().over(every.orderBy("psi", "feature"))
    return worst.withColumn("kept", F.when(enough, steady).otherwise(place <= least))


def family_gate(rows: DataFrame, features: list[str], n: int, families: dict[str, set[str]], specialist: tuple[str, ...] = (), least_features: int = 8, purge: int = 7) -> tuple[list[str], list[dict]]:
    """(kept features, comparisons): each family is left out once, and goes if the model without it is better on the last training dates.

    All models are fitted together on the dates before. Families in `specialist` serve experts of their own and never stay.
    """
    size = min(120, max(60, n // 5))
    train, judged = (0, max(0, n - size - purge)), (n - size, n)
    reserved = set().union(*(families[f] for f in specialist)) if specialist else set()
    base = [c for c in features if c not in reserved]
    fits = [Fit("", 0, tuple(base), train, judged)]
    for name, members in families.items():
        left = tuple(c for c in base if c not in members)
        if name not in specialist and len(left) < len(base) and len(left) >= least_features:
            fits.append(Fit(name, 0, left, train, judged))
    full, *reduced = judge(rows, fits, descend(rows, features, fits, 0.24, 24))
    out, gone = [], set(reserved)
    for r in reduced:
        harmful = full["brier"] - r["brier"] > 0.0005 and r["balanced_accuracy"] - full["balanced_accuracy"] > -0.10
        gone |= families[r["name"]] if harmful else set()
        out.append({"family": r["name"], "removed": len(base) - r["features"], "full_brier": full["brier"], "brier": r["brier"], "full_accuracy": full["balanced_accuracy"], "accuracy": r["balanced_accuracy"], "excluded": harmful})
    out += [{"family": f, "removed": len(families[f] & set(features)), "full_brier": full["brier"], "brier": None, "full_accuracy": full["balanced_accuracy"], "accuracy": None, "excluded": True} for f in specialist]
    return [c for c in features if c not in gone], out


def inner_windows(n: int, size: int, purge: int, least: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(train, judged) places of the last three windows of `size` dates, `purge` dates left out, where `least` dates come before."""
    ends = (n - 2 * size, n - size, n)
    return [((0, end - size - purge), (end - size, end)) for end in ends if end - size - purge >= least]


def profile_gate(rows: DataFrame, features: list[str], n: int, profiles: dict[str, set[str]], least_features: int = 8, least_dates: int = 300) -> tuple[str | None, list[dict]]:
    """(chosen profile, one comparison for each): sets of features are fitted before each of three inner windows and judged on it.

    The score is the mean Brier score, and a penalty for windows without skill and for a balanced accuracy below 50 %. None with fewer than
    two windows or two profiles.
    """
    own = {p: tuple(c for c in features if c in names) for p, names in profiles.items()}
    own = {p: c for p, c in own.items() if len(c) >= least_features}
    windows = inner_windows(n, min(100, max(60, n // 10)), 7, least_dates)
    if len(own) < 2 or len(windows) < 2:
        return None, []
    fits = [Fit(p, i, c, train, judged) for i, (train, judged) in enumerate(windows) for p, c in own.items()]
    found = judge(rows, fits, descend(rows, features, fits, 0.28, 28))
    out = []
    for p, columns in own.items():
        mine = [r for r in found if r["name"] == p]
        mean = {c: sum(r[c] for r in mine) / len(mine) for c in ("brier", "skill", "balanced_accuracy", "f1")}
        negative = sum(r["skill"] <= 0 for r in mine)
        score = mean["brier"] + negative * 0.00075 + max(0.0, 50.0 - mean["balanced_accuracy"]) / 1000
        out.append({"profile": p, "features": len(columns), **mean, "negative_windows": negative, "score": score})
    out.sort(key=lambda r: (round(r["score"], 7), -round(r["f1"], 5)))
    return out[0]["profile"], out


def family_ablation(rows: DataFrame, features: list[str], n: int, families: dict[str, set[str]], first_test: int, purge: int) -> list[dict]:
    """What each family adds on untouched test dates: scores of the model without it less those of the full one ("" in the first row)."""
    train, judged = (0, max(0, first_test - purge)), (first_test, n)
    left = {f: tuple(c for c in features if c not in members) for f, members in families.items()}
    fits = [Fit("", 0, tuple(features), train, judged), *(Fit(f, 0, c, train, judged) for f, c in left.items() if 0 < len(c) < len(features))]
    full, *reduced = judge(rows, fits, descend(rows, features, fits, 0.18, 30))
    return [full | {"brier_delta": 0.0, "accuracy_delta": 0.0}, *(r | {"brier_delta": r["brier"] - full["brier"], "accuracy_delta": r["balanced_accuracy"] - full["balanced_accuracy"]} for r in reduced)]


# ---- calibrators ----

METHODS = ("identity", "shrinkage", "platt", "isotonic")
BINS = 2000
ISOTONIC_ROWS, ISOTONIC_DATES = 5000, 120


def _times(rows: DataFrame) -> Column:
    """How many equal rows a row stands for: n, or 1 where there is none."""
    return F.col("n") if "n" in rows.columns else F.lit(1)


def _p(column: str | Column) -> Column:
    return clamp(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0.5)), 0.001, 0.999)


def shrinkage(n: int, sy: float, sp: float, spp: float, spy: float, syy: float, dates: int) -> tuple[float, float]:
    """(prior, alpha): how far probabilities move from the base rate, the best of 21 steps up to a share that grows with the number of dates.

    The Brier score is a quadratic in alpha, so the sums of y, p, pp, py and yy are all it needs.
    """
    prior = min(max(sy / max(1, n), 0.001), 0.999)
    cap = min(max(dates / 120, 0.10), 1.0)
    a = n * prior**2 - 2 * prior * sy + syy  # sum of (prior - y)^2
    b = prior * sp - n * prior**2 - spy + prior * sy  # sum of (prior - y)(p - prior)
    c = spp - 2 * prior * sp + n * prior**2  # sum of (p - prior)^2
    best, alpha = math.inf, 0.0
    for step in range(21):
        t = cap * step / 20
        loss = (a + 2 * t * b + t * t * c) / max(1, n)
        if loss < best - 1e-15:
            best, alpha = loss, t
    return prior, alpha


def pooled(sums: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Knots of a rising curve from (sum of p, sum of y, n) in order of p: adjacent violators pooled."""
    pools: list[list[float]] = []
    for x, s, n in sums:
        pools.append([x, s, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            x, s, n = pools.pop()
            pools[-1] = [pools[-1][0] + x, pools[-1][1] + s, pools[-1][2] + n]
    return [x / n for x, _, n in pools], [min(max(s / n, 0.001), 0.999) for _, s, n in pools]


def fit_platts(rows: DataFrame, sums: dict[str, tuple[int, float]], rounds: int = 30, ridge: float = 0.02) -> dict[str, tuple[float, float]]:
    """(intercept, slope) of every group of rows (group, p, y, and n where a row stands for several) by Newton steps; one aggregate is a step of all groups.

    The steps read each probability of a group once, with its rows and the sum of their outcomes.
    """
    spark, n = rows.sparkSession, _times(rows)
    with stored(rows.groupBy("group", "p").agg(F.sum(n).cast("double").alias("n"), F.sum(n * F.col("y")).alias("y")).select("group", logit("p").alias("l"), "n", "y")) as counted:
        return _newton_steps(spark, counted, sums, rounds, ridge)


def _newton_steps(spark: SparkSession, rows: DataFrame, sums: dict[str, tuple[int, float]], rounds: int, ridge: float) -> dict[str, tuple[float, float]]:
    found, going = {}, {}
    for g, (n, sy) in sums.items():
        rate = min(max(sy / max(1, n), 0.001), 0.999)
        going[g] = (math.log(rate / (1 - rate)), 1.0)
    for _ in range(rounds):
        if not going:
            break
        at = F.broadcast(spark.createDataFrame([(g, *ab) for g, ab in going.items()], "group string, a double, b double"))  # one row a group
        d = rows.join(at, "group")
        q, n = sigmoid(F.col("a") + F.col("b") * F.col("l")), F.col("n")
        e, c, x = n * q - F.col("y"), n * F.greatest(F.lit(1e-8), q * (1 - q)), F.col("l")
        for r in d.groupBy("group").agg(F.sum(e), F.sum(e * x), F.sum(c), F.sum(c * x), F.sum(c * x * x)).collect():
            g, s = r[0], r[1:]
            a, b = going[g]
            h0, h1, h2 = s[2] + 1e-8, s[3], s[4] + ridge + 1e-8
            g0, g1, det = s[0], s[1] + ridge * (b - 1), (s[2] + 1e-8) * (s[4] + ridge + 1e-8) - s[3] ** 2
            if abs(det) < 1e-12:
                found[g] = going.pop(g)
                continue
            da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
            going[g] = (min(max(a - da, -20.0), 20.0), min(max(b - db, 0.02), 4.0))
            if abs(da) + abs(db) < 1e-7:
                found[g] = going.pop(g)
    return found | going


def fit_calibrators(rows: DataFrame, methods: tuple[str, ...] = METHODS) -> dict[str, dict]:
    """For each group of rows (group, place, p, y, and n where a row stands for several) the parameters of each method, from shared passes.

    Isotonic curves come from sums over BINS equal bins of p, for groups of ISOTONIC_ROWS rows and ISOTONIC_DATES dates.
    """
    p, y, n = F.col("p"), F.col("y"), _times(rows)
    sums = {r["group"]: r for r in rows.groupBy("group").agg(F.sum(n).alias("n"), F.sum(n * y).alias("sy"), F.sum(n * p).alias("sp"), F.sum(n * p * p).alias("spp"), F.sum(n * p * y).alias("spy"), F.sum(n * y * y).alias("syy"), F.count_distinct("place").alias("dates")).collect()}
    out: dict[str, dict] = {g: {"identity": ()} if "identity" in methods else {} for g in sums}
    if "shrinkage" in methods:
        for g, r in sums.items():
            out[g]["shrinkage"] = shrinkage(r["n"], r["sy"], r["sp"], r["spp"], r["spy"], r["syy"], r["dates"])
    if "platt" in methods:
        for g, ab in fit_platts(rows, {g: (r["n"], r["sy"]) for g, r in sums.items()}).items():
            out[g]["platt"] = ab
    wide = [g for g, r in sums.items() if r["n"] >= ISOTONIC_ROWS and r["dates"] >= ISOTONIC_DATES]
    if "isotonic" in methods and wide:
        bins: dict[str, list] = {g: [] for g in wide}
        for r in rows.filter(F.col("group").isin(wide)).groupBy("group", F.least(F.lit(BINS - 1), F.floor(p * BINS)).alias("bin")).agg(F.sum(n * p).alias("sp"), F.sum(n * y).alias("sy"), F.sum(n).alias("n")).orderBy("group", "bin").collect():
            bins[r["group"]].append((r["sp"], r["sy"], r["n"]))
        for g, s in bins.items():
            out[g]["isotonic"] = pooled(s)
    return out


PARAMETERS = "group string, method string, u double, v double, xs array<double>, ys array<double>"


def parameter_table(spark, choices: list[tuple[str, str, tuple]]) -> DataFrame:
    """(group, method, parameters) as rows; the table has the size of the models."""
    flat = {"identity": lambda p: (None, None, None, None), "isotonic": lambda p: (None, None, *p)}
    return spark.createDataFrame([(g, m, *flat.get(m, lambda p: (*p, None, None))(p)) for g, m, p in choices], PARAMETERS)


def calibrated(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """rows (group, p within 0.001 and 0.999, ..) with method and q, the probability as the group's method maps it; a row for each method."""
    p, u, v, xs, ys = (F.col(c) for c in ("p", "u", "v", "xs", "ys"))
    held = F.greatest(F.get(xs, F.lit(0)), F.least(F.element_at(xs, -1), p))
    right = F.size(F.filter(xs, lambda t: t < held))  # 0-based place of the first knot not below
    a, b, low, high = F.get(xs, right - 1), F.get(xs, right), F.get(ys, right - 1), F.get(ys, right)
    between = clamp(low + (high - low) * F.when(b - a > 1e-12, (held - a) / (b - a)).otherwise(F.lit(0.0)), 0.001, 0.999)
    curve = F.when(right == 0, F.get(ys, F.lit(0))).otherwise(between)
    q = F.when(F.col("method") == "identity", p).when(F.col("method") == "shrinkage", clamp(u + v * (p - u), 0.001, 0.999)).when(F.col("method") == "platt", sigmoid(u + v * logit(p))).otherwise(curve)
    return rows.join(F.broadcast(parameters), "group").withColumn("q", q).drop("u", "v", "xs", "ys")


def choose_calibrators(rows: DataFrame, n_dates: dict[str, int], methods: tuple[str, ...] = METHODS, least_rows: int = 500, least_dates: int = 40) -> dict[str, tuple[str, tuple]]:
    """(method, parameters) for each group of rows (group, place, p, y, and n where a row stands for several), whose dates have the places 0 to n_dates[group] - 1.

    Methods are fitted on the first 80 % of a group's dates and compared by Brier score on the others; the best one (the earlier of equals) is
    fitted again on all. Groups with fewer rows or dates shrink.
    """
    rows = rows.select("group", "place", _p("p").alias("p"), F.col("y").cast("double").alias("y"), _times(rows).alias("n"))
    split = {g: max(10, min(n - 10, int(n * 0.80))) for g, n in n_dates.items()}
    cut = F.element_at(F.create_map(*(F.lit(x) for g, s in split.items() for x in (g, s))), F.col("group"))
    size = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    wide = [g for g in n_dates if size.get(g, 0) >= least_rows and n_dates[g] >= least_dates]
    parts = rows.withColumn("part", F.explode(F.when(F.col("group").isin(wide) & (F.col("place") < cut), F.array(F.lit("early"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    parts = parts.withColumn("group", F.concat("part", F.lit(":"), "group")).drop("part")
    fitted = fit_calibrators(parts, methods)
    best: dict[str, str] = {g: "shrinkage" for g in n_dates}
    if wide:
        late = rows.filter(F.col("group").isin(wide) & (F.col("place") >= cut))
        tried = parameter_table(rows.sparkSession, [(g, m, p) for g in wide for m, p in fitted.get(f"early:{g}", {}).items()])
        loss: dict[str, list] = {}
        for r in calibrated(late, tried).groupBy("group", "method").agg((F.sum(F.col("n") * (F.col("q") - F.col("y")) ** 2) / F.sum("n")).alias("loss")).collect():
            loss.setdefault(r["group"], []).append((r["loss"], methods.index(r["method"]), r["method"]))
        best |= {g: min(known)[2] for g, known in loss.items()}
    out = {}
    for g in n_dates:
        own = fitted.get(f"all:{g}")
        if own is None:
            out[g] = ("identity", ())
        else:
            method = best[g] if best[g] in own else ("shrinkage" if "shrinkage" in own else next(iter(own)))
            out[g] = (method, own[method])
    return out


# ---- direction models ----


def nested_scores(df: DataFrame, names: list[str], y: str, weight: str, date: str, purge: int = 7, methods: tuple[str, ...] = METHODS, least_dates: int = 240, before: int = 120) -> DataFrame | None:
    """model, window, calibrator, brier, baseline, skill: each model is calibrated before each of three inner windows and judged on it.

    None with fewer than `least_dates` dates or fewer than two windows. Rows of one date that a model gives the same probability and that
    have the same outcome are one row with their number and weight before windows are made of them.
    """
    spark = df.sparkSession
    placed, n = with_places(df, date)
    windows = inner_windows(n, min(80, max(60, n // 6)), max(1, purge), before)
    if n < least_dates or len(windows) < 2:
        return None
    long = placed.filter(F.col(y).isNotNull()).select(
        "place", F.col(y).cast("double").alias("y"), F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.col(weight).cast("double"), F.lit(1.0))).alias("w"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("model"), _p(m).alias("p")) for m in names))).alias("m")).select("place", "y", "w", "m.*")
    long = long.groupBy("place", "model", "p", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    ranges = F.array(*(F.struct(F.lit(i).alias("window"), F.lit(t[0][1]).alias("until"), F.lit(t[1][0]).alias("first"), F.lit(t[1][1]).alias("last")) for i, t in enumerate(windows)))
    at = F.col("place")
    long = long.withColumn("r", F.explode(F.filter(ranges, lambda r: (at < r["until"]) | ((at >= r["first"]) & (at < r["last"])))))
    long = long.select("place", "y", "n", "w", "p", "model", F.col("r.window").alias("window"), (at < F.col("r.until")).alias("train"), F.concat_ws("|", F.col("r.window").cast("string"), "model").alias("group"))
    with stored(long) as rows:
        train = rows.filter("train")
        counts = {i: t[0][1] for i, t in enumerate(windows)}
        chosen = choose_calibrators(train, {f"{i}|{m}": counts[i] for i in counts for m in names}, methods)
        judged = calibrated(rows.filter("not train"), parameter_table(spark, [(g, *c) for g, c in chosen.items()]))
        y_, w_ = F.col("y"), F.col("w")
        found = judged.groupBy("model", "window").agg((F.sum(w_ * (F.col("q") - y_) ** 2) / F.sum(w_)).alias("brier"), (F.sum(w_ * y_ * y_) / F.sum(w_) - (F.sum(w_ * y_) / F.sum(w_)) ** 2).alias("baseline")).collect()
    out = [(r["model"], r["window"], chosen[f"{r['window']}|{r['model']}"][0], r["brier"], r["baseline"], (r["baseline"] - r["brier"]) / r["baseline"] if r["baseline"] > 0 else 0.0) for r in found]
    return spark.createDataFrame(out, "model string, window int, calibrator string, brier double, baseline double, skill double")


def champions(scores: DataFrame, least_models: int = 3) -> DataFrame:
    """model, mean_skill, positive_windows, windows, selected: skilled on average and in two thirds of the windows (two at least).

    With fewer than `least_models` such models only the best one is selected, as an ensemble of two would only dilute it.
    """
    every = W.partitionBy()  # one row a model
    g = scores.groupBy("model").agg(F.avg("skill").alias("mean_skill"), F.count_if(F.col("skill") > 0).alias("positive_windows"), F.count("*").alias("windows"))
    g = g.withColumn("able", (F.col("mean_skill") > 0) & (F.col("positive_windows") >= F.greatest(F.lit(2), F.ceil(F.max("windows").over(every) * 2 / 3 - F.lit(1e-9)))))
    place = F.row_number().over(every.orderBy(F.desc("able"), F.desc(F.round("mean_skill", 7)), F.desc("positive_windows"), "model"))
    return g.withColumn("selected", F.when(F.sum(F.col("able").cast("int")).over(every) >= least_models, F.col("able")).otherwise(place == 1)).drop("able")
