"""Committees of many small models by market and horizon: candidates, simplex weights, stability over time, abstention.

A scope is a market with all horizons or one bucket of them. Each scope's dates are cut into tenths of its rows, and models
only ever see tenths before those they are judged on. All scopes, windows and candidates are fitted together: one pass sums the
Gram matrices of all tenths (from which every ridge model of every window follows), a few more are the Newton steps of all
logistic models, and one writes the candidates' predictions, from which the rest is aggregates. What reaches the driver has the
size of the models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, horizon_bucket
from tidemark.operators.models import capped_minimum
from tidemark.operators.selection import totals
from tidemark.sources.stored import stored

W = Window
LEAST_ROWS = 32
SLICES = 10
#: Windows of the committee: models see tenths 0 to 5, weights 6 and 7, judgement 8 and 9 (purged); folds are the tenths from 5.
MAIN, VALID, TEST, FOLDS = 6, (6, 7), (8, 9), (5, 6, 7, 8, 9)
WINDOWS = (5, 6, 7, 8, 9)
LIMIT, Y_LIMIT = 18.0, 24.0
PENALTIES = (0.02, 0.06, 0.14, 0.28)
EXTERNAL_EACH, EXTERNAL_ALL = 0.08, 0.12


@dataclass(frozen=True)
class Candidate:
    """One model of a committee: a column of the rows, a ridge model of the return, or two logistic models (target, stop) made a return."""

    name: str
    kind: str
    columns: tuple[str, ...]
    penalty: float = 0.12
    external: bool = False


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    intercept: float
    centre: np.ndarray
    scale: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + (x - self.centre) / self.scale @ self.weights


def _by_scope(df: DataFrame, market: str, horizon: str, day: str, least: int, slices: int) -> tuple[DataFrame, DataFrame]:
    """(rows by scope, dates: a row for each scope and date with its tenth)."""
    both = F.array(F.lit("all"), horizon_bucket(F.col(horizon)))
    d = df.filter(F.col(day).isNotNull()).withColumn("scope", F.explode(F.transform(both, lambda b: F.concat_ws("|", F.col(market), b))))
    dates = d.groupBy("scope", day).agg(F.count("*").alias("n_"))
    by = W.partitionBy("scope")  # one row a date
    dates = dates.withColumns({"total_": F.sum("n_").over(by), "before_": F.sum("n_").over(by.orderBy(day)) - F.col("n_")})
    return d, dates.filter(F.col("total_") >= least).select("scope", day, F.floor(F.col("before_") * slices / F.col("total_")).cast("int").alias("tenth"))


def scoped(df: DataFrame, market: str, horizon: str, day: str, least: int = LEAST_ROWS, slices: int = SLICES) -> DataFrame:
    """Rows by scope ("market|all" and "market|short", mid or long) with `tenth`, the tenth (or other slice) of the scope's rows that the date begins in.

    A date lies in one tenth as a whole. Scopes with fewer than `least` rows are left out.
    """
    d, dates = _by_scope(df, market, horizon, day, least, slices)
    return d.join(F.broadcast(dates), ["scope", day])  # one row a scope and date


def learnable(df: DataFrame, market: str, horizon: str, day: str, resolved: str | None, least: int = LEAST_ROWS, slices: int = SLICES) -> DataFrame:
    """scoped() rows with `learn`: false where the outcome (`resolved`) is not known before the next tenth begins, so that nothing learns from them.

    The tenths' first dates come from the table of dates, so the rows themselves are neither shuffled nor read again for them.
    """
    if resolved is None:
        return scoped(df, market, horizon, day, least, slices).withColumn("learn", F.lit(True))
    d, dates = _by_scope(df, market, horizon, day, least, slices)
    starts = dates.groupBy("scope", "tenth").agg(F.min(day).alias("next_")).withColumn("tenth", F.col("tenth") - 1)
    rows = d.join(F.broadcast(dates.join(starts, ["scope", "tenth"], "left")), ["scope", day])  # one row a scope and date
    return rows.withColumn("learn", F.coalesce(F.col(resolved) < F.col("next_"), F.lit(True))).drop("next_")


def places(scopes: list[str]) -> Column:
    """The number of a row's scope."""
    return (F.array_position(F.array(*map(F.lit, scopes)), F.col("scope")) - 1 if scopes else F.lit(0)).cast("int")


def gram_matrices(rows: DataFrame, n_scopes: int, k: int) -> np.ndarray:
    """[scope, tenth]: sums of products of (1, features, y) over the rows that may be learned from."""
    size = k + 2

    def sums(scope, tenth, learn, y, x):
        out = np.zeros((n_scopes * SLICES, size, size))
        z = np.column_stack([np.ones(len(y)), x, y])
        at = scope * SLICES + tenth
        for g in np.unique(at[learn]):
            own = z[(at == g) & learn]
            out[g] = own.T @ own
        return out.ravel()

    return totals(rows, sums, n_scopes * SLICES * size * size, ("at", "tenth", "learn", "y", "x")).reshape(n_scopes, SLICES, size, size)


def moments(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of the features in a Gram matrix of (1, features, y)."""
    n = max(gram[0, 0], 1.0)
    centre = gram[0, 1:-1] / n
    scale = np.sqrt(np.maximum(np.diag(gram)[1:-1] / n - centre**2, 0))
    return centre, np.where(scale > 1e-9 * (1 + np.abs(centre)), scale, 1.0)


def ridge(gram: np.ndarray, used: np.ndarray, penalty: float) -> Linear:
    """The minimum of mean squared error + penalty |weights|^2 over the used, standardised features."""
    n = max(gram[0, 0], 1.0)
    centre, scale = moments(gram)
    mean = gram[0, -1] / n
    cov = (gram[1:-1, 1:-1] / n - np.outer(centre, centre)) / np.outer(scale, scale)
    with_y = (gram[1:-1, -1] / n - centre * mean) / scale
    weights = np.zeros(len(centre))
    at = np.flatnonzero(used)
    weights[at] = np.linalg.solve(cov[np.ix_(at, at)] + penalty * np.eye(len(at)), with_y[at])
    return Linear(weights, float(mean), centre, scale)


#: Rows that are equal in all that a logistic model reads are one row with their number where that leaves at most this share of them.
COUNTED = 0.25


def logistic_models(rows: DataFrame, label: str, grams: np.ndarray, used: np.ndarray, penalty: float, rounds: int = 12) -> dict[tuple[int, int], Linear]:
    """(scope, window) -> the minimum of mean logistic loss + penalty |weights|^2 over the tenths before the window, by Newton steps of all at once.

    Steps read equal rows once, with their number, where many are equal.
    """
    own = F.array(*(F.col("x")[int(i)] for i in np.flatnonzero(used)))
    own = rows.filter("learn").select("at", "tenth", F.col(label).cast("double").alias("label_"), own.alias("x"))
    n, different = own.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*own.columns))).first()
    if different > COUNTED * n:
        return _newton(own.withColumn("n", F.lit(1.0)), grams, used, penalty, rounds)
    with stored(own.groupBy(*own.columns).agg(F.count("*").cast("double").alias("n"))) as counted:
        return _newton(counted, grams, used, penalty, rounds)


def _newton(rows: DataFrame, grams: np.ndarray, used: np.ndarray, penalty: float, rounds: int) -> dict[tuple[int, int], Linear]:
    n_scopes, cols = len(grams), np.flatnonzero(used)
    k, keys = len(cols), [(s, w) for s in range(n_scopes) for w in WINDOWS]
    before = {(s, w): grams[s, :w].sum(0) for s, w in keys}
    shape = {key: moments(g) for key, g in before.items()}
    n = {key: max(g[0, 0], 1.0) for key, g in before.items()}
    now = {key: np.zeros(k + 1) for key in keys}
    size = (k + 1) * (k + 2)
    going = set(keys)
    for _ in range(rounds):
        if not going:
            break
        asked, level = sorted(going), dict(now)

        def sums(scope, tenth, times, y, x):
            out = np.zeros((len(asked), size))
            for i, (s, w) in enumerate(asked):
                here = (scope == s) & (tenth < w)
                if here.any():
                    centre, scale = shape[s, w]
                    z, u = np.column_stack([np.ones(here.sum()), (x[here] - centre[cols]) / scale[cols]]), times[here]
                    p = 1 / (1 + np.exp(-np.clip(z @ level[s, w], -30, 30)))
                    out[i] = [*(z.T @ (u * (p - y[here]))), *((z * (u * p * (1 - p))[:, None]).T @ z).ravel()]
            return out.ravel()

        found = totals(rows, sums, len(asked) * size, ("at", "tenth", "n", "label_", "x")).reshape(len(asked), size)
        ridge_ = 2 * penalty * np.diag([0.0] + [1.0] * k)
        for key, s in zip(asked, found, strict=True):
            slope, bend = s[: k + 1] / n[key] + ridge_ @ now[key], s[k + 1 :].reshape(k + 1, k + 1) / n[key] + ridge_ + 1e-9 * np.eye(k + 1)
            step = np.linalg.solve(bend, slope)
            step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            now[key] = np.clip(now[key] - step, -20, 20)
            if np.abs(step).max() < 1e-8:
                going.discard(key)
    out = {}
    for key, b in now.items():
        weights = np.zeros(len(used))
        weights[cols] = b[1:]
        out[key] = Linear(weights, float(b[0]), *shape[key])
    return out


def expected_return(target: np.ndarray, stop: np.ndarray, upside: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """What chances of target and stop are worth (fixed values)."""
    upside, loss = np.maximum(0.5, upside), np.maximum(0.8, np.abs(loss))
    return (target - 0.5) * upside * 2.25 - np.maximum(0.0, stop - 0.35) * loss * 1.35 + (target - stop) * 0.8


def predicted(rows: DataFrame, candidates: list[Candidate], linear: dict, logistic: dict) -> DataFrame:
    """Rows from the first fold on with main (predictions of models before tenth MAIN; from MAIN on) and fold (of models before the row's tenth)."""

    def one(c: int, keys: list[tuple[int, int]], at, x, given, upside, loss) -> np.ndarray:
        """Predictions of candidate c; keys: (scope, window) to use, at: which of them each row takes."""
        kind = candidates[c].kind
        if kind == "column":
            return np.clip(given[:, c], -LIMIT, LIMIT)
        out = np.zeros(len(x))
        for i, key in enumerate(keys):
            here = at == i
            if kind == "ridge":
                out[here] = linear[c, *key].raw(x[here])
            else:
                chance = [1 / (1 + np.exp(-np.clip(logistic[c, side][key].raw(x[here]), -30, 30))) for side in ("target", "stop")]
                out[here] = expected_return(*chance, upside[here], loss[here])
        return np.clip(out, -LIMIT, LIMIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda n: batch.column(n).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            scope, tenth, upside, loss = (get(n) for n in ("at", "tenth", "upside", "loss"))
            x, given = (batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in ("x", "given"))
            sides = []
            for window in (np.full(len(scope), MAIN), tenth):
                code, at = np.unique(scope * 100 + window, return_inverse=True)
                keys = [(int(v) // 100, int(v) % 100) for v in code]
                sides.append(np.column_stack([one(c, keys, at, x, given, upside, loss) for c in range(len(candidates))]))
            arrays = [pa.array(list(s), pa.list_(pa.float64())) for s in sides]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("scope", "tenth", "y", "target")), *arrays], names=["scope", "tenth", "y", "target", "main", "fold"])

    return rows.filter(F.col("tenth") >= FOLDS[0]).select("scope", "at", "tenth", "y", "target", "upside", "loss", "x", "given").mapInArrow(run, "scope string, tenth int, y double, target double, main array<double>, fold array<double>")


def _scores(p: Column, y: Column, target: Column) -> list[Column]:
    hit = (p >= 0) == (y >= 0)
    return [F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("mse"), F.avg(F.abs(p - y)).alias("mae"), (100 * F.avg(hit.cast("double"))).alias("hit_rate"), (100 * F.avg(F.when(p > 0.15, target))).alias("target_precision")]


def by_candidate(scored: DataFrame, column: str, names: list[str], *by: str) -> DataFrame:
    """One row a scope, `by` and candidate with its scores."""
    long = scored.select("scope", *by, "y", "target", F.posexplode(column).alias("i", "p"))
    return long.groupBy("scope", *by, "i").agg(*_scores(F.col("p"), F.col("y"), F.col("target"))).withColumn("candidate", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)).drop("i")


def stability(scored: DataFrame, names: list[str]) -> DataFrame:
    """scope, candidate, folds, mean gain over the first candidate in error and hit rate, and whether it is stable: in half of two or more folds at least."""
    each = by_candidate(scored, "fold", names, "tenth")
    base = each.filter(F.col("candidate") == names[0]).select("scope", "tenth", F.col("mse").alias("mse_"), F.col("hit_rate").alias("hit_"))
    d = each.filter(F.col("candidate") != names[0]).join(base, ["scope", "tenth"])
    gain, lift = F.coalesce(100 * F.try_divide(F.col("mse_") - F.col("mse"), F.nullif("mse_", F.lit(0.0))), F.lit(0.0)), F.col("hit_rate") - F.col("hit_")
    g = d.groupBy("scope", "candidate").agg(F.count("*").alias("folds"), F.avg(gain).alias("gain"), F.avg(lift).alias("lift"), F.avg((gain >= 0).cast("double")).alias("g_"), F.avg((lift >= 0).cast("double")).alias("l_"))
    stable = (F.col("folds") >= 2) & (F.col("g_") >= 0.5) & (F.col("l_") >= 0.5) & ((F.col("gain") >= 0) | (F.col("lift") >= 1.0))
    return g.withColumn("stable", stable).drop("g_", "l_")


def stability_score(stable: DataFrame) -> DataFrame:
    """scope, stability (0 to 100) and whether the committee may be used: two stable candidates or more and a score of 56."""
    kept, n = F.col("stable"), F.count_if("stable")
    mean = lambda c: F.coalesce(F.avg(F.when(kept, F.col(c))), F.lit(0.0))
    folds = F.max("folds")
    score = clamp(42 + F.least(F.lit(22), n * 7) + clamp(mean("gain"), -10.0, 14.0) * 1.1 + clamp(mean("lift"), -6.0, 10.0) * 1.7 + F.least(F.lit(10.0), folds * 2.5), 0.0, 100.0)
    return stable.groupBy("scope").agg(score.alias("stability"), ((folds >= 2) & (n >= 2) & (score >= 56)).alias("stable"))


def capped_external(weights: np.ndarray, external: list[bool]) -> np.ndarray:
    """Weights of which external models hold EXTERNAL_EACH at most, and EXTERNAL_ALL together; the others share the rest."""
    weights, out = weights / weights.sum(), np.array(external)
    if not (out & (weights > 0)).any() or out.all():
        return weights
    weights = np.where(out, np.minimum(weights, EXTERNAL_EACH), weights)
    weights[out] *= min(1.0, EXTERNAL_ALL / max(1e-12, weights[out].sum()))
    inner = weights[~out].sum()
    weights[~out] = weights[~out] / inner * (1 - weights[out].sum()) if inner > 0 else (1 - weights[out].sum()) / (~out).sum()
    return weights / weights.sum()


def blended(scored: DataFrame, weights: list[tuple[str, str, list[float]]]) -> DataFrame:
    """scored with p and dispersion of each weighting: (scope, name, weights) rows, a row of output for each name."""
    table = scored.sparkSession.createDataFrame(weights, "scope string, name string, weights array<double>")
    d = scored.join(F.broadcast(table), "scope")  # a few rows a scope
    add = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("p", add(F.zip_with("main", "weights", lambda v, w: v * w)))
    return d.withColumn("dispersion", F.sqrt(F.greatest(F.lit(0.0), add(F.zip_with("main", "weights", lambda v, w: (v - F.col("p")) * (v - F.col("p")) * w)))))


@dataclass
class Committee:
    """Tables of a row each: candidates (scope, candidate, weight, scores on test, folds), scopes (choices, gains, gate)."""

    candidates: DataFrame
    scopes: DataFrame


def train(df: DataFrame, market: str, horizon: str, day: str, y: str, target: str, stop: str, features: list[str], candidates: list[Candidate], resolved: str | None = None, upside: str | None = None, loss: str | None = None, least: int = LEAST_ROWS) -> Committee:
    """Committees of all scopes. candidates[0] is the stored forecast that the others are compared with.

    Weights are the exact minimum of mean squared error + penalty |w - prior|^2 on the simplex over the validation tenths, for the penalty with the
    smallest error less a hundredth of the hit rate there. The gate refuses rows where the candidates disagree beyond a quantile of the test rows.
    """
    spark, names, k = df.sparkSession, [c.name for c in candidates], len(features)
    number = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c else F.lit(default)
    rows = learnable(df.filter(F.col(y).isNotNull()), market, horizon, day, resolved, least).select(
        "scope", "tenth", "learn", clamp(F.col(y).cast("double"), -Y_LIMIT, Y_LIMIT).alias("y"), number(target, 0.0).alias("target"), number(stop, 0.0).alias("stop"), number(upside, 5.0).alias("upside"), number(loss, 4.0).alias("loss"),
        F.array(*(number(c, 0.0) for c in features)).alias("x"), F.array(*(number(c.columns[0], 0.0) if c.kind == "column" else F.lit(0.0) for c in candidates)).alias("given"))
    with stored(rows) as kept:
        scopes = [r.scope for r in kept.select("scope").distinct().orderBy("scope").collect()]  # a few a market
        kept = kept.withColumn("at", places(scopes))
        grams = gram_matrices(kept, len(scopes), k)
        used = {i: np.array([f in c.columns for f in features]) for i, c in enumerate(candidates)}
        linear = {(i, s, w): ridge(grams[s, :w].sum(0), used[i], c.penalty) for i, c in enumerate(candidates) if c.kind == "ridge" for s in range(len(scopes)) for w in WINDOWS}
        logistic = {(i, side): logistic_models(kept, side, grams, used[i], c.penalty) for i, c in enumerate(candidates) if c.kind == "target_stop" for side in ("target", "stop")}
        with stored(predicted(kept, candidates, linear, logistic)) as scored:
            return _judged(spark, scored, scopes, names, candidates)


def _judged(spark, scored: DataFrame, scopes: list[str], names: list[str], candidates: list[Candidate]) -> Committee:
    k = len(names)
    found = stability(scored, names)
    known = found.collect()  # a row a scope and candidate
    stable = {(r.scope, r.candidate): r for r in known}
    whole = {r.scope: r for r in stability_score(spark.createDataFrame(known, found.schema)).collect()}
    valid, test = scored.filter(F.col("tenth").isin(*VALID)), scored.filter(F.col("tenth").isin(*TEST))
    shown = {(r.scope, r.candidate): r for r in by_candidate(test, "main", names).collect()}
    hits = {(r.scope, r.candidate): r.hit_rate for r in by_candidate(valid, "main", names).collect()}
    place = {s: i for i, s in enumerate(scopes)}

    def products(at, y, p):
        out = np.zeros((len(scopes), k + 1, k + 2))
        for s in np.unique(at):
            z = np.column_stack([p[at == s], y[at == s]])
            out[s] = np.column_stack([z.T @ z, np.full(k + 1, len(z))])
        return out.ravel()

    sums = totals(valid.withColumn("at", places(scopes)), products, len(scopes) * (k + 1) * (k + 2), ("at", "y", "main")).reshape(len(scopes), k + 1, k + 2)
    tried, priors, choice = [], {}, {}
    for s in scopes:
        g, n = sums[place[s]], max(1.0, sums[place[s], 0, -1])
        prior = np.array([0.18 if i == 0 else max(0.04, (hits.get((s, c)) or 50.0) / 100) for i, c in enumerate(names)])
        prior /= prior.sum()
        for penalty in PENALTIES:
            w = capped_minimum(2 * (g[:k, :k] / n + penalty * np.eye(k)), 2 * (g[:k, k] / n + penalty * prior), 1.0)
            tried.append((s, str(penalty), np.maximum(w, 0).tolist()))
    if tried:
        for r in blended(valid, tried).groupBy("scope", "name").agg(*_scores(F.col("p"), F.col("y"), F.col("target"))).collect():
            choice.setdefault(r.scope, []).append((r.mse - 0.01 * r.hit_rate, float(r.name), r.hit_rate))
    weights = {s: capped_external(np.array(w), [c.external for c in candidates]) for s, name, w in tried if s in choice and float(name) == min(choice[s])[1]}
    sets = [(s, n, v) for s, w in weights.items() for n, v in (("selected", w.tolist()), ("equal", [1 / k] * k), ("stored", [1.0] + [0.0] * (k - 1)))]
    mixes = {(r.scope, r.name): r for r in blended(test, sets).groupBy("scope", "name").agg(*_scores(F.col("p"), F.col("y"), F.col("target"))).collect()} if sets else {}
    gates = {r.scope: r for r in reject_gate(blended(test, [x for x in sets if x[1] == "selected"])).collect()} if sets else {}
    rows, about = [], []
    for s, w in weights.items():
        if (s, "selected") not in mixes:
            continue
        best, equal, base, g = mixes[s, "selected"], mixes[s, "equal"], mixes[s, "stored"], gates[s]
        gain = lambda other: 100 * (other.mse - best.mse) / other.mse if other.mse > 0 else 0.0  # noqa: B023, E731
        penalty, hit = min(choice[s])[1:]
        better = gain(equal) >= 1 or gain(base) >= 1 or best.hit_rate - equal.hit_rate >= 3 or best.hit_rate - base.hit_rate >= 3
        active = hit >= 48 and better and best.hit_rate >= max(48, min(equal.hit_rate, base.hit_rate) - 1.5) and bool(whole[s].stable)
        about.append((s, best.n, penalty, best.mse, best.hit_rate, gain(equal), gain(base), float(whole[s].stability), bool(whole[s].stable), g.threshold, g.accepted, g.accepted_hit_rate, active))
        for i, c in enumerate(names):
            own, t = shown[s, c], stable.get((s, c))
            rows.append((s, c, float(w[i]), own.mse, own.hit_rate, own.target_precision, t.folds if t else None, t.gain if t else None, t.lift if t else None, t.stable if t else None))
    return Committee(
        spark.createDataFrame(rows, "scope string, candidate string, weight double, mse double, hit_rate double, target_precision double, folds long, gain double, lift double, stable boolean"),
        spark.createDataFrame(about, "scope string, rows long, penalty double, mse double, hit_rate double, gain_on_equal double, gain_on_stored double, stability double, stable boolean, threshold double, accepted long, accepted_hit_rate double, active boolean"))


def reject_gate(blend: DataFrame) -> DataFrame:
    """scope, threshold, accepted and its hit rate: rows whose dispersion lies within the 72nd percentile (0.75 at least), or the 85th where that leaves too few."""
    cuts = blend.groupBy("scope").agg(F.count("*").alias("n_"), F.percentile("dispersion", F.array(F.lit(0.72), F.lit(0.85))).alias("q_")).withColumn("first_", F.greatest(F.lit(0.75), F.col("q_")[0]))
    d = blend.join(cuts, "scope")
    few = d.groupBy("scope").agg((F.count_if(F.col("dispersion") <= F.col("first_")) < F.greatest(F.lit(4), F.floor(F.max("n_") * 0.35))).alias("few_"))
    d = d.join(few, "scope").withColumn("threshold", F.when(F.col("few_"), F.col("q_")[1]).otherwise(F.col("first_")))
    ok = F.col("dispersion") <= F.col("threshold")
    hit = ((F.col("p") >= 0) == (F.col("y") >= 0)).cast("double")
    return d.groupBy("scope").agg(F.max("threshold").alias("threshold"), F.count_if(ok).alias("accepted"), (100 * F.avg(F.when(ok, hit))).alias("accepted_hit_rate"))
