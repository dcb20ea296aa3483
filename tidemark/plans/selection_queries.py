"""Queries on the selection layer: feature gates, calibrators, direction models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boosting, committee, method_weights, metrics, panel, trainer
from tidemark.operators import selection as op
from tidemark.plans.learner_queries import D, SCORES
from tidemark.plans.panel_queries import PANEL_SQL
from tidemark.plans.registry import PREDICTIONS_SQL, query, r, r6
from tidemark.sources import tables
from tidemark.sources.stored import stored

FACTORS = list(panel.FACTORS)
MODELS = ["m1", "m2", "m3", "m4", "m5"]
FAMILIES = {"trend": {"momentum_5", "momentum_20", "trend_gap_20", "trend_gap_60", "macd_hist_pct"}, "flow": {"vwap_gap", "volume_ratio_20"}, "risk": {"volatility_10", "atr_pct_14", "range_position_20"}, "candle": {"candle_body_pressure", "close_location"}}
PROFILES = {"compact": {"momentum_5", "momentum_20", "trend_gap_20", "volume_ratio_20", "volatility_10", "range_position_20", "atr_pct_14", "close_location"}, "enriched": set(FACTORS)}


def _training(spark, sf_dir):
    d = panel.factor_panel(tables.bars(spark, sf_dir)).withColumn("up", (F.col("label") > 0).cast("double"))
    return op.with_places(d, "day")


def _psi(i: int, a: str, b: str) -> str:
    """PSI of every factor between two ranges of places, by the boundaries of the first."""
    return f"""e{i} AS (SELECT factor, value AS v, CASE WHEN {a} THEN 0 ELSE 1 END AS side FROM lg, nd WHERE ({a} OR {b}) AND value IS NOT NULL),
o{i} AS (SELECT factor, v, row_number() OVER (PARTITION BY factor ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY factor) AS c FROM e{i} WHERE side = 0),
b{i} AS (SELECT factor, list_sort(list(v)) AS bd FROM (SELECT factor, q, min(v) AS v FROM o{i}, range(1, 10) t(q) WHERE i = c * q // 10 GROUP BY factor, q) GROUP BY factor),
h{i} AS (SELECT e.factor, side, len([x FOR x IN bd IF x < v]) AS bin, count(*) AS c FROM e{i} e JOIN b{i} USING (factor) GROUP BY ALL),
g{i} AS (SELECT f.factor, f.bin, greatest(1e-4, coalesce(p.c, 0) / sum(p.c) OVER (PARTITION BY f.factor)) AS p, greatest(1e-4, coalesce(q.c, 0) / sum(q.c) OVER (PARTITION BY f.factor)) AS q
  FROM (SELECT factor, bin FROM b{i}, range(0, 10) t(bin)) f LEFT JOIN h{i} p ON p.factor = f.factor AND p.bin = f.bin AND p.side = 0 LEFT JOIN h{i} q ON q.factor = f.factor AND q.bin = f.bin AND q.side = 1),
s{i} AS (SELECT factor, sum((q - p) * ln(q / p)) AS psi FROM g{i} GROUP BY factor)"""


def _stability_sql() -> str:
    edge = lambda k: f"round_even(n * {k} / 4.0, 0)"
    spans = [("0", "sp"), ("sp", "n")], [(edge(0), edge(1)), (edge(1), edge(2))], [(edge(1), edge(2)), (edge(2), edge(3))], [(edge(2), edge(3)), (edge(3), edge(4))]
    inside = lambda s: f"place >= {s[0]} AND place < {s[1]}"
    parts = ",\n".join(_psi(i, *map(inside, s)) for i, s in enumerate(spans))
    return f"""{PANEL_SQL}, pl AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS place FROM panel), lg AS (SELECT place, factor, value FROM pl UNPIVOT (value FOR factor IN ({', '.join(FACTORS)}))),
nd AS (SELECT max(place) + 1 AS n, greatest(40, least(max(place) + 1 - 40, floor((max(place) + 1) * 0.70))) AS sp FROM pl),
{parts}, wp AS (SELECT factor, max(psi) AS psi FROM ({' UNION ALL '.join(f'SELECT * FROM s{i}' for i in range(4))}) GROUP BY factor),
k AS (SELECT *, sum(CAST(psi < 0.25 AS INT)) OVER () AS steady, row_number() OVER (ORDER BY psi, factor) AS pl FROM wp)"""


@query(f"WITH {_stability_sql()} SELECT factor AS feature, {r('psi')}, CASE WHEN steady >= 8 THEN psi < 0.25 ELSE pl <= 8 END AS kept FROM k")
def feature_stability_gate(spark, sf_dir):
    d, n = _training(spark, sf_dir)
    return op.stable_features(op.stability(d, FACTORS, n)).select("feature", r6("psi"), "kept")


@query()
def feature_family_gate(spark, sf_dir):
    """Families of factors left out one by one and judged on the last training dates; a test compares the fits with a direct loop."""
    d, n = _training(spark, sf_dir)
    with stored(op.packed(d, FACTORS, "up")) as rows:
        kept, found = op.family_gate(rows, FACTORS, n, FAMILIES)
    return spark.createDataFrame([(r["family"], r["removed"], float(r["full_brier"]), float(r["brier"]), float(r["full_accuracy"]), float(r["accuracy"]), bool(r["excluded"]), len(kept)) for r in found], "family string, removed int, full_brier double, brier double, full_accuracy double, accuracy double, excluded boolean, kept int")


@query()
def feature_profile_gate(spark, sf_dir):
    """Profiles of factors fitted before three inner windows and judged on them; a test compares with a direct loop."""
    d, n = _training(spark, sf_dir)
    with stored(op.packed(d, FACTORS, "up")) as rows:
        chosen, found = op.profile_gate(rows, FACTORS, n, PROFILES)
    return spark.createDataFrame([(r["profile"], r["features"], *(float(r[c]) for c in ("brier", "skill", "balanced_accuracy", "f1")), int(r["negative_windows"]), float(r["score"]), r["profile"] == chosen) for r in found], "profile string, features int, brier double, skill double, balanced_accuracy double, f1 double, negative_windows int, score double, selected boolean")


@query()
def feature_family_ablation(spark, sf_dir):
    """What each family of factors adds on the last tenth of the dates."""
    d, n = _training(spark, sf_dir)
    with stored(op.packed(d, FACTORS, "up")) as rows:
        found = op.family_ablation(rows, FACTORS, n, FAMILIES, first_test=int(n * 0.9), purge=8)
    return spark.createDataFrame([(r["name"], r["features"], r["rows"], *(float(r[c]) for c in ("brier", "skill", "balanced_accuracy", "brier_delta", "accuracy_delta"))) for r in found], "without string, features int, rows int, brier double, skill double, balanced_accuracy double, brier_delta double, accuracy_delta double")


def _models(spark, sf_dir):
    return tables.predictions(spark, sf_dir).selectExpr("*", *(f"{SCORES[m]} AS `{m}`" for m in MODELS))


def _shrunk_sql() -> str:
    sums = lambda name, condition: f"""{name}s AS (SELECT w, m, count(*) AS n, sum(y) AS sy, sum(p) AS sp, sum(p * p) AS spp, sum(p * y) AS spy, sum(y * y) AS syy, count(DISTINCT place) AS dates FROM x WHERE {condition} GROUP BY w, m),
{name}q AS (SELECT *, greatest(0.001, least(0.999, sy / n)) AS pr, least(1, greatest(0.10, dates / 120.0::DOUBLE)) AS cap FROM {name}s),
{name}a AS (SELECT w, m, pr, arg_min(t, (n * pr * pr - 2 * pr * sy + syy) + 2 * t * (pr * sp - n * pr * pr - spy + pr * sy) + t * t * (spp - 2 * pr * sp + n * pr * pr)) AS al FROM (SELECT *, cap * st / 20.0::DOUBLE AS t FROM {name}q, range(0, 21) g(st)) GROUP BY w, m, pr)"""  # noqa: E731
    shrunk = lambda a: f"greatest(0.001, least(0.999, {a}.pr + {a}.al * (p - {a}.pr)))"
    return f"""{D}, pl AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS place FROM d), nd AS (SELECT max(place) + 1 AS n FROM pl),
wn AS (SELECT w, n, CAST(least(80, greatest(60, n // 6)) AS BIGINT) AS sz FROM nd, range(0, 3) g(w)), wd AS (SELECT w, n - (3 - w) * sz - 7 AS te, n - (3 - w) * sz AS s, n - (2 - w) * sz AS e FROM wn),
cu AS (SELECT *, greatest(10, least(te - 10, floor(te * 0.8))) AS cut FROM wd WHERE te >= 120),
x AS (SELECT w, te, s, e, cut, place, u.m AS m, greatest(0.001, least(0.999, coalesce(u.p, 0.5))) AS p, y, wt FROM (SELECT place, actual::DOUBLE AS y, greatest(0.05, weight) AS wt, unnest([{', '.join(f"{{'m': '{m}', 'p': {m}}}" for m in MODELS)}]) AS u FROM pl) JOIN cu ON place < te OR (place >= s AND place < e)),
{sums('early', 'place < cut')}, {sums('every', 'place < te')},
late AS (SELECT x.w, x.m, avg((p - y) * (p - y)) AS plain, avg(({shrunk('a')} - y) * ({shrunk('a')} - y)) AS drawn FROM x JOIN earlya a ON a.w = x.w AND a.m = x.m WHERE place >= cut AND place < te GROUP BY ALL),
jd AS (SELECT x.w, x.m, l.drawn < l.plain AS sh, y, wt, CASE WHEN l.drawn < l.plain THEN {shrunk('a')} ELSE p END AS q FROM x JOIN everya a ON a.w = x.w AND a.m = x.m JOIN late l ON l.w = x.w AND l.m = x.m WHERE place >= s AND place < e),
sc AS (SELECT w, m, CASE WHEN sh THEN 'shrinkage' ELSE 'identity' END AS calibrator, sum(wt * (q - y) * (q - y)) / sum(wt) AS brier, sum(wt * y * y) / sum(wt) - (sum(wt * y) / sum(wt)) * (sum(wt * y) / sum(wt)) AS baseline FROM jd GROUP BY ALL)"""


@query(f"WITH {_shrunk_sql()} SELECT m AS model, CAST(w AS INT) AS \"window\", calibrator, {r('brier', 'baseline', skill='(baseline - brier) / baseline')} FROM sc")
def shrinkage_windows(spark, sf_dir):
    """Models left as they are or shrunk to the base rate, whatever does better on later training dates, judged on three inner windows."""
    out = op.nested_scores(_models(spark, sf_dir), MODELS, "actual", "weight", "day", methods=("identity", "shrinkage"))
    return out.select("model", "window", "calibrator", r6("brier"), r6("baseline"), r6("skill"))


@query(f"""WITH {_shrunk_sql()}, g AS (SELECT m AS model, avg((baseline - brier) / baseline) AS mean_skill, count(*) FILTER (WHERE brier < baseline) AS positive_windows, count(*) AS windows FROM sc GROUP BY m),
ab AS (SELECT *, mean_skill > 0 AND positive_windows >= greatest(2, ceil(max(windows) OVER () * 2 / 3.0)) AS able FROM g),
k AS (SELECT *, sum(CAST(able AS INT)) OVER () AS na, row_number() OVER (ORDER BY able DESC, round(mean_skill, 7) DESC, positive_windows DESC, model) AS pl FROM ab)
SELECT model, {r('mean_skill')}, positive_windows, windows, CASE WHEN na >= 3 THEN able ELSE pl = 1 END AS selected FROM k""")
def direction_champions(spark, sf_dir):
    """Which direction models an ensemble may use, or the single best one, by shrunk scores on inner windows."""
    scores = op.nested_scores(_models(spark, sf_dir), MODELS, "actual", "weight", "day", methods=("identity", "shrinkage"))
    return op.champions(scores).select("model", r6("mean_skill"), "positive_windows", "windows", "selected")


@query()
def direction_selection(spark, sf_dir):
    """As direction_champions with all four calibrators; a test compares the scores with a direct loop."""
    return op.champions(op.nested_scores(_models(spark, sf_dir), MODELS, "actual", "weight", "day"))


@query(f"""WITH {PREDICTIONS_SQL}, bl AS (SELECT row_number() OVER (ORDER BY day) - 1 AS pos, * FROM (SELECT day, count(*) AS n, sum(CAST((probability >= 0.5) = (actual = 1) AS INT)) AS hits, sum(actual) AS ups, sum((probability - actual) * (probability - actual)) AS loss, sum(actual_return) AS gain FROM predictions GROUP BY day)),
nb AS (SELECT count(*) AS nb FROM bl), dr AS (SELECT s, CAST('0x' || substr(md5('20260728:' || s || ':' || t), 1, 8) AS BIGINT) % nb AS pos FROM nb, range(0, 400) a(s), range(0, nb) b(t)),
sm AS (SELECT s, sum(n) AS n, sum(hits) AS hits, sum(ups) AS ups, sum(loss) AS loss, sum(gain) AS gain FROM dr JOIN bl USING (pos) GROUP BY s),
v AS (SELECT unnest([{{'k': 'accuracy', 'v': 100.0::DOUBLE * hits / n}}, {{'k': 'mean_return', 'v': gain / n}}, {{'k': 'brier_skill', 'v': 1 - (loss / n) / (ups::DOUBLE / n * (1 - ups::DOUBLE / n))}}]) AS x FROM sm),
o AS (SELECT x.k AS k, x.v AS v, row_number() OVER (PARTITION BY x.k ORDER BY x.v) - 1 AS i, count(*) OVER (PARTITION BY x.k) AS c FROM v)
SELECT k AS statistic, any_value(nb) AS blocks, count(*) AS samples, {r(low="max(v) FILTER (WHERE i = least(c - 1, floor(c * 0.025)))", high="max(v) FILTER (WHERE i = least(c - 1, floor(c * 0.975)))")} FROM o, nb GROUP BY k""")
def block_bootstrap(spark, sf_dir):
    """Intervals of accuracy, return and Brier skill from 400 resamples of whole dates."""
    d, a = tables.predictions(spark, sf_dir), F.col("actual")
    sums = {"n": F.lit(1), "hits": ((F.col("probability") >= 0.5) == (a == 1)).cast("int"), "ups": a, "loss": (F.col("probability") - a) * (F.col("probability") - a), "gain": F.col("actual_return")}
    rate = F.col("ups") / F.col("n")
    found = metrics.resampled_blocks(d, "day", sums, {"accuracy": 100 * F.col("hits") / F.col("n"), "mean_return": F.col("gain") / F.col("n"), "brier_skill": 1 - F.try_divide(F.col("loss") / F.col("n"), rate * (1 - rate))})
    return found.select("statistic", F.col("blocks").cast("long").alias("blocks"), "samples", r6("low"), r6("high"))


@query()
def gradient_trainer(spark, sf_dir):
    """Checkpoints of a linear model of all factors by accumulated mini-batches of dates; a test compares with a numpy run."""
    found = trainer.train(panel.factor_panel(tables.bars(spark, sf_dir)), FACTORS, "label", "day", horizon=5)
    best = max(found.checkpoints, key=lambda c: c["score"])
    return spark.createDataFrame([(c["epoch"], c["steps"], *(float(c[m]) for m in ("mae", "hit_rate", "ic", "score")), c is best, found.rollback, float(found.test["ic"])) for c in found.checkpoints], "epoch int, steps int, mae double, hit_rate double, ic double, score double, best boolean, rollback boolean, test_ic double")


SIGNALS = ["probability", "predicted_return", "weight", "l_tax", "l_extendedprice", "lift"]
ZOO = [
    committee.Candidate("stored", "column", ("predicted_return",)), committee.Candidate("technical_ridge", "ridge", ("probability", "predicted_return")), committee.Candidate("flow_ridge", "ridge", ("weight", "l_extendedprice")),
    committee.Candidate("wide_ridge", "ridge", tuple(SIGNALS), 0.2), committee.Candidate("target_stop", "target_stop", ("probability", "weight", "l_tax")), committee.Candidate("outside", "column", ("lift",), external=True),
]


def _committee(spark, sf_dir):
    d = tables.predictions(spark, sf_dir).withColumns({"days": F.col("horizon") * 5, "lift": F.col("probability") * 4 - 2, "resolved": F.date_add("day", F.col("horizon").cast("int") * 5)})
    return committee.train(d, "model", "days", "day", "actual_return", "actual", "stopped", SIGNALS, ZOO, resolved="resolved")


@query()
def committee_candidates(spark, sf_dir):
    """Weights and scores of the candidates of every market and horizon; a test compares with direct fits and planted regimes."""
    return _committee(spark, sf_dir).candidates


@query()
def committee_scopes(spark, sf_dir):
    """What each committee gains on its stored forecast, its stability, and the rows its gate accepts; a test compares with a loop."""
    return _committee(spark, sf_dir).scopes


def _method_weights(spark, sf_dir):
    d = tables.predictions(spark, sf_dir).withColumns({"days": F.col("horizon") * 5, "trend": F.col("predicted_return"), "level": F.col("probability") * 2 - 1, "near": F.col("l_tax") * 100 - 4, "size": F.col("weight") / 25 - 1, "resolved": F.date_add("day", F.col("horizon").cast("int") * 5)})
    return method_weights.calibrate(d, "model", "days", "day", "actual_return", ["trend", "level", "near", "size"], weight="weight", resolved="resolved")


@query()
def method_weights_learned(spark, sf_dir):
    """Weights of four forecasting methods in every market and horizon; a test compares with a numpy run."""
    return _method_weights(spark, sf_dir)[0]


@query()
def method_weights_stability(spark, sf_dir):
    """What the learned weights gain on equal ones, on the holdout and over folds; a test compares with a numpy run."""
    return _method_weights(spark, sf_dir)[1]


@query()
def boosted_scores(spark, sf_dir):
    """Quantile trees and a ranker of all factors, fitted on the first part of the dates and applied to the last; tests compare with direct trees."""
    d = panel.chronological_split(panel.factor_panel(tables.bars(spark, sf_dir)).withColumn("grade", F.when(F.col("label") > 20, 3).when(F.col("label") > 0, 2).when(F.col("label") > -20, 1).otherwise(0)), [], "day", gap=8)
    with stored(d.filter("part = 'train'")) as kept:
        made = {f"q{round(100 * a)}": boosting.boost(kept, FACTORS, "label", "quantile", alpha=a, trees=8) for a in (0.1, 0.5, 0.9)}
        made["rank_score"] = boosting.boost(kept, FACTORS, "grade", "rank", date="day", trees=8)
    test = d.filter("part = 'test'")
    return test.select("market", "symbol", "day", "label", *(m.score().alias(n) for n, m in made.items()))
