"""Queries on learners: out-of-fold scores, assembly, skill, pruning, ranking blends, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learners as op
from tidemark.operators import panel
from tidemark.plans.registry import PREDICTIONS_SQL, query, r, r6
from tidemark.sources import tables

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: Scores of several models, made from the prediction rows.
SCORES = {
    "m1": "probability", "m2": "1 - probability", "m3": "0.3 + 0.4 * actual", "m4": "weight / 50", "m5": "0.9 * probability + 0.05", "target_score": "probability", "stop_score": "(50 - weight) / 50", "timeout_score": "0.4", "low": "actual_return - 1", "middle": "predicted_return / 2", "high": "actual_return + 2", "rank_score": "predicted_return + horizon",
    "rank": "predicted_return", "direction": "weight", "target": "probability", "path_safety": "actual_return", "stop_safety": "l_tax", "median": "predicted_return - weight", "return": "l_extendedprice", "liquidity": "l_quantity",
}
D = f"{PREDICTIONS_SQL}, d AS (SELECT *, " + ", ".join(f'{e} AS "{n}"' for n, e in SCORES.items()) + " FROM predictions)"


def _rows(spark, sf_dir):
    return tables.predictions(spark, sf_dir).selectExpr("*", *(f"{e} AS `{n}`" for n, e in SCORES.items()))


@query(f"""WITH {D}, q AS (SELECT *, list_sort([low, middle, high]) AS q, greatest(1e-6, least(1, target_score)) AS t, greatest(1e-6, least(1, stop_score)) AS s, 0.4::DOUBLE AS o FROM d),
b AS (SELECT *, CASE WHEN 0.5 <= q[1] THEN 0.1 WHEN 0.5 <= q[2] THEN 0.1 + (0.5 - q[1]) / greatest(1e-9, q[2] - q[1]) * 0.4 WHEN 0.5 <= q[3] THEN 0.5 + (0.5 - q[2]) / greatest(1e-9, q[3] - q[2]) * 0.4 ELSE 0.9 END AS below,
  (rank() OVER (PARTITION BY day ORDER BY rank_score) + (count(*) OVER (PARTITION BY day, rank_score) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY day) AS pr FROM q)
SELECT {', '.join(ID)}, {r(p_target='t / (t + s + o)', p_stop='s / (t + s + o)', p_timeout='o / (t + s + o)', p_quantile='1 - below', p_rank='pr')} FROM b""")
def fold_assembly(spark, sf_dir):
    out = op.assemble(_rows(spark, sf_dir), ["day"], "target_score", "stop_score", "timeout_score", "rank_score", "low", "middle", "high", 0.5)
    return out.select(*ID, *map(r6, ("p_target", "p_stop", "p_timeout", "p_quantile", "p_rank")))


def _brier(m: str) -> str:
    return f"sum(weight * (greatest(0.001, least(0.999, {m})) - actual) * (greatest(0.001, least(0.999, {m})) - actual)) / sum(weight)"


@query(f"""WITH {D}, s AS (SELECT sum(weight * actual) / sum(weight) - (sum(weight * actual) / sum(weight)) * (sum(weight * actual) / sum(weight)) AS base, unnest([{', '.join(f"{{'m': '{m}', 'b': {_brier(m)}}}" for m in ('m1', 'm2', 'm3', 'm4', 'm5'))}]) AS x FROM d)
SELECT x.m AS model, {r(baseline='base', brier='x.b')}, x.b <= base + 1e-9 AS kept FROM s""")
def model_skill(spark, sf_dir):
    return op.model_skill(_rows(spark, sf_dir), ["m1", "m2", "m3", "m4", "m5"], "actual", "weight").select("model", r6("baseline"), r6("brier"), "kept")


@query()
def model_pruning(spark, sf_dir):
    """Models that stay and go by the correlation of their residuals; a test compares with a direct loop."""
    kept, dropped = op.prune(_rows(spark, sf_dir), ["m1", "m2", "m3", "m4", "m5"], "actual", "weight")
    return spark.createDataFrame([(n, True, None, None) for n in kept] + [(n, False, why, c) for n, why, c in dropped], "model string, kept boolean, because string, correlation double")


def _blend_sql() -> str:
    parts = sorted({c for b in op.BLENDS.values() for c in b})
    place = lambda c: f'CASE WHEN count(*) OVER (PARTITION BY day) > 1 THEN (rank() OVER (PARTITION BY day ORDER BY "{c}") - 1 + (count(*) OVER (PARTITION BY day, "{c}") - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY day) - 1) ELSE 0.5 END AS "pct_{c}"'
    blends = ", ".join(f"{{'blend': '{n}', 'score': " + " + ".join(f'"pct_{c}" * {v / sum(b.values())}::DOUBLE' for c, v in b.items()) + "}" for n, b in op.BLENDS.items())
    return f"""{D}, pc AS (SELECT *, {', '.join(map(place, parts))} FROM d), u AS (SELECT day, actual_return, actual, {', '.join(ID)}, unnest([{blends}]) AS x FROM pc),
k AS (SELECT *, x.blend AS blend, row_number() OVER (PARTITION BY x.blend, day ORDER BY round(x.score, 9) DESC, {', '.join(ID)}) AS pl, count(*) OVER (PARTITION BY x.blend, day) AS n FROM u),
g AS (SELECT blend, 100 * avg(actual) FILTER (WHERE pl <= 10) AS td, avg(actual_return) FILTER (WHERE pl <= ceil(n * 0.1)) AS tr, avg(actual_return) FILTER (WHERE pl <= ceil(n * 0.1)) - avg(actual_return) AS li FROM k GROUP BY blend),
h AS (SELECT g.*, g.td - b.td AS dg, g.tr - b.tr AS rg, g.li - b.li AS lg, (g.td - 50) * 0.2 + g.li * 1.5 + g.tr * 0.5 AS ob FROM g, g b WHERE b.blend = 'rank-only'),
a AS (SELECT *, blend = 'rank-only' OR (dg >= 0.5 AND rg >= -0.02 AND lg >= -0.02) OR (rg >= 0.05 AND dg >= 0 AND lg >= 0.03) AS ok FROM h)"""


@query(f"WITH {_blend_sql()} SELECT blend, ok AS admissible, row_number() OVER (ORDER BY ok DESC, round(ob, 9) DESC, blend) = 1 AS selected, {r(top_direction_pct='td', top_return='tr', lift='li', objective='ob')} FROM a")
def ranking_blends(spark, sf_dir):
    parts = sorted({c for b in op.BLENDS.values() for c in b})
    d = op.percentiles(_rows(spark, sf_dir), "day", parts)
    return op.blend_metrics(d, "day", "actual_return", "actual", ID).select("blend", "admissible", "selected", *map(r6, ("top_direction_pct", "top_return", "lift", "objective")))


def _chosen_sql() -> str:
    days = f"WITH {D}, dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM d)), pt AS (SELECT day, CASE WHEN i >= floor(n * 0.8) THEN 'test' WHEN i >= floor(n * 0.6) AND i < floor(n * 0.8) - 5 THEN 'inner' END AS part FROM dd)"
    side = lambda part: "(WITH " + _blend_sql().replace(D, f"dx AS (SELECT d.* FROM d JOIN pt ON pt.day = d.day WHERE part = '{part}')", 1).replace("FROM d)", "FROM dx)") + " SELECT * FROM a)"
    return f"""{days} SELECT i.blend, i.ok AS admissible, row_number() OVER (ORDER BY i.ok DESC, round(i.ob, 9) DESC, i.blend) = 1 AS selected, {r(top_direction_pct='i.td', lift='i.li', objective='i.ob', test_top_direction_pct='t.td', test_top_return='t.tr', test_lift='t.li')}
FROM {side('inner')} i LEFT JOIN {side('test')} t ON t.blend = i.blend"""


@query(_chosen_sql())
def ranking_choice(spark, sf_dir):
    """The blend chosen on an inner block of dates, and what every blend does on the dates after a purge."""
    parts = sorted({c for b in op.BLENDS.values() for c in b})
    rows = op.inner_block(_rows(spark, sf_dir), "day")
    out = op.blends_of_parts(op.percentiles(rows, "day", parts), "day", "actual_return", "actual", ID)
    return out.select("blend", "admissible", "selected", *map(r6, ("top_direction_pct", "lift", "objective", "test_top_direction_pct", "test_top_return", "test_lift")))


def _training(spark, sf_dir):
    factors = ("momentum_5", "momentum_20", "volume_ratio_20", "volatility_10", "range_position_20", "close_location")
    d = panel.factor_panel(tables.bars(spark, sf_dir), factors=factors)
    d = d.withColumns({"up": (F.col("label") > 0).cast("double"), "path": F.when(F.col("label") >= 3, 0.0).when(F.col("label") <= -3, 1.0).otherwise(2.0)})
    return d, list(factors)


@query()
def oof_scores(spark, sf_dir):
    """Purged out-of-fold scores of all base learners; a test holds them against planted signals."""
    d, factors = _training(spark, sf_dir)
    folds = op.for_fits(panel.walk_forward(d, "day", folds=2, purge=8), ["symbol", "day", "fold"])  # every fit reads it
    return op.out_of_fold(folds, factors, op.BASE).select("symbol", "day", "fold", "label", *(c for n in op.BASE for c in ([f"{n}_{i}" for i in range(3)] if n == "outcome" else [n])))


@query()
def risk_scores(spark, sf_dir):
    """Probability that an accepted signal is false, learned on the first part of the dates, and the lowered scores of the last; a test checks that none is raised."""
    d, factors = _training(spark, sf_dir)
    d = panel.chronological_split(d.withColumn("score", 1 / (1 + F.exp(-F.col("momentum_5") / 5))), [], "day", gap=8)
    out = op.risk_head(d.filter("part = 'train'"), d.filter("part = 'test'"), factors, "score", "up")
    return out.select("symbol", "day", "score", "risk", "adjusted")
