"""Queries on cross-sections and factor research."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import panel as op
from tidemark.plans.indicator_queries import ALPHA_SQL
from tidemark.plans.registry import BARS_SQL, query, r, r6
from tidemark.sources import tables

W = "PARTITION BY symbol ORDER BY day"
FACTORS = op.FACTORS
PANEL_SQL = f"""{ALPHA_SQL}, pn AS (SELECT market, symbol, sector, day, {', '.join(FACTORS)}, (lead(close, 5) OVER ({W}) / close - 1) * 100 AS label, row_number() OVER ({W}) AS rn FROM alpha), panel AS (SELECT * EXCLUDE (rn) FROM pn WHERE rn > 60 AND label IS NOT NULL)"""
LONG_SQL = f"{PANEL_SQL}, long AS (SELECT market, symbol, sector, day, label, factor, value FROM panel UNPIVOT (value FOR factor IN ({', '.join(FACTORS)})))"


def _panel(spark, sf_dir):
    return op.factor_panel(tables.bars(spark, sf_dir), factors=FACTORS)


def _long(spark, sf_dir):
    return op.long_form(_panel(spark, sf_dir), FACTORS)


def _rank(c: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY day) > 1 THEN (row_number() OVER (PARTITION BY day ORDER BY {c}, symbol) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY day) - 1) ELSE 0.5 END"


@query(f"WITH {PANEL_SQL} SELECT symbol, day, {r(rank_momentum_5=_rank('momentum_5') + ' * 2 - 1', rank_vwap_gap=_rank('vwap_gap') + ' * 2 - 1', return_rank=_rank('label'), breadth='avg(CAST(label > 0 AS INT)) OVER (PARTITION BY day)')} FROM panel")
def cross_section_ranks(spark, sf_dir):
    out = op.cross_ranks(_panel(spark, sf_dir), ["momentum_5", "vwap_gap"])
    return out.select("symbol", "day", r6("rank_momentum_5"), r6("rank_vwap_gap"), r6("return_rank"), r6("breadth"))


@query(f"WITH {PANEL_SQL}, k AS (SELECT symbol, day, {_rank('label')} AS rk, CASE WHEN label > 20 THEN 3 WHEN label > 0 THEN 2 WHEN label > -20 THEN 1 ELSE 0 END AS g FROM panel) SELECT symbol, day, {r(relevance='3 * g + 2 * rk')} FROM k")
def rank_relevance(spark, sf_dir):
    grade = F.when(F.col("label") > 20, 3).when(F.col("label") > 0, 2).when(F.col("label") > -20, 1).otherwise(0)
    d = op.cross_ranks(_panel(spark, sf_dir), [])
    return d.select("symbol", "day", r6(op.rank_relevance(grade, F.col("return_rank")), "relevance"))


@query(f"""WITH {PANEL_SQL}, b AS (SELECT day, symbol, CAST(label > 0 AS INT) AS y, volume_ratio_20 AS w FROM panel), t AS (SELECT sum(w * y) / sum(w) AS rate FROM b), mass AS (SELECT day, sum(w) AS mass FROM b GROUP BY day), med AS (SELECT quantile_cont(mass, 0.5) AS md FROM mass)
SELECT b.day, b.symbol, {r(balanced='w * least(2, 0.5 / greatest(1e-9, CASE WHEN y = 1 THEN rate ELSE 1 - rate END)) * least(4, greatest(0.25, md / greatest(1e-9, mass)))')} FROM b JOIN mass ON b.day = mass.day, t, med""")
def date_balance_weights(spark, sf_dir):
    d = _panel(spark, sf_dir).select("day", "symbol", (F.col("label") > 0).cast("int").alias("y"), F.col("volume_ratio_20").alias("w"))
    return op.balance_weights(d, "day", "y", "w").select("day", "symbol", r6("balanced"))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT market, day, dense_rank() OVER (PARTITION BY market ORDER BY day) AS p FROM panel), dn AS (SELECT *, max(p) OVER (PARTITION BY market) AS n FROM d),
s AS (SELECT market, day, CASE WHEN p <= floor(n * 0.6) - 5 THEN 'train' WHEN p <= floor(n * 0.6) THEN NULL WHEN p <= floor(n * 0.8) - 5 THEN 'validation' WHEN p <= floor(n * 0.8) THEN NULL ELSE 'test' END AS part FROM dn)
SELECT market, part, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM s WHERE part IS NOT NULL GROUP BY ALL""")
def chronological_split(spark, sf_dir):
    out = op.chronological_split(_panel(spark, sf_dir), ["market"], "day")
    return out.groupBy("market", "part").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


WF_SQL = f"""{PANEL_SQL}, dt AS (SELECT day, row_number() OVER (ORDER BY day) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM panel)), fd AS (SELECT day, p, fold, floor(n * 0.5) + (fold - 1) * floor((n - floor(n * 0.5)) / 5) AS b, floor((n - floor(n * 0.5)) / 5) AS k FROM dt, range(1, 6) f(fold)),
fold AS (SELECT day, CAST(fold AS INT) AS fold, CASE WHEN p <= b - 8 THEN 'train' WHEN p > b AND p <= b + k THEN 'test' END AS part FROM fd), wf AS (SELECT panel.*, fold, part FROM panel JOIN fold ON panel.day = fold.day WHERE part IS NOT NULL)"""


@query(f"WITH {WF_SQL} SELECT fold, part, count(*) AS n, min(day) AS first_day, max(day) AS last_day, {r(ic='corr(momentum_5, label)')} FROM wf GROUP BY ALL")
def walk_forward_folds(spark, sf_dir):
    out = op.walk_forward(_panel(spark, sf_dir), "day")
    return out.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), r6(op.pearson(F.col("momentum_5"), F.col("label")), "ic"))


IC_SQL = f"""{LONG_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY factor, day ORDER BY value) + (count(*) OVER (PARTITION BY factor, day, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY factor, day ORDER BY label) + (count(*) OVER (PARTITION BY factor, day, label) - 1) / 2.0::DOUBLE AS b,
  count(*) OVER (PARTITION BY factor, day) AS n, row_number() OVER (PARTITION BY factor, day ORDER BY value, symbol) AS lo FROM long),
daily AS (SELECT factor, day, max(n) AS symbols, coalesce(covar_pop(value, label) / nullif(sqrt(var_pop(value) * var_pop(label)), 0), 0) AS ic, coalesce(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 0) AS rank_ic,
  CASE WHEN max(n) >= 20 THEN avg(label) FILTER (WHERE lo > n - n // 5) - avg(label) FILTER (WHERE lo <= n // 5) END AS spread FROM rk WHERE n >= 8 GROUP BY factor, day)"""


@query(f"WITH {IC_SQL} SELECT factor, day, symbols, {r('ic', 'rank_ic', spread='coalesce(spread, 0)')} FROM daily")
def factor_daily_ic(spark, sf_dir):
    return op.daily_ic(_long(spark, sf_dir)).select("factor", "day", "symbols", r6("ic"), r6("rank_ic"), r6(F.coalesce("spread", F.lit(0.0)), "spread"))


SUMMARY_SQL = f"""{IC_SQL}, sm AS (SELECT factor, count(*) AS dates, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(rank_ic) / stddev_samp(rank_ic) AS icir, avg(spread) AS spread, avg(CAST(rank_ic > 1e-9 AS INT)) AS up FROM daily GROUP BY factor),
sc AS (SELECT *, CASE WHEN rank_ic >= 0 THEN up ELSE 1 - up END AS stability FROM sm),
ev AS (SELECT *, least(40, abs(rank_ic) / 0.05 * 40) + least(1, greatest(0, (stability - 0.5) / 0.2)) * 25 + least(20, abs(coalesce(icir, 0)) / 0.4 * 20) + least(15, abs(coalesce(spread, 0)) / 1.0 * 15) AS evidence FROM sc)"""


@query(f"WITH {SUMMARY_SQL} SELECT factor, dates, {r('ic', 'rank_ic', 'icir', 'spread', 'stability', 'evidence')}, evidence >= 55 AND stability >= 0.55 AS admitted FROM ev")
def factor_summary(spark, sf_dir):
    out = op.evidence_score(op.ic_summary(op.daily_ic(_long(spark, sf_dir))))
    return out.select("factor", "dates", *map(r6, ("ic", "rank_ic", "icir", "spread", "stability", "evidence")), "admitted")


@query(f"""WITH {SUMMARY_SQL}, x AS (SELECT factor, evidence, avg(evidence) OVER () AS m, stddev_pop(evidence) OVER () AS s FROM ev), ex AS (SELECT *, exp(least(8, greatest(-8, (evidence - m) / greatest(4, CASE WHEN s > 0 THEN s ELSE 6 END)))) AS e FROM x)
SELECT factor, {r(weight='e / sum(e) OVER ()')} FROM ex""")
def factor_weights(spark, sf_dir):
    out = op.evidence_score(op.ic_summary(op.daily_ic(_long(spark, sf_dir))))
    return op.softmax_weights(out, [], "evidence").select("factor", r6("weight"))


@query(f"""WITH {LONG_SQL}, d AS (SELECT factor, count(*) OVER w AS n, value - avg(value) OVER w AS v, label - avg(label) OVER w AS y FROM long WINDOW w AS (PARTITION BY factor, day, sector))
SELECT factor, count(*) AS n, {r(neutral_ic='corr(v, y)')} FROM d WHERE n >= 2 GROUP BY factor""")
def factor_sector_neutral_ic(spark, sf_dir):
    return op.sector_neutral_ic(_long(spark, sf_dir)).select("factor", "n", r6("neutral_ic"))


@query(f"""WITH {LONG_SQL}, q AS (SELECT factor, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM long GROUP BY factor),
g AS (SELECT l.factor, count(*) AS n, count(DISTINCT round(value + 0, 8))::DOUBLE / count(*) AS richness, count_if(abs(value - m) > 8 * greatest((b - a) / 1.349, 1e-9))::DOUBLE / count(*) AS outliers, stddev_pop(value) AS sd FROM long l JOIN q ON l.factor = q.factor GROUP BY l.factor)
SELECT factor, n, {r('outliers')}, round(richness, 2) AS richness, richness >= 0.12 AND outliers <= 0.06 AND sd > 1e-9 AS passed FROM g""")
def factor_quality_gate(spark, sf_dir):
    return op.quality_gate(_long(spark, sf_dir)).select("factor", "n", r6("outliers"), F.round("richness", 2).alias("richness"), "passed")


@query("WITH " + PANEL_SQL + " " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(correlation=f'corr({a}, {b})')} FROM panel" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]))
def factor_correlations(spark, sf_dir):
    return op.correlations(_panel(spark, sf_dir), FACTORS).select("left", "right", r6("correlation"))


@query("WITH " + PANEL_SQL + " " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(avg({a} * {b}) + 1e-9, 4) + 0 AS value FROM panel" for i, a in enumerate(FACTORS) for b in FACTORS[i:]))
def factor_gram(spark, sf_dir):
    return op.gram(_panel(spark, sf_dir), FACTORS).select("left", "right", r6("value", digits=4))


@query("WITH " + PANEL_SQL + ", corrs AS (" + " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, corr({x}, {y}) AS co FROM panel" for i, x in enumerate(FACTORS) for j, y in enumerate(FACTORS) if i < j) + f"""),
near_ AS (SELECT a, b FROM corrs WHERE abs(co) >= 0.72 UNION SELECT b, a FROM corrs WHERE abs(co) >= 0.72), names_ AS (SELECT unnest(range({len(FACTORS)})) AS i, unnest([{', '.join(f"'{x}'" for x in FACTORS)}]) AS factor),
reach AS (SELECT i, i AS j FROM names_ UNION SELECT reach.i, near_.b FROM reach JOIN near_ ON reach.j = near_.a), least_ AS (SELECT i, min(j) AS first FROM reach GROUP BY i)
SELECT factor, (dense_rank() OVER (ORDER BY first) - 1)::INT AS cluster FROM least_ JOIN names_ ON least_.i = names_.i""")
def factor_clusters(spark, sf_dir):
    """Cluster of each factor by correlation."""
    found = op.clusters(op.correlations(_panel(spark, sf_dir), FACTORS), FACTORS)
    return spark.createDataFrame(list(found.items()), "factor string, cluster int")


@query()
def factor_ridge(spark, sf_dir):
    """Ridge coefficients; compared with numpy in the tests."""
    return spark.createDataFrame(list(op.ridge(_panel(spark, sf_dir), FACTORS).items()), "factor string, coefficient double")


@query(f"WITH {LONG_SQL}, s AS (SELECT factor, value, abs(value - lag(value) OVER (PARTITION BY factor, symbol ORDER BY day)) AS st FROM long) SELECT factor, {r(turnover='avg(st) / stddev_pop(value)')} FROM s GROUP BY factor")
def factor_turnover(spark, sf_dir):
    return op.turnover(_long(spark, sf_dir)).select("factor", r6("turnover"))


@query(f"""WITH {LONG_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY factor, symbol ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY factor, symbol) AS n FROM long),
w AS (SELECT factor, symbol, k AS "window", value, label FROM a, range(0, 200) t(k) WHERE pos >= k * 20 AND pos < k * 20 + 60 AND k * 20 + 60 <= n)
SELECT factor, symbol, CAST("window" AS INT) AS "window", {r(ic='coalesce(covar_pop(value, label) / nullif(sqrt(var_pop(value) * var_pop(label)), 0), 0)')} FROM w GROUP BY ALL""")
def factor_rolling_ic(spark, sf_dir):
    return op.rolling_ic(_long(spark, sf_dir)).select("factor", "symbol", "window", r6("ic"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT market, symbol, sector, day, (close / lag(close, 10) OVER ({W}) - 1) * 100 AS momentum, (lead(close, 3) OVER ({W}) / close - 1) * 100 AS label FROM bars)
SELECT symbol, day, {r('momentum', 'label')} FROM x WHERE momentum IS NOT NULL AND label IS NOT NULL""")
def momentum_labels(spark, sf_dir):
    return op.momentum_label(tables.bars(spark, sf_dir), 10, 3).select("symbol", "day", r6("momentum"), r6("label"))
