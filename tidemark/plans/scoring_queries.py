"""Queries on scores, gates, registries and formulaic alphas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alpha, panel, portfolio
from tidemark.operators import scoring as op
from tidemark.plans.indicator_queries import ALPHA_SQL
from tidemark.plans.registry import BARS_SQL, PREDICTIONS_SQL, query, r, r6
from tidemark.sources import tables

P = f"WITH {PREDICTIONS_SQL}, d AS (SELECT *, actual = 1 AS target, stopped = 1 AS stop, probability >= 0.45 AS buy, weight / 50 AS w, 0.5 + probability / 2 AS confidence FROM predictions)"


def _predictions(spark, sf_dir):
    return tables.predictions(spark, sf_dir).withColumns({"predicted": F.col("predicted_return"), "p_target": F.col("probability"), "target": F.col("actual") == 1, "stop": F.col("stopped") == 1, "buy": F.col("probability") >= 0.45, "weight": F.col("weight") / 50, "confidence": 0.5 + F.col("probability") / 2}).withColumn("actual", F.col("actual_return"))


@query(f"""{P} SELECT horizon, count(*) AS samples, count_if(buy)::BIGINT AS buy_signals, count_if(buy AND confidence >= 0.78 AND w >= 0.72)::BIGINT AS sure_samples,
  {r(effective_samples='sum(w)', direction_hit_pct='100 * sum(w * CAST((predicted_return >= 0) = (actual_return >= 0) AS INT)) / sum(w)', target_hit_pct='100 * sum(w * CAST(target AS INT)) FILTER (WHERE buy) / sum(w) FILTER (WHERE buy)', stop_pct='100 * sum(w * CAST(stop AS INT)) FILTER (WHERE buy) / sum(w) FILTER (WHERE buy)', sure_target_pct='100 * sum(w * CAST(target AS INT)) FILTER (WHERE buy AND confidence >= 0.78 AND w >= 0.72) / sum(w) FILTER (WHERE buy AND confidence >= 0.78 AND w >= 0.72)', rejected_stop_pct='100 * sum(w * CAST(stop AS INT)) FILTER (WHERE NOT buy) / sum(w) FILTER (WHERE NOT buy)', mean_return='sum(w * actual_return) FILTER (WHERE buy) / sum(w) FILTER (WHERE buy)', brier='sum(w * (probability - CAST(target AS INT)) * (probability - CAST(target AS INT))) / sum(w)', low_quality_pct='100 * avg(CAST(w < 0.55 AS INT))')} FROM d GROUP BY horizon""")
def prediction_summary(spark, sf_dir):
    out = op.summarize(_predictions(spark, sf_dir), ["horizon"])
    return out.select("horizon", "samples", "buy_signals", "sure_samples", *map(r6, ("effective_samples", "direction_hit_pct", "target_hit_pct", "stop_pct", "sure_target_pct", "rejected_stop_pct", "mean_return", "brier", "low_quality_pct")))


@query(f"{P}, g AS (SELECT horizon, count(*) AS samples, 100 * avg(CAST(target AS INT)) AS h, 100 * avg(CAST(stop AS INT)) AS s, avg(actual_return) AS m FROM d GROUP BY horizon) SELECT horizon, samples, {r(score='greatest(-10, least(10, (h - 52) / 4 + m * 0.18 - s * 0.035))')} FROM g")
def calibration_score(spark, sf_dir):
    return op.calibration_score(_predictions(spark, sf_dir), ["horizon"]).select("horizon", "samples", r6("score"))


@query(f"""WITH {BARS_SQL}, t AS (SELECT symbol, day, greatest(-9, least(9, (close / open - 1) * 100)) AS rt FROM bars), e AS (SELECT *, sum(rt) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS e FROM t),
k AS (SELECT *, e - greatest(0, max(e) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)) AS dd FROM e), g AS (SELECT symbol, count(*) AS trades, avg(rt) AS m, 100 * avg(CAST(rt > 0 AS INT)) AS w, min(dd) AS dd FROM k GROUP BY symbol)
SELECT symbol, trades, {r(score='m * 3.4 + (w - 50) * 0.18 + least(12, trades * 0.35) + dd * 0.45', max_drawdown='dd')} FROM g""")
def strategy_replay(spark, sf_dir):
    rt = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), (F.col("close") / F.col("open") - 1) * 100))
    out = op.replay_score(tables.bars(spark, sf_dir).select("symbol", "day", rt.alias("ret")), ["symbol"], "day", "ret")
    return out.select("symbol", "trades", r6("score"), r6("max_drawdown"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 50 AS symbol, (o_orderkey % 97) / 97.0::DOUBLE AS rl, (o_custkey % 89) / 89.0::DOUBLE AS inf, (o_orderkey % 11) / 11.0::DOUBLE AS va, (o_orderkey % 7) / 7.0::DOUBLE AS tr, (o_orderkey % 5) / 5.0::DOUBLE AS ma, (o_orderkey % 3) - 1.0::DOUBLE AS se, o_orderkey % 80 AS age FROM orders),
i AS (SELECT *, rl * 0.36 + inf * 0.28 + va * 0.18 + tr * 0.16 - ma * 0.18 AS impact FROM s), f AS (SELECT * FROM i WHERE age <= CASE WHEN impact >= 0.6 THEN 72 WHEN impact >= 0.35 THEN 24 ELSE 12 END),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY impact DESC, id) AS k FROM f) SELECT symbol, id, """ + r("impact", score="se * impact * tr - greatest(0, ma - 0.6) * 0.5") + " FROM k WHERE k <= 10")
def social_scores(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = tables.table(spark, sf_dir, "orders").select(k.alias("id"), (c % 50).alias("symbol"), ((k % 97) / 97.0).alias("relevance"), ((c % 89) / 89.0).alias("influence"), ((k % 11) / 11.0).alias("validity"), ((k % 7) / 7.0).alias("truth"), ((k % 5) / 5.0).alias("manipulation"), ((k % 3) - 1.0).alias("sentiment"), (k % 80).alias("age_hours"))
    return op.social_scores(d, ["symbol"]).select("symbol", "id", r6("impact"), r6("score"))


@query(f"""{P}, m AS (SELECT day, horizon AS model, avg(predicted_return) AS up, avg(confidence) * 100 AS cf, 100 * avg(actual) AS dh, 100 * avg(CAST(target AS INT)) AS sh, count(*) AS n FROM d GROUP BY day, horizon), a AS (SELECT *, 0.1 * model * CASE WHEN n >= 5 THEN greatest(0.45, least(1.35, 0.76 + (dh - 50) * 0.012 + (sh - 50) * 0.009 + least(0.12, n * 0.004))) ELSE 1 END AS w FROM m WHERE n >= 2),
b AS (SELECT *, avg(CAST(up >= 0 AS INT)) OVER (PARTITION BY day) AS sh2 FROM a), c AS (SELECT *, greatest(sh2, 1 - sh2) AS ag, w * CASE WHEN greatest(sh2, 1 - sh2) >= 0.55 AND (up >= 0) = (sh2 >= 0.5) THEN 1.08 ELSE 1 END AS w2 FROM b)
SELECT day, count(*) AS models, {r(upside='sum(w2 * up) / sum(w2)', agreement='max(ag)', confidence='sum(w2 * cf) / sum(w2) - CASE WHEN max(ag) < 0.55 THEN 6 ELSE 0 END')} FROM c GROUP BY day""")
def ensemble_forecast(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("hit", F.col("target").cast("double"))
    m = p.groupBy("day", F.col("horizon").alias("model")).agg(F.avg("predicted_return").alias("upside"), (F.avg("confidence") * 100).alias("confidence"), (100 * F.avg("hit")).alias("direction_hit_pct"), (100 * F.avg("hit")).alias("strategy_hit_pct"), F.count("*").alias("samples"))
    m = m.withColumns({"available": F.col("samples") >= 2, "base_weight": 0.1 * F.col("model")})
    return op.ensemble(m, ["day"]).select("day", "models", r6("upside"), r6("agreement"), r6("confidence"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), d AS (SELECT q.vec_id AS query, sqrt(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / 64) AS d FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 10 = 0),
g AS (SELECT query, list(d ORDER BY d) AS ds, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d) AS k FROM d) WHERE k <= 18 GROUP BY query), c AS (SELECT query, greatest(0, least(100, 104 - ds[1] * 24 - m * 31 - ds[CAST(floor((len(ds) - 1) * 0.75) AS INT) + 1] * 11 + least(8, log10((SELECT count(*) - 1 FROM e)) * 3.5))) AS c FROM g)
SELECT query, """ + r(coverage="c", coverage_weight="greatest(0.22, least(1, 0.22 + c * 0.0078))", ood_risk="1 - c / 100") + " FROM c")
def neighbour_coverage(spark, sf_dir):
    """Every tenth row against the 18 nearest of all other rows."""
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    near = portfolio.nearest(e, e.filter("id % 10 = 0"), 64)
    near = near.crossJoin(e.agg((F.count("*") - 1).alias("samples")))
    return op.neighbour_coverage(near, ["query"], "distance", "samples").select("query", r6("coverage"), r6("coverage_weight"), r6("ood_risk"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT market, symbol, day, volume AS w, close - open AS y FROM bars) SELECT market, count(*) AS row_count, count(DISTINCT symbol) AS symbols, count(DISTINCT day) AS dates, CAST(ceil(count(DISTINCT day) / 5) AS BIGINT) AS blocks, {r(effective_n='sum(w) * sum(w) / sum(w * w)', positive_share='avg(CAST(y > 0 AS INT))')} FROM x GROUP BY market""")
def dataset_profile(spark, sf_dir):
    d = tables.bars(spark, sf_dir).withColumns({"weight": F.col("volume"), "label": F.col("close") - F.col("open")})
    return op.dataset_profile(d, ["market"], "day", 5).select("market", "row_count", "symbols", "dates", "blocks", r6("effective_n"), r6("positive_share"))


@query(r"""WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Warrants' WHEN 1 THEN ' unit' ELSE '' END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'ETF' ELSE 'Stock' END AS kind FROM part)
SELECT p_partkey, NOT regexp_matches(name, '\b(warrants?|units?|rights?|preferred|preference|acquisition|spac|deferred|etf|etp|notes?|fund)\b', 'i') AND lower(kind) IN ('stock', 'common stock') AS eligible FROM p""")
def universe_eligibility(spark, sf_dir):
    k = F.col("p_partkey")
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(k % 4 == 0, " Warrants").when(k % 4 == 1, " unit").otherwise("")).alias("name"), F.when(k % 5 == 0, "ETF").otherwise("Stock").alias("kind"))
    return p.select("p_partkey", op.eligible(F.col("name"), F.col("kind")).alias("eligible"))


@query("""WITH t AS (SELECT c_custkey AS symbol FROM customer), a AS (SELECT DISTINCT o_custkey AS symbol FROM orders WHERE o_totalprice > 400000), b AS (SELECT DISTINCT o_custkey AS symbol FROM orders WHERE o_orderstatus = 'P')
SELECT 'large' AS gate, count(*) AS target, count(a.symbol) AS covered, """ + r(covered_pct="count(a.symbol) * 100.0::DOUBLE / count(*)") + """, count(a.symbol) * 100.0 / count(*) >= 80 AS passed FROM t LEFT JOIN a ON t.symbol = a.symbol
UNION ALL SELECT 'pending', count(*), count(b.symbol), """ + r(covered_pct="count(b.symbol) * 100.0::DOUBLE / count(*)") + """, count(b.symbol) * 100.0 / count(*) >= 99.9 FROM t LEFT JOIN b ON t.symbol = b.symbol""")
def readiness_gates(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "symbol")
    target = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"))
    out = op.readiness(target, {"large": o.filter("o_totalprice > 400000"), "pending": o.filter("o_orderstatus = 'P'")}, {"large": 80.0, "pending": 99.9})
    return out.select("gate", "target", "covered", r6("covered_pct"), "passed")


@query("""WITH k AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE k > 3 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def artifact_retention(spark, sf_dir):
    used = tables.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return op.retain(tables.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", 3, used, "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name, CASE WHEN c_custkey % 5 = 0 THEN 1.5::DOUBLE END AS bal FROM customer WHERE c_custkey % 4 < 2)
SELECT coalesce(e.id, n.id) AS id, coalesce(n.name, e.name, '-') AS name, coalesce(n.bal, e.bal, 0) AS bal FROM e FULL JOIN n ON e.id = n.id""")
def registry_upsert(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.filter("id % 4 < 2").select("id", F.when(F.col("id") % 2 == 0, "new").alias("name"), F.when(F.col("id") % 5 == 0, 1.5).alias("bal"))
    out = op.upsert_keeping(c.filter("id % 3 > 0"), new, ["id"])
    return out.select("id", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("bal", F.lit(0.0)).alias("bal"))


W60 = "PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING"


def _z(c: str) -> str:
    return f"greatest(-6, least(6, ({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END))"


@query(f"WITH {ALPHA_SQL} SELECT symbol, day, {r(mom_quality=_z('momentum_20') + ' - ' + _z('volatility_10'), gap_reversal='-' + _z('overnight_gap'), vwap_reclaim=_z('close_location') + ' - ' + _z('vwap_gap'), macd_volume_gate=_z('macd_hist_pct') + ' * ' + _z('volume_ratio_20'))} FROM alpha WINDOW w AS ({W60})")
def alpha_expressions(spark, sf_dir):
    names = ("mom_quality", "gap_reversal", "vwap_reclaim", "macd_volume_gate")
    base = panel.alpha_frame(tables.bars(spark, sf_dir))
    d = alpha.with_expressions(base, [alpha.SEEDS[n] for n in names])
    return d.select("symbol", "day", *(r6(alpha.name_of(alpha.SEEDS[n]), n) for n in names))


@query()
def alpha_evolution(spark, sf_dir):
    """Expressions after two generations of breeding, with their fitness; a test compares the statistics with a direct loop."""
    d = panel.chronological_split(panel.factor_panel(tables.bars(spark, sf_dir)), [], "day", gap=5)
    rows = alpha.evolve(d)
    return spark.createDataFrame(rows, "name string, expression string, ic double, rank_ic double, train_ic double, validation_ic double, test_ic double, test_ic_p double, stability double, positive_share double, losing_share double, max_overlap double, incremental double, gates int, overfit_penalty double, generalization double, overfit boolean, fitness double")
