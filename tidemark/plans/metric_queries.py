"""Queries on evaluation metrics, over the predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import correlation_p_value
from tidemark.functions.series import average_rank, pearson
from tidemark.operators import metrics as op
from tidemark.plans.registry import BARS_SQL, ORDER_SQL, PREDICTIONS_SQL, query, r, r6
from tidemark.sources import tables

P = f"WITH {PREDICTIONS_SQL}"
O_SQL = ORDER_SQL


def _p(spark, sf_dir):
    return tables.predictions(spark, sf_dir)


@query(f"""{P}, c AS (SELECT model, count_if(probability >= 0.5 AND actual = 1) AS tp, count_if(probability < 0.5 AND actual = 0) AS tn, count_if(probability >= 0.5 AND actual = 0) AS fp, count_if(probability < 0.5 AND actual = 1) AS fn FROM predictions GROUP BY model),
m AS (SELECT *, tp::DOUBLE / greatest(1, tp + fp) AS pr, tp::DOUBLE / greatest(1, tp + fn) AS rc, tn::DOUBLE / greatest(1, tn + fn) AS np, tn::DOUBLE / greatest(1, tn + fp) AS nr FROM c)
SELECT model, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, {r(precision='pr', recall='rc', f1='2 * pr * rc / greatest(1e-12, pr + rc)', accuracy='(tp + tn)::DOUBLE / (tp + tn + fp + fn)', balanced_accuracy='(rc + nr) / 2', macro_f1='(2 * pr * rc / greatest(1e-12, pr + rc) + 2 * np * nr / greatest(1e-12, np + nr)) / 2', mcc='(tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')} FROM m""")
def confusion_matrix(spark, sf_dir):
    return op.confusion(_p(spark, sf_dir), ["model"]).select("model", "tp", "tn", "fp", "fn", *map(r6, ("precision", "recall", "f1", "accuracy", "balanced_accuracy", "macro_f1", "mcc")))


BIN_SQL = "CAST(greatest(0, least(9, floor(probability * 10 + 1e-9))) AS INT)"


@query(f"""{P} SELECT model, {BIN_SQL} AS bin, count(*) AS n, {r(predicted='sum(weight * probability) / sum(weight)', observed='sum(weight * actual) / sum(weight)', error='abs(sum(weight * probability) / sum(weight) - sum(weight * actual) / sum(weight))')} FROM predictions GROUP BY ALL""")
def reliability_curve(spark, sf_dir):
    return op.reliability(_p(spark, sf_dir), ["model"], weight="weight").select("model", "bin", "n", r6("predicted"), r6("observed"), r6("error"))


@query(f"""{P}, b AS (SELECT horizon, avg((probability - actual) * (probability - actual)) AS brier, avg(actual) AS rate FROM predictions GROUP BY horizon),
k AS (SELECT horizon, {BIN_SQL} AS bin, count(*) AS n, avg(probability) AS p, avg(actual) AS o FROM predictions GROUP BY ALL), l AS (SELECT *, lag(o) OVER (PARTITION BY horizon ORDER BY bin) AS pv FROM k),
e AS (SELECT horizon, sum(abs(p - o) * n) / sum(n) AS ece, count_if(pv - o > 0.03) AS inversions FROM l GROUP BY horizon)
SELECT horizon, {r('brier', 'rate', baseline_brier='rate * (1 - rate)', brier_skill='1 - brier / (rate * (1 - rate))')}, {r('ece')}, inversions::BIGINT AS inversions FROM b JOIN e USING (horizon)""")
def brier_ece(spark, sf_dir):
    return op.brier_ece(_p(spark, sf_dir), ["horizon"]).select("horizon", *map(r6, ("brier", "rate", "baseline_brier", "brier_skill", "ece")), "inversions")


@query(f"""{P}, k AS (SELECT model, horizon, actual, rank() OVER (PARTITION BY model, horizon ORDER BY probability) + (count(*) OVER (PARTITION BY model, horizon, probability) - 1) / 2.0::DOUBLE AS rk,
  row_number() OVER d AS nth, sum(actual) OVER d AS hits FROM predictions WINDOW d AS (PARTITION BY model, horizon ORDER BY probability DESC, actual DESC, {O_SQL} ROWS UNBOUNDED PRECEDING)),
s AS (SELECT model, horizon, count(*) AS n, sum(actual)::BIGINT AS positives, sum(actual * rk) AS ranks, sum(CASE WHEN actual = 1 THEN hits::DOUBLE / nth END) AS ap FROM k GROUP BY ALL)
SELECT model, horizon, n, positives, {r(auc='(ranks - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives::DOUBLE * (n - positives), 0)', average_precision='ap / nullif(positives, 0)')} FROM s""")
def roc_auc_ap(spark, sf_dir):
    return op.auc_ap(_p(spark, sf_dir), ["model", "horizon"]).select("model", "horizon", "n", "positives", r6("auc"), r6("average_precision"))


@query(f"""{P}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY probability DESC, {O_SQL}) AS nth, count(*) OVER (PARTITION BY model) AS n FROM predictions)
SELECT model, count(*) AS selected, {r(hit_rate='avg(actual)')} FROM k WHERE nth <= greatest(1, ceil(n * 0.1 - 1e-9)) GROUP BY model""")
def top_decile(spark, sf_dir):
    return op.top_share(_p(spark, sf_dir), ["model"], "probability", tables.ORDER).select("model", "selected", r6("hit_rate"))


@query(f"""{P}, e AS (SELECT *, predicted_return - actual_return AS e FROM predictions)
SELECT horizon, count(*) AS n, {r(mae='avg(abs(e))', rmse='sqrt(avg(e * e))', mean_error='avg(e)', direction='avg(CAST((predicted_return >= 0) = (actual_return >= 0) AS INT))', r2='1 - avg(e * e) / var_pop(actual_return)')} FROM e GROUP BY horizon""")
def regression_metrics(spark, sf_dir):
    return op.regression(_p(spark, sf_dir), ["horizon"]).select("horizon", "n", *map(r6, ("mae", "rmse", "mean_error", "direction", "r2")))


@query(f"""{P}, e AS (SELECT model, abs(predicted_return - actual_return) AS e, row_number() OVER (PARTITION BY model ORDER BY abs(predicted_return - actual_return)) AS nth, count(*) OVER (PARTITION BY model) AS n FROM predictions)
SELECT model, {r(error_p90='max(e)')} FROM e WHERE nth = ceil(n * 0.9 - 1e-9) GROUP BY model""")
def error_p90(spark, sf_dir):
    out = op.order_statistic(_p(spark, sf_dir), ["model"], F.abs(F.col("predicted_return") - F.col("actual_return")), F.ceil(F.col("n_") * 0.9 - 1e-9), "error_p90")
    return out.select("model", r6("error_p90"))


@query(f"""{P}, e AS (SELECT model, abs(predicted_return - actual_return) AS v, weight FROM predictions), g AS (SELECT model, v, sum(weight) AS w FROM e GROUP BY model, v),
k AS (SELECT *, sum(w) OVER (PARTITION BY model ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY model) AS total FROM g)
SELECT model, {r(q50='min(v) FILTER (WHERE upto >= total * 0.5 - 1e-9)', q80='min(v) FILTER (WHERE upto >= total * 0.8 - 1e-9)', q90='min(v) FILTER (WHERE upto >= total * 0.9 - 1e-9)')} FROM k GROUP BY model""")
def weighted_quantile(spark, sf_dir):
    d = _p(spark, sf_dir).withColumn("err", F.abs(F.col("predicted_return") - F.col("actual_return")))
    return op.weighted_quantiles(d, ["model"], "err", "weight", (0.5, 0.8, 0.9)).select("model", r6("q50"), r6("q80"), r6("q90"))


BAND = "predicted_return - 4.5 AS p10, predicted_return AS p50, predicted_return + 3.5 AS p90"


@query(f"""{P}, b AS (SELECT *, {BAND} FROM predictions) SELECT horizon, {r(pinball_low='avg(greatest(0.1 * (actual_return - p10), -0.9 * (actual_return - p10)))', pinball_mid='avg(greatest(0.5 * (actual_return - p50), -0.5 * (actual_return - p50)))', pinball_high='avg(greatest(0.9 * (actual_return - p90), -0.1 * (actual_return - p90)))', coverage='avg(CAST(p10 <= actual_return AND actual_return <= p90 AS INT))', width='avg(p90 - p10)')} FROM b GROUP BY horizon""")
def quantile_metrics(spark, sf_dir):
    d = _p(spark, sf_dir).withColumns({"p10": F.col("predicted_return") - 4.5, "p90": F.col("predicted_return") + 3.5})
    return op.quantile_losses(d, ["horizon"], "p10", "predicted_return", "p90", "actual_return").select("horizon", *map(r6, ("pinball_low", "pinball_mid", "pinball_high", "coverage", "width")))


@query(f"""{P}, b AS (SELECT *, {BAND} FROM predictions), s AS (SELECT model, greatest(p10 - actual_return, actual_return - p90) AS v FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v) AS nth, count(*) OVER (PARTITION BY model) AS n FROM s)
SELECT model, {r(margin='max(v)')} FROM k WHERE nth = least(n, ceil((n + 1) * 0.8 - 1e-9)) GROUP BY model""")
def conformal_margin(spark, sf_dir):
    d = _p(spark, sf_dir).withColumns({"p10": F.col("predicted_return") - 4.5, "p90": F.col("predicted_return") + 3.5})
    return op.conformal(d, ["model"], "p10", "p90", "actual_return").select("model", r6("margin"))


@query(f"""{P}, g AS (SELECT horizon, count_if(weight > 0)::BIGINT AS n, sum(weight) AS w, sum(weight * weight) AS ww, sum(weight * actual) AS wy FROM predictions GROUP BY horizon), k AS (SELECT *, w * w / ww AS ne, wy / w AS p, 1.6448536269514722::DOUBLE AS z FROM g),
c AS (SELECT *, (p + z * z / (2 * ne)) / (1 + z * z / ne) AS c, z * sqrt((p * (1 - p) + z * z / (4 * ne)) / ne) / (1 + z * z / ne) AS m FROM k)
SELECT horizon, n, {r(effective_n='ne', rate='p', lower='greatest(0, c - m)', upper='least(1, c + m)')} FROM c""")
def kish_wilson(spark, sf_dir):
    return op.kish_wilson(_p(spark, sf_dir), ["horizon"], "actual", "weight").select("horizon", "n", *map(r6, ("effective_n", "rate", "lower", "upper")))


@query(f"""{P}, b AS (SELECT *, CASE WHEN probability * 100 + 1e-9 < 40 THEN '0-39' WHEN probability * 100 + 1e-9 < 50 THEN '40-49' WHEN probability * 100 + 1e-9 < 60 THEN '50-59' WHEN probability * 100 + 1e-9 < 70 THEN '60-69' WHEN probability * 100 + 1e-9 < 80 THEN '70-79' ELSE '80-99' END AS bucket FROM predictions),
g AS (SELECT bucket, count(*) AS n, sum(weight * probability) / sum(weight) * 100 AS p, sum(weight * actual) / sum(weight) * 100 AS o FROM b GROUP BY bucket)
SELECT bucket, n, {r(predicted_pct='p', observed_pct='o', error_pct='abs(p - o)')} FROM g""")
def calibration_buckets(spark, sf_dir):
    return op.calibration_buckets(_p(spark, sf_dir), [], "probability", "actual", "weight").select("bucket", "n", r6("predicted_pct"), r6("observed_pct"), r6("error_pct"))


@query(f"""{P}, d AS (SELECT CAST(year(day) AS INT) AS year, model, horizon, probability, actual FROM predictions)
SELECT CASE WHEN grouping(year) = 0 THEN 'year' WHEN grouping(model) = 0 THEN 'model' ELSE 'horizon' END AS key, coalesce(CAST(year AS VARCHAR), model, CAST(horizon AS VARCHAR)) AS value, count(*) AS n,
  {r(rate='avg(actual)', predicted='avg(probability)', brier='avg((probability - actual) * (probability - actual))')} FROM d GROUP BY GROUPING SETS ((year), (model), (horizon)) HAVING count(*) >= 10""")
def diagnostic_buckets(spark, sf_dir):
    d = _p(spark, sf_dir).withColumn("year", F.year("day"))
    return op.diagnostics(d, ["year", "model", "horizon"]).select("key", "value", "n", r6("rate"), r6("predicted"), r6("brier"))


@query(f"""{P}, l AS (SELECT feature, side, v FROM (SELECT CAST(day >= DATE '1999-01-01' AS INT) AS side, probability, actual_return, weight FROM predictions) UNPIVOT (v FOR feature IN (probability, actual_return, weight))),
t AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS at_, count(*) OVER (PARTITION BY feature) AS n FROM l WHERE side = 0),
b AS (SELECT feature, list(v ORDER BY q) AS bounds FROM t JOIN range(1, 10) x(q) ON at_ = n * q // 10 GROUP BY feature),
k AS (SELECT l.feature, side, len(list_filter(bounds, lambda z: z < v)) AS bin, count(*) AS c FROM l JOIN b ON l.feature = b.feature GROUP BY ALL),
f AS (SELECT feature, bin FROM b, range(0, 10) y(bin)),
s AS (SELECT f.feature, f.bin, coalesce(k0.c, 0) AS c0, coalesce(k1.c, 0) AS c1 FROM f LEFT JOIN k k0 ON k0.feature = f.feature AND k0.bin = f.bin AND k0.side = 0 LEFT JOIN k k1 ON k1.feature = f.feature AND k1.bin = f.bin AND k1.side = 1),
p AS (SELECT feature, greatest(1e-4, c0::DOUBLE / sum(c0) OVER (PARTITION BY feature)) AS p, greatest(1e-4, c1::DOUBLE / sum(c1) OVER (PARTITION BY feature)) AS q FROM s),
m AS (SELECT feature, avg(v) FILTER (WHERE side = 0) AS m0, avg(v) FILTER (WHERE side = 1) AS m1, stddev_pop(v) FILTER (WHERE side = 0) AS sd FROM l GROUP BY feature)
SELECT p.feature, {r(psi='sum((q - p) * ln(q / p))', mean_shift='any_value((m1 - m0) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END)')} FROM p JOIN m ON p.feature = m.feature GROUP BY p.feature""")
def psi_drift(spark, sf_dir):
    d = _p(spark, sf_dir)
    late = F.col("day") >= F.lit("1999-01-01").cast("date")
    return op.psi(d.filter(~late), d.filter(late), ["probability", "actual_return", "weight"]).select("feature", r6("psi"), r6("mean_shift"))


RANK_SQL = f"""k AS (SELECT day, actual_return AS y, count(*) OVER d AS n, row_number() OVER (PARTITION BY day ORDER BY predicted_return, {O_SQL}) - 1 AS p, row_number() OVER (PARTITION BY day ORDER BY actual_return, {O_SQL}) - 1 AS a,
  CASE WHEN actual = 1 AND stopped = 0 THEN 3 WHEN stopped = 1 THEN 0 WHEN actual_return > 0 THEN 2 ELSE 1 END AS rel, {O_SQL} FROM predictions WINDOW d AS (PARTITION BY day)),
j AS (SELECT *, greatest(1, ceil(n * 0.1 - 1e-9)) AS t, row_number() OVER (PARTITION BY day ORDER BY rel DESC, {O_SQL}) - 1 AS i FROM k WHERE n >= 5),
daily AS (SELECT day, max(n) AS symbols, sum((p - (n - 1) / 2.0::DOUBLE) * (a - (n - 1) / 2.0::DOUBLE)) / sum((p - (n - 1) / 2.0::DOUBLE) * (p - (n - 1) / 2.0::DOUBLE)) AS rank_ic, count_if(p >= n - t AND a >= n - t)::DOUBLE / max(t) AS precision,
  coalesce(sum((power(2.0::DOUBLE, rel) - 1) / log2(n - p + 1)) FILTER (WHERE p >= n - t) / nullif(sum((power(2.0::DOUBLE, rel) - 1) / log2(i + 2)) FILTER (WHERE i < t), 0), 0) AS ndcg, avg(y) FILTER (WHERE p >= n - t) AS top_return, avg(y) AS mean_return FROM j GROUP BY day)"""


def _daily(spark, sf_dir):
    rel = F.when((F.col("actual") == 1) & (F.col("stopped") == 0), 3).when(F.col("stopped") == 1, 0).when(F.col("actual_return") > 0, 2).otherwise(1)
    return op.rank_by_date(_p(spark, sf_dir), ["day"], "predicted_return", "actual_return", tables.ORDER, relevance=rel)


@query(f"{P}, {RANK_SQL} SELECT day, symbols, {r('rank_ic', 'precision', 'ndcg', 'top_return', 'mean_return')} FROM daily")
def rank_metrics_daily(spark, sf_dir):
    return _daily(spark, sf_dir).select("day", "symbols", *map(r6, ("rank_ic", "precision", "ndcg", "top_return", "mean_return")))


@query(f"{P}, {RANK_SQL} SELECT count(*) AS dates, {r(rank_ic='avg(rank_ic)', icir='avg(rank_ic) / stddev_samp(rank_ic)', precision='avg(precision)', ndcg='avg(ndcg)', top_return='avg(top_return)', lift='avg(top_return) - avg(mean_return)')} FROM daily")
def rank_metrics(spark, sf_dir):
    return op.rank_summary(_daily(spark, sf_dir), []).select("dates", *map(r6, ("rank_ic", "icir", "precision", "ndcg", "top_return", "lift")))


@query(f"""{P}, {RANK_SQL}, d AS (SELECT year(day) AS year, row_number() OVER w AS i, rank_ic - avg(rank_ic) OVER (PARTITION BY year(day)) AS d, avg(rank_ic) OVER (PARTITION BY year(day)) AS m, count(*) OVER (PARTITION BY year(day)) AS n FROM daily WINDOW w AS (PARTITION BY year(day) ORDER BY day)),
l AS (SELECT *, CAST(greatest(1, floor(4 * power(n / 100.0::DOUBLE, 2.0 / 9) + 1e-12)) AS INT) AS lg FROM d),
s AS (SELECT a.year, any_value(a.n) AS n, any_value(a.lg) AS lags, any_value(a.m) AS mean, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i)::DOUBLE / (a.lg + 1)) END * a.d * b.d) AS s FROM l a JOIN l b ON a.year = b.year AND b.i BETWEEN a.i - a.lg AND a.i GROUP BY a.year)
SELECT CAST(year AS INT) AS year, n, lags, {r('mean', lower='mean - 1.96 * sqrt(greatest(0, s / n) / n)', upper='mean + 1.96 * sqrt(greatest(0, s / n) / n)')} FROM s WHERE n >= 8""")
def newey_west_ci(spark, sf_dir):
    daily = _daily(spark, sf_dir).withColumn("year", F.year("day"))
    return op.newey_west(daily, ["year"], "rank_ic", "day").select("year", "n", "lags", r6("mean"), r6("lower"), r6("upper"))


@query(f"""{P}, {RANK_SQL}, e AS (SELECT year(day) AS year, day, exp(sum(ln(greatest(0.01, 1 + top_return / 100))) OVER (PARTITION BY year(day) ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq FROM daily),
peaks AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY year ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pk FROM e)
SELECT CAST(year AS INT) AS year, {r(equity='last(eq ORDER BY day)', max_drawdown_pct='max((pk - eq) / pk * 100)', current_drawdown_pct='last((pk - eq) / pk * 100 ORDER BY day)')} FROM peaks GROUP BY year""")
def drawdown(spark, sf_dir):
    daily = _daily(spark, sf_dir).withColumn("year", F.year("day"))
    return op.drawdown(daily, ["year"], "top_return", "day").select("year", *map(r6, ("equity", "max_drawdown_pct", "current_drawdown_pct")))


@query()
def bootstrap_interval(spark, sf_dir):
    """Interval of the mean rank correlation by year; resampled by months."""
    daily = _daily(spark, sf_dir).select(F.year("day").alias("year"), F.date_trunc("month", "day").alias("month"), "rank_ic")
    return op.block_bootstrap(daily, ["year"], "month", "rank_ic").select("year", r6("lower"), r6("upper"))


@query(f"""{P}, g AS (SELECT horizon, model, corr(predicted_return, actual_return) AS c, count(*) AS n FROM predictions GROUP BY ALL), t AS (SELECT *, abs(c) * sqrt(greatest(1, (n - 2) / greatest(1e-12, 1 - c * c))) / sqrt(2) AS x FROM g),
e AS (SELECT *, 1 / (1 + 0.5 * x) AS u FROM t),
p AS (SELECT *, least(1, u * exp(-x * x - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277)))))))))) AS p FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY p, horizon, model) AS rk, count(*) OVER () AS m FROM p)
SELECT horizon, model, n, {r(correlation='c', p_value='p', q_value='least(1, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING))')} FROM k""")
def fdr_bh(spark, sf_dir):
    """Correlations by horizon and model with p values and Benjamini-Hochberg q values."""
    g = _p(spark, sf_dir).groupBy("horizon", "model").agg(pearson(F.col("predicted_return"), F.col("actual_return")).alias("correlation"), F.count("*").alias("n"))
    out = op.benjamini_hochberg(g.withColumn("p_value", correlation_p_value("correlation", "n")), [], "p_value", ["horizon", "model"])
    return out.select("horizon", "model", "n", r6("correlation"), r6("p_value"), r6("q_value"))


@query(f"""{P}, d AS (SELECT *, probability AS pt, (1 - probability) * 0.6 AS ps, (1 - probability) * 0.4 AS po FROM predictions), e AS (SELECT horizon, (pt * 8 - ps * 5 + po * predicted_return) / greatest(1e-9, pt + ps + po) - 0.18 AS ev FROM d)
SELECT horizon, count(*) AS n, {r(expected_value='avg(ev)', positive_share='avg(CAST(ev > 0 AS INT))')} FROM e GROUP BY horizon""")
def expected_value(spark, sf_dir):
    p = F.col("probability")
    d = _p(spark, sf_dir).withColumns({"p_target": p, "p_stop": (1 - p) * 0.6, "p_timeout": (1 - p) * 0.4, "gain": F.lit(8.0), "loss": F.lit(5.0), "drift": F.col("predicted_return")})
    return op.expected_value(d, ["horizon"], 0.18).select("horizon", "n", r6("expected_value"), r6("positive_share"))


@query(f"""{P}, d AS (SELECT p.*, t FROM predictions p, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE)) v(t) WHERE probability >= t - 1e-9), g AS (SELECT horizon, t AS threshold, count(*) AS n, avg(actual) AS h, avg(actual_return) AS m FROM d GROUP BY ALL)
SELECT horizon, threshold, n, {r(hit_rate='h', mean_return='m')}, n >= 30 AND h >= 0.5 AND m > 0 AS qualified FROM g""")
def long_gate_thresholds(spark, sf_dir):
    return op.long_gate(_p(spark, sf_dir), ["horizon"], (0.5, 0.6, 0.7, 0.8), "probability", "actual", "actual_return").select("horizon", "threshold", "n", r6("hit_rate"), r6("mean_return"), "qualified")


@query(f"""WITH {BARS_SQL}, s AS (SELECT sector, day, (close / lag(close) OVER w - 1) * 100 AS x, (lead(close) OVER w / close - 1) * 100 AS y FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)), k AS (SELECT * FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY x) + (count(*) OVER (PARTITION BY sector, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY sector ORDER BY y) + (count(*) OVER (PARTITION BY sector, y) - 1) / 2.0::DOUBLE AS b FROM k)
SELECT sector, count(*) AS n, {r(spearman='corr(a, b)')} FROM r GROUP BY sector""")
def spearman(spark, sf_dir):
    from tidemark.functions.scalars import pct_from
    from tidemark.functions.series import ordered

    w = ordered(["symbol"], ["day"])
    b = tables.bars(spark, sf_dir).select("sector", pct_from(F.lag("close").over(w), F.col("close")).alias("x"), pct_from(F.col("close"), F.lead("close").over(w)).alias("y"), F.lag("close").over(w).alias("p"), F.lead("close").over(w).alias("n"))
    k = b.filter("p is not null and n is not null").select("sector", average_rank("x", ["sector"]).alias("a"), average_rank("y", ["sector"]).alias("b"))
    return k.groupBy("sector").agg(F.count("*").alias("n"), r6(pearson(F.col("a"), F.col("b")), "spearman"))
