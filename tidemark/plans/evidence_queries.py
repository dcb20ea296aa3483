"""Queries on evidence, reliability, regimes, sessions, overlays and live scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evidence as op
from tidemark.operators import indicators
from tidemark.plans.indicator_queries import SCORES_SQL
from tidemark.plans.registry import BARS_SQL, PREDICTIONS_SQL, query, r, r6
from tidemark.sources import tables

#: Predictions as the evidence functions take them.
ROWS = {
    "outcome": "actual_return", "buy_signal": "probability >= 0.6", "target_wins": "actual = 1", "stop_wins": "stopped = 1", "regime": "CASE horizon % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'uptrend' ELSE 'volatile' END",
    "barrier_label": "CASE WHEN actual = 1 THEN 'target' WHEN stopped = 1 THEN 'stop' WHEN actual_return >= 0 THEN 'timeout_positive' ELSE 'timeout_negative' END", "target_probability": "probability", "stop_probability": "1 - probability", "target_label": "actual", "stop_label": "stopped",
}
P = f"{PREDICTIONS_SQL}, d AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in ROWS.items())} FROM predictions)"


def _rows(spark, sf_dir):
    return tables.predictions(spark, sf_dir).selectExpr("*", *(f"{e} AS {n}" for n, e in ROWS.items()))


def _wilson(p: str, n: str, z: str = "1.6448536269514722::DOUBLE") -> tuple[str, str]:
    centre, scale = f"({p} + {z} * {z} / (2 * {n}))", f"(1 + {z} * {z} / {n})"
    margin = f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n}))"
    return f"greatest(0, ({centre} - {margin}) / {scale})", f"least(1, ({centre} + {margin}) / {scale})"


@query(f"""WITH {P} SELECT model, count(*) AS n, count_if(barrier_label = 'target')::BIGINT AS target, count_if(barrier_label = 'stop')::BIGINT AS stop, count_if(barrier_label LIKE 'timeout%')::BIGINT AS timeout,
{r(target_rate="100 * avg((barrier_label = 'target')::INT)", stop_rate="100 * avg((barrier_label = 'stop')::INT)", timeout_rate="100 * avg((barrier_label LIKE 'timeout%')::INT)")} FROM d GROUP BY model""")
def barrier_summary(spark, sf_dir):
    return op.barrier_summary(_rows(spark, sf_dir), ["model"]).select("model", "n", "target", "stop", "timeout", *map(r6, ("target_rate", "stop_rate", "timeout_rate")))


@query(f"""WITH {P}, f AS (SELECT *, target_probability < 0.55 OR stop_probability >= 0.62 OR barrier_label = 'stop' AS f FROM d)
SELECT horizon, count(*) AS n, count_if(f)::BIGINT AS flagged, count_if(NOT f)::BIGINT AS tradable, {r(flagged_stop_rate="100 * avg(stop_label) FILTER (WHERE f)", tradable_target_rate="100 * avg(target_label) FILTER (WHERE NOT f)")} FROM f GROUP BY horizon""")
def no_trade_diagnostics(spark, sf_dir):
    return op.no_trade_diagnostics(_rows(spark, sf_dir), ["horizon"]).select("horizon", "n", "flagged", "tradable", r6("flagged_stop_rate"), r6("tradable_target_rate"))


@query("""SELECT event_type, user_id % 50 AS bucket, max_by(event_id, ts) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1 GROUP BY ALL""")
def event_signatures(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 50)
    return op.newest_by_signature(e, ["event_type", "bucket"], "ts", ["event_id"]).select("event_type", "bucket", "event_id")


LOW, HIGH = _wilson("((tp + tn) / n::DOUBLE)", "n", "1.959963984540054::DOUBLE")


@query(f"""WITH {P}, o AS (SELECT *, row_number() OVER (PARTITION BY horizon, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM d), u AS (SELECT horizon, probability AS p, (outcome >= 0)::INT AS y FROM o WHERE k = 1),
b AS (SELECT horizon, least(9, floor(p * 10)) AS b, count(*) AS n, sum(p) AS p, sum(y) AS y FROM u GROUP BY ALL), e AS (SELECT horizon, sum(abs(p - y)) / sum(n) * 100 AS ece FROM b GROUP BY horizon),
g AS (SELECT horizon, count(*) AS n, count_if(p >= 0.5 AND y = 1) AS tp, count_if(p < 0.5 AND y = 0) AS tn, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn, avg((p - y) * (p - y)) AS br, var_pop(y) AS vb FROM u GROUP BY horizon),
l AS (SELECT horizon, p, count(*) AS c, sum(y) AS s FROM u GROUP BY ALL), c AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY horizon ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ov FROM l),
t AS (SELECT c.horizon, 100 * sum(greatest(0, least(c, ceil(n * 0.1) - ov)) * s / c) / max(ceil(n * 0.1)) AS top FROM c JOIN g ON c.horizon = g.horizon GROUP BY c.horizon)
SELECT g.horizon, n, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, {r(accuracy_pct='100.0 * (tp + tn) / n', balanced_pct='50.0 * (tp / (tp + fn) + tn / (tn + fp))', precision_pct='100.0 * tp / (tp + fp)', recall_pct='100.0 * tp / (tp + fn)', f1_pct='200.0 * tp / (2 * tp + fp + fn)', brier='br', brier_skill='1 - br / vb', ece_pct='ece', top_decile_pct='top', accuracy_low=f'100 * {LOW}', accuracy_high=f'100 * {HIGH}')}
FROM g JOIN e ON g.horizon = e.horizon JOIN t ON g.horizon = t.horizon""")
def evidence_metrics(spark, sf_dir):
    out = op.evidence_metrics(_rows(spark, sf_dir), ["horizon"], ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("horizon", "n", "tp", "tn", "fp", "fn", *map(r6, ("accuracy_pct", "balanced_pct", "precision_pct", "recall_pct", "f1_pct", "brier", "brier_skill", "ece_pct", "top_decile_pct", "accuracy_low", "accuracy_high")))


@query(f"""WITH {SCORES_SQL}
SELECT symbol, day, CASE WHEN (day - DATE '1995-01-01') % 10 = 0 THEN 'low_coverage' WHEN risk_score < 48 OR abs(change5) >= 8 OR vr >= 3.2 THEN 'volatile' WHEN rsi >= 72 OR (change5 >= 6 AND trend_score >= 60) THEN 'overextended'
WHEN trend_score >= 62 AND momentum_score >= 56 AND change20 >= 2 THEN 'uptrend' WHEN trend_score <= 42 AND change20 <= -2 THEN 'downtrend' WHEN vr >= 1.35 AND change5 >= 0 AND momentum_score >= 52 THEN 'volume_breakout' ELSE 'range' END AS regime FROM scores""")
def regime_buckets(spark, sf_dir):
    d = indicators.scores(tables.bars(spark, sf_dir))
    coverage = F.when(F.date_diff("day", F.lit("1995-01-01").cast("date")) % 10 == 0, 30.0).otherwise(90.0)
    return d.select("symbol", "day", op.regime_bucket(coverage=coverage).alias("regime"))


@query(f"""WITH {P}, g AS (SELECT model, regime, count(*) AS n, sum(weight) AS effective, count_if(buy_signal) AS buys, 100 * sum(weight * ((predicted_return >= 0) = (actual_return >= 0))::INT) / sum(weight) AS dr, 100 * sum(weight * target_wins::INT) / sum(weight) AS tr, 100 * sum(weight * stop_wins::INT) / sum(weight) AS sr, sum(weight * actual_return) / sum(weight) AS mr FROM d GROUP BY ALL)
SELECT model, regime, n, buys::BIGINT AS buys, {r('effective', direction_rate='dr', target_rate='tr', stop_rate='sr', mean_return='mr', score='greatest(-12, least(12, (tr - 52) / 3.5 + mr * 0.25 - sr * 0.04))')}, row_number() OVER (PARTITION BY model ORDER BY effective DESC, regime) AS rank FROM g""")
def regime_calibration(spark, sf_dir):
    out = op.regime_calibration(_rows(spark, sf_dir), ["model"])
    return out.select("model", "regime", "n", "buys", *map(r6, ("effective", "direction_rate", "target_rate", "stop_rate", "mean_return", "score")), "rank")


def _reliability_sql() -> str:
    bounds = {c: _wilson(f"({c} / {t})", n) for c, t, n in (("dd", "w", "(w * w / ww)"), ("tt", "tw", "(tw * tw / tww)"), ("ss", "tw", "(tw * tw / tww)"))}
    return f"""{P}, a AS (SELECT *, max(buy_signal::INT) OVER (PARTITION BY day) AS an FROM d), x AS (SELECT *, an = 0 OR buy_signal AS tr FROM a),
g AS (SELECT day, sum(weight) AS w, sum(weight * weight) AS ww, sum(weight * ((predicted_return >= 0) = (actual_return >= 0))::INT) AS dd, sum(weight) FILTER (WHERE tr) AS tw, sum(weight * weight) FILTER (WHERE tr) AS tww, sum(weight * target_wins::INT) FILTER (WHERE tr) AS tt, sum(weight * stop_wins::INT) FILTER (WHERE tr) AS ss, max(an) = 1 AS accepted_only FROM x GROUP BY day),
b AS (SELECT day, accepted_only, tw * tw / tww AS effective, 100 * {bounds['tt'][0]} AS tl, 100 * {bounds['dd'][0]} AS dl, 100 * {bounds['ss'][1]} AS sh, 50 * ({bounds['tt'][1]} - {bounds['tt'][0]}) AS mg FROM g),
rel AS (SELECT *, greatest(0, least(100, 100 - greatest(0, 55 - tl) * 1.25 - greatest(0, 52 - dl) * 0.8 - greatest(0, sh - 52) * 0.9 - greatest(0, 14 - effective) * 2.15 - greatest(0, mg - 16) * 0.75)) AS score,
  CASE WHEN effective < 10 THEN 'collecting' WHEN tl >= 58 AND dl >= 53 AND sh <= 48 THEN 'strong' WHEN tl < 50 OR sh > 58 THEN 'weak_lower_bound' WHEN mg >= 20 THEN 'wide_interval' ELSE 'usable' END AS status FROM b)"""


@query(f"WITH {_reliability_sql()} SELECT day, accepted_only, status, {r('effective', 'score', target_low='tl', direction_low='dl', stop_high='sh', margin='mg')} FROM rel")
def statistical_reliability(spark, sf_dir):
    return op.statistical_reliability(_rows(spark, sf_dir), ["day"]).select("day", "accepted_only", "status", *map(r6, ("effective", "score", "target_low", "direction_low", "stop_high", "margin")))


@query(f"""WITH {_reliability_sql()}, y AS (SELECT year(day) AS year, *, list_position(['weak_lower_bound', 'collecting', 'wide_interval', 'usable', 'strong'], status) AS pl FROM rel)
SELECT year, count(*) AS symbols, {r(samples='sum(greatest(1, effective))', score='sum(score * greatest(1, effective)) / sum(greatest(1, effective))')}, ['weak_lower_bound', 'collecting', 'wide_interval', 'usable', 'strong'][min(pl)] AS weakest FROM y GROUP BY year""")
def reliability_roll_up(spark, sf_dir):
    d = op.statistical_reliability(_rows(spark, sf_dir), ["day"]).withColumn("year", F.year("day").cast("long"))
    return op.roll_up(d, ["year"], ["score"], samples="effective").select("year", "symbols", r6("samples"), r6("score"), "weakest")


@query(f"""WITH {P}, m AS (SELECT model, horizon, day, count(*) AS samples, avg(probability) - 0.2 AS weight, avg(actual_return) AS improvement, avg(predicted_return) AS lift FROM d GROUP BY ALL),
w AS (SELECT model, horizon, greatest(0, sum(weight * samples * (1 + greatest(0, improvement) / 100 + greatest(0, lift) / 100))) AS w FROM m GROUP BY ALL) SELECT model, horizon, {r(weight='w / sum(w) OVER (PARTITION BY model)')} FROM w""")
def method_weight_roll_up(spark, sf_dir):
    d = _rows(spark, sf_dir).groupBy("model", "horizon", "day").agg(F.count("*").alias("samples"), (F.avg("probability") - 0.2).alias("weight"), F.avg("actual_return").alias("improvement_pct"), F.avg("predicted_return").alias("lift_pct"))
    return op.roll_up_weights(d, ["model"], method="horizon").select("model", "horizon", r6("weight"))


@query(f"""WITH {P} SELECT day, count(*) AS n, {r(probability='avg(probability)', weight='avg(weight)', date_weight='least(1, count(*) / 50.0::DOUBLE)')}, (quantile_cont(actual_return, 0.5) > 0)::INT AS up FROM d GROUP BY day""")
def date_features(spark, sf_dir):
    d = _rows(spark, sf_dir).withColumnRenamed("weight", "size")
    out = op.date_features(d, "day", ["probability", "size"], "actual_return")
    return out.select("day", "n", r6("probability"), r6("size", "weight").alias("weight"), r6("weight", "date_weight"), "up")


@query(f"""WITH {P}, c AS (SELECT unnest([{{'feature': 'probability', 'r': corr(probability, actual)}}, {{'feature': 'predicted_return', 'r': corr(predicted_return, actual)}}, {{'feature': 'weight', 'r': corr(weight, actual)}}, {{'feature': 'horizon', 'r': corr(horizon, actual)}}]) AS x FROM d)
SELECT x.feature AS feature, {r(importance='abs(x.r) / sum(abs(x.r)) OVER ()')}, CASE WHEN x.r >= 0 THEN 1 ELSE -1 END AS direction FROM c""")
def feature_importance(spark, sf_dir):
    return op.importance(_rows(spark, sf_dir), ["probability", "predicted_return", "weight", "horizon"], "actual").select("feature", r6("importance"), "direction")


@query("""WITH m(market, zone, minutes) AS (VALUES ('US', 'America/New_York', 960), ('ASX', 'Australia/Sydney', 970), ('CN', 'Asia/Shanghai', 900)), e AS (SELECT event_id, market, minutes, timezone(zone, CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC') AS t FROM events, m),
d AS (SELECT event_id, market, CAST(t AS DATE) - CASE WHEN hour(t) * 60 + minute(t) >= minutes THEN 0 ELSE 1 END AS d FROM e)
SELECT event_id, market, CAST(d - CASE isodow(d) WHEN 7 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS DATE) AS session FROM d""")
def completed_sessions(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").withColumn("market", F.explode(F.array(F.lit("US"), F.lit("ASX"), F.lit("CN"))))
    return e.select("event_id", "market", op.completed_session(F.col("ts").cast("timestamp"), "market").alias("session"))


@query(f"""WITH {BARS_SQL}, q AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day, o_totalprice / 100 AS price, o_orderkey AS k FROM orders WHERE o_orderkey % 4 > 0 AND o_totalprice > 0),
n AS (SELECT symbol, day, max_by(price, k) AS price FROM q WHERE isodow(day) < 6 AND day <= DATE '2000-01-01' GROUP BY ALL)
SELECT coalesce(b.symbol, n.symbol) AS symbol, coalesce(b.day, n.day) AS day, {r(open='coalesce(open, price)', high='greatest(high, price)', low='least(low, price)', close='coalesce(price, close)', volume='coalesce(volume, 0)')}, price IS NOT NULL AS overlaid FROM bars b FULL JOIN n ON b.symbol = n.symbol AND b.day = n.day""")
def quote_overlay(spark, sf_dir):
    k = F.col("o_orderkey")
    q = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 100).alias("price"), k.alias("at"), (k % 4 > 0).alias("time_verified"))
    out = op.merge_quotes(tables.bars(spark, sf_dir), q, F.lit("2000-01-01").cast("date"))
    return out.select("symbol", "day", *map(r6, ("open", "high", "low", "close", "volume")), "overlaid")


LAB = {"change5": "l_discount * 200 - 10", "change20": "l_tax * 300 - 12", "volatility": "l_quantity / 10", "volume_ratio": "l_quantity / 25", "close": "l_extendedprice", "sma20": "30000.0", "vwap_gap_pct": "l_quantity - 25", "range_position": "l_discount * 10"}
LAB_WEIGHTS, LAB_RESEARCH = {"momentum_5": 2.0, "momentum_20": 1.0, "reversal_5": 0.5, "volatility_10": 1.0, "trend_gap_20": 1.5}, {"volume_ratio_20": 3.0, "vwap_gap": 1.0, "range_position": 1.0}
_TEN = "greatest(-10, least(10, {}))"
_LAB_SQL = {"momentum_5": "change5", "momentum_20": "change20 * 0.5", "reversal_5": "-change5", "volatility_10": "4 - volatility * 2", "volume_ratio_20": "(volume_ratio - 1) * 8", "trend_gap_20": "(close - sma20) / sma20 * 70", "vwap_gap": "vwap_gap_pct", "range_position": "(range_position - 0.5) * 20"}


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{e} AS {n}' for n, e in LAB.items())} FROM lineitem), s AS (SELECT *, {' + '.join(f'{_TEN.format(_LAB_SQL[n])} * {w / 1.2}' for n, w in LAB_WEIGHTS.items())} AS ly, {' + '.join(f'{_TEN.format(_LAB_SQL[n])} * {w / 5}' for n, w in LAB_RESEARCH.items())} AS rs FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, {r(layer_score='ly', research_score='rs', factor_score='greatest(-25, least(25, ly + rs))')} FROM s""")
def lab_scores(spark, sf_dir):
    i = tables.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *(f"{e} AS {n}" for n, e in LAB.items()))
    return op.lab_scores(i, LAB_WEIGHTS, LAB_RESEARCH).select("l_orderkey", "l_linenumber", "l_partkey", *map(r6, ("layer_score", "research_score", "factor_score")))


@query(f"""WITH {P} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r(scale='greatest(0.02, least(0.22, 0.02 + abs(predicted_return - actual_return) * 0.012 + 0.035 * ((actual = 0)::INT + 0.6 * stopped + greatest(0, -actual_return) / 8 + greatest(0, weight / 5) / 12)))')} FROM d""")
def micro_tuning(spark, sf_dir):
    d = _rows(spark, sf_dir).withColumn("max_drawdown", -F.col("weight") / 5)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(op.micro_tuning(missed=F.col("actual") == 0, adverse="stopped"), "scale"))


@query(f"""WITH {P}, b AS (SELECT horizon, model, max(actual_return) * 10 - 20 AS best FROM d GROUP BY ALL) SELECT horizon, model, {r(aggressiveness='greatest(0.55, least(1.45, 0.7 + greatest(0, best) / 38))', bias='greatest(-5, least(5, horizon - 4 + best * 0.012))')} FROM b""")
def agent_bias(spark, sf_dir):
    b = _rows(spark, sf_dir).groupBy("horizon", "model").agg((F.max("actual_return") * 10 - 20).alias("best"))
    a, c = op.agent_bias("best", (F.col("horizon") - 4).cast("double"))
    return b.select("horizon", "model", r6(a, "aggressiveness"), r6(c, "bias"))


@query(f"""WITH {P}, g AS (SELECT day, model, count(*) AS paths, avg(greatest(0, -actual_return)) AS m, list(greatest(0, -actual_return) ORDER BY greatest(0, -actual_return)) AS f FROM d GROUP BY ALL), p AS (SELECT *, least((m + f[greatest(1, CAST(ceil(len(f) * 0.75) AS INT))]) / 2 * 0.82, 4 * 1.22) AS pd FROM g)
SELECT day, model, paths, {r(projected_downside='pd', probability='greatest(0, least(92, 30 + len(list_filter(f, lambda x: x >= pd)) / len(f) * 40 + 28 * 0.2 + (72 - 50) * 0.1))')} FROM p""")
def downside_confidence(spark, sf_dir):
    d = _rows(spark, sf_dir).withColumns({"max_drawdown": F.col("actual_return"), "stop_loss": F.lit(4.0), "shrink": F.lit(0.82), "stop_risk_pct": F.lit(28.0), "agreement_pct": F.lit(72.0)})
    return op.downside_confidence(d, ["day", "model"]).select("day", "model", "paths", r6("projected_downside"), r6("probability"))


@query("""WITH e AS (SELECT user_id, ts, event_id, value, CASE event_id % 5 WHEN 0 THEN 'LSTM-a' WHEN 1 THEN 'GradientBoost' WHEN 2 THEN 'ridge' WHEN 3 THEN 'Stacked blend' ELSE 'x' END AS name FROM events)
SELECT event_id, name, CASE event_id % 5 WHEN 0 THEN 'deep' WHEN 1 THEN 'tree' WHEN 2 THEN 'linear' WHEN 3 THEN 'ensemble' ELSE 'other' END AS family, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS impact FROM e""")
def model_trajectories(spark, sf_dir):
    k = F.col("event_id") % 5
    e = tables.table(spark, sf_dir, "events").withColumn("name", F.when(k == 0, "LSTM-a").when(k == 1, "GradientBoost").when(k == 2, "ridge").when(k == 3, "Stacked blend").otherwise("x"))
    return op.trajectory(e, ["user_id"], "event_id", ["value"]).select("event_id", "name", op.model_family("name").alias("family"), F.coalesce("value_impact", F.lit(0.0)).alias("impact"))
