"""Queries on portfolios, models, normalizers, text scoring and stream operators over static rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.operators import indicators, models, panel, selection
from tidemark.operators import portfolio as op
from tidemark.plans.indicator_queries import ATR_SQL, SCORES_SQL
from tidemark.plans.panel_queries import FACTORS
from tidemark.plans.registry import BARS_SQL, PREDICTIONS_SQL, TICKS_SQL, query, r, r6
from tidemark.sources import normalize, tables
from tidemark.streaming import market as stream

POS_SQL = f"""{BARS_SQL}, lt AS (SELECT market, symbol, sector, last(close ORDER BY day) AS px, avg(close) AS av, last(volume ORDER BY day) AS q FROM bars GROUP BY ALL),
pos AS (SELECT market, symbol, sector, round(q * px, 2) AS value, round(q * av, 2) AS cost, CAST(substr(symbol, 7) AS INT) % 7 - 5.0 AS ch, CAST(substr(symbol, 7) AS INT) % 6 AS vo, 600000.0::DOUBLE AS cap, 3.5 AS dd FROM lt),
w AS (SELECT *, (value - cost) / cost * 100 AS pnl_pct, value / cap * 100 AS weight_pct FROM pos), fl AS (SELECT *, pnl_pct <= -4 OR ch <= -4 AS stop_hit FROM w)"""


def _positions(spark, sf_dir):
    g = tables.bars(spark, sf_dir).groupBy("market", "symbol", "sector").agg(F.max_by("close", "day").alias("current_price"), F.avg("close").alias("avg_price"), F.max_by("volume", "day").alias("qty"))
    n = F.substring("symbol", 7, 9).cast("int")
    return g.withColumns({"change_5d_pct": (n % 7) - 5.0, "volatility_pct": (n % 6).cast("double"), "total_capital": F.lit(600000.0), "current_drawdown_pct": F.lit(3.5)})


@query(f"WITH {POS_SQL} SELECT symbol, value, {r('pnl_pct', 'weight_pct')}, stop_hit, CAST(weight_pct > 20 AS INT) + CAST(stop_hit AS INT) + CAST(NOT stop_hit AND vo > 4 AS INT) AS n_flags FROM fl")
def risk_positions(spark, sf_dir):
    return op.weigh(_positions(spark, sf_dir), ["market"]).select("symbol", "value", r6("pnl_pct"), r6("weight_pct"), "stop_hit", F.size("flags").alias("n_flags"))


@query(f"""WITH {POS_SQL}, s AS (SELECT market, sector, sum(value) AS v, max(weight_pct) AS t, count_if(weight_pct > 20) + count_if(NOT stop_hit AND vo > 4) AS w, count_if(stop_hit) AS b, sum(value) / 600000.0 * 100 AS sw FROM fl GROUP BY ALL),
g AS (SELECT market, sum(v) AS inv, max(t) AS cn, max(sw) AS sc, sum(w) + count_if(sw > 35) AS wn, sum(b) AS b FROM s GROUP BY market), h AS (SELECT *, greatest(0, 600000.0 - inv) AS cash, inv / 600000.0 * 100 AS gr FROM g),
k AS (SELECT *, b + CAST(gr > 100 AS INT) + CAST(cash < 90000 AS INT) AS bl FROM h)
SELECT market, {r(invested='inv', gross_exposure_pct='gr', available_cash='cash', risk_score='greatest(0, least(100, 100 - greatest(0, gr - 70) * 0.35 - greatest(0, cn - 20) * 1.25 - greatest(0, sc - 35) * 0.8 - wn * 4 - bl * 14 - 4.9))')}, wn::BIGINT AS warnings, bl::BIGINT AS blockers, CASE WHEN bl > 0 THEN 'blocked' WHEN wn > 0 THEN 'warning' ELSE 'within-policy' END AS status FROM k""")
def risk_exposure(spark, sf_dir):
    out = op.exposure(_positions(spark, sf_dir), ["market"])
    return out.select("market", r6("invested"), r6("gross_exposure_pct"), r6("available_cash"), r6("risk_score"), F.col("warnings").cast("long").alias("warnings"), F.col("blockers").cast("long").alias("blockers"), "status")


@query(f"""WITH {BARS_SQL}, {ATR_SQL}, t AS (SELECT market, symbol, day, atr_pct, close * volume AS nt, avg(close * volume) OVER w AS adv, volume / avg(volume) OVER w AS vr, dayofmonth(day) % 2 = 0 AS dg FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)),
c AS (SELECT *, CASE market WHEN 'ASX' THEN 0.08 WHEN 'US' THEN 0.045 ELSE 0.07 END AS cm, CASE market WHEN 'ASX' THEN 0.055 WHEN 'US' THEN 0.025 ELSE 0.045 END AS sp, CASE market WHEN 'ASX' THEN 0.01 WHEN 'US' THEN 0.005 ELSE 0.008 END AS mp, least(0.45, 0.012 + atr_pct * 0.012 + greatest(0, 0.9 - greatest(0.05, vr)) * 0.08) AS sl, least(0.8, (0.055 + atr_pct * 0.008) * sqrt(nt / adv)) AS im FROM t)
SELECT symbol, day, {r(slippage_pct='sl', impact_pct='im', cost_pct='cm + sp + sl + im + CASE WHEN dg THEN 0.025 ELSE 0 END')}, nt > adv * mp * 1.05 AS capacity_blocked FROM c""")
def cost_model(spark, sf_dir):
    from tidemark.functions.series import ordered, trailing

    w = trailing(ordered(["symbol"], ["day"]), 20)
    d = indicators.true_range(tables.bars(spark, sf_dir)).withColumn("notional", F.col("close") * F.col("volume"))
    d = d.withColumns({"average_dollar_volume": F.avg("notional").over(w), "volume_ratio": F.col("volume") / F.avg("volume").over(w), "spread_pct": F.lit(0.0), "degraded": F.dayofmonth("day") % 2 == 0})
    return op.trade_cost(d).select("symbol", "day", r6("slippage_pct"), r6("impact_pct"), r6("cost_pct"), "capacity_blocked")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS side, CASE WHEN o_orderkey % 11 = 0 THEN 'live' ELSE 'paper' END AS mode, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'S' || CAST(o_custkey AS VARCHAR) END AS symbol, (o_orderkey % 5)::DOUBLE AS qty, o_totalprice AS px, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'k' END AS ik, o_orderkey % 4 <> 0 AS ok, (o_custkey % 3)::DOUBLE AS held FROM orders),
v AS (SELECT *, qty * px AS value FROM o),
e AS (SELECT *, CAST(mode <> 'paper' AS INT) + CAST(side NOT IN ('BUY', 'SELL') AS INT) + CAST(symbol = '' AS INT) + CAST(qty <= 0 AS INT) + CAST(px <= 0 AS INT) + CAST(ik = '' AS INT) + CAST(side = 'BUY' AND NOT ok AS INT) + CAST(side = 'BUY' AND value > 500000.01 AS INT) + CAST(side = 'BUY' AND value > 400000.01 AS INT)
  + CAST(side = 'SELL' AND held <= 0 AS INT) + CAST(side = 'SELL' AND held > 0 AND qty > held + 1e-7 AS INT) AS n FROM v)
SELECT side, n AS n_errors, count(*) AS n, CASE WHEN n = 0 THEN 'approved-for-audit-only' ELSE 'rejected' END AS status FROM e GROUP BY ALL""")
def order_intents(spark, sf_dir):
    k = F.col("o_orderkey")
    o = tables.table(spark, sf_dir, "orders").select(
        F.lit("US").alias("market"), F.when(k % 3 == 0, "BUY").when(k % 3 == 1, "SELL").otherwise("HOLD").alias("side"), F.when(k % 11 == 0, "live").otherwise("paper").alias("mode"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).alias("symbol"),
        (k % 5).cast("double").alias("qty"), F.col("o_totalprice").alias("limit_price"), F.when(k % 17 == 0, "").otherwise("k").alias("idempotency_key"), (k % 4 != 0).alias("new_orders_allowed"), F.lit(500000.0).alias("available_for_trades"), F.lit(2000000.0).alias("total_capital"), (F.col("o_custkey") % 3).cast("double").alias("held_qty"))
    return op.order_intents(o).groupBy("side", F.size("errors").alias("n_errors"), "status").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES_SQL}, ds AS (SELECT symbol, day, rsi, vr, change5, trend_score AS tr, risk_score AS rk, momentum_score AS cf, factor_quality AS fq FROM scores),
st AS (SELECT symbol, day, unnest([{{'style': 'reversion', 's': 46 + (50 - rsi) * 0.75 + 4 * 2.4 + (cf - 55) * 0.22 + 0.5 * 0.55 + 10 * 0.08}}, {{'style': 'breakout', 's': 35 + (cf - 48) * 0.42 + 4 * 3.1 + (tr - 48) * 0.22 + (vr - 1) * 11 + greatest(0, change5) * 0.45 + 60 * 0.08 + 0.5 * 0.7}},
  {{'style': 'news-flow', 's': 34 + 10 * 0.34 + fq * 0.2 + 55 * 0.12 + 1.5 * 2.6 + (tr - 50) * 0.12 + 0.5 * 0.55}}, {{'style': 'risk-balanced', 's': 28 + cf * 0.24 + 55 * 0.18 + 52 * 0.1 + (rk - 45) * 0.28 + greatest(0, tr - 50) * 0.14 + 10 * 0.08 - greatest(0, 48 - 45) * 0.18}},
  {{'style': 'momentum', 's': 38 + (cf - 50) * 0.5 + 1.5 * 3.2 + 4 * 1.1 + (tr - 50) * 0.24 + (vr - 1) * 8 + 10 * 0.08 + 0.5 * 0.9}}]) AS x FROM ds)
SELECT symbol, day, x.style AS style, {r(score='greatest(0, least(100, x.s))')} FROM st""")
def decision_scores(spark, sf_dir):
    d = indicators.scores(tables.bars(spark, sf_dir))
    fixed = {"max_upside": 4.0, "market_bias": 0.5, "evidence": 10.0, "max_prob": 60.0, "target_prob": 55.0, "final_return": 1.5, "final_prob": 52.0, "downside": 48.0}
    d = d.withColumns({n: F.lit(v) for n, v in fixed.items()} | {"confidence": F.col("momentum_score"), "trend": F.col("trend_score"), "risk": F.col("risk_score"), "factor": F.col("factor_quality")})
    return op.decision_scores(d).select("symbol", "day", "style", r6("score"))


@query(f"""WITH {PREDICTIONS_SQL}, d AS (SELECT p.*, t FROM predictions p, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) v(t) WHERE probability >= t - 1e-9), g AS (SELECT horizon, t, count(*) AS n, sum(actual) AS w, avg(actual_return) AS m FROM d GROUP BY ALL),
k AS (SELECT *, (w + 1.0::DOUBLE) / (n + 2) AS po, m * sqrt(n) AS ob FROM g)
SELECT horizon, t AS threshold, n, {r(posterior='po', objective='ob')}, row_number() OVER (PARTITION BY horizon ORDER BY n >= 20 DESC, po DESC, ob DESC, t) = 1 AS best FROM k""")
def bandit_thresholds(spark, sf_dir):
    out = op.bandit(tables.predictions(spark, sf_dir), ["horizon"], "probability", "actual", "actual_return", (0.5, 0.6, 0.7))
    return out.select("horizon", "threshold", "n", r6("posterior"), r6("objective"), "best")


TERMS = {"positive": ["the", "ing"], "negative": ["xx", "der"]}


@query(f"""WITH h AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'the|ing')) AS p, len(regexp_extract_all(lower(text), 'xx|der')) AS n FROM documents), s AS (SELECT *, greatest(-1, least(1, (p * 0.01 - n * 0.02) / 2)) AS s FROM h)
SELECT doc_id, p::INT AS positive_hits, n::INT AS negative_hits, {r(sentiment='s')}, CASE WHEN s >= 0.5 THEN 'positive' WHEN s <= -0.5 THEN 'negative' ELSE 'neutral' END AS stance FROM s""")
def news_scores(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.news_scores(d, TERMS, {"positive": 0.01, "negative": -0.02}).select("doc_id", "positive_hits", "negative_hits", r6("sentiment"), "stance")


@query(f"""WITH e AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 25 = 0),
d AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / 64) AS d FROM q JOIN e ON q.vec_id <> e.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS k FROM d)
SELECT query, count(*) AS neighbours, {r(label_mean='avg(label)', nearest='min(d)', average='avg(d)')} FROM k WHERE k <= 18 GROUP BY query""")
def knn_neighbors(spark, sf_dir):
    """Every 25th row against all other rows."""
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label", F.lit(1.0).alias("weight"))
    return op.knn(e, e.filter("id % 25 = 0"), 64).select("query", "neighbours", r6("label_mean"), r6("nearest"), r6("average"))


@query(f"""WITH {BARS_SQL}, c AS (SELECT symbol, day, close - lag(close) OVER w AS d, lag(close) OVER w AS p, close FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)), h AS (SELECT symbol, day, coalesce(d, 0) AS change, p FROM c),
z AS (SELECT *, avg(change) OVER w AS m, stddev_pop(change) OVER w AS s FROM h WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT symbol, day, {r('change', score="CASE WHEN m IS NULL THEN 0 ELSE greatest(-3, least(3, (change - m) / CASE WHEN s > 1e-12 THEN s ELSE greatest(1e-6, abs(p) * 0.02) END)) / 3 * CASE WHEN symbol < 'Brand#2' THEN 1 ELSE -1 END END")} FROM z""")
def macro_vintages(spark, sf_dir):
    d = tables.bars(spark, sf_dir).select("symbol", "day", "close")
    return normalize.vintages(d, ["symbol"], "day", "close", F.when(F.col("symbol") < "Brand#2", 1.0).otherwise(-1.0)).select("symbol", "day", r6("change"), r6("score"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS listed, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS delisted FROM orders)
SELECT id, 'listed' AS event_type, listed AS event_day FROM o UNION ALL SELECT id, 'delisted', delisted FROM o WHERE delisted IS NOT NULL""")
def listing_events(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return normalize.listing_events(tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("listed"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 30)).alias("delisted")))


@query("""WITH f AS (SELECT c_nationkey AS nation, o_orderkey // 10 AS accession, CAST(year(o_orderdate) AS INT) AS fy, CAST(quarter(o_orderdate) AS VARCHAR) AS period, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ed, CASE o_orderkey % 2 WHEN 0 THEN 'revenue' ELSE 'income' END AS concept, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT nation, accession, fy, period, ed, max(v) FILTER (WHERE concept = 'revenue') AS revenue, max(v) FILTER (WHERE concept = 'income') AS income FROM f GROUP BY nation, accession, fy, period, ed),
p AS (SELECT w.nation, w.accession, w.fy, w.period, w.ed, arg_max_null(p.revenue, strftime(p.ed, '%Y-%m-%d') || lpad(CAST(p.accession AS VARCHAR), 20, '0')) AS revenue, arg_max_null(p.income, strftime(p.ed, '%Y-%m-%d') || lpad(CAST(p.accession AS VARCHAR), 20, '0')) AS income
  FROM w JOIN w p ON p.nation = w.nation AND p.fy + 1 = w.fy AND p.period = w.period AND (p.ed < w.ed OR (p.ed = w.ed AND p.accession < w.accession)) GROUP BY ALL)
SELECT w.nation, w.accession, w.fy AS fiscal_year, w.period, """ + r(margin="CASE WHEN w.income + w.revenue IS NULL THEN 0 ELSE greatest(-1, least(1, w.income / greatest(1, abs(w.revenue)))) END", revenue_growth="CASE WHEN w.revenue + p.revenue IS NULL THEN 0 ELSE greatest(-1, least(1, (w.revenue - p.revenue) / greatest(1, abs(p.revenue)))) END", income_growth="CASE WHEN w.income + p.income IS NULL THEN 0 ELSE greatest(-1, least(1, (w.income - p.income) / greatest(1, abs(p.income)))) END") + """
FROM w LEFT JOIN p ON p.nation = w.nation AND p.accession = w.accession AND p.fy = w.fy AND p.period = w.period AND p.ed = w.ed""")
def filing_facts(spark, sf_dir):
    d = tables.table(spark, sf_dir, "orders").join(tables.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.select(F.col("c_nationkey").alias("nation"), F.floor(F.col("o_orderkey") / 10).alias("accession"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").cast("string").alias("period"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("event_day"), F.when(F.col("o_orderkey") % 2 == 0, "revenue").otherwise("income").alias("concept"), F.col("o_totalprice").alias("value"))
    out = normalize.filings(d, ["nation"], ("revenue", "income"))
    return out.select("nation", "accession", "fiscal_year", "period", *(r6(F.coalesce(c, F.lit(0.0)), c) for c in ("margin", "revenue_growth", "income_growth")))


@query(f"""WITH {TICKS_SQL}, c AS (SELECT * FROM ticks WHERE price > 0 AND size > 0) SELECT symbol, time_bucket(INTERVAL 15 minutes, ts) AS start, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close, {r(volume='sum(size)', vwap='sum(price * size) / sum(size)')}, count(*) AS trades FROM c GROUP BY ALL""")
def stream_minute_bars(spark, sf_dir):
    """The streaming bars over the rows at rest; a test runs the stream and compares."""
    out = stream.minute_bars(tables.ticks(spark, sf_dir), "15 minutes")
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", r6("volume"), r6("vwap"), "trades")


@query(f"""WITH {TICKS_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) <= INTERVAL 30 minutes THEN 0 ELSE 1 END AS nw FROM ticks WHERE price > 0 AND size > 0), s AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS trades, {r(volume='sum(size)')} FROM s GROUP BY symbol, sid""")
def stream_sessions(spark, sf_dir):
    out = stream.sessions(tables.ticks(spark, sf_dir))
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "trades", r6("volume"))


@query()
def platt_calibration(spark, sf_dir):
    """Intercept and slope of a logistic calibration by model; checked against a direct Newton in the tests."""
    d = tables.predictions(spark, sf_dir).select(F.col("model").alias("group"), clamp("probability", 0.001, 0.999).alias("p"), F.col("actual").cast("double").alias("y")).filter("`group` is not null and y is not null")
    sums = {r["group"]: (r.n, r.sy) for r in d.groupBy("group").agg(F.count("*").alias("n"), F.sum("y").alias("sy")).collect()}  # one row a model
    return spark.createDataFrame([(m, *ab) for m, ab in sorted(selection.fit_platts(d, sums).items())], "model string, intercept double, slope double")


@query()
def stack_weights(spark, sf_dir):
    """Capped weights of four probability models."""
    d = tables.predictions(spark, sf_dir).withColumns({"m1": F.col("probability"), "m2": 1 - F.col("probability"), "m3": F.lit(0.3), "m4": F.col("weight") / 50})
    return spark.createDataFrame(list(models.fit_stack(d, ["m1", "m2", "m3", "m4"], "actual", "weight").items()), "model string, weight double")


@query(f"""WITH {PREDICTIONS_SQL}, g AS (SELECT floor(probability * 1000) AS b, avg(probability) AS x, sum(actual) AS s, count(*) AS n FROM predictions GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY b) AS i FROM g),
seg AS (SELECT j.i AS j, k.i AS k, sum(m.s) / sum(m.n)::DOUBLE AS rt FROM o j JOIN o k ON j.i <= k.i JOIN o m ON m.i BETWEEN j.i AND k.i GROUP BY ALL),
f AS (SELECT i, max(lo) AS v FROM (SELECT o.i, seg.j, min(rt) AS lo FROM o JOIN seg ON seg.j <= o.i AND seg.k >= o.i GROUP BY ALL) GROUP BY i)
SELECT {r(probability='sum(x * n) / sum(n)', rate='max(v)')} FROM f JOIN o ON f.i = o.i GROUP BY round(v, 12)""")
def isotonic_knots(spark, sf_dir):
    """Pooled adjacent violators; the SQL takes the largest of the smallest means around each bin."""
    knots = spark.createDataFrame(models.isotonic(tables.predictions(spark, sf_dir), "probability", "actual"), "probability double, rate double")
    return knots.select(r6("probability"), r6("rate"))


@query()
def walk_forward_backtest(spark, sf_dir):
    """Out-of-sample ridge predictions of each symbol; no row is predicted from labels that overlap it."""
    d = panel.factor_panel(tables.bars(spark, sf_dir), factors=FACTORS)
    return models.walk_forward(d, ["symbol"], list(FACTORS), "label", 5)
