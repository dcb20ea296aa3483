"""Queries on price structure and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import cost_pct
from tidemark.operators import labels
from tidemark.operators import structure as op
from tidemark.plans.indicator_queries import ATR_SQL, FLOW_SQL
from tidemark.plans.registry import BARS_SQL, query, r, r6
from tidemark.sources import tables

W = "PARTITION BY symbol ORDER BY day"


def _bars(spark, sf_dir):
    return tables.bars(spark, sf_dir)


FVG_SQL = f"""l AS (SELECT *, lag(high, 2) OVER ({W}) AS lh, lag(low, 2) OVER ({W}) AS ll, min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fl, max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fh FROM src),
g AS (SELECT symbol, day, CASE WHEN low > lh THEN 'bullish_fvg' ELSE 'bearish_fvg' END AS kind, CASE WHEN low > lh THEN lh ELSE high END AS gap_low, CASE WHEN low > lh THEN low ELSE ll END AS gap_high,
        CASE WHEN low > lh THEN low - lh ELSE ll - high END / greatest(close, 0.0001) * 100 AS size_pct, coalesce(CASE WHEN low > lh THEN fl <= lh ELSE fh >= ll END, FALSE) AS filled FROM l WHERE low > lh OR high < ll)"""


@query(f"WITH {BARS_SQL}, src AS (SELECT * FROM bars), {FVG_SQL} SELECT symbol, day, kind, {r('gap_low', 'gap_high', 'size_pct')}, filled, CASE WHEN kind = 'bullish_fvg' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * CASE WHEN filled THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS pressure FROM g")
def fair_value_gaps(spark, sf_dir):
    return op.fair_value_gaps(_bars(spark, sf_dir)).select("symbol", "day", "kind", r6("gap_low"), r6("gap_high"), r6("size_pct"), "filled", "pressure")


@query(f"""WITH {BARS_SQL}, src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS b FROM bars) WHERE b <= 60), {FVG_SQL},
n AS (SELECT *, CASE WHEN kind = 'bullish_fvg' THEN 1 ELSE -1 END * CASE WHEN filled THEN 0.35::DOUBLE ELSE 1 END * size_pct AS p, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM g)
SELECT symbol, {r(gap_pressure='greatest(-12, least(12, sum(p)))')}, count(*) AS gaps FROM n WHERE k <= 12 GROUP BY symbol""")
def gap_pressure(spark, sf_dir):
    return op.gap_pressure(_bars(spark, sf_dir)).select("symbol", r6("gap_pressure"), "gaps")


@query(f"""WITH {BARS_SQL}, x AS (SELECT *, max(high) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ph, min(low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS pl, volume / avg(volume) OVER ({W} ROWS 19 PRECEDING) AS vr, row_number() OVER ({W}) AS rn FROM bars),
s AS (SELECT symbol, day, 'buy_side' AS side, ph AS level, (high - ph) / greatest(close, 0.0001) * 100 AS depth_pct, -1 AS sg, vr FROM x WHERE rn > 10 AND high > ph AND close < ph
      UNION ALL SELECT symbol, day, 'sell_side', pl, (pl - low) / greatest(close, 0.0001) * 100, 1, vr FROM x WHERE rn > 10 AND low < pl AND close > pl)
SELECT symbol, day, side, {r('level', 'depth_pct', pressure='sg * depth_pct * greatest(1, vr)')} FROM s""")
def liquidity_sweeps(spark, sf_dir):
    return op.liquidity_sweeps(_bars(spark, sf_dir)).select("symbol", "day", "side", r6("level"), r6("depth_pct"), r6("pressure"))


@query(f"""WITH {BARS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS b FROM bars), k AS (SELECT * FROM l WHERE b <= 60),
h AS (SELECT symbol, first(high ORDER BY high DESC, b DESC) AS sh, first(b ORDER BY high DESC, b DESC) AS hb, first(low ORDER BY low, b DESC) AS sl, first(b ORDER BY low, b DESC) AS lb, first(close ORDER BY b) AS last, count(*) AS lookback FROM k GROUP BY symbol),
v AS (SELECT *, lb > hb AS up, greatest(sh - sl, sh * 0.0001) AS span FROM h),
p AS (SELECT *, CASE WHEN up THEN sh - span * ratio ELSE sl + span * ratio END AS price FROM v, (VALUES (0.236::DOUBLE), (0.382::DOUBLE), (0.5::DOUBLE), (0.618::DOUBLE), (0.786::DOUBLE)) t(ratio)),
d AS (SELECT *, (last / price - 1) * 100 AS dist FROM p)
SELECT symbol, lookback, CASE WHEN up THEN 'upswing' ELSE 'downswing' END AS direction, {r(swing_high='sh', swing_low='sl')}, ratio, {r('price', distance_pct='dist')}, row_number() OVER (PARTITION BY symbol ORDER BY abs(dist), ratio) = 1 AS nearest FROM d""")
def fibonacci(spark, sf_dir):
    return op.fibonacci(_bars(spark, sf_dir)).select("symbol", "lookback", "direction", r6("swing_high"), r6("swing_low"), "ratio", r6("price"), r6("distance_pct"), "nearest")


@query(f"""WITH {BARS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS b FROM bars), k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, (high - low) / greatest(close, 0.0001) * 100 AS wd FROM l WHERE b <= 60),
g AS (SELECT symbol, max(n) AS lookback, max(high) AS h, min(low) AS lo, first(close ORDER BY b) AS last, first(close ORDER BY b DESC) AS fst, avg(volume) FILTER (WHERE n - b < n // 2) AS v1, avg(volume) FILTER (WHERE NOT n - b < n // 2) AS v2, avg(wd) AS w, avg(wd) FILTER (WHERE b <= 12) AS w12 FROM k GROUP BY symbol),
f AS (SELECT *, (last / fst - 1) * 100 AS s, (last - lo) / greatest(h - lo, last * 0.0001) AS p, coalesce(v2 / v1, 1) AS ve, 1 - least(2, greatest(0, w12 / greatest(w, 0.0001))) AS c FROM g)
SELECT symbol, lookback, CASE WHEN s >= 6 AND p >= 0.58 THEN 'markup' WHEN s <= -6 AND p <= 0.42 THEN 'markdown' WHEN abs(s) < 6 AND p <= 0.48 THEN 'accumulation' WHEN abs(s) < 6 AND p >= 0.52 THEN 'distribution' ELSE 'range' END AS phase,
  {r(confidence='least(92, greatest(10, abs(s) * 2.2 + abs(p - 0.5) * 55 + greatest(0, ve - 1) * 12 + greatest(0, c) * 18))', slope_pct='s', range_position='p', volume_expansion='ve', compression='c')} FROM f""")
def wyckoff_phase(spark, sf_dir):
    return op.wyckoff(_bars(spark, sf_dir)).select("symbol", "lookback", "phase", *map(r6, ("confidence", "slope_pct", "range_position", "volume_expansion", "compression")))


@query(f"""WITH {BARS_SQL}, t AS (SELECT *, (high + low + close) / 3 AS tp, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM bars),
w AS (SELECT *, greatest((hi - lo) / 18, greatest(hi, 1) * 0.0001) AS width FROM t), b AS (SELECT *, CAST(greatest(0, least(17, floor((tp - lo) / width))) AS INT) AS bucket FROM w),
g AS (SELECT symbol, bucket, lo, width, round(sum(volume), 4) AS volume, sum(volume * tp) AS notional FROM b GROUP BY ALL),
k AS (SELECT *, sum(volume) OVER (PARTITION BY symbol) AS total, coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bucket) AS rk FROM g)
SELECT symbol, bucket, volume, {r(mean_price='notional / volume', price='lo + (bucket + 0.5) * width', share_pct='volume / total * 100')}, rk = 1 AS poc, before / total < 0.7 AS in_value_area FROM k""")
def volume_profile(spark, sf_dir):
    return op.volume_profile(_bars(spark, sf_dir), ["symbol"]).select("symbol", "bucket", "volume", r6(F.col("notional") / F.col("volume"), "mean_price"), r6("price"), r6("share_pct"), "poc", "in_value_area")


@query(f"""WITH {BARS_SQL}, {FLOW_SQL}, l AS (SELECT symbol, greatest(1.8, avg(vr) + stddev_pop(vr) * 1.2) AS v, greatest(1.2, stddev_pop(rp) * 1.35) AS rt FROM flow GROUP BY symbol),
k AS (SELECT f.symbol, day, rp, vr, imbalance, CASE WHEN rp >= rt AND vr >= v * 0.75 THEN 'breakout' WHEN rp <= -rt AND vr >= v * 0.75 THEN 'selloff' WHEN vr >= v AND abs(rp) >= rt * 0.45 THEN 'volume_shock' END AS kind FROM flow f JOIN l ON f.symbol = l.symbol)
SELECT symbol, day, kind, {r('imbalance', return_pct='rp', volume_ratio='vr')} FROM k WHERE kind IS NOT NULL""")
def anomaly_segments(spark, sf_dir):
    return op.anomalies(_bars(spark, sf_dir)).select("symbol", "day", "kind", r6("imbalance"), r6("return_pct"), r6("volume_ratio"))


REGIME_SQL = f"""p0 AS (SELECT symbol, day, coalesce((close / lag(close) OVER ({W}) - 1) * 100, 0) AS rt FROM bars),
p1 AS (SELECT *, avg(rt) OVER ({W} ROWS 9 PRECEDING) AS dr, coalesce(stddev_pop(rt) OVER ({W} ROWS 19 PRECEDING), 0) AS vo FROM p0),
p2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY vo, day) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM p1),
p3 AS (SELECT *, max(CASE WHEN place = n // 2 + 1 THEN vo END) OVER (PARTITION BY symbol) AS med FROM p2),
states AS (SELECT symbol, day, CASE WHEN vo > med * 1.35 AND dr < 0 THEN 'risk_off_high_vol' WHEN dr > 0.12 THEN 'risk_on_trend' WHEN dr < -0.12 THEN 'bearish_drift' ELSE 'range_mean_reversion' END AS state FROM p3)"""


@query(f"""WITH {BARS_SQL}, {REGIME_SQL}, q AS (SELECT *, lead(state) OVER ({W}) AS next_state FROM states), c AS (SELECT symbol, state, next_state, count(*) AS n FROM q WHERE next_state IS NOT NULL GROUP BY ALL)
SELECT symbol, state, next_state, n, {r(probability='n / sum(n) OVER (PARTITION BY symbol, state)')} FROM c""")
def regime_transitions(spark, sf_dir):
    return op.transitions(op.regime_path(_bars(spark, sf_dir))).select("symbol", "state", "next_state", "n", r6("probability"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT *, (close - lag(close) OVER ({W})) / lag(close) OVER ({W}) AS rt, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS b FROM bars)
SELECT symbol, {r(ewma_annual_pct='sqrt(sum(0.06 * power(0.94::DOUBLE, b - 1) * rt * rt)) * sqrt(252) * 100', parkinson_annual_pct='coalesce(sqrt(avg(power(ln(high / low), 2) / (4 * ln(2))) FILTER (WHERE b <= 120 AND low > 0 AND high > low)) * sqrt(252) * 100, 0)', shock_ratio='coalesce(avg(abs(rt)) FILTER (WHERE b <= 20) / greatest(1e-9, avg(abs(rt)) FILTER (WHERE b > 20 AND b <= 80)), 0)')}
FROM x WHERE b <= 180 GROUP BY symbol""")
def volatility_models(spark, sf_dir):
    return op.volatility(_bars(spark, sf_dir)).select("symbol", r6("ewma_annual_pct"), r6("parkinson_annual_pct"), r6("shock_ratio"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT symbol, ln(close / lag(close) OVER ({W})) AS lg, close / lag(close) OVER ({W}) - 1 AS rt, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS b FROM bars),
g AS (SELECT symbol, avg(lg) AS mu, stddev_pop(lg) AS sg, avg(rt) FILTER (WHERE b <= 80) AS m, var_pop(rt) FILTER (WHERE b <= 80) AS v FROM x WHERE b <= 120 GROUP BY symbol)
SELECT symbol, {r(drift_annual_pct='mu * 25200', expected_pct='(exp(mu * 5) - 1) * 100', p10_pct='(exp((mu - 0.5 * sg * sg) * 5 - 1.281551565545 * sg * sqrt(5)) - 1) * 100', p90_pct='(exp((mu - 0.5 * sg * sg) * 5 + 1.281551565545 * sg * sqrt(5)) - 1) * 100', weight_pct='greatest(-0.25, least(0.35, m * 5 / greatest(v * 5, 1e-8) / 6)) * 100')} FROM g""")
def gbm_forecast(spark, sf_dir):
    return op.gbm_forecast(_bars(spark, sf_dir)).select("symbol", *map(r6, ("drift_annual_pct", "expected_pct", "p10_pct", "p90_pct", "weight_pct")))


@query(f"""WITH {BARS_SQL}, x AS (SELECT *, lead(close, 5) OVER ({W}) AS c5, max(high) OVER n AS hi, min(low) OVER n AS lo, sum((high + low + close) / 3 * volume) OVER n / sum(volume) OVER n AS vw FROM bars WINDOW n AS ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT symbol, day, {r(forward_return='(c5 / close - 1) * 100', forward_vwap_return='(vw / close - 1) * 100', max_upside='(hi / close - 1) * 100', max_drawdown='(lo / close - 1) * 100')} FROM x WHERE c5 IS NOT NULL""")
def forward_labels(spark, sf_dir):
    return labels.forward_returns(_bars(spark, sf_dir), 5).filter("forward_return is not null").select("symbol", "day", *map(r6, ("forward_return", "forward_vwap_return", "max_upside", "max_drawdown")))


BARRIER_SQL = f"""{ATR_SQL}, bar AS (SELECT *, least(greatest(8 * 1.8, 1.5), greatest(greatest(0.6, 8 * 0.55), greatest(8 * 0.55, greatest(0.15, atr_pct) * (2.35 * sqrt(10.0::DOUBLE / 15))))) AS t,
    least(greatest(5 * 1.6, 1.0), greatest(greatest(0.5, 5 * 0.55), greatest(5 * 0.55, greatest(0.15, atr_pct) * (1.65 * sqrt(10.0::DOUBLE / 15))))) AS s,
    lead(open) OVER ({W}) AS entry, row_number() OVER ({W}) AS rn FROM atr)"""


@query(f"WITH {BARS_SQL}, {BARRIER_SQL} SELECT symbol, day, {r(target_pct='t', stop_pct='s')} FROM bar")
def adaptive_barriers(spark, sf_dir):
    return labels.barriers(_bars(spark, sf_dir), 10, 8.0, 5.0).select("symbol", "day", r6("target_pct"), r6("stop_pct"))


@query(f"""WITH {BARS_SQL}, {BARRIER_SQL},
f AS (SELECT a.symbol, a.day, a.market, a.entry, a.t, a.s, b.rn - a.rn AS bar, (b.high - a.entry) / a.entry * 100 AS u, (b.low - a.entry) / a.entry * 100 AS d, b.close AS c FROM bar a JOIN bar b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 10),
g AS (SELECT symbol, day, market, entry, t, s, count(*) AS bars_seen, greatest(0, max(u)) AS up, least(0, min(d)) AS dn, min(CASE WHEN u >= t OR d <= -s THEN bar END) AS event_bar, last((c - entry) / entry * 100 ORDER BY bar) AS rt,
        first(CASE WHEN u >= t AND d <= -s THEN 'ambiguous' WHEN u >= t THEN 'target' ELSE 'stop' END ORDER BY bar) FILTER (WHERE u >= t OR d <= -s) AS event FROM f GROUP BY symbol, day, market, entry, t, s),
h AS (SELECT *, rt - CASE market WHEN 'US' THEN 0.12::DOUBLE WHEN 'ASX' THEN 0.18::DOUBLE ELSE 0.2::DOUBLE END AS net, up >= t AND (NOT dn <= -s OR event = 'target') AS tw, dn <= -s AND (NOT up >= t OR event = 'stop') AS sw FROM g)
SELECT symbol, day, bars_seen::INT AS bars_seen, event, coalesce(event_bar, 0)::INT AS event_bar, {r(max_upside='up', max_drawdown='dn', forward_return='net', risk_adjusted_return='CASE WHEN tw THEN least(up, t) WHEN sw THEN -s ELSE net END')}, tw AS target_wins, sw AS stop_wins FROM h""")
def triple_barrier(spark, sf_dir):
    out = labels.triple_barrier(labels.barriers(_bars(spark, sf_dir), 10, 8.0, 5.0).withColumn("cost", cost_pct("market")), 10, F.col("cost"))
    return out.select("symbol", "day", "bars_seen", "event", F.coalesce("event_bar", F.lit(0)).cast("int").alias("event_bar"), *map(r6, ("max_upside", "max_drawdown", "forward_return", "risk_adjusted_return")), "target_wins", "stop_wins")


@query()
def labelled_rows(spark, sf_dir):
    """Training rows with label confidence; compared with a direct loop in the tests."""
    out = labels.labelled(_bars(spark, sf_dir), 10, 8.0, 5.0, 0.2)
    return out.select("symbol", "day", "y_target", "y_stop", *map(r6, ("confidence", "noise", "path_volatility", "training_weight", "y_return", "y_final", "y_max")), "direction_flips")


@query(f"""WITH {BARS_SQL}, b AS (SELECT * FROM bars WHERE day <= DATE '2001-07-31'), s AS (SELECT o_orderkey AS id, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders),
j AS (SELECT s.id, s.symbol, s.day, b.day AS bd, b.open, b.close, b.high, b.low, CASE WHEN b.day IS NOT NULL THEN row_number() OVER (PARTITION BY s.id ORDER BY b.day) END AS nth FROM s LEFT JOIN b ON s.symbol = b.symbol AND b.day > s.day),
g AS (SELECT id, symbol, day, count(nth) AS bars_seen, first(open ORDER BY nth) AS e, last(close ORDER BY nth) AS c, max(high) AS h, min(low) AS l FROM j WHERE nth IS NULL OR nth <= 10 GROUP BY id, symbol, day)
SELECT id, symbol, day, bars_seen, bars_seen >= 10 AS resolved, {r(forward_return='CASE WHEN bars_seen >= 10 THEN (c - e) / e * 100 END', max_upside='CASE WHEN bars_seen >= 10 THEN (h - e) / e * 100 END', max_drawdown='CASE WHEN bars_seen >= 10 THEN (l - e) / e * 100 END')} FROM g""")
def prediction_maturation(spark, sf_dir):
    """All predictions as they stand on 31 July 2001."""
    orders = tables.table(spark, sf_dir, "orders")
    samples = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), (F.pmod("o_custkey", F.lit(25)) + 1).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("day"))
    out = labels.mature(samples, _bars(spark, sf_dir), 10, F.lit("2001-07-31").cast("date"))
    return out.select("id", "symbol", "day", "bars_seen", "resolved", r6("forward_return"), r6("max_upside"), r6("max_drawdown"))
