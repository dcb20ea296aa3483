"""Queries on indicators: one row for each bar unless said otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.series import ordered
from tidemark.operators import indicators as op
from tidemark.plans.registry import BARS_SQL, query, r, r6
from tidemark.sources import tables

W = "PARTITION BY symbol ORDER BY day"


def _bars(spark, sf_dir):
    return tables.bars(spark, sf_dir)


def _out(df, *columns):
    return df.select("symbol", "day", *map(r6, columns))


@query(f"WITH {BARS_SQL} SELECT symbol, day, {r(sma5=f'avg(close) OVER ({W} ROWS 4 PRECEDING)', sma20=f'avg(close) OVER ({W} ROWS 19 PRECEDING)', sma50=f'avg(close) OVER ({W} ROWS 49 PRECEDING)')} FROM bars")
def sma_set(spark, sf_dir):
    return _out(op.moving_averages(_bars(spark, sf_dir)), "sma5", "sma20", "sma50")


EMA_SQL = f"""RECURSIVE {BARS_SQL},
n AS (SELECT symbol, day, close, row_number() OVER ({W}) AS rn FROM bars),
e AS (SELECT symbol, rn, close AS ema_fast, close AS ema_slow, 0.0::DOUBLE AS macd_signal FROM n WHERE rn = 1
      UNION ALL
      SELECT n.symbol, n.rn, n.close * (2.0::DOUBLE / 13) + e.ema_fast * (1 - 2.0::DOUBLE / 13), n.close * (2.0::DOUBLE / 27) + e.ema_slow * (1 - 2.0::DOUBLE / 27),
        ((n.close * (2.0::DOUBLE / 13) + e.ema_fast * (1 - 2.0::DOUBLE / 13)) - (n.close * (2.0::DOUBLE / 27) + e.ema_slow * (1 - 2.0::DOUBLE / 27))) * (2.0::DOUBLE / 10) + e.macd_signal * (1 - 2.0::DOUBLE / 10)
      FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
m AS (SELECT n.symbol, n.day, n.close, ema_fast, ema_slow, ema_fast - ema_slow AS macd, macd_signal, ema_fast - ema_slow - macd_signal AS macd_hist FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn)"""


@query(f"WITH {EMA_SQL} SELECT symbol, day, {r('ema_fast', 'ema_slow', 'macd', 'macd_signal', 'macd_hist')} FROM m")
def ema_macd(spark, sf_dir):
    return _out(op.macd(_bars(spark, sf_dir)), "ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist")


RSI_SQL = BARS_SQL + f""",
d AS (SELECT *, close - lag(close) OVER w AS d, coalesce((close / lag(close) OVER w - 1) * 100, 0) AS rp FROM bars WINDOW w AS ({W})),
g AS (SELECT *, coalesce(avg(CASE WHEN d IS NOT NULL THEN greatest(0, d) END) OVER w, 0) AS up, coalesce(avg(CASE WHEN d IS NOT NULL THEN greatest(0, -d) END) OVER w, 0) AS dn,
         avg(greatest(0, rp)) OVER w AS gp, avg(greatest(0, -rp)) OVER w AS lp FROM d WINDOW w AS ({W} ROWS 13 PRECEDING)),
rsi AS (SELECT *, CASE WHEN dn <= 1e-9 THEN CASE WHEN up > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + up / nullif(dn, 0)) END AS rsi, CASE WHEN lp = 0 THEN 100 ELSE 100 - 100 / (1 + gp / nullif(lp, 0)) END AS rsi_pct FROM g)"""


@query(f"WITH {RSI_SQL} SELECT symbol, day, {r('rsi', 'rsi_pct')} FROM rsi")
def rsi14(spark, sf_dir):
    return _out(op.rsi(_bars(spark, sf_dir)), "rsi", "rsi_pct")


ATR_SQL = f"""t0 AS (SELECT *, lag(close) OVER ({W}) AS p FROM bars),
t1 AS (SELECT *, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS tr, CASE WHEN p > 0 THEN greatest(high - low, abs(high - p), abs(low - p)) / p * 100 END AS trp FROM t0),
atr AS (SELECT *, avg(tr) OVER ({W} ROWS 13 PRECEDING) AS atr, coalesce(avg(trp) OVER ({W} ROWS 13 PRECEDING), 0) AS atr_pct FROM t1)"""


@query(f"WITH {BARS_SQL}, {ATR_SQL} SELECT symbol, day, {r('atr', 'atr_pct')} FROM atr")
def atr14(spark, sf_dir):
    return _out(op.true_range(_bars(spark, sf_dir)), "atr", "atr_pct")


VWAP_SQL = f"""vw AS (SELECT symbol, day, sum(tp * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS vwap,
  sum(tp * volume) OVER ({W} ROWS 19 PRECEDING) / sum(volume) OVER ({W} ROWS 19 PRECEDING) AS vwap20 FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))"""


@query(f"WITH {BARS_SQL}, {VWAP_SQL} SELECT symbol, day, {r('vwap', 'vwap20')} FROM vw")
def vwap_set(spark, sf_dir):
    return _out(op.vwap(_bars(spark, sf_dir)), "vwap", "vwap20")


def _change(n: int) -> str:
    return f"coalesce((close - lag(close, {n}) OVER w) / nullif(lag(close, {n}) OVER w, 0) * 100, 0)"


@query(f"WITH {BARS_SQL} SELECT symbol, day, {r(**{f'change{n}': _change(n) for n in (1, 3, 5, 10, 20)})} FROM bars WINDOW w AS ({W})")
def momentum_set(spark, sf_dir):
    return _out(op.momentum(_bars(spark, sf_dir)), "change1", "change3", "change5", "change10", "change20")


@query(f"""WITH {BARS_SQL}, b0 AS (SELECT *, avg(close) OVER w AS middle, coalesce(stddev_pop(close) OVER w, 0) AS sd FROM bars WINDOW w AS ({W} ROWS 19 PRECEDING)),
b1 AS (SELECT *, middle + 2 * sd AS upper, middle - 2 * sd AS lower FROM b0),
b2 AS (SELECT *, CASE WHEN upper > lower THEN (close - lower) / (upper - lower) ELSE 0.5 END AS percent_b, coalesce((upper - lower) / nullif(middle, 0) * 100, 0) AS bandwidth_pct FROM b1),
b3 AS (SELECT *, list(bandwidth_pct) OVER ({W} ROWS 79 PRECEDING) AS ws FROM b2),
b4 AS (SELECT *, len(list_filter(ws, lambda x: x <= bandwidth_pct)) * 100.0::DOUBLE / len(ws) AS rk FROM b3)
SELECT symbol, day, {r('middle', 'upper', 'lower', 'percent_b', 'bandwidth_pct', bandwidth_rank_pct='rk')}, CASE WHEN 100 - rk >= 75 THEN 'squeeze' WHEN rk >= 75 THEN 'expansion' ELSE 'normal' END AS state FROM b4""")
def bollinger(spark, sf_dir):
    df = op.bollinger(_bars(spark, sf_dir))
    return df.select("symbol", "day", *map(r6, ("middle", "upper", "lower", "percent_b", "bandwidth_pct", "bandwidth_rank_pct")), "state")


FLOW_SQL = f"""f0 AS (SELECT *, greatest(high - low, close * 0.0001) AS sp, greatest(1e-9, high - low) AS ti, volume / avg(volume) OVER ({W} ROWS 19 PRECEDING) AS vr,
    coalesce((close / lag(close) OVER ({W}) - 1) * 100, 0) AS rp FROM bars),
flow AS (SELECT *, greatest(-1, least(1, greatest(-1, least(1, (close - open) / sp)) * 0.55 + greatest(-1, least(1, (close - low) / sp * 2 - 1)) * 0.45)) AS imbalance,
    greatest(-1, least(1, ((close - low) / ti - 0.5) * 2 * 0.55 + (close - open) / ti * 0.45)) AS flow, (high + low + close) / 3 * volume AS nt FROM f0)"""


@query(f"""WITH {BARS_SQL}, {FLOW_SQL} SELECT symbol, day, {r('imbalance', 'flow', pressure='avg(imbalance) OVER w', absorption='coalesce(avg(CASE WHEN vr >= 1.6 AND abs(rp) <= 0.45 THEN vr * (1 - abs(rp) / 0.45) END) OVER w, 0)', effort_vs_result='avg(vr / (abs(rp) + 0.25)) OVER w', amihud='coalesce(avg(CASE WHEN nt > 0 THEN abs(rp / 100) / nt END) OVER w, 0) * 1000000')}
FROM flow WINDOW w AS ({W} ROWS 19 PRECEDING)""")
def order_flow(spark, sf_dir):
    """amihud in millionths."""
    df = op.order_flow(_bars(spark, sf_dir)).withColumn("amihud", F.col("amihud") * 1_000_000)
    return _out(df, "imbalance", "flow", "pressure", "absorption", "effort_vs_result", "amihud")


@query(f"""WITH {BARS_SQL}, x AS (SELECT *, max(high) OVER a AS h, min(low) OVER a AS l, max(close) OVER b AS ch, min(close) OVER b AS cl FROM bars WINDOW a AS ({W} ROWS 19 PRECEDING), b AS ({W} ROWS 20 PRECEDING))
SELECT symbol, day, {r(range_pos='(close - l) / greatest(1e-9, h - l)', close_pos='(close - cl) / greatest(1e-9, ch - cl)')} FROM x""")
def range_position(spark, sf_dir):
    return _out(op.range_position(_bars(spark, sf_dir)), "range_pos", "close_pos")


@query(f"""WITH {BARS_SQL}, x AS (SELECT symbol, day, list({{'p': (high + low + close) / 3, 'v': volume}}) OVER ({W} ROWS 19 PRECEDING) AS ws FROM bars),
e AS (SELECT symbol, day, unnest(ws) AS e FROM x), m AS (SELECT symbol, day, e.p AS p, e.v AS v, sum(e.p * e.v) OVER k / sum(e.v) OVER k AS mean FROM e WINDOW k AS (PARTITION BY symbol, day)),
q AS (SELECT symbol, day, sum((p - mean) * (p - mean) * v) / sum(v) AS m2, sum((p - mean) * (p - mean) * (p - mean) * v) / sum(v) AS m3 FROM m GROUP BY ALL)
SELECT symbol, day, round(m3 / power(CASE WHEN m2 > 1e-12 THEN sqrt(m2) ELSE 1 END, 3) + 1e-9, 5) + 0 AS volume_skew FROM q""")
def volume_skew(spark, sf_dir):
    return op.volume_skew(_bars(spark, sf_dir)).select("symbol", "day", r6("volume_skew", digits=5))


@query(f"""WITH {BARS_SQL}, x AS (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s, list(close) OVER w AS ws, close - lag(close, 5) OVER ({W}) AS dl FROM bars WINDOW w AS ({W} ROWS 59 PRECEDING))
SELECT symbol, day, {r(z60='greatest(-6, least(6, (close - m) / CASE WHEN s > 0 THEN s ELSE 1 END))', rank60='CASE WHEN len(ws) <= 1 THEN 0.5 ELSE len(list_filter(ws, lambda x: x <= close))::DOUBLE / len(ws) END', delta5='coalesce(dl, 0)')} FROM x""")
def zscore_rank(spark, sf_dir):
    df = op.rank_pct(op.zscore(_bars(spark, sf_dir), "close", "z60"), "close", "rank60")
    return _out(df.withColumn("delta5", F.coalesce(F.col("close") - F.lag("close", 5).over(ordered(["symbol"], ["day"])), F.lit(0.0))), "z60", "rank60", "delta5")


ALPHA = ("returns", "momentum_5", "momentum_20", "trend_gap_20", "trend_gap_60", "vwap_gap", "volume_ratio_20", "volatility_10", "range_position_20", "macd_hist_pct", "atr_pct_14", "candle_body_pressure", "close_location", "overnight_gap", "intraday_return", "volume_price_impulse")
ALPHA_SQL = f"""{EMA_SQL}, {ATR_SQL}, {VWAP_SQL},
a0 AS (SELECT b.*, m.macd_hist, atr.atr, vw.vwap, volume / avg(volume) OVER (PARTITION BY b.symbol ORDER BY b.day ROWS 19 PRECEDING) AS vr, lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.day) AS pc
       FROM bars b JOIN m ON b.symbol = m.symbol AND b.day = m.day JOIN (SELECT symbol, day, atr FROM atr) atr ON b.symbol = atr.symbol AND b.day = atr.day JOIN vw ON b.symbol = vw.symbol AND b.day = vw.day),
a1 AS (SELECT *, coalesce((close / pc - 1) * 100, 0) AS returns, greatest(high - low, close * 0.0001) AS sp FROM a0),
alpha AS (SELECT symbol, day, market, sector, close, returns, (close / coalesce(lag(close, 5) OVER w, first_value(close) OVER w) - 1) * 100 AS momentum_5, (close / coalesce(lag(close, 20) OVER w, first_value(close) OVER w) - 1) * 100 AS momentum_20,
  (close / avg(close) OVER ({W} ROWS 19 PRECEDING) - 1) * 100 AS trend_gap_20, (close / avg(close) OVER ({W} ROWS 59 PRECEDING) - 1) * 100 AS trend_gap_60, (close / vwap - 1) * 100 AS vwap_gap, vr AS volume_ratio_20,
  coalesce(stddev_pop(returns) OVER ({W} ROWS 9 PRECEDING), 0) AS volatility_10, (close - min(low) OVER ({W} ROWS 19 PRECEDING)) / greatest(1e-9, max(high) OVER ({W} ROWS 19 PRECEDING) - min(low) OVER ({W} ROWS 19 PRECEDING)) AS range_position_20,
  macd_hist / greatest(close, 1e-9) * 100 AS macd_hist_pct, atr / greatest(close, 1e-9) * 100 AS atr_pct_14, (close - open) / sp AS candle_body_pressure, ((close - low) / sp - 0.5) * 2 AS close_location,
  coalesce((open / pc - 1) * 100, 0) AS overnight_gap, (close / open - 1) * 100 AS intraday_return, returns * vr AS volume_price_impulse FROM a1 WINDOW w AS ({W}))"""


@query(f"WITH {ALPHA_SQL} SELECT symbol, day, {r(*ALPHA)} FROM alpha")
def alpha_base_columns(spark, sf_dir):
    return _out(op.alpha_frame(_bars(spark, sf_dir)), *ALPHA)


SCORES_SQL = f"""{EMA_SQL}, {RSI_SQL.split(BARS_SQL + ",")[1]}, {VWAP_SQL}, {FLOW_SQL},
s0 AS (SELECT b.symbol, b.day, b.market, b.sector, b.close, b.volume, m.macd_hist, rsi.rsi, vw.vwap20, flow.flow, avg(b.close) OVER (w ROWS 19 PRECEDING) AS sma20, avg(b.close) OVER (w ROWS 49 PRECEDING) AS sma50,
         CASE WHEN lag(b.close) OVER w IS NULL THEN NULL ELSE (b.close - lag(b.close) OVER w) / lag(b.close) OVER w * 100 END AS r1, coalesce((b.close - lag(b.close, 5) OVER w) / lag(b.close, 5) OVER w * 100, 0) AS change5,
         coalesce((b.close - lag(b.close, 20) OVER w) / lag(b.close, 20) OVER w * 100, 0) AS change20, b.volume / greatest(1, avg(b.volume) OVER (w ROWS 19 PRECEDING)) AS vr,
         sum(flow.flow * b.volume) OVER (w ROWS 4 PRECEDING) / sum(b.volume) OVER (w ROWS 4 PRECEDING) AS bp5
       FROM bars b JOIN m ON b.symbol = m.symbol AND b.day = m.day JOIN (SELECT symbol, day, rsi FROM rsi) rsi ON b.symbol = rsi.symbol AND b.day = rsi.day JOIN vw ON b.symbol = vw.symbol AND b.day = vw.day
            JOIN (SELECT symbol, day, flow FROM flow) flow ON b.symbol = flow.symbol AND b.day = flow.day WINDOW w AS (PARTITION BY b.symbol ORDER BY b.day)),
s1 AS (SELECT *, coalesce(sqrt(avg(r1 * r1) OVER ({W} ROWS 19 PRECEDING)), 0) AS volatility,
         least(100, greatest(0, 50 + CASE WHEN close > sma20 THEN 12 ELSE -9 END + CASE WHEN sma20 > sma50 THEN 11 ELSE -10 END + least(9, greatest(-9, change20 * 0.62)))) AS trend_score,
         least(100, greatest(0, 50 + macd_hist / close * 9200 + (rsi - 50) * 0.55 + least(6, greatest(-6, change5)) * 0.35 + least(3, greatest(-3, change20 * 0.12)))) AS momentum_score FROM s0),
s2 AS (SELECT *, least(100, greatest(0, 82 - volatility * 8)) AS risk_score FROM s1),
scores AS (SELECT *, least(25, greatest(-25, (trend_score - 50) * 0.18 + (momentum_score - 50) * 0.16 + (risk_score - 50) * 0.1 + bp5 * 8 + least(5, greatest(-5, (close - vwap20) / vwap20 * 100)) * 0.45)) AS factor_quality,
         CASE WHEN risk_score < 48 OR abs(change5) >= 8 OR vr >= 3.2 THEN 'volatile' WHEN rsi >= 72 OR (change5 >= 6 AND trend_score >= 60) THEN 'overextended' WHEN trend_score >= 62 AND momentum_score >= 56 AND change20 >= 2 THEN 'uptrend'
           WHEN trend_score <= 42 AND change20 <= -2 THEN 'downtrend' WHEN vr >= 1.35 AND change5 >= 0 AND momentum_score >= 52 THEN 'volume_breakout' ELSE 'range' END AS regime FROM s2)"""


@query(f"WITH {SCORES_SQL} SELECT symbol, day, {r('trend_score', 'momentum_score', 'risk_score', 'factor_quality')}, regime FROM scores")
def technical_scores(spark, sf_dir):
    return op.scores(_bars(spark, sf_dir)).select("symbol", "day", *map(r6, ("trend_score", "momentum_score", "risk_score", "factor_quality")), "regime")


@query(f"WITH {SCORES_SQL} SELECT market, regime, count(*) AS n, {r(mean_trend='avg(trend_score)', mean_factor='avg(factor_quality)')} FROM scores GROUP BY ALL")
def regime_summary(spark, sf_dir):
    return op.scores(_bars(spark, sf_dir)).groupBy("market", "regime").agg(F.count("*").alias("n"), r6(F.avg("trend_score"), "mean_trend"), r6(F.avg("factor_quality"), "mean_factor"))


