"""Queries on point-in-time events and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_week, market_close
from tidemark.operators import pit
from tidemark.operators import trades as op
from tidemark.plans.registry import BARS_SQL, PIT_SQL, TICKS_SQL, query, r, r6
from tidemark.sources import tables

SIGNAL_SQL = f"""{BARS_SQL}, {PIT_SQL}, sig AS (SELECT market, symbol, day FROM bars),
usable AS (SELECT * FROM pit WHERE verified AND available_day >= event_day),
pairs AS (SELECT s.symbol, s.day, e.event_id, e.dataset, e.series, e.event_day, e.available_day, e.sentiment, date_diff('day', e.available_day, s.day) AS age FROM sig s JOIN usable e ON s.symbol = e.symbol AND e.available_day <= s.day AND e.event_day <= s.day
  AND date_diff('day', e.available_day, s.day) <= CASE e.dataset WHEN 'news' THEN 180 WHEN 'social' THEN 21 WHEN 'macro' THEN 120 ELSE 400 END),
c1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, dataset, series ORDER BY available_day DESC, event_id DESC) AS k FROM pairs),
c2 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY symbol, day, dataset ORDER BY available_day DESC, event_id DESC) AS k FROM c1 WHERE dataset <> 'macro' OR k <= 2),
chosen AS (SELECT * FROM c2 WHERE k <= CASE dataset WHEN 'news' THEN 40 WHEN 'social' THEN 16 WHEN 'fundamentals' THEN 12 WHEN 'financial_disclosures' THEN 16 ELSE 24 END)"""


def _signals(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("symbol", "day")


def _events(spark, sf_dir):
    return pit.prepare(tables.pit_events(spark, sf_dir))[0].withColumns({"relevance": F.lit(0.6), "source_quality": F.lit(0.8)})


@query(f"WITH {PIT_SQL} SELECT CASE WHEN NOT verified THEN 'unverified' ELSE 'temporal_order' END AS reason, count(*) AS n FROM pit WHERE NOT verified OR available_day < event_day GROUP BY ALL")
def pit_excluded(spark, sf_dir):
    return pit.prepare(tables.pit_events(spark, sf_dir))[1]


@query(f"WITH {SIGNAL_SQL} SELECT symbol, day, dataset, count(*) AS n, min(age) AS youngest, max(age) AS oldest FROM pairs GROUP BY ALL")
def pit_as_of(spark, sf_dir):
    # usable records are never available before they happened, so those of a day count alike
    days = _events(spark, sf_dir).groupBy("symbol", "dataset", "available_day").agg(F.max("event_day").alias("event_day"), F.count("*").alias("n"))
    pairs = pit.as_of(_signals(spark, sf_dir), days)
    return pairs.groupBy("symbol", "day", "dataset").agg(F.sum("n").alias("n"), F.min("age_days").cast("long").alias("youngest"), F.max("age_days").cast("long").alias("oldest"))


@query(f"WITH {SIGNAL_SQL} SELECT symbol, day, dataset, event_id FROM chosen")
def pit_capped(spark, sf_dir):
    return pit.recent(_signals(spark, sf_dir), _events(spark, sf_dir), ["symbol", "day"]).select("symbol", "day", "dataset", "event_id")


@query(f"""WITH {SIGNAL_SQL}, d AS (SELECT *, exp(-ln(2) * age / CASE dataset WHEN 'news' THEN 24.0 WHEN 'social' THEN 7.0 WHEN 'macro' THEN 30.0 ELSE 45.0 END) AS decay FROM chosen), w AS (SELECT *, decay * 0.6 * 0.8 AS w, least(1, greatest(-1, sentiment)) AS s FROM d),
a AS (SELECT symbol, day, count(*) AS records, sum(s * w) FILTER (WHERE abs(sentiment) > 1e-12) / sum(w) FILTER (WHERE abs(sentiment) > 1e-12) AS sentiment, 1 - exp(sum(ln(1 - least(0.95, greatest(0, least(1, greatest(0, -sentiment)) * w))))) AS risk, tanh(sum(abs(s) * w) / 2.5) AS intensity, max(decay) AS freshness, max(available_day) AS latest_available FROM w GROUP BY ALL)
SELECT sig.symbol, sig.day, coalesce(records, 0) AS records, {r(sentiment='coalesce(sentiment, 0)', risk='coalesce(risk, 0)', intensity='coalesce(intensity, 0)', freshness='coalesce(freshness, 0)')}, 0::BIGINT AS join_violations FROM sig LEFT JOIN a ON sig.symbol = a.symbol AND sig.day = a.day""")
def pit_event_features(spark, sf_dir):
    out = pit.event_features(_signals(spark, sf_dir), _events(spark, sf_dir), ["symbol", "day"])
    return out.select("symbol", "day", "records", r6("sentiment"), r6("risk"), r6("intensity"), r6("freshness"), "join_violations")


@query(f"""WITH {BARS_SQL}, {PIT_SQL}, u AS (SELECT * FROM pit WHERE verified), rc AS (SELECT symbol, event_day AS s, event_day + CAST(event_id % 11 AS INT) AS e FROM u WHERE dataset = 'macro')
SELECT market, symbol, day, EXISTS (SELECT 1 FROM rc WHERE rc.symbol = b.symbol AND b.day BETWEEN rc.s AND rc.e) AS covered FROM bars b""")
def pit_coverage(spark, sf_dir):
    receipts = tables.pit_events(spark, sf_dir).filter("verified and dataset = 'macro'").select("symbol", F.col("event_day").alias("start_day"), F.date_add("event_day", F.pmod("event_id", F.lit(11)).cast("int")).alias("end_day"))
    return pit.covered(tables.bars(spark, sf_dir).select("market", "symbol", "day"), receipts)


@query(f"""WITH {BARS_SQL}, {PIT_SQL}, j AS (SELECT b.symbol, b.day, p.sentiment, p.available_day, row_number() OVER (PARTITION BY b.symbol, b.day ORDER BY p.available_day DESC, p.event_id DESC) AS k FROM bars b LEFT JOIN pit p ON p.symbol = b.symbol AND p.verified AND p.available_day <= b.day)
SELECT symbol, day, coalesce(sentiment, 0) AS sentiment, coalesce(date_diff('day', available_day, day), -1) AS age_days FROM j WHERE k = 1""")
def pit_latest_known(spark, sf_dir):
    out = pit.latest_known(tables.bars(spark, sf_dir).select("symbol", "day"), _events(spark, sf_dir), "sentiment")
    return out.select("symbol", "day", F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"), F.coalesce(F.date_diff("day", "available_day"), F.lit(-1)).cast("long").alias("age_days"))


@query(f"""WITH {BARS_SQL}, {PIT_SQL}, m AS (SELECT DISTINCT market, symbol FROM bars), x AS (SELECT 'US' AS market, event_id, event_day FROM pit WHERE dataset = 'macro' AND event_id % 3 = 0 UNION ALL SELECT 'CN', event_id, event_day FROM pit WHERE dataset = 'macro' AND event_id % 3 = 1 UNION ALL SELECT 'ASX', event_id, event_day FROM pit WHERE dataset = 'macro' AND event_id % 3 = 2)
SELECT m.market, m.symbol, count(*) AS n, min(event_day) AS first_day FROM x JOIN m ON m.market = x.market GROUP BY ALL""")
def pit_macro_fan_out(spark, sf_dir):
    k = F.pmod("event_id", F.lit(3))
    macro = tables.pit_events(spark, sf_dir).filter("dataset = 'macro'").select(F.when(k == 0, "US").when(k == 1, "CN").otherwise("ASX").alias("market"), "event_id", "event_day")
    symbols = tables.bars(spark, sf_dir).select("market", "symbol").distinct()
    return pit.fan_out(macro, symbols).groupBy("market", "symbol").agg(F.count("*").alias("n"), F.min("event_day").alias("first_day"))


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), m(market, zone, minutes) AS (VALUES ('US', 'America/New_York', 960), ('ASX', 'Australia/Sydney', 970), ('CN', 'Asia/Shanghai', 900))
SELECT day, market, CAST(timezone(zone, CAST(day AS TIMESTAMP) + to_minutes(minutes)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS closes_at, CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week FROM d, m""")
def market_sessions(spark, sf_dir):
    days = tables.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    d = days.withColumn("market", F.explode(F.array(F.lit("US"), F.lit("ASX"), F.lit("CN"))))
    return d.select("day", "market", market_close("day", "market").cast("timestamp_ntz").alias("closes_at"), iso_week("day").alias("week"))


T = f"WITH {TICKS_SQL}, clean AS (SELECT *, price * size AS notional FROM ticks WHERE price > 0 AND size > 0)"


@query(f"""{T}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY size) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM clean), l AS (SELECT symbol, greatest(1, max(size)) AS lt FROM s WHERE k = round_even((n - 1) * 0.9, 0) + 1 GROUP BY symbol),
g AS (SELECT c.symbol, count(*) AS trades, sum(size) AS ts_, sum(notional) AS tn, first(price ORDER BY ts, trade_id) AS fp, last(price ORDER BY ts, trade_id) AS lp, epoch_us(max(ts)) - epoch_us(min(ts)) AS du, max(lt) AS lt, count_if(size >= lt) AS large_trades, sum(size) FILTER (WHERE size >= lt) AS ls, count(DISTINCT exchange) AS exchanges FROM clean c JOIN l ON c.symbol = l.symbol GROUP BY c.symbol)
SELECT symbol, trades, {r(total_size='ts_', total_notional='tn', first_price='fp', last_price='lp', duration_s='du / 1e6', large_threshold='lt', vwap='tn / ts_', change_pct='(lp / fp - 1) * 100', large_share_pct='ls / ts_ * 100', average_size='ts_ / trades', rate_per_minute='trades / greatest(1, du / 1e6 / 60)')}, large_trades::BIGINT AS large_trades, exchanges FROM g""")
def trades_summary(spark, sf_dir):
    out = op.totals(tables.ticks(spark, sf_dir), ["symbol"])
    return out.select("symbol", "trades", *map(r6, ("total_size", "total_notional", "first_price", "last_price", "duration_s", "large_threshold", "vwap", "change_pct", "large_share_pct", "average_size", "rate_per_minute")), "large_trades", "exchanges")


@query(f"{T}, g AS (SELECT symbol, exchange, count(*) AS trades, sum(size) AS size, sum(notional) AS notional FROM clean GROUP BY ALL) SELECT symbol, exchange, trades, {r('size', 'notional', share_pct='size / sum(size) OVER (PARTITION BY symbol) * 100')} FROM g")
def exchange_breakdown(spark, sf_dir):
    return op.exchange_breakdown(tables.ticks(spark, sf_dir), ["symbol"]).select("symbol", "exchange", "trades", r6("size"), r6("notional"), r6("share_pct"))


@query(f"""{T}, g AS (SELECT symbol, date_trunc('minute', ts) AS start, count(*) AS trades, sum(size) AS size, sum(notional) AS notional, last(price ORDER BY ts, trade_id) AS last_price FROM clean GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start DESC) AS k FROM g)
SELECT symbol, start, trades, {r('size', 'notional', 'last_price', vwap='notional / size')} FROM k WHERE k <= 120""")
def minute_buckets(spark, sf_dir):
    out = op.buckets(tables.ticks(spark, sf_dir), ["symbol"], last=120)
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "trades", *map(r6, ("size", "notional", "last_price", "vwap")))


SIDE_SQL = f"""{T}, mv AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id)), 0) AS mv FROM clean), sd AS (SELECT *, coalesce(last_value(mv IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING), 0) AS side FROM mv),
lv AS (SELECT symbol, date_trunc('hour', ts) AS start, floor(price / 5) * 5::BIGINT AS level, sum(CASE WHEN side = 1 THEN size ELSE 0 END) AS b, sum(CASE WHEN side = -1 THEN size ELSE 0 END) AS s, sum(CASE WHEN side = 0 THEN size ELSE 0 END) AS n, count(*) AS trades FROM sd GROUP BY ALL)"""


@query(f"{SIDE_SQL} SELECT symbol, start, {r('level', buy_volume='b', sell_volume='s', neutral_volume='n', imbalance='coalesce((b - s) / nullif(b + s, 0), 0)')}, trades FROM lv")
def footprint_bars(spark, sf_dir):
    out = op.footprint(tables.ticks(spark, sf_dir), ["symbol"])
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), *map(r6, ("level", "buy_volume", "sell_volume", "neutral_volume", "imbalance")), "trades")


@query(f"{SIDE_SQL} SELECT symbol, start, {r(poc='first(level ORDER BY b + s + n DESC, level)', imbalance='coalesce((sum(b) - sum(s)) / nullif(sum(b) + sum(s), 0), 0)')}, count(*) AS levels FROM lv GROUP BY symbol, start")
def footprint_levels(spark, sf_dir):
    out = op.level_metrics(op.footprint(tables.ticks(spark, sf_dir), ["symbol"]), ["symbol", "start"])
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), r6("poc"), r6("imbalance"), "levels")


@query(f"""WITH {TICKS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol, exchange, size ORDER BY ts, trade_id) AS k FROM ticks WHERE trade_id % 2 = 1 AND price > 0 AND size > 0), o AS (SELECT DISTINCT symbol, exchange, size FROM ticks WHERE trade_id % 2 = 0)
SELECT symbol, exchange, size, trade_id, price FROM i WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.symbol = i.symbol AND o.exchange = i.exchange AND o.size = i.size)""")
def ticks_insert_new(spark, sf_dir):
    """Even ids are stored, odd ones come in."""
    t = tables.ticks(spark, sf_dir)
    new = op.insert_new(t.filter("trade_id % 2 = 0"), t.filter("trade_id % 2 = 1"), ["symbol", "exchange", "size"], ["ts", "trade_id"], F.col("price") * F.col("size") > 0)
    return new.select("symbol", "exchange", "size", "trade_id", "price")


@query(f"WITH {TICKS_SQL} SELECT symbol, exchange, count(*) AS n, max(ts) AS ts, last(price ORDER BY ts, trade_id) AS price, last(size ORDER BY ts, trade_id) AS size FROM ticks GROUP BY symbol, exchange")
def market_data_summary(spark, sf_dir):
    out = op.market_summary(tables.ticks(spark, sf_dir), ["symbol", "exchange"])
    return out.select("symbol", "exchange", "n", F.col("ts").cast("timestamp_ntz").alias("ts"), "price", "size")


@query(f"""WITH {TICKS_SQL}, v AS (SELECT symbol, date_trunc('day', ts) AS day, ts, price, exchange AS source FROM ticks WHERE trade_id % 4 <> 0 AND price > 0), m AS (SELECT symbol, day, quantile_cont(price, 0.5) AS md FROM v GROUP BY ALL),
n AS (SELECT v.* FROM v JOIN m ON v.symbol = m.symbol AND v.day = m.day WHERE abs(price / md - 1) * 100 <= 40)
SELECT symbol, day, count(*) AS agreeing, last(price ORDER BY ts, source) AS price, max(ts) AS ts, last(source ORDER BY ts, source) AS source FROM n GROUP BY symbol, day""")
def quote_selection(spark, sf_dir):
    q = tables.ticks(spark, sf_dir).select("symbol", F.date_trunc("day", "ts").alias("day"), "ts", "price", F.col("exchange").alias("source"), (F.col("trade_id") % 4 != 0).alias("verified"))
    out = op.best_quote(q, ["symbol", "day"], 40.0)
    return out.select("symbol", F.col("day").cast("timestamp_ntz").alias("day"), "agreeing", "price", F.col("ts").cast("timestamp_ntz").alias("ts"), "source")
