"""Queries on candles: building, validating, repairing, grading, merging, reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import pct_from
from tidemark.functions.series import average_rank, ordered, pearson
from tidemark.operators import bars as op
from tidemark.plans.registry import BARS_SQL, MARKET_SQL, ORDER_SQL, RAW_SQL, query, r6
from tidemark.sources import tables


def flagship(spark, sf_dir: str, min_symbols: int = 8):
    """Daily rank correlation of five-bar momentum with the next five bars' return."""
    w = ordered(["symbol"], ["day"])
    b = tables.bars(spark, sf_dir).select("symbol", "day", "close").withColumns({"past": F.lag("close", 5).over(w), "next": F.lead("close", 5).over(w)})
    b = b.filter("past is not null and next is not null").select("day", pct_from("past", "close").alias("momentum"), pct_from("close", "next").alias("label"))
    ranked = b.withColumns({"a": average_rank("momentum", ["day"]), "b": average_rank("label", ["day"])})
    out = ranked.groupBy("day").agg(F.count("*").alias("symbols"), pearson(F.col("a"), F.col("b")).alias("rank_ic")).filter(F.col("symbols") >= min_symbols)
    return out.select("day", "symbols", r6("rank_ic"))


@query(f"""WITH {BARS_SQL},
s AS (SELECT symbol, day, close, lag(close, 5) OVER w AS past, lead(close, 5) OVER w AS next FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
m AS (SELECT day, (close / past - 1) * 100 AS momentum, (next / close - 1) * 100 AS label FROM s WHERE past IS NOT NULL AND next IS NOT NULL),
r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY momentum) + (count(*) OVER (PARTITION BY day, momentum) - 1) / 2.0::DOUBLE AS a,
             rank() OVER (PARTITION BY day ORDER BY label) + (count(*) OVER (PARTITION BY day, label) - 1) / 2.0::DOUBLE AS b FROM m)
SELECT day, count(*) AS symbols, round(coalesce(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 0) + 1e-9, 6) + 0 AS rank_ic FROM r GROUP BY day HAVING count(*) >= 8""")
def daily_rank_ic(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {BARS_SQL} SELECT market, symbol, sector, day, open, high, low, close, volume, trade_count FROM bars")
def bars_daily(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("market", "symbol", "sector", "day", *op.PRICES, "volume", "trade_count")


REASON_SQL = """CASE WHEN close IS NULL OR close <= 0 THEN 'non_positive_close' WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price'
  WHEN high < low THEN 'high_below_low' WHEN high + 1e-12 < greatest(open, close) THEN 'high_below_open_or_close'
  WHEN low - 1e-12 > least(open, close) THEN 'low_above_open_or_close' WHEN volume < 0 THEN 'negative_volume' END"""


@query(f"WITH {RAW_SQL} SELECT market, coalesce({REASON_SQL}, 'valid') AS reason, count(*) AS n FROM raw GROUP BY ALL")
def candle_validation(spark, sf_dir):
    judged = tables.raw_candles(spark, sf_dir).withColumn("reason", F.coalesce(op.validation_reason(), F.lit("valid")))
    return judged.groupBy("market", "reason").agg(F.count("*").alias("n"))


SANITIZED_SQL = """sane AS (SELECT market, symbol, "timestamp", open, close, greatest(high, open, close) AS high, least(CASE WHEN low > 0 THEN low ELSE least(open, close) END, open, close) AS low,
  greatest(0, volume) AS volume, ORDER FROM (SELECT * REPLACE (coalesce(open, close) AS open) FROM raw WHERE close > 0))""".replace("ORDER FROM", f"{ORDER_SQL} FROM")


@query(f"""WITH {RAW_SQL}, {SANITIZED_SQL}
SELECT symbol, count(*) AS n, round(sum(open), 4) AS open, round(sum(high), 4) AS high, round(sum(low), 4) AS low, round(sum(close), 4) AS close, sum(volume) AS volume FROM sane GROUP BY symbol""")
def candle_sanitize(spark, sf_dir):
    clean = op.sanitize(tables.raw_candles(spark, sf_dir))
    return clean.groupBy("symbol").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 4).alias(c) for c in op.PRICES), F.sum("volume").alias("volume"))


@query(f"""WITH {RAW_SQL}, {SANITIZED_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY market, symbol, "timestamp" ORDER BY {', '.join(c + ' DESC' for c in ORDER_SQL.split(', '))}) AS nth FROM sane)
SELECT market, symbol, "timestamp" AS day, open, high, low, close, volume FROM k WHERE nth = 1""")
def candle_sanitize_daily(spark, sf_dir):
    return op.sanitize_daily(tables.raw_candles(spark, sf_dir), tables.ORDER).select("market", "symbol", "day", *op.PRICES, "volume")


@query(f"""WITH {RAW_SQL},
v AS (SELECT *, market AS exchange FROM raw WHERE {REASON_SQL} IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY market, exchange, symbol, "interval", "timestamp" ORDER BY saved_at DESC NULLS LAST, {', '.join(c + ' DESC' for c in ORDER_SQL.split(', '))}) AS nth FROM v)
SELECT market || ':' || exchange || ':' || symbol || ':' || "interval" || ':' || "timestamp" AS key, saved_at, close, volume FROM k WHERE nth = 1""")
def candle_repair(spark, sf_dir):
    raw = tables.raw_candles(spark, sf_dir).withColumns({"exchange": F.lit(None).cast("string"), "available_at": F.lit(None).cast("string")})
    return op.repair(raw, tables.ORDER).select("key", "saved_at", "close", "volume")


@query(f"""WITH {RAW_SQL},
u AS (SELECT *, CAST(l_tax > 0.04 AS INT) AS side FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY side DESC, {', '.join(c + ' DESC' for c in ORDER_SQL.split(', '))}) AS nth FROM u)
SELECT symbol, "timestamp", side AS incoming, close, volume FROM k WHERE nth = 1""")
def candle_upsert(spark, sf_dir):
    raw = tables.raw_candles(spark, sf_dir).withColumn("incoming", (F.col("l_tax") > 0.04).cast("int"))
    merged = op.merge_latest(raw.filter("incoming = 0"), raw.filter("incoming = 1"), ["symbol", "timestamp"], tables.ORDER)
    return merged.select("symbol", "timestamp", "incoming", "close", "volume")


@query(f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS nth FROM bars)
SELECT symbol, day, close FROM k WHERE nth <= 50""")
def bars_newest(spark, sf_dir):
    """Newest 50 bars of each symbol."""
    return op.newest(tables.bars(spark, sf_dir), ["symbol"], [F.desc("day")], 50).select("symbol", "day", "close")


@query(f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS nth, count(*) OVER (PARTITION BY symbol) AS c FROM bars)
SELECT symbol, day, close FROM k WHERE nth <= 1300 AND least(c, 1300) >= 1290""")
def bars_panel(spark, sf_dir):
    """The newest 1300 bars of symbols that have at least 1290."""
    return op.panel(tables.bars(spark, sf_dir), ["symbol"], [F.desc("day")], 1300, 1290).select("symbol", "day", "close")


@query(f"""WITH {BARS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
p AS (SELECT DISTINCT symbol, (i * n) // 100 AS pos FROM (SELECT DISTINCT symbol, n FROM k), range(100) t(i) WHERE n > 100)
SELECT k.symbol, day, close FROM k LEFT JOIN p ON k.symbol = p.symbol AND k.pos = p.pos WHERE n <= 100 OR p.pos IS NOT NULL""")
def bars_evenly_spaced(spark, sf_dir):
    """100 evenly spaced bars of each symbol."""
    return op.evenly_spaced(tables.bars(spark, sf_dir), ["symbol"], ["day"], 100).select("symbol", "day", "close")


QUALITY_SQL = BARS_SQL + """,
q0 AS (SELECT *, lag(close) OVER w AS prev, avg(volume) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) AS v20, date_diff('day', lag(day) OVER w, day) AS gap, row_number() OVER w AS rn
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
q1 AS (SELECT *, CASE WHEN prev IS NULL OR prev = 0 THEN 0 ELSE (close - prev) / prev * 100 END AS chg, coalesce(abs(close - prev) <= greatest(1e-9, prev * 0.00002), FALSE) AS still FROM q0),
q2 AS (SELECT *, rn - max(CASE WHEN NOT still THEN rn END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS streak FROM q1),
q3 AS (SELECT *, least(100, greatest(5, 100 - CASE WHEN close <= 0 OR open <= 0 THEN 70 ELSE 0 END - CASE WHEN high < greatest(open, close) OR low > least(open, close) OR low <= 0 THEN 35 ELSE 0 END
         - CASE WHEN volume <= 0 THEN 12 WHEN v20 > 0 AND volume / greatest(1, v20) > 12 THEN 8 ELSE 0 END - CASE WHEN prev IS NOT NULL AND abs(chg) >= 35 THEN 45 WHEN prev IS NOT NULL AND abs(chg) >= 18 THEN 20 ELSE 0 END
         - CASE WHEN streak >= 4 AND volume <= greatest(1, v20) * 0.15 THEN 18 ELSE 0 END - CASE WHEN gap > 10 THEN 10 ELSE 0 END))::DOUBLE AS score,
         CASE WHEN v20 > 0 THEN volume / greatest(1, v20) ELSE 0 END AS vr FROM q2)"""


@query(f"WITH {QUALITY_SQL} SELECT symbol, day, score, round(greatest(0.12, least(1, score / 100)) + 1e-9, 6) AS sample_weight, round(chg + 1e-9, 6) AS return_pct, round(vr + 1e-9, 6) AS volume_ratio20 FROM q3")
def candle_quality(spark, sf_dir):
    return op.quality(tables.bars(spark, sf_dir), ["symbol"]).select("symbol", "day", "score", r6("sample_weight"), r6("return_pct"), r6("volume_ratio20"))


@query(f"""WITH {QUALITY_SQL}, g AS (SELECT market, count(*) AS row_count, avg(score) AS a, min(score) AS min_score, count_if(score >= 82) * 100.0::DOUBLE / count(*) AS h, count_if(score < 65) * 100.0::DOUBLE / count(*) AS d FROM q3 GROUP BY market)
SELECT market, row_count, round(a + 1e-9, 6) AS avg_score, min_score, round(h + 1e-9, 6) AS high_quality_pct, round(d + 1e-9, 6) AS degraded_pct, CASE WHEN a >= 88 AND d <= 4 THEN 'high' WHEN a >= 74 THEN 'usable' ELSE 'degraded' END AS grade FROM g""")
def candle_quality_summary(spark, sf_dir):
    scored = op.quality(tables.bars(spark, sf_dir), ["symbol"])
    return op.quality_summary(scored, ["market"]).select("market", "row_count", r6("avg_score"), "min_score", r6("high_quality_pct"), r6("degraded_pct"), "grade")


@query(f"""WITH {QUALITY_SQL}, f AS (SELECT market, unnest([CASE WHEN abs(chg) >= 35 AND prev IS NOT NULL THEN 'possible_split_or_provider_jump' WHEN abs(chg) >= 18 AND prev IS NOT NULL THEN 'extreme_return' END,
  CASE WHEN gap > 10 THEN 'large_calendar_gap' END, CASE WHEN volume > 0 AND v20 > 0 AND volume / greatest(1, v20) > 12 THEN 'volume_spike' END, CASE WHEN streak >= 4 AND volume <= greatest(1, v20) * 0.15 THEN 'stale_close_low_volume' END]) AS flag FROM q3)
SELECT market, flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY ALL""")
def candle_issue_counts(spark, sf_dir):
    return op.issue_counts(op.quality(tables.bars(spark, sf_dir), ["symbol"]), ["market"])


@query(f"""WITH {BARS_SQL} SELECT market, symbol, count(*) AS row_count, min(day) AS first_day, max(day) AS last_day, count_if(volume > 0)::BIGINT AS traded_days FROM bars GROUP BY ALL""")
def lake_summary(spark, sf_dir):
    return op.summary(tables.bars(spark, sf_dir))


@query(f"""WITH {RAW_SQL}, s AS (SELECT *, lower(source) AS s FROM raw),
f AS (SELECT symbol, source, market, NOT (market = 'ASX' AND regexp_matches(s, 'alpaca|nasdaq-us|tiingo-us|-us-')) AND NOT (market = 'US' AND regexp_matches(s, 'stockanalysis-asx|tiingo-asx|eodhd-asx|yahoo-asx|-asx-'))
  AND (market <> 'CN' OR regexp_matches(s, 'cn|tushare|baostock|tencent|eastmoney|sina')) AS fits FROM s)
SELECT symbol, source, count(*) AS row_count, CASE WHEN NOT bool_and(fits) THEN 'foreign_source' WHEN symbol IN ('Brand#1', 'Brand#2') THEN 'unknown_symbol' ELSE 'ok' END AS status FROM f GROUP BY symbol, source""")
def lake_audit(spark, sf_dir):
    raw = tables.raw_candles(spark, sf_dir)
    return op.audit(raw, ["symbol", "source"], raw.select("market", "symbol").filter("symbol not in ('Brand#1', 'Brand#2')"))


@query(rf"""WITH c AS (SELECT p_partkey, {MARKET_SQL.replace('symbol', 'p_brand')} AS market, CASE p_partkey % 4 WHEN 0 THEN CAST(600000 + p_partkey AS VARCHAR) WHEN 1 THEN ' bhp' || CAST(p_partkey % 7 AS VARCHAR) || '.ax' WHEN 2 THEN 'sh.' || CAST(600000 + p_partkey AS VARCHAR) ELSE 'A..B' END AS raw FROM part),
u AS (SELECT *, upper(trim(raw)) AS s FROM c),
v AS (SELECT *, CASE market WHEN 'ASX' THEN regexp_replace(s, '\.AX$', '') WHEN 'CN' THEN regexp_replace(replace(s, '.', ''), '^(SH|SZ)(\d{{6}})$', '\2') ELSE s END AS t FROM u)
SELECT p_partkey, market, raw, CASE WHEN regexp_full_match(t, '[A-Z0-9._^-]{{1,32}}') AND NOT contains(t, '..') AND t <> '.' AND (regexp_full_match(t, '\d{{6}}') = (market = 'CN')) THEN t END AS symbol,
  CASE market WHEN 'ASX' THEN 'ASX' WHEN 'CN' THEN CASE WHEN regexp_matches(t, '^(5|6|9|SH)') THEN 'SSE' ELSE 'SZSE' END ELSE 'US' END AS exchange FROM v""")
def symbol_canonical(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, (k + 600000).cast("string")).when(k % 4 == 1, F.concat(F.lit(" bhp"), (k % 7).cast("string"), F.lit(".ax"))).when(k % 4 == 2, F.concat(F.lit("sh."), (k + 600000).cast("string"))).otherwise("A..B")
    part = tables.table(spark, sf_dir, "part").select("p_partkey", tables.market_of(F.col("p_brand")).alias("market"), raw.alias("raw"))
    clean = F.upper(F.trim("raw"))
    stored = F.when(F.col("market") == "CN", F.regexp_replace(F.replace(clean, F.lit("."), F.lit("")), r"^(SH|SZ)(\d{6})$", "$2")).otherwise(clean)
    return part.select("p_partkey", "market", "raw", op.canonical_symbol(F.col("raw"), F.col("market")).alias("symbol"), op.exchange_of(stored, F.col("market")).alias("exchange"))


@query(f"""WITH {RAW_SQL}, a AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN close * (1 - l_discount) END AS adj FROM raw), b AS (SELECT *, CASE WHEN adj > 0 THEN adj ELSE close END AS c FROM a)
SELECT symbol, CASE WHEN adj > 0 AND close > 0 AND abs(adj - close) / close > 1e-8 THEN 'split-dividend-adjusted' ELSE 'provider-adjusted' END AS adjustment, count(*) AS n, round(sum(high * c / close), 4) AS high, round(sum(c), 4) AS close
FROM b WHERE c > 0 GROUP BY ALL""")
def candle_adjust(spark, sf_dir):
    raw = tables.raw_candles(spark, sf_dir).withColumn("adj_close", F.when(F.col("l_linenumber") % 2 == 0, F.col("close") * (1 - F.col("l_discount"))))
    return op.adjust_prices(raw).groupBy("symbol", "adjustment").agg(F.count("*").alias("n"), F.round(F.sum("high"), 4).alias("high"), F.round(F.sum("close"), 4).alias("close"))


@query(f"""WITH {BARS_SQL},
u AS (SELECT symbol, day, close, 0 AS rank FROM bars UNION ALL SELECT symbol, day, close * 1.01, 1 FROM bars WHERE dayofmonth(day) <= 15 UNION ALL SELECT symbol, day, open, 2 FROM bars WHERE dayofmonth(day) = 7),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY rank DESC) AS nth FROM u)
SELECT symbol, day, close FROM k WHERE nth = 1""")
def source_precedence(spark, sf_dir):
    """Snapshot, cache and live candles: the later source wins for each day."""
    b = tables.bars(spark, sf_dir).select("symbol", "day", "open", "close")
    frames = [b.select("symbol", "day", "close"), b.filter(F.dayofmonth("day") <= 15).select("symbol", "day", (F.col("close") * 1.01).alias("close")), b.filter(F.dayofmonth("day") == 7).select("symbol", "day", F.col("open").alias("close"))]
    return op.precedence_merge(frames, ["symbol", "day"]).select("symbol", "day", "close")
