"""Queries on provider rows, keyed records, stores and isolation. Inputs are made from the sample tables by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import PREDICTIONS_SQL, query, r, r6
from tidemark.sources import records, tables


def _input(spark, sf_dir, table: str, exprs: list[str]):
    return tables.table(spark, sf_dir, table).selectExpr(*exprs)


def _sql(table: str, exprs: list[str]) -> str:
    return f"i AS (SELECT {', '.join(exprs)} FROM {table})"


DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
FINANCIALS = [
    "concat('S', CAST(o_custkey AS STRING)) AS symbol", f"CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE {DAY} END AS end_date", f"CASE WHEN o_orderkey % 3 = 0 THEN {DAY} END AS ann_date", f"CASE WHEN o_orderkey % 5 <> 0 THEN {DAY} END AS f_ann_date",
    "CASE WHEN o_orderkey % 7 = 0 THEN '1' END AS update_flag", "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice % 300 - 150 AS STRING) END AS netprofit_margin", "'x' AS grossprofit_margin", "o_totalprice % 90 AS netprofit_yoy", "1.0 AS profit_dedt_yoy",
    "CASE WHEN o_orderkey % 2 = 0 THEN 250.0 END AS or_yoy", "10.0 AS tr_yoy", "o_totalprice % 40 AS roe", "o_totalprice % 70 AS debt_to_assets", "o_totalprice % 3 AS current_ratio",
]


@query(f"""WITH {_sql('orders', FINANCIALS)}
SELECT concat_ws(':', symbol, end_date, coalesce(nullif(ann_date, ''), nullif(f_ann_date, ''), 'initial')) AS id, CAST(end_date AS DATE) AS event_day, CAST(coalesce(f_ann_date, ann_date) AS DATE) AS available_day, coalesce(update_flag, ann_date, 'initial') AS revision,
  {r(margin="coalesce(greatest(-1, least(1, CASE WHEN netprofit_margin IS NOT NULL THEN CAST(netprofit_margin AS DOUBLE) / 100 END)), 0) * CASE WHEN netprofit_margin IS NULL THEN 0 ELSE 1 END", income_growth="least(1, netprofit_yoy / 100)", revenue_growth="least(1, coalesce(or_yoy, tr_yoy) / 100)", return_on_equity="roe / 100", current_ratio="current_ratio")}
FROM i WHERE end_date <> '' AND coalesce(f_ann_date, ann_date) IS NOT NULL""")
def tushare_financials(spark, sf_dir):
    out = records.tushare_financials(_input(spark, sf_dir, "orders", FINANCIALS))
    return out.select("id", "event_day", "available_day", "revision", *map(r6, ("margin", "income_growth", "revenue_growth", "return_on_equity", "current_ratio")))


EAST = [
    "concat('S', CAST(o_custkey AS STRING)) AS symbol", f"{DAY} AS REPORT_DATE", f"CASE WHEN o_orderkey % 3 > 0 THEN {DAY} END AS NOTICE_DATE", "CASE WHEN o_orderkey % 4 = 0 THEN '2001-05-05 10:00:00.000' END AS UPDATE_DATE",
    "o_totalprice % 60 AS XSJLL", "CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE '12.5' END AS XSMLL", "o_totalprice % 20 AS PARENTNETPROFITTZ", "1 AS TOTALOPERATEREVETZ", "2 AS ROEJQ", "3 AS ZCFZL", "4 AS LD", "o_totalprice AS TOTAL_ASSETS_PK",
]


@query(f"""WITH {_sql('orders', EAST)}, c AS (SELECT *, coalesce(UPDATE_DATE, NOTICE_DATE, 'initial') AS ch FROM i WHERE coalesce(UPDATE_DATE, NOTICE_DATE) IS NOT NULL)
SELECT concat_ws(':', symbol, REPORT_DATE, substr(ch, 1, 10)) AS id, CAST(REPORT_DATE AS DATE) AS event_day, CAST(greatest(coalesce(substr(UPDATE_DATE, 1, 10), NOTICE_DATE), coalesce(NOTICE_DATE, substr(UPDATE_DATE, 1, 10))) AS DATE) AS available_day, substr(ch, 1, 19) AS revision,
  {r(margin="XSJLL / 100", gross_margin="coalesce(TRY_CAST(XSMLL AS DOUBLE) / 100, -1)", total_assets="TOTAL_ASSETS_PK")} FROM c""")
def eastmoney_financials(spark, sf_dir):
    out = records.eastmoney_financials(_input(spark, sf_dir, "orders", EAST))
    return out.select("id", "event_day", "available_day", "revision", r6("margin"), r6(F.coalesce("gross_margin", F.lit(-1.0)), "gross_margin"), r6("total_assets"))


CHANGES = ["CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' s' || CAST(o_orderkey % 90 AS STRING) || ' ' END AS old_symbol", "CASE WHEN o_orderkey % 6 = 0 THEN 'alt' END AS symbol_from", "'N' || CAST(o_custkey AS STRING) AS new_symbol", "'' AS symbol_to",
           "CASE WHEN o_orderkey % 5 = 0 THEN 'Name' ELSE '' END AS name", "CAST(NULL AS STRING) AS company_name", f"CASE WHEN o_orderkey % 7 > 0 THEN {DAY} END AS date", "'bad' AS effective_date"]


@query(f"""WITH {_sql('orders', CHANGES)}, c AS (SELECT upper(trim(coalesce(nullif(old_symbol, ''), symbol_from))) AS previous_symbol, upper(new_symbol) AS symbol, coalesce(nullif(name, ''), upper(new_symbol)) AS name, CAST(date AS DATE) AS event_day FROM i)
SELECT concat_ws(':', previous_symbol, symbol, CAST(event_day AS VARCHAR)) AS id, symbol, previous_symbol, name, event_day FROM c WHERE previous_symbol IS NOT NULL AND event_day IS NOT NULL""")
def symbol_changes(spark, sf_dir):
    return records.symbol_changes(_input(spark, sf_dir, "orders", CHANGES)).select("id", "symbol", "previous_symbol", "name", "event_day")


@query("""SELECT 'US:' || upper(c_name) || ':F' || CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 * c_custkey ELSE c_custkey END AS VARCHAR) AS id, upper(c_name) AS symbol, 'F' || CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 * c_custkey ELSE c_custkey END AS VARCHAR) AS figi,
  CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE upper(c_name) END AS name FROM customer WHERE c_custkey % 5 > 0""")
def identifier_maps(spark, sf_dir):
    """One request of two symbols for each customer: itself and one without a response; every fifth response is empty."""
    c, k = tables.table(spark, sf_dir, "customer"), F.col("c_custkey")
    candidate = lambda figi, name, sector: F.struct(F.concat(F.lit("F"), figi.cast("string")).alias("figi"), F.lit(name).alias("name"), F.lit("X").alias("exchange"), F.lit(sector).alias("market_sector"))
    data = F.when(k % 5 == 0, F.array().cast("array<struct<figi:string,name:string,exchange:string,market_sector:string>>")).when(k % 3 == 0, F.array(candidate(k, "", "Index"), candidate(2 * k, "second", "Equity"))).otherwise(F.array(candidate(k, "", "Index")))
    out = records.identifier_maps(c.select(F.lit("US").alias("market"), F.array("c_name", F.lit("other")).alias("symbols"), F.array(F.struct(data.alias("data"))).alias("responses")), F.lit("2024-01-02").cast("date"))
    return out.select("id", "symbol", "figi", "name")


ACTIONS = ["concat('S', CAST(o_custkey % 50 AS STRING)) AS symbol", "o_orderkey AS row_id", f"CASE WHEN o_orderkey % 4 > 0 THEN {DAY} END AS ex_date", "CASE WHEN o_orderkey % 8 = 0 THEN '1999-01-04' END AS date", "'' AS effective_date", "'' AS payment_date", "'' AS record_date",
           "CASE WHEN o_orderkey % 3 = 0 THEN '1994-12-31' END AS declaration_date", "'nothing' AS announcement_date", "CASE WHEN o_orderkey % 5 = 0 THEN 'SPLIT' END AS event_type", "CAST(NULL AS STRING) AS type", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS amount", "0.5 AS dividend", "'2:1' AS ratio", "'' AS split"]


@query(f"""WITH {_sql('orders', ACTIONS)}, c AS (SELECT *, CAST(coalesce(ex_date, date) AS DATE) AS d, lower(coalesce(event_type, 'dividend')) AS k FROM i)
SELECT concat_ws(':', symbol, k, CAST(d AS VARCHAR), CAST(row_id AS VARCHAR)) AS id, k AS event_type, d AS event_day, coalesce(CAST(declaration_date AS DATE), d) AS available_day, {r(amount="coalesce(amount, 0.5)")} FROM c WHERE d IS NOT NULL""")
def corporate_actions(spark, sf_dir):
    return records.corporate_actions(_input(spark, sf_dir, "orders", ACTIONS), "dividend").select("id", "event_type", "event_day", "available_day", r6("amount"))


FACTORS_IN = ["'Brand#' || CAST(o_custkey % 25 + 1 AS STRING) AS symbol", f"CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {DAY} END AS operate_date", "CASE WHEN o_orderkey % 6 = 0 THEN '1997-07-07' END AS divi_date", "'x' AS date", "o_totalprice AS fore", "'' AS back"]


@query(f"""WITH {_sql('orders', FACTORS_IN)}, c AS (SELECT symbol, CAST(coalesce(nullif(operate_date, ''), divi_date) AS DATE) AS d, fore FROM i)
SELECT event_type, symbol, event_day, count(*) AS n, {r(fore="coalesce(sum(fore), 0)")} FROM (SELECT 'adjustment-factor' AS event_type, symbol, d AS event_day, fore FROM c WHERE d IS NOT NULL
UNION ALL SELECT DISTINCT 'coverage', 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR), DATE '1995-01-01', NULL FROM orders) GROUP BY ALL""")
def adjust_factors(spark, sf_dir):
    i = _input(spark, sf_dir, "orders", FACTORS_IN)
    queried = i.select("symbol", F.lit("1995-01-01").cast("date").alias("start_day"), F.lit("2001-12-31").cast("date").alias("end_day")).distinct()
    return records.adjust_factors(i, queried).groupBy("event_type", "symbol", "event_day").agg(F.count("*").alias("n"), F.coalesce(F.sum("fore_factor"), F.lit(0.0)).alias("fore")).withColumn("fore", r6("fore"))


RECORDS = ["CASE o_orderkey % 2 WHEN 0 THEN 'news' ELSE 'macro' END AS dataset", "'US' AS market", "'X' AS exchange", "concat('S', CAST(o_custkey % 20 AS STRING)) AS symbol", "'feed' AS source", "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 1000 AS STRING) END AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 'u' || CAST(o_orderkey AS STRING) ELSE '' END AS url",
           f"CASE WHEN o_orderkey % 11 > 0 THEN {DAY} END AS event_time", f"CASE WHEN o_orderkey % 13 > 0 THEN {DAY} ELSE '' END AS available_at", "CASE WHEN o_orderkey % 4 = 0 THEN 'r2' END AS revision", "CAST(NULL AS STRING) AS first_seen_at", "o_orderkey % 5 > 0 AS verified", "o_orderkey % 10 = 1 AS unverified", "'' AS method"]


@query(f"""WITH {_sql('orders', RECORDS)} SELECT concat_ws(':', dataset, market, exchange, symbol, coalesce(id, nullif(url, '')), available_at, coalesce(revision, 'initial')) AS record_key, verified AND NOT unverified AS verified,
CASE WHEN verified AND NOT unverified THEN 'source-published-timestamp' ELSE 'unverified' END AS method, available_at AS first_seen_at FROM i WHERE event_time IS NOT NULL AND available_at <> ''""")
def keyed_records(spark, sf_dir):
    return records.keyed_records(_input(spark, sf_dir, "orders", RECORDS)).select("record_key", "verified", "method", "first_seen_at")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 100")
def event_log(spark, sf_dir):
    """The newest 100 events; the limit is the feature."""
    return records.newest_rows(tables.table(spark, sf_dir, "events"), F.col("event_type") != "view", ["event_id"], 100).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, ts FROM (SELECT * FROM events WHERE user_id % 10 = 3 ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts, event_id""")
def market_rows(spark, sf_dir):
    """The newest 50 ticks of one symbol in ascending order; the limit is the feature."""
    rows = records.newest_rows(tables.table(spark, sf_dir, "events"), F.col("user_id") % 10 == 3, ["ts", "event_id"], 50)
    return rows.orderBy("ts", "event_id").select("event_id", "ts")


@query("""WITH s AS (SELECT o_custkey % 700 AS k, min(o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 > 0 GROUP BY 1), i AS (SELECT o_orderkey AS id, o_custkey % 700 AS k, min(o_orderkey) OVER (PARTITION BY o_custkey % 700) AS f FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_custkey % 3 > 0))
SELECT i.id, coalesce(s.id, i.f) AS kept_id, s.id IS NOT NULL OR i.id <> i.f AS duplicate FROM i LEFT JOIN s ON s.k = i.k""")
def intent_inserts(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 700).alias("idempotency_key"), "o_custkey")
    stored = (F.col("id") % 2 == 0) & (F.col("o_custkey") % 3 > 0)
    return records.insert_intents(o.filter(stored).drop("o_custkey"), o.filter(~stored).drop("o_custkey")).select("id", "kept_id", "duplicate")


OOF = ["CASE WHEN l_linenumber = 7 THEN 'asx' ELSE 'US' END AS market", "CAST(l_partkey % 200 AS STRING) AS symbol", "CAST(l_shipdate AS DATE) AS day", "l_linenumber % 3 AS horizon", "CAST(l_shipdate AS DATE) AS signal_at", "CASE WHEN l_suppkey % 9 = 0 THEN DATE '2003-01-01' ELSE DATE '1990-01-01' END AS available_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
OOF_SQL = f"""{_sql('lineitem', OOF)}, j AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, horizon ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, row_number() OVER (PARTITION BY symbol, day, horizon, upper(market) = 'US' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ok, upper(market) = 'US' AS own FROM i)"""


def _isolated(spark, sf_dir):
    return records.isolate(_input(spark, sf_dir, "lineitem", OOF), "US", ["symbol", "day", "horizon"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query(f"WITH {OOF_SQL} SELECT symbol, day, horizon, l_orderkey, l_linenumber FROM j WHERE own AND ok = 1")
def oof_isolated(spark, sf_dir):
    return _isolated(spark, sf_dir)[0].select("symbol", "day", "horizon", "l_orderkey", "l_linenumber")


@query(f"""WITH {OOF_SQL} SELECT count(*) AS raw_rows, count_if(own AND ok = 1)::BIGINT AS unique_rows, count_if(k > 1)::BIGINT AS duplicate_rows, count_if(NOT own)::BIGINT AS cross_market_rows, count_if(available_at > signal_at)::BIGINT AS future_rows,
count(DISTINCT CASE WHEN own AND ok = 1 THEN day END) AS days, count(DISTINCT CASE WHEN own AND ok = 1 THEN symbol END) AS symbols FROM j""")
def oof_counts(spark, sf_dir):
    return _isolated(spark, sf_dir)[1]


@query(f"""WITH {PREDICTIONS_SQL}, d AS (SELECT DISTINCT day FROM predictions), p AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) * 10 // count(*) OVER () AS t FROM d),
s AS (SELECT day, t < 6 AS tr, t BETWEEN 6 AND 7 OR day = (SELECT min(day) FROM d) AS va, t > 7 AS te FROM p)
SELECT count_if(tr)::BIGINT AS train_dates, count_if(va)::BIGINT AS validation_dates, count_if(te)::BIGINT AS test_dates, count_if(tr AND va)::BIGINT AS train_validation, count_if(tr AND te)::BIGINT AS train_test, count_if(va AND te)::BIGINT AS validation_test FROM s""")
def split_overlap(spark, sf_dir):
    """A split into tenths of the dates, with the first date put into validation too, which must show."""
    from pyspark.sql import Window

    from tidemark.operators import evidence

    days = tables.predictions(spark, sf_dir).select("day").distinct()
    tenth = F.floor((F.row_number().over(Window.orderBy("day")) - 1) * 10 / F.count("*").over(Window.partitionBy()))
    d = days.withColumn("t", tenth).withColumn("part", F.when(F.col("t") < 6, "train").when(F.col("t") < 8, "validation").otherwise("test")).drop("t")
    first = days.agg(F.min("day").alias("day")).withColumn("part", F.lit("validation"))
    return evidence.split_overlap(d.unionByName(first), "part", "day")
