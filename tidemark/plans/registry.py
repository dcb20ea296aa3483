"""Where query modules register: name -> function of (spark, sf_dir), and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def r6(column: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded, without negative zeros; the nudge makes both engines agree on exact ties."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c + 1e-9, digits) + 0.0).alias(name or column)


def r(*names: str, **exprs: str) -> str:
    """The same as r6(), as SQL select items."""
    return ", ".join(f"round({e} + 1e-9, 6) + 0 AS {n}" for n, e in [*((n, n) for n in names), *exprs.items()])


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"
TRADES_SQL = f"""
trades AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price, l_quantity AS size, {ORDER_SQL}
           FROM lineitem JOIN part ON l_partkey = p_partkey)"""
MARKET_SQL = "CASE CAST(substr(symbol, 7) AS INT) % 3 WHEN 0 THEN 'ASX' WHEN 1 THEN 'CN' ELSE 'US' END"
#: CTE "bars", the same bars as sources.tables.bars().
BARS_SQL = TRADES_SQL + f""",
bars AS (SELECT {MARKET_SQL} AS market, symbol, 'S' || CAST(CAST(substr(symbol, 7) AS INT) % 5 AS VARCHAR) AS sector, day, open, high, low, close, volume, trade_count FROM (
  SELECT symbol, day, first(price ORDER BY {ORDER_SQL}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {ORDER_SQL}) AS close,
         sum(size) AS volume, count(*) AS trade_count
  FROM trades GROUP BY symbol, day))"""
RAW_SQL = f"""
raw AS (SELECT {MARKET_SQL} AS market, symbol, '1d' AS "interval", strftime(day, '%Y-%m-%d') AS "timestamp",
          CASE WHEN l_linenumber <> 2 THEN p END AS open, p * (0.98 + l_discount) AS high, p * (1 - l_tax) AS low,
          CASE WHEN l_linenumber = 3 THEN 0.0::DOUBLE ELSE p * (1 + (l_linenumber - 4) / 100.0::DOUBLE) END AS close, l_quantity - 2 AS volume,
          CASE l_returnflag WHEN 'A' THEN 'yahoo-asx-daily' WHEN 'N' THEN 'eastmoney-cn' ELSE 'alpaca-us-bars' END AS source,
          strftime(day + CAST(l_suppkey % 5 AS INT), '%Y-%m-%d') AS saved_at, {ORDER_SQL}
        FROM (SELECT *, p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS p FROM lineitem JOIN part ON l_partkey = p_partkey))"""
PIT_SQL = """
pit AS (SELECT o_orderkey AS event_id, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol,
          CASE o_orderkey % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'social' WHEN 2 THEN 'fundamentals' WHEN 3 THEN 'financial_disclosures' ELSE 'macro' END AS dataset,
          CAST(o_orderdate AS DATE) AS event_day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) AS available_day,
          (o_totalprice % 2000) / 1000 - 1 AS sentiment, substr(o_orderpriority, 1, 1) AS series, o_orderstatus <> 'P' AS verified
        FROM orders)"""
TICKS_SQL = """
ticks AS (SELECT 'T' || CAST(user_id % 10 AS VARCHAR) AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_type AS exchange, event_id AS trade_id FROM events)"""
PREDICTIONS_SQL = f"""
predictions AS (SELECT CAST(l_shipdate AS DATE) AS day, l_linestatus AS model, l_linenumber AS horizon, l_discount * 10 AS probability,
                  CAST(l_returnflag = 'R' AS INT) AS actual, CAST(l_returnflag = 'A' AS INT) AS stopped, l_tax * 100 - 4 + l_quantity / 50 AS actual_return,
                  l_discount * 100 - 5 AS predicted_return, l_quantity AS weight, {ORDER_SQL} FROM lineitem)"""
