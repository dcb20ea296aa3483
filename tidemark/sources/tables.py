"""The sample tables as domain inputs: bars, raw candles, ticks, point-in-time events, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import order_key

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_of(symbol: F.Column) -> F.Column:
    """Three markets by the brand's number."""
    return F.element_at(F.array(F.lit("ASX"), F.lit("CN"), F.lit("US")), F.pmod(F.substring(symbol, 7, 9).cast("int"), F.lit(3)) + 1)


def sector_of(symbol: F.Column) -> F.Column:
    return F.concat(F.lit("S"), F.pmod(F.substring(symbol, 7, 9).cast("int"), F.lit(5)).cast("string"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, price, size and the columns that order rows: one row for each lineitem."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("symbol", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), *ORDER)
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV by symbol. Open and close are min_by/max_by over one number, so rows are hashed and nothing is sorted or collected."""
    at = order_key((F.col("l_orderkey") * 8 + F.col("l_linenumber"), 14), ("l_partkey", 12), ("l_suppkey", 11))
    out = trades(spark, sf_dir).groupBy("symbol", "day").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("trade_count"),
    )
    return out.select(market_of(F.col("symbol")).alias("market"), "symbol", sector_of(F.col("symbol")).alias("sector"), "day", "open", "high", "low", "close", "volume", "trade_count")


def raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles with faults, one for each lineitem, to validate and repair."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    p, n = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_linenumber")
    day = F.to_date("l_shipdate")
    source = F.when(F.col("l_returnflag") == "A", "yahoo-asx-daily").when(F.col("l_returnflag") == "N", "eastmoney-cn").otherwise("alpaca-us-bars")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            market_of(F.col("symbol")).alias("market"), "symbol", F.lit("1d").alias("interval"), F.date_format(day, "yyyy-MM-dd").alias("timestamp"),
            F.when(n != 2, p).alias("open"), (p * (0.98 + F.col("l_discount"))).alias("high"), (p * (1 - F.col("l_tax"))).alias("low"),
            F.when(n == 3, F.lit(0.0)).otherwise(p * (1 + (n - 4) / 100.0)).alias("close"), (F.col("l_quantity") - 2).alias("volume"),
            source.alias("source"), F.date_format(F.date_add(day, F.pmod("l_suppkey", F.lit(5)).cast("int")), "yyyy-MM-dd").alias("saved_at"), *ORDER,
        )
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of ten symbols from the events: timestamp, price, size, exchange, trade_id."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), F.pmod("user_id", F.lit(10)).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), F.col("event_type").alias("exchange"), F.col("event_id").alias("trade_id"),
    )


def pit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time records from the orders; each becomes known 0 to 6 days after it happened."""
    k = F.col("o_orderkey")
    dataset = F.element_at(F.array(*map(F.lit, ("news", "social", "fundamentals", "financial_disclosures", "macro"))), F.pmod(k, F.lit(5)).cast("int") + 1)
    return table(spark, sf_dir, "orders").select(
        k.alias("event_id"), F.concat(F.lit("Brand#"), (F.pmod("o_custkey", F.lit(25)) + 1).cast("string")).alias("symbol"), dataset.alias("dataset"),
        F.to_date("o_orderdate").alias("event_day"), F.date_add(F.to_date("o_orderdate"), F.pmod(k, F.lit(7)).cast("int")).alias("available_day"),
        ((F.col("o_totalprice") % 2000) / 1000 - 1).alias("sentiment"), F.substring("o_orderpriority", 1, 1).alias("series"), (F.col("o_orderstatus") != "P").alias("verified"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold rows: probability (11 levels, so there are ties), outcomes and returns."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("horizon"), (F.col("l_discount") * 10).alias("probability"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual"), (F.col("l_returnflag") == "A").cast("int").alias("stopped"),
        (F.col("l_tax") * 100 - 4 + F.col("l_quantity") / 50).alias("actual_return"), (F.col("l_discount") * 100 - 5).alias("predicted_return"),
        F.col("l_quantity").alias("weight"), *ORDER,
    )
