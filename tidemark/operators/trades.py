"""Trades: cleaning, totals, breakdowns, bars and footprints, quotes, market-row deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import moment_key
from tidemark.operators.metrics import order_statistic


def sanitize(df: DataFrame) -> DataFrame:
    """Trades with positive price and size, with their notional."""
    return df.filter((F.col("price") > 0) & (F.col("size") > 0)).withColumn("notional", F.col("price") * F.col("size"))


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group. Large trades have at least the size at the nearest rank of 0.9 (half to even)."""
    d = sanitize(df)
    at = moment_key()
    limit = order_statistic(d, by, F.col("size"), F.bround((F.col("n_") - 1) * 0.9, 0) + 1, "limit_").withColumn("large_threshold", F.greatest(F.lit(1.0), F.col("limit_"))).drop("limit_")
    # the limits are one row a group; Spark broadcasts them only if they are small
    g = d.join(limit, by).groupBy(*by).agg(
        F.count("*").alias("trades"), F.sum("size").alias("total_size"), F.sum("notional").alias("total_notional"), F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration_s"), F.max("large_threshold").alias("large_threshold"), F.count_if(F.col("size") >= F.col("large_threshold")).alias("large_trades"),
        F.sum(F.when(F.col("size") >= F.col("large_threshold"), F.col("size"))).alias("large_"), F.count_distinct("exchange").alias("exchanges"),
    )
    return g.withColumns({
        "vwap": F.col("total_notional") / F.col("total_size"), "change_pct": (F.col("last_price") / F.col("first_price") - 1) * 100, "large_share_pct": F.col("large_") / F.col("total_size") * 100,
        "average_size": F.col("total_size") / F.col("trades"), "rate_per_minute": F.col("trades") / F.greatest(F.lit(1.0), F.col("duration_s") / 60),
    }).drop("large_")


def exchange_breakdown(df: DataFrame, by: list[str]) -> DataFrame:
    g = sanitize(df).groupBy(*by, F.coalesce(F.nullif("exchange", F.lit("")), F.lit("unknown")).alias("exchange")).agg(F.count("*").alias("trades"), F.sum("size").alias("size"), F.sum("notional").alias("notional"))
    return g.withColumn("share_pct", F.col("size") / F.sum("size").over(Window.partitionBy(*by)) * 100)


def buckets(df: DataFrame, by: list[str], width: str = "1 minute", last: int | None = None) -> DataFrame:
    """Tumbling bars of trades: the same expression serves streams. last keeps each group's newest buckets."""
    g = sanitize(df).groupBy(*by, F.window("ts", width).alias("w_")).agg(F.count("*").alias("trades"), F.sum("size").alias("size"), F.sum("notional").alias("notional"), F.max_by("price", moment_key()).alias("last_price"))
    out = g.select(*by, F.col("w_.start").alias("start"), "trades", "size", "notional", (F.col("notional") / F.col("size")).alias("vwap"), "last_price")
    if last is None:
        return out
    return out.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("start")))).filter(F.col("k_") <= last).drop("k_")


def sides(df: DataFrame, by: list[str]) -> DataFrame:
    """side by the tick rule: the sign of the last price change that was not 0; 0 before any."""
    w = Window.partitionBy(*by).orderBy("ts", "trade_id")
    move = F.signum(F.col("price") - F.lag("price").over(w))
    d = sanitize(df).withColumn("move_", F.nullif(move, F.lit(0.0)))
    return d.withColumn("side", F.coalesce(F.last("move_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).cast("int")).drop("move_")


def footprint(df: DataFrame, by: list[str], width: str = "1 hour", step: float = 5.0) -> DataFrame:
    """Buy and sell volume at each price level of each bar, and the level's imbalance."""
    d = sides(df, by).withColumn("level", F.floor(F.col("price") / step) * step)
    vol = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    g = d.groupBy(*by, F.window("ts", width).alias("w_"), "level").agg(vol(1).alias("buy_volume"), vol(-1).alias("sell_volume"), vol(0).alias("neutral_volume"), F.count("*").alias("trades"))
    both = F.col("buy_volume") + F.col("sell_volume")
    return g.select(*by, F.col("w_.start").alias("start"), "level", "buy_volume", "sell_volume", "neutral_volume", "trades", F.coalesce(F.try_divide(F.col("buy_volume") - F.col("sell_volume"), both), F.lit(0.0)).alias("imbalance"))


def level_metrics(levels: DataFrame, by: list[str]) -> DataFrame:
    """Point of control (ties: the lower price) and imbalance of each bar's levels."""
    volume = F.col("buy_volume") + F.col("sell_volume") + F.col("neutral_volume")
    g = levels.withColumn("v_", volume).groupBy(*by).agg(F.min(F.struct((-F.col("v_")).alias("v"), F.col("level").alias("level"))).alias("p"), F.sum("buy_volume").alias("b"), F.sum("sell_volume").alias("s"), F.count("*").alias("levels"))
    return g.select(*by, F.col("p.level").alias("poc"), F.coalesce(F.try_divide(F.col("b") - F.col("s"), F.col("b") + F.col("s")), F.lit(0.0)).alias("imbalance"), "levels")


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], valid: Column) -> DataFrame:
    """Valid incoming rows whose key is neither stored nor seen earlier among them; null keys are equal."""
    first = incoming.filter(valid).withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("k_ = 1").drop("k_")
    old = existing.select(*(F.col(k).alias(f"old_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"old_{k}"))
    return first.join(old, on, "left_anti")


def market_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and the latest row of each group, without a sort."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.max_by(c, moment_key()).alias(c) for c in ("ts", "price", "size")))


def best_quote(quotes: DataFrame, by: list[str], tolerance_pct: float = 3.0) -> DataFrame:
    """The freshest verified quote within tolerance of the median of all verified ones, and how many agree."""
    d = quotes.filter("verified and price > 0")
    med = d.groupBy(*by).agg(F.percentile("price", 0.5).alias("median"))
    near = d.join(med, by).filter(F.abs(F.col("price") / F.col("median") - 1) * 100 <= tolerance_pct)
    return near.groupBy(*by).agg(F.count("*").alias("agreeing"), F.max_by(F.struct("price", "ts", "source"), F.struct("ts", "source")).alias("x")).select(*by, "agreeing", "x.*")
