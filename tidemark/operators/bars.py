"""Candles: validation, repair, quality, merging, newest-first reading, panels, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, number, pct_change
from tidemark.functions.series import ordered, trailing

PRICES = ("open", "high", "low", "close")

#: Words in a source's name that contradict a market; for CN, one of the words is needed. Fixed values.
FOREIGN = {"ASX": ("alpaca", "nasdaq-us", "tiingo-us", "-us-"), "US": ("stockanalysis-asx", "tiingo-asx", "eodhd-asx", "yahoo-asx", "-asx-")}
CN_SOURCES = ("cn", "tushare", "baostock", "tencent", "eastmoney", "sina")


def canonical_symbol(symbol: Column, market: Column) -> Column:
    """The symbol as stored; null where it is not one of its market."""
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    s = F.when(market == "ASX", F.regexp_replace(s, r"\.AX$", "")).when(market == "CN", F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"^(SH|SZ)(\d{6})$", "$2")).otherwise(s)
    six = s.rlike(r"^\d{6}$")
    fine = s.rlike(r"^[A-Z0-9._^-]{1,32}$") & ~s.contains("..") & (s != ".") & F.when(market == "CN", six).otherwise(~six)
    return F.when(fine, s)


def exchange_of(symbol: Column, market: Column, explicit: Column | None = None) -> Column:
    given = F.nullif(F.substring(F.upper(F.trim(F.coalesce(explicit, F.lit("")) if explicit is not None else F.lit(""))), 1, 16), F.lit(""))
    return F.coalesce(given, F.when(market == "ASX", "ASX").when(market == "CN", F.when(symbol.rlike("^(5|6|9|SH)"), "SSE").otherwise("SZSE")).otherwise("US"))


def source_fits(source: Column, market: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    foreign = F.lit(False)
    for name, words in FOREIGN.items():
        foreign = foreign | ((market == name) & s.rlike("|".join(words)))
    return (s != "") & ~foreign & ((market != "CN") | s.rlike("|".join(CN_SOURCES)))


def adjust_prices(df: DataFrame) -> DataFrame:
    """Scales prices to adj_close where there is one; volume stays."""
    raw, adjusted = number("close", None), number("adj_close", None)
    close = F.when(adjusted > 0, adjusted).otherwise(raw)
    scale = F.when(raw > 0, close / raw).otherwise(F.lit(1.0))
    moved = (adjusted > 0) & (raw > 0) & (F.abs(adjusted - raw) / F.when(raw > 0, raw) > 1e-8)
    return df.filter(close > 0).withColumns({
        "open": number("open", None) * scale, "high": number("high", None) * scale, "low": number("low", None) * scale, "close": close,
        "adjustment": F.when(moved, "split-dividend-adjusted").otherwise("provider-adjusted"),
    })


def validation_reason(tolerance: float = 1e-12) -> Column:
    """The first rule that a candle breaks, or null."""
    o, h, lo, c, v = (number(x, None) for x in (*PRICES, "volume"))
    return F.coalesce(
        F.when(c.isNull() | (c <= 0), "non_positive_close"),
        F.when(F.least(o, h, lo, c) <= 0, "non_positive_price"),
        F.when(h < lo, "high_below_low"),
        F.when(h + tolerance < F.greatest(o, c), "high_below_open_or_close"),
        F.when(lo - tolerance > F.least(o, c), "low_above_open_or_close"),
        F.when(v < 0, "negative_volume"),
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason)."""
    judged = df.withColumn("reason", validation_reason())
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def sanitize(df: DataFrame) -> DataFrame:
    """Drops rows without a close, fills the open, makes high and low hold open and close."""
    c = number("close")
    o = F.coalesce(F.nullif(number("open", None), F.lit(0.0)), c)
    low = number("low", None)
    return df.filter(c > 0).withColumns({
        "close": c, "open": o, "high": F.greatest(F.coalesce(number("high", None), c), o, c),
        "low": F.least(F.when(low > 0, low).otherwise(F.least(o, c)), o, c), "volume": F.greatest(F.lit(0.0), number("volume")),
    })


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order. Null keys are equal."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")


def sanitize_daily(df: DataFrame, order: list[str]) -> DataFrame:
    """sanitize(), then the last row of each day."""
    day = F.substring("timestamp", 1, 10)
    clean = sanitize(df).withColumn("day", day).filter(F.length("day") >= 8)
    return latest_by(clean, ["market", "symbol", "day"], [F.desc("timestamp"), *map(F.desc, order)])


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: incoming rows replace existing ones of the same key; the last in order wins in each."""
    both = existing.withColumn("side_", F.lit(0)).unionByName(incoming.withColumn("side_", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, [F.desc("side_"), *map(F.desc, order)]).drop("side_")


def repair(df: DataFrame, order: list[str]) -> DataFrame:
    """Valid rows, one for each identity: the newest saved_at, then available_at; with a rebuilt key."""
    good, _ = split_valid(df)
    exchange = F.coalesce("exchange", "market")
    kept = latest_by(good.withColumn("exchange", exchange), ["market", "exchange", "symbol", "interval", "timestamp"], [F.desc_nulls_last("saved_at"), F.desc_nulls_last("available_at"), *map(F.desc, order)])
    return kept.withColumn("key", F.concat_ws(":", "market", "exchange", "symbol", "interval", "timestamp"))


def newest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n last rows of each group (first in the given descending order)."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("nth_") <= n).drop("nth_")


def panel(df: DataFrame, by: list[str], order: list[Column], limit: int, min_rows: int) -> DataFrame:
    """newest() of the groups that have at least min_rows of them."""
    kept = newest(df, by, order, limit)
    return kept.withColumn("rows_", F.count("*").over(Window.partitionBy(*by))).filter(F.col("rows_") >= min_rows).drop("rows_")


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows number floor(i n / limit) of each group in order; all of them if there are no more."""
    at = F.row_number().over(ordered(by, order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    # row `at` is taken if some i maps to it: the smallest i with floor(i n / limit) >= at
    i = F.ceil(F.col("at_") * limit / F.col("n_"))
    chosen = (F.col("n_") <= limit) | ((i < limit) & (F.floor(i * F.col("n_") / limit) == F.col("at_")))
    return df.withColumns({"at_": at.cast("long"), "n_": n}).filter(chosen).drop("at_", "n_")


def quality(df: DataFrame, by: list[str], order: str = "day") -> DataFrame:
    """score (5 to 100), sample_weight and flags of every candle; low scores weigh less, nothing is deleted."""
    w = ordered(by, [order])
    c, o, h, lo, v = F.col("close"), F.coalesce("open", "close"), F.coalesce("high", F.greatest(F.coalesce("open", "close"), F.col("close"))), F.coalesce("low", F.least(F.coalesce("open", "close"), F.col("close"))), F.greatest(F.lit(0.0), F.coalesce("volume", F.lit(0.0)))
    df = df.withColumns({"prev_": F.lag("close").over(w), "v20_": F.avg(v).over(trailing(w, 20)), "gap_": F.date_diff(F.col(order), F.lag(order).over(w)), "row_": F.row_number().over(w)})
    prev, v20 = F.col("prev_"), F.col("v20_")
    still = prev.isNotNull() & (F.abs(c - prev) <= F.greatest(F.lit(1e-9), prev * 0.00002))
    # rows since the last one that moved: gaps and islands without a second sort
    df = df.withColumn("still_", still).withColumn("streak_", F.col("row_") - F.max(F.when(~F.col("still_"), F.col("row_"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.when(prev.isNotNull(), pct_change(c, prev)).otherwise(F.lit(0.0))
    base = F.greatest(F.lit(1.0), v20)
    rules = [
        ("non_positive_price", (c <= 0) | (o <= 0), 70),
        ("ohlc_range_inconsistent", (h < F.greatest(o, c)) | (lo > F.least(o, c)) | (lo <= 0), 35),
        ("zero_volume", v <= 0, 12),
        ("volume_spike", (v > 0) & (v20 > 0) & (v / base > 12), 8),
        ("possible_split_or_provider_jump", prev.isNotNull() & (F.abs(change) >= 35), 45),
        ("extreme_return", prev.isNotNull() & (F.abs(change) >= 18) & (F.abs(change) < 35), 20),
        ("stale_close_low_volume", (F.col("streak_") >= 4) & (v <= base * 0.15), 18),
        ("large_calendar_gap", F.col("gap_") > 10, 10),
        ("time_order_violation", F.col("gap_") < 0, 45),
    ]
    score = F.lit(100.0)
    for _, rule, penalty in rules:
        score = score - F.when(rule, F.lit(float(penalty))).otherwise(F.lit(0.0))
    score = clamp(score, 5.0, 100.0)
    out = df.withColumns({
        "return_pct": change, "volume_ratio20": F.when(v20 > 0, v / base).otherwise(F.lit(0.0)), "score": score, "sample_weight": clamp(score / 100, 0.12, 1.0),
        "flags": F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule, _ in rules))),
    })
    return out.drop("prev_", "v20_", "gap_", "row_", "still_", "streak_")


def quality_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Grade and shares by group."""
    share = lambda cond: F.count_if(cond) * 100.0 / F.count("*")
    out = scored.groupBy(*by).agg(
        F.count("*").alias("row_count"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), share(F.col("score") >= 82).alias("high_quality_pct"),
        share(F.col("score") < 65).alias("degraded_pct"), F.avg("sample_weight").alias("avg_weight"), F.sum(F.size("flags")).alias("issues"),
    )
    return out.withColumn("grade", F.when((F.col("avg_score") >= 88) & (F.col("degraded_pct") <= 4), "high").when(F.col("avg_score") >= 74, "usable").otherwise("degraded"))


def issue_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.select(*by, F.explode("flags").alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def audit(df: DataFrame, group: list[str], allowed: DataFrame) -> DataFrame:
    """Status of each stored group: ok, mixed_identity, foreign_source or unknown_symbol."""
    found = df.groupBy(*group).agg(
        F.count_distinct(F.struct("market", "symbol")).alias("identities"), F.bool_and(source_fits(F.col("source"), F.col("market"))).alias("fits"),
        F.min("market").alias("market_"), F.min("symbol").alias("symbol_"), F.count("*").alias("row_count"),
    )
    known = allowed.select(F.col("market").alias("market_"), F.col("symbol").alias("symbol_"), F.lit(True).alias("known")).distinct()
    out = found.join(known, ["market_", "symbol_"], "left")
    fine = F.coalesce("known", F.lit(False)) | F.col("symbol_").startswith("^")
    status = F.when(F.col("identities") > 1, "mixed_identity").when(~F.col("fits"), "foreign_source").when(~fine, "unknown_symbol").otherwise("ok")
    return out.select(*group, "row_count", status.alias("status"))


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("market", "symbol").agg(F.count("*").alias("row_count"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("volume") > 0).alias("traded_days"))


def precedence_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the row of the latest frame wins for each key."""
    out = frames[0].withColumn("rank_", F.lit(0))
    for rank, frame in enumerate(frames[1:], 1):
        out = out.unionByName(frame.withColumn("rank_", F.lit(rank)))
    return latest_by(out, keys, [F.desc("rank_")]).drop("rank_")


def content_version(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A hash of each group's rows that does not depend on their order or place."""
    own = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sha2(F.concat_ws(":", F.count("*"), F.sum(own), F.max(own), F.min(own)), 256).alias("version"))


