"""Point-in-time joins: what was known at a signal, and no more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, half_life_decay
from tidemark.operators.bars import latest_by

#: Days for which a record of a dataset counts, how many of them, and its half life. Fixed values.
MAX_AGE = {"news": 180, "social": 21, "fundamentals": 400, "financial_disclosures": 400, "macro": 120}
LIMITS = {"news": 40, "social": 16, "fundamentals": 12, "financial_disclosures": 16, "macro": 24}
HALF_LIFE = {"news": 24.0, "social": 7.0, "fundamentals": 45.0, "financial_disclosures": 45.0, "macro": 30.0}
SERIES_LIMIT = 2
OLDEST = 400
BUCKET_DAYS = 32


def by_dataset(values: dict, dataset: Column, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(dataset == name, F.lit(value)).otherwise(out)
    return out


def prepare(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable records, counts of the excluded by reason).

    Records must be verified, have both times, and not be available before they happened; of
    one event, a financial disclosure goes before other datasets, then the earliest available.
    """
    reason = F.when(~F.coalesce("verified", F.lit(False)), "unverified").when(F.col("available_day").isNull() | F.col("event_day").isNull(), "invalid_timestamp").when(F.col("available_day") < F.col("event_day"), "temporal_order")
    judged = events.withColumn("reason", reason)
    usable = judged.filter("reason is null").drop("reason")
    kept = latest_by(usable, ["symbol", "event_id"], [F.desc(F.col("dataset") == "financial_disclosures"), "available_day", "dataset"])
    return kept, judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def as_of(signals: DataFrame, events: DataFrame, oldest: int = OLDEST) -> DataFrame:
    """Every (signal, record) pair with available_day and event_day <= day and an age of at most the dataset's.

    A range join as an equi join: time is cut into buckets of 32 days; a record is copied to the
    buckets in which it can still count, so each pair meets in exactly one (the signal's own).
    """
    number = lambda c: F.floor(F.unix_date(c) / BUCKET_DAYS).cast("int")
    age = by_dataset({k: min(v, oldest) for k, v in MAX_AGE.items()}, F.col("dataset"), min(180, oldest)).cast("int")
    left = signals.withColumn("bucket_", number("day"))
    right = events.withColumnRenamed("symbol", "symbol_").withColumn("age_", age).withColumn("bucket__", F.explode(F.sequence(number("available_day"), number(F.date_add("available_day", F.col("age_"))))))
    on = (F.col("symbol") == F.col("symbol_")) & (F.col("bucket_") == F.col("bucket__"))
    within = (F.col("available_day") <= F.col("day")) & (F.col("event_day") <= F.col("day")) & (F.date_diff("day", "available_day") <= F.col("age_"))
    joined = left.join(right, on & within)
    return joined.withColumn("age_days", F.date_diff("day", "available_day")).drop("symbol_", "bucket_", "bucket__", "age_")


def capped(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The newest records of each signal: two of a macro series first, then the dataset's limit."""
    newest = [F.desc("available_day"), F.desc("event_id")]
    first = pairs.withColumn("k_", F.row_number().over(Window.partitionBy(*key, "dataset", "series").orderBy(*newest))).filter(~F.col("dataset").eqNullSafe("macro") | (F.col("k_") <= SERIES_LIMIT))
    second = first.withColumn("k_", F.row_number().over(Window.partitionBy(*key, "dataset").orderBy(*newest)))
    return second.filter(F.col("k_") <= by_dataset(LIMITS, F.col("dataset"), 24)).drop("k_")


def recent(signals: DataFrame, events: DataFrame, key: list[str], oldest: int = OLDEST) -> DataFrame:
    """The pairs of capped(as_of(..)) for prepare()d records, without joining any that the limits leave out.

    A symbol's records are numbered by availability in each stream (a dataset, or a series of macro). One sort of signals and records tells each
    signal the last number it can know; it meets that one and as many before it as the stream's limit lets count, by number. Old ones go by
    age, and of macro the dataset's limit is then taken over its series.
    """
    names, macro = signals.columns, F.col("dataset") == "macro"
    dataset = F.coalesce("dataset", F.lit(""))
    stream = F.concat_ws("|", dataset, F.when(macro, F.coalesce("series", F.lit(""))))
    e = events.filter("available_day is not null and event_day is not null").withColumn("stream_", stream)
    e = e.withColumn("m_", F.row_number().over(Window.partitionBy("symbol", "stream_").orderBy("available_day", "event_id")))
    s = signals.join(e.select("symbol", "stream_", F.when(macro, F.lit(SERIES_LIMIT)).otherwise(by_dataset(LIMITS, dataset, 24)).alias("limit_")).distinct(), "symbol")
    rows = s.withColumns({"at_": F.col("day"), "kind_": F.lit(1), "m_": F.lit(None).cast("int")}).unionByName(e.select("symbol", "stream_", F.col("available_day").alias("at_"), F.lit(0).alias("kind_"), "m_"), allowMissingColumns=True)
    upto = Window.partitionBy("symbol", "stream_").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("last_", F.max("m_").over(upto)).filter("kind_ = 1 and last_ is not null")
    wanted = last.select(*names, "stream_", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last_") - F.col("limit_") + 1), F.col("last_"))).alias("m_"))
    age = by_dataset({k: min(v, oldest) for k, v in MAX_AGE.items()}, F.col("dataset"), min(180, oldest)).cast("int")
    pairs = wanted.join(e, ["symbol", "stream_", "m_"]).withColumn("age_days", F.date_diff("day", "available_day")).filter(F.col("age_days") <= age).drop("stream_", "m_")
    newest = Window.partitionBy(*key).orderBy(F.desc("available_day"), F.desc("event_id"))
    of_macro = pairs.filter(macro).withColumn("k_", F.row_number().over(newest)).filter(F.col("k_") <= LIMITS["macro"]).drop("k_")
    return pairs.filter(~F.coalesce(macro, F.lit(False))).unionByName(of_macro)


def event_features(signals: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Decayed evidence of each signal: sentiment, intensity, saturating risk, freshness, coverage; zeros without records.

    latest_available and join_violations are computed from the joined rows, so a leak would show.
    """
    chosen = recent(signals, events, key)
    decay = half_life_decay(F.col("age_days"), by_dataset(HALF_LIFE, F.col("dataset"), 30.0))
    evidence = F.col("decay_") * clamp("relevance", 0.05, 1.0) * clamp("source_quality", 0.2, 1.0)
    d = chosen.withColumn("decay_", decay).withColumn("w_", evidence)
    signed, seen = clamp("sentiment", -1.0, 1.0), F.abs(F.col("sentiment")) > 1e-12
    risk = clamp(clamp(-F.col("sentiment"), 0.0, 1.0) * F.col("w_"), 0.0, 0.95)
    agg = d.groupBy(*key).agg(
        F.count("*").alias("records"), F.sum(F.when(seen, signed * F.col("w_"))).alias("sw_"), F.sum(F.when(seen, F.col("w_"))).alias("ww_"), (1 - F.exp(F.sum(F.ln(1 - risk)))).alias("risk"),
        F.tanh(F.sum(F.abs(signed) * F.col("w_")) / 2.5).alias("intensity"), F.max("decay_").alias("freshness"), F.max("available_day").alias("latest_available"), F.count_if(F.col("available_day") > F.col("day")).alias("join_violations"),
    )
    out = signals.join(agg, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*signals.columns, F.coalesce("records", F.lit(0)).alias("records"), zero(F.try_divide("sw_", "ww_")).alias("sentiment"), *(zero(F.col(c)).alias(c) for c in ("risk", "intensity", "freshness")), "latest_available", F.coalesce("join_violations", F.lit(0)).alias("join_violations"))


def covered(signals: DataFrame, receipts: DataFrame) -> DataFrame:
    """signals with covered: whether a receipt's [start_day, end_day] of the symbol holds the day.

    Overlapping intervals are merged to islands first; then a signal meets at most the last
    island that starts before it, found with one window over both tables in order of time.
    """
    w = Window.partitionBy("symbol").orderBy("start_day", "end_day")
    upto = F.max("end_day").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = receipts.withColumn("new_", (upto.isNull() | (F.col("start_day") > upto)).cast("int")).withColumn("island", F.sum("new_").over(w)).groupBy("symbol", "island").agg(F.min("start_day").alias("start_day"), F.max("end_day").alias("end_day"))
    names = signals.columns
    rows = signals.withColumns({"at_": F.col("day"), "kind_": F.lit(1), "end_": F.lit(None).cast("date")}).unionByName(islands.select("symbol", F.col("start_day").alias("at_"), F.lit(0).alias("kind_"), F.col("end_day").alias("end_")), allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_end_", F.last("end_", ignorenulls=True).over(order)).filter("kind_ = 1")
    return rows.select(*names, F.coalesce(F.col("last_end_") >= F.col("day"), F.lit(False)).alias("covered"))


def fan_out(market_rows: DataFrame, symbols: DataFrame, on: str = "market") -> DataFrame:
    """Market-wide rows for every symbol of their market: an equi join on the market, broadcast by Spark if it is small."""
    return market_rows.join(symbols, on)


def latest_known(signals: DataFrame, events: DataFrame, value: str) -> DataFrame:
    """As-of of one value: the newest available at each signal, in one sort of both tables, without a join."""
    names = signals.columns
    rows = signals.withColumns({"at_": F.col("day"), "kind_": F.lit(1), "id_": F.lit(None).cast("long"), "value_": F.lit(None).cast("struct<v:double,d:date>")}).unionByName(
        events.select("symbol", F.col("available_day").alias("at_"), F.lit(0).alias("kind_"), F.col("event_id").alias("id_"), F.struct(F.col(value).alias("v"), F.col("available_day").alias("d")).alias("value_")), allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("at_", "kind_", "id_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_", F.last("value_", ignorenulls=True).over(order)).filter("kind_ = 1")
    return rows.select(*names, F.col("last_.v").alias(value), F.col("last_.d").alias("available_day"))
