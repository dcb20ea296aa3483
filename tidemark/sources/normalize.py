"""Provider payloads to point-in-time records: arrays zipped and exploded, nothing parsed by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.functions.series import before


def columnar(df: DataFrame, fields: str, items: str) -> DataFrame:
    """fields (array of names) x items (array of arrays) -> row (map) for each item."""
    return df.select(*[c for c in df.columns if c not in (fields, items)], F.posexplode(items).alias("pos", "item_"), F.col(fields).alias("fields_")).withColumn("row", F.map_from_arrays("fields_", "item_")).drop("item_", "fields_")


def listing_events(df: DataFrame) -> DataFrame:
    """One row with listed and delisted days -> 0 to 2 events."""
    return df.unpivot([c for c in df.columns if c not in ("listed", "delisted")], ["listed", "delisted"], "event_type", "event_day").filter("event_day is not null")


def vintages(df: DataFrame, by: list[str], order: str, value: str, direction: Column) -> DataFrame:
    """change and score of each observation: its change against the mean and deviation of up to 24 changes before, clamped at 3, over 3, signed."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("change", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))
    prior = before(w, 24)
    d = d.withColumns({"m_": F.avg("change").over(prior), "s_": F.stddev_pop("change").over(prior), "p_": F.lag(value).over(w)})
    scale = F.when(F.col("s_") > 1e-12, F.col("s_")).otherwise(F.greatest(F.lit(1e-6), F.abs("p_") * 0.02))
    score = F.when(F.col("m_").isNotNull(), clamp((F.col("change") - F.col("m_")) / scale, -3.0, 3.0) / 3 * direction).otherwise(F.lit(0.0))
    return d.withColumn("score", score).drop("m_", "s_", "p_")


def filings(df: DataFrame, by: list[str], concepts: tuple[str, str]) -> DataFrame:
    """Facts (concept, value) of one filing side by side; concepts: revenue and income by their names.

    margin, revenue_growth and income_growth in [-1, 1], against the last filing of the same
    period a year before that came earlier (by event_day, then accession): later restatements
    change nothing. Null where a value is missing.
    """
    revenue, income = concepts
    wide = df.groupBy(*by, "accession", "fiscal_year", "period", "event_day").pivot("concept", list(concepts)).agg(F.max("value"))
    keys, at = [*by, "period", "fiscal_year"], ["event_day", "accession"]
    # a filing also stands, as what came before, under its period of the next year; one sort of both finds the last of them, without a join
    before_ = wide.dropna(subset=keys).withColumn("fiscal_year", F.col("fiscal_year") + 1)
    rows = wide.withColumn("kind_", F.lit(0)).unionByName(before_.withColumn("kind_", F.lit(1)))
    upto = Window.partitionBy(*keys).orderBy(*at, "kind_").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("p", F.last(F.when(F.col("kind_") == 1, F.struct(revenue, income)), ignorenulls=True).over(upto)).filter("kind_ = 0")
    ratio = lambda x, base: clamp(x / F.greatest(F.lit(1.0), F.abs(base)), -1.0, 1.0)
    growth = lambda c: F.when(F.col("p")[c].isNotNull(), ratio(F.col(c) - F.col("p")[c], F.col("p")[c]))
    margin = F.when(F.col(revenue).isNotNull(), ratio(F.col(income), F.col(revenue)))
    return met.select(*wide.columns, margin.alias("margin"), growth(revenue).alias("revenue_growth"), growth(income).alias("income_growth"))


def statements(df: DataFrame, column: str) -> DataFrame:
    """map<statement, map<period, map<day, value>>> -> statement, period, day, value."""
    keep = [c for c in df.columns if c != column]
    a = df.select(*keep, F.explode(column).alias("statement", "a_"))
    b = a.select(*keep, "statement", F.explode("a_").alias("period", "b_"))
    return b.select(*keep, "statement", "period", F.explode("b_").alias("day", "value"))


def record_key(*parts: str) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
