"""Provider rows to point-in-time records, newline-delimited files in and out, and append-only stores.

Records have id, event_day, available_day, revision and verified, and the values of their kind.
Rows without a day of their event or of their availability give no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, number
from tidemark.operators.bars import latest_by
from tidemark.sources import lake

#: The columns of a candle file, in the types that it is read with.
CANDLE_SCHEMA = lake.SCHEMA


def either(*columns: str | Column) -> Column:
    """The first text that is neither missing nor empty."""
    return F.coalesce(*(F.nullif((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def day(*columns: str) -> Column:
    """The first of the columns that holds anything, as a day; null if it can't be read."""
    return F.try_to_date(F.substring(either(*columns), 1, 10))


def hundredth(column: str) -> Column:
    """A percentage as a share; null if it is no number."""
    return number(column, None) / 100


def tushare_financials(df: DataFrame) -> DataFrame:
    """Financial indicators: margins and growth as shares in [-1, 1], 0 where missing."""
    share = lambda *names: F.coalesce(clamp(F.coalesce(*(number(n, None) for n in names)) / 100, -1.0, 1.0), F.lit(0.0))
    out = df.select(
        F.concat_ws(":", "symbol", "end_date", F.coalesce(either("ann_date", "f_ann_date"), F.lit("initial"))).alias("id"), "symbol", day("end_date").alias("event_day"), day("f_ann_date", "ann_date").alias("available_day"),
        F.coalesce(either("update_flag", "ann_date"), F.lit("initial")).alias("revision"), F.lit(True).alias("verified"), share("netprofit_margin", "grossprofit_margin").alias("margin"), share("netprofit_yoy", "profit_dedt_yoy").alias("income_growth"), share("or_yoy", "tr_yoy").alias("revenue_growth"),
        hundredth("roe").alias("return_on_equity"), hundredth("debt_to_assets").alias("debt_to_assets"), number("current_ratio", None).alias("current_ratio"), F.lit(0.92).alias("source_quality"),
    )
    return out.filter("event_day is not null and available_day is not null")


def eastmoney_financials(df: DataFrame) -> DataFrame:
    """Main financial figures; known from the later of notice and update."""
    changed = F.coalesce(either("UPDATE_DATE", "NOTICE_DATE"), F.lit("initial"))
    out = df.select(
        F.concat_ws(":", "symbol", F.substring("REPORT_DATE", 1, 10), F.substring(changed, 1, 10)).alias("id"), "symbol", day("REPORT_DATE").alias("event_day"), F.greatest(day("NOTICE_DATE"), day("UPDATE_DATE")).alias("available_day"),
        F.substring(changed, 1, 19).alias("revision"), F.lit(True).alias("verified"), *(hundredth(c).alias(n) for c, n in (("XSJLL", "margin"), ("XSMLL", "gross_margin"), ("PARENTNETPROFITTZ", "income_growth"), ("TOTALOPERATEREVETZ", "revenue_growth"), ("ROEJQ", "return_on_equity"), ("ZCFZL", "debt_to_assets"))),
        *(number(c, None).alias(n) for c, n in (("LD", "current_ratio"), ("TOTAL_ASSETS_PK", "total_assets"))), F.lit(0.86).alias("source_quality"),
    )
    return out.filter("event_day is not null and available_day is not null")


def symbol_changes(df: DataFrame) -> DataFrame:
    """Old and new symbol of a renamed listing, known on the day."""
    old, new, at = F.upper(F.trim(either("old_symbol", "symbol_from"))), F.upper(F.trim(either("new_symbol", "symbol_to"))), day("date", "effective_date")
    out = df.select(new.alias("symbol"), old.alias("previous_symbol"), F.coalesce(either("name", "company_name"), new).alias("name"), at.alias("event_day"), at.alias("available_day"), F.lit("symbol-change-event").alias("revision"), F.lit(True).alias("verified"))
    out = out.filter("event_day is not null and symbol <> '' and previous_symbol <> ''")
    return out.withColumn("id", F.concat_ws(":", "previous_symbol", "symbol", F.col("event_day").cast("string")))


def identifier_maps(df: DataFrame, retrieved: Column) -> DataFrame:
    """Requested symbols and the responses to them, by place: symbols array<string>, responses array<struct<data:array<struct<figi, name, exchange, market_sector>>>>.

    Of a response's candidates the first equity counts, else the first; what a symbol mapped to in the past is not known by this.
    """
    placed = df.select("market", "symbols", F.posexplode("responses").alias("at", "response"))
    data = F.col("response.data")
    equity = F.coalesce(F.try_element_at(F.filter(data, lambda x: F.lower(x["market_sector"]) == "equity"), F.lit(1)), F.try_element_at(data, F.lit(1)))
    found = placed.select("market", F.upper(F.trim(F.get("symbols", F.col("at")))).alias("symbol"), equity.alias("e")).filter("symbol <> '' and e.figi <> ''")
    return found.select(F.concat_ws(":", "market", "symbol", "e.figi").alias("id"), "market", "symbol", "e.figi", F.coalesce(either("e.name"), F.col("symbol")).alias("name"), F.coalesce(either("e.exchange"), F.col("market")).alias("exchange"), retrieved.alias("event_day"), retrieved.alias("available_day"), F.lit(False).alias("verified"))


def corporate_actions(df: DataFrame, default_type: str = "corporate-action", quality: float = 0.92) -> DataFrame:
    """Dividends and splits; known from their announcement, else from the day itself."""
    at = day("ex_date", "date", "effective_date", "payment_date", "record_date")
    announced = day("declaration_date", "announcement_date")
    kind = F.lower(F.coalesce(either("event_type", "type"), F.lit(default_type)))
    out = df.select("symbol", "row_id", kind.alias("event_type"), at.alias("event_day"), F.coalesce(announced, at).alias("available_day"), F.coalesce(number("amount", None), number("dividend", None)).alias("amount"), either("ratio", "split").alias("ratio"), F.lit(True).alias("verified"), F.lit(quality).alias("source_quality"))
    out = out.filter("event_day is not null")
    return out.withColumn("id", F.concat_ws(":", "symbol", "event_type", F.col("event_day").cast("string"), F.col("row_id").cast("string"))).drop("row_id")


def adjust_factors(df: DataFrame, queried: DataFrame) -> DataFrame:
    """Adjustment factors by day, and one coverage row for each queried (symbol, start_day, end_day).

    Coverage tells a history without actions from one that nobody asked for; it is no event of the market.
    """
    at = day("operate_date", "divi_date", "date")
    events = df.select(F.concat_ws(":", "symbol", F.lit("adjust"), at.cast("string")).alias("id"), "symbol", F.lit("adjustment-factor").alias("event_type"), at.alias("event_day"), at.alias("available_day"), number("fore", None).alias("fore_factor"), number("back", None).alias("back_factor")).filter("event_day is not null")
    receipts = queried.select(F.concat_ws(":", "symbol", F.lit("adjust-coverage"), F.col("start_day").cast("string"), F.col("end_day").cast("string")).alias("id"), "symbol", F.lit("coverage").alias("event_type"), F.col("start_day").alias("event_day"), F.col("start_day").alias("available_day"), F.col("end_day").alias("coverage_end"))
    return events.unionByName(receipts, allowMissingColumns=True)


def keyed_records(df: DataFrame) -> DataFrame:
    """Records of a batch (dataset, market, exchange, symbol, source, id, url, event_time, available_at, revision, first_seen_at, verified, unverified, method) with their key.

    Without id and url a hash of the row identifies it. Verified means: said so, and not withdrawn.
    """
    whole = F.to_json(F.struct(*df.columns))
    verified = F.coalesce("verified", F.lit(False)) & ~F.coalesce("unverified", F.lit(False))
    revision = F.substring(F.coalesce(either("revision"), F.lit("initial")), 1, 40)
    known = df.filter((either("available_at").isNotNull()) & (either("event_time").isNotNull()))
    identity = F.substring(F.coalesce(either("id", "url"), F.substring(F.sha2(whole, 256), 1, 32)), 1, 240)
    return known.select(
        F.concat_ws(":", "dataset", "market", "exchange", "symbol", identity, F.substring("available_at", 1, 40), revision).alias("record_key"), "dataset", "market", "exchange", "symbol", "event_time", "available_at", revision.alias("revision"),
        F.coalesce(either("first_seen_at"), F.col("available_at")).alias("first_seen_at"), verified.alias("verified"), F.coalesce(either("method"), F.when(verified, "source-published-timestamp").otherwise("unverified")).alias("method"), "source", whole.alias("payload_json"),
    )


PIT_KEYS = ["dataset", "market", "symbol"]
PIT_SCHEMA = "record_key string, dataset string, market string, exchange string, symbol string, event_time string, available_at string, revision string, first_seen_at string, verified boolean, method string, source string, payload_json string"


def upsert_records(spark: SparkSession, root: str, batches: DataFrame) -> int:
    """Writes keyed records of any number of batches; a record that comes again replaces the stored one. Returns the rows of the touched partitions.

    Only partitions (dataset, market, symbol) that get rows are read and written.
    """
    incoming = keyed_records(batches)
    path = f"{root}/records"
    stored = spark.read.schema(PIT_SCHEMA).parquet(path) if lake._exists(spark, path) else spark.createDataFrame([], PIT_SCHEMA)
    touched = incoming.select(*PIT_KEYS).distinct()
    both = stored.join(touched, PIT_KEYS, "left_semi").withColumn("new_", F.lit(0)).unionByName(incoming.withColumn("new_", F.lit(1)))
    merged = latest_by(both, ["record_key"], [F.desc("new_"), F.desc("payload_json")]).drop("new_")
    with lake.staged(spark, root, merged) as rows:
        out = rows.repartition(*map(F.col, PIT_KEYS)).sortWithinPartitions(*PIT_KEYS, "available_at", "event_time")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PIT_KEYS).parquet(path)
        return rows.count()


def read_records(spark: SparkSession, root: str, dataset: str, market: str, symbols: list[str], known_by: str | None = None) -> DataFrame:
    """The verified records of some symbols, oldest first; known_by keeps those available at that time."""
    rows = spark.read.schema(PIT_SCHEMA).parquet(f"{root}/records").filter((F.col("dataset") == dataset) & (F.col("market") == market) & F.col("symbol").isin(symbols) & F.col("verified"))
    return rows.filter(F.col("available_at") <= known_by) if known_by else rows


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited candles in their fixed types; lines that are no JSON give no row."""
    return spark.read.schema(CANDLE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def ingest_candles(spark: SparkSession, root: str, path: str) -> dict[str, int]:
    """A file of candles into the lake, invalid ones into quarantine."""
    return lake.upsert(spark, root, read_candles(spark, path).withColumn("row_", F.monotonically_increasing_id()), ["saved_at", "row_"])


def newest_rows(df: DataFrame, where: Column, order: list[str], limit: int, most: int = 500) -> DataFrame:
    """The last rows of an append-only table, newest first: events, intents, market rows."""
    return df.filter(where).orderBy(*(F.desc(c) for c in order)).limit(max(1, min(most, limit)))


def insert_intents(stored: DataFrame, incoming: DataFrame, key: str = "idempotency_key", order: str = "id") -> DataFrame:
    """incoming with the id that each key has and duplicate: a key that is stored, or that came before, keeps its first row."""
    first = F.min(F.struct("kind_", order)).over(Window.partitionBy(key))
    keys = stored.select(key, order, F.lit(0).alias("kind_")).join(incoming.select(key).distinct(), key, "left_semi")
    rows = keys.unionByName(incoming.withColumn("kind_", F.lit(1)), allowMissingColumns=True).withColumn("first_", first).filter("kind_ = 1")
    return rows.select(*incoming.columns, F.col("first_")[order].alias("kept_id"), ((F.col("first_")["kind_"] == 0) | (F.col("first_")[order] != F.col(order))).alias("duplicate"))


def write_oof(df: DataFrame, path: str) -> None:
    """Out-of-fold rows as gzip JSON lines, columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip").json(path)


def read_oof(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines)."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.withColumn("x", F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("x._corrupt_record").isNotNull()
    return parsed.filter(~broken).select("x.*").drop("_corrupt_record"), parsed.filter(broken).select("value")


def isolate(rows: DataFrame, market: str, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of one market, each key once, the first in order; one row of counts of what was left out).

    rows: market, symbol, day, signal_at, available_at and the keys.
    """
    own = F.coalesce(F.upper("market") == market, F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    own_nth = F.row_number().over(Window.partitionBy(*keys, own).orderBy(*order))
    judged = rows.withColumns({"nth_": nth, "own_": own, "own_nth_": own_nth})
    kept = F.col("own_") & (F.col("own_nth_") == 1)
    counts = judged.agg(
        F.count("*").alias("raw_rows"), F.count_if(kept).alias("unique_rows"), F.count_if(F.col("nth_") > 1).alias("duplicate_rows"), F.count_if(~F.col("own_")).alias("cross_market_rows"), F.count_if(F.col("available_at") > F.col("signal_at")).alias("future_rows"),
        F.count_distinct(F.when(kept, F.col("day"))).alias("days"), F.count_distinct(F.when(kept, F.col("symbol"))).alias("symbols"),
    )
    return judged.filter(kept).drop("nth_", "own_", "own_nth_"), counts
