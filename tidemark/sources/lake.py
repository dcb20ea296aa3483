"""A bar lake on Parquet: market=/interval=/symbol= folders, upserts that rewrite only touched partitions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import merge_latest, newest, split_valid

KEYS = ["market", "interval", "symbol"]
SCHEMA = "market string, interval string, symbol string, timestamp string, open double, high double, low double, close double, volume double, source string, available_at string, saved_at string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, root: str) -> DataFrame:
    """All bars of the lake; an empty frame if there are none. Filters on the keys prune folders."""
    path = f"{root}/bars"
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


@contextmanager
def staged(spark: SparkSession, root: str, rows: DataFrame) -> Iterator[DataFrame]:
    """rows, written and read again, as a path can't be overwritten while it is read; gone afterwards."""
    path = f"{root}/stage/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(spark: SparkSession, root: str, incoming: DataFrame, order: list[str]) -> dict[str, int]:
    """Valid rows replace stored ones of the same symbol and timestamp; invalid ones go to quarantine with their reason.

    Only partitions that get rows are read and rewritten, of the lake and of the quarantine; a rerun gives the same of both.
    """
    good, bad = split_valid(incoming)
    touched = good.select(*KEYS).distinct()
    current = read(spark, root).join(touched, KEYS, "left_semi")
    before = current.count()
    merged = merge_latest(current, good, [*KEYS, "timestamp"], order).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    with staged(spark, root, merged) as rows:
        out = rows.repartition(*map(F.col, KEYS)).sortWithinPartitions(*KEYS, "timestamp")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*KEYS).parquet(f"{root}/bars")
        stored = rows.count()
    rejected = bad.select(*KEYS, "timestamp", "reason", F.to_json(F.struct("open", "high", "low", "close", "volume")).alias("payload"))
    old = spark.read.schema(rejected.schema).parquet(f"{root}/quarantine") if _exists(spark, f"{root}/quarantine") else rejected.limit(0)
    own = rejected.select(*KEYS).distinct()
    both = old.join(own, KEYS, "left_semi").withColumn("new_", F.lit(0)).unionByName(rejected.withColumn("new_", F.lit(1)))
    with staged(spark, root, both.groupBy(*rejected.columns).agg(F.max("new_").alias("new_"))) as rows:
        n = rows.filter("new_ = 1").count()
        rows.drop("new_").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{root}/quarantine")
    return {"stored": stored, "inserted": max(0, stored - before), "rejected": n}


def read_rows(spark: SparkSession, root: str, market: str, symbol: str, limit: int = 6500) -> DataFrame:
    """The newest rows of one symbol in ascending order; the key filters prune to one folder."""
    limit = min(max(limit, 1), 20_000)
    rows = read(spark, root).filter((F.col("market") == market) & (F.col("symbol") == symbol))
    return rows.orderBy(F.desc("timestamp")).limit(limit).orderBy("timestamp")


def read_panel(spark: SparkSession, root: str, market: str, symbols: list[str], limit: int) -> DataFrame:
    rows = read(spark, root).filter((F.col("market") == market) & F.col("symbol").isin(symbols))
    return newest(rows, KEYS, [F.desc("timestamp")], limit)


def create_view(spark: SparkSession, root: str, name: str = "ohlcv") -> None:
    read(spark, root).createOrReplaceTempView(name)
