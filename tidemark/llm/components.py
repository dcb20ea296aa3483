"""Connected components by alternating large and small stars; no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: any ids) -> one row (node, root) for each node of a link; root: smallest id.

    Each step connects neighbours to the smallest id known around a node and shortens paths, so
    long chains take a number of steps in the order of the logarithm of their length. Minima are
    aggregated before the shuffle, so a node with very many links is no burden on one task.
    Rows with a = b give single nodes. Each step is written to the shared folder.
    """
    single = links.filter("a = b").select(F.col("a").alias("node"))
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
        small = large.join(least, F.col("u") == F.col("at")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, edges = edges, durable(small.filter("u <> v").distinct())
        discard(last)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return nodes.unionByName(single.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
