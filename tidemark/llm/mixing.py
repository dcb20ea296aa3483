"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

1. Targets. Sources share `share` times all words by weight. A target stops at `most` times its
   source's size; the excess goes to the others by weight (water filling, solved in one pass
   over the sources in order of the level at which they fill up).
2. Quotas. All targets together are house = round(total / block_words) equal blocks of words. They are
   allocated to sources by highest quotients target / (2k + 1), and each source's quota in the
   same way to its shards, whose size is the weight. Of n weights with the sum S, the divisor
   S / (house + n / 2) gives house seats or more, and S / (house - n / 2) gives no more than house,
   as rounding changes a seat count by half a seat at most. So quotients beyond the second are won,
   those below the first are lost, and only those between, 2n at most, are ranked.
3. Blocks. A shard's documents are laid end to end in the order of a seeded hash and cut into
   blocks. A quota of q over m blocks takes every block q div m times and q mod m consecutive
   blocks (in a circle) once more, from a seeded start. As the order is random, so is the
   choice, and all but a few documents of a shard are taken whole. The choice of a shard is
   known by the places in the order where it begins and ends, so texts meet one row a shard
   and are never shuffled for their place.

A source has as many shards as it needs for shards of about shard_docs documents, so a source
with a third of all rows is many groups. Windows see the tables of sources and of shards, and
within a shard its hashes and sizes.

Edge cases: null texts have size 0; null is a source of its own, last in order; documents
without words take nothing; rows with a null doc_id are ordered by their texts; rows with one
place in the order (repeated rows) share what is taken there in proportion to their sizes, each
with its own share; an empty table gives an empty result; other columns, whatever their names,
are ignored or passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, durable, fresh, n_words, read

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 8
SHARD_DOCS = 4096
SEED = "mix-1"


def _hash(text: Column, start: int = 1) -> Column:
    return F.substring(F.md5(text.cast("binary")), start, 16)


def _as_long(text: Column, length: int) -> Column:
    """The first hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(text, 1, length), 16, 10).cast("long")


def order_key(seed: str) -> Column:
    """The seeded order of a row with doc_id and text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return _hash(F.concat(F.lit(seed + "|"), name))


def with_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and the seeded order key of every row."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key(seed).alias("order_key"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target: one row for each source."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_fill = Window.orderBy("fill_at", F.col("source").asc_nulls_last())
    cap = most * F.col("source_size")
    sources = (
        sized.groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
        .withColumn("total", share * F.sum("source_size").over(every))
        .withColumn("fill_at", cap / F.col("weight"))
        .withColumns({
            "place": F.row_number().over(by_fill),
            "filled": F.coalesce(F.sum(cap).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        })
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    )
    level = F.min(F.when(F.col("level") <= F.col("fill_at"), F.struct("place", "level"))).over(every)["level"]
    return sources.withColumn("target", F.least(cap, F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "n_docs", "source_size", "target")


def apportion(rows: DataFrame, weight: Column, house: Column, group: list[str], order: list[Column]) -> DataFrame:
    """Adds quota: house seats of each group by highest quotients weight / (2k + 1), ties in the given order.

    A group whose weights are all zero gets no seats.
    """
    names = w, seats, total, n, even, floor_, tries, need = fresh([*rows.columns, "quota"], "w", "seats", "total", "n", "even", "won", "tries", "need")
    k, quotient, place = fresh([*rows.columns, *names, "quota"], "k", "quotient", "place")
    every = Window.partitionBy(*group)
    c = F.col
    at = lambda divisor: F.floor(c(w) / divisor + 0.5).cast("long")
    divisor = c(total) / c(seats)
    low = F.when(c(even) >= c(seats), divisor).otherwise(c(total) / (c(seats) + c(n) / 2))
    high = F.when(c(even) <= c(seats), divisor).when(2 * c(seats) > c(n), c(total) / (c(seats) - c(n) / 2) * (1 + 1e-9))
    counted = (
        rows.withColumns({w: weight.cast("double"), seats: house.cast("long")})
        .withColumns({total: F.sum(w).over(every), n: F.count_if(c(w) > 0).over(every)})
        .withColumn(seats, F.when(c(total) > 0, c(seats)).otherwise(F.lit(0)).cast("long"))
        .withColumn(even, F.sum(F.when(c(seats) > 0, at(divisor)).otherwise(F.lit(0))).over(every))
        .withColumn(floor_, F.when((c(seats) > 0) & high.isNotNull(), at(high)).otherwise(F.lit(0)).cast("long"))
        .withColumn(tries, F.when(c(seats) > 0, at(low)).otherwise(F.lit(0)) - c(floor_))
        .withColumn(need, c(seats) - F.sum(floor_).over(every))
    )
    ranked = counted.withColumn(k, F.explode_outer(F.when(c(tries) > 0, F.sequence(F.lit(0).cast("long"), c(tries) - 1))))
    ranked = ranked.withColumn(quotient, c(w) / (2 * (c(floor_) + c(k)) + 1))
    ranked = ranked.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(c(quotient).desc_nulls_last(), *order)))
    won = F.count_if(c(k).isNotNull() & (c(place) <= c(need)))
    return ranked.groupBy(*rows.columns, floor_).agg(won.alias("quota")).withColumn("quota", c("quota") + c(floor_)).drop(floor_)


def shard_of(key: Column, n_shards: Column) -> Column:
    return F.pmod(_as_long(F.reverse(key), 8), n_shards)


def choose(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The durable tables of sources (source, n_shards) and of shards with what the mix takes of them.

    A shard's documents are taken `rounds` times, and once more from its start to `wrap` and
    from `low` to `high`, given as (order_key, words into the documents there, their words); a
    null reaches to the shard's end.
    """
    targets = source_targets(sized, weights, share, most)
    house = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5)
    sources = apportion(targets, F.col("target"), house, [], [F.col("source").asc_nulls_last()]).withColumnsRenamed({"quota": "source_quota"})
    sources = durable(sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long")))
    laid = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.source", "order_key", "size", shard_of(F.col("order_key"), F.col("n_shards")).alias("shard"))
    in_order = Window.partitionBy("source", "shard").orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0)
    # one exchange for the sums and for the order
    laid = laid.repartition("source", "shard").groupBy("source", "shard", "order_key").agg(F.sum("size").alias("of"))
    laid = durable(laid.withColumn("last", F.sum("of").over(in_order)).withColumn("first", F.col("last") - F.col("of")))
    shards = laid.groupBy("source", "shard").agg(F.sum("of").alias("shard_size")).alias("h")
    shards = shards.join(sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.*", "source_size", "target", "source_quota")
    shards = apportion(shards, F.col("shard_size"), F.col("source_quota"), ["source"], [F.col("shard")])
    blocks = F.ceil(F.col("shard_size") / block_words).cast("long")
    name = F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), F.lit("|"), F.col("shard").cast("string"))
    shards = (
        shards.withColumn("blocks", blocks)
        .withColumn("some", F.greatest("blocks", F.lit(1)))
        .withColumn("quota", F.least("quota", F.col("blocks") * F.lit(int(most))))
        .withColumns({"rounds": F.floor(F.col("quota") / F.col("some")).cast("long"), "start": F.pmod(_as_long(_hash(name), 8), "some")})
        .withColumn("stop", F.col("start") + F.pmod("quota", "some"))
        .withColumns({"low": F.col("start") * block_words, "high": F.least("stop", "blocks") * block_words, "wrap": F.greatest(F.col("stop") - F.col("blocks"), F.lit(0)) * block_words})
        .select("source", "shard", "source_size", "target", "rounds", "low", "high", "wrap")
    )
    at = lambda x: F.min(F.when(F.col("last") > F.col(x), F.struct("order_key", (F.col(x) - F.col("first")).alias("into"), "of"))).alias(f"{x}_at")
    met = laid.alias("l").join(shards.alias("h"), F.col("l.source").eqNullSafe(F.col("h.source")) & (F.col("l.shard") == F.col("h.shard"))).select("h.*", "order_key", "first", "last", "of")
    met = met.groupBy("source", "shard", "source_size", "target", "rounds").agg(at("low"), at("high"), at("wrap"))
    return sources.select("source", "n_shards"), durable(met)


def decide(rows: DataFrame, size: str, key: str, chosen: tuple[DataFrame, DataFrame], how: str) -> DataFrame:
    """Adds to rows (source, their size and order key) the struct `how`: source_size, target, rounds, b, c, d.

    A row is taken whole `rounds` times; then its words [0, b) and [c, d), counted from 0.
    """
    sources, shards = chosen
    own, its_size = F.col(f"d.`{key}`"), F.col(f"d.`{size}`")

    def inside(x: str) -> Column:
        at = F.col(f"h.{x}_at")
        part = F.call_function("div", at["into"] * its_size, at["of"])
        return F.when(at.isNull() | (own < at["order_key"]), its_size).when(own == at["order_key"], part).otherwise(F.lit(0)).cast("long")

    met = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    met = met.join(shards.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")) & (shard_of(own, F.col("s.n_shards")) == F.col("h.shard")))
    parts = F.struct("h.source_size", "h.target", "h.rounds", inside("wrap").alias("b"), inside("low").alias("c"), inside("high").alias("d"))
    return met.select(*(F.col(f"d.`{c}`") for c in rows.columns), parts.alias(how))


def mix(sized: DataFrame, **options) -> DataFrame:
    """For each row of with_sizes(): source_size, target, and taken, the words that the mix takes; options as of choose()."""
    out = decide(sized, "size", "order_key", choose(sized, **options), "how")
    taken = F.col("how.rounds") * F.col("size") + F.col("how.b") + F.col("how.d") - F.col("how.c")
    return out.select("doc_id", "source", "size", "how.source_size", "how.target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row once for each time it is taken, texts cut where taken in part."""
    size, key, how, whole = fresh(docs.columns, "size", "order_key", "how", "whole")
    chosen = choose(durable(with_sizes(docs)), **options)
    rows = decide(docs.withColumn(size, n_words(F.col("text"))).withColumn(key, order_key(options.get("seed", SEED))), size, key, chosen, how)
    part = lambda x: F.col(f"`{how}`.{x}")
    found = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    words_of = lambda x, y: F.slice(found, (x + 1).cast("int"), (y - x).cast("int"))
    n_part = part("b") + part("d") - part("c")
    cut = F.when(n_part == F.col(size), F.col("text")).otherwise(F.array_join(F.concat(words_of(F.lit(0), part("b")), words_of(part("c"), part("d"))), " "))
    no_more = F.array().cast("array<boolean>")
    times = F.concat(F.array_repeat(F.lit(True), part("rounds").cast("int")), F.when(n_part > 0, F.array(F.lit(False))).otherwise(no_more))
    rows = rows.filter(F.col(size) > 0).withColumn(whole, F.explode(times)).withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    sized = durable(with_sizes(read(spark, sf_dir, "documents")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 16) AS order_key
  FROM documents),
src AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM src),
w AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM ranked),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS fill_at FROM w),
g AS (SELECT *, row_number() OVER (ORDER BY fill_at, nth) AS place,
             coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY fill_at, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (ORDER BY fill_at, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM f),
level AS (SELECT first((total - filled) / open ORDER BY place) AS level FROM g WHERE (total - filled) / open <= fill_at),
t AS (SELECT nth, source, n_docs, source_size, least(2.0::DOUBLE * source_size, coalesce(level, 0) * weight) AS target, greatest(1, CAST(ceil(n_docs / 4096.0) AS BIGINT)) AS n_shards FROM g, level),
house AS (SELECT CAST(floor(sum(target) / 8 + 0.5) AS BIGINT) AS seats FROM t),
q AS (SELECT nth, target / (2 * k + 1) AS quotient FROM (SELECT nth, target, unnest(range(seats)) AS k FROM t, house WHERE target > 0)),
won AS (SELECT nth, count(*) AS quota FROM (SELECT nth, row_number() OVER (ORDER BY quotient DESC, nth) AS r FROM q), house WHERE r <= seats GROUP BY nth),
laid AS (SELECT d.*, t.nth, t.source_size, t.target, coalesce(won.quota, 0) AS source_quota, coalesce('=' || d.source, 'null') AS key, CAST('0x' || substr(reverse(order_key), 1, 8) AS BIGINT) % n_shards AS shard
         FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON won.nth = t.nth),
sh AS (SELECT nth, key, shard, any_value(source_quota) AS seats, CAST(sum(size) AS BIGINT) AS shard_size FROM laid GROUP BY nth, key, shard),
sq AS (SELECT nth, shard, seats, shard_size / (2.0::DOUBLE * k + 1) AS quotient FROM (SELECT nth, shard, seats, shard_size, unnest(range(seats)) AS k FROM sh WHERE shard_size > 0)),
sw AS (SELECT nth, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY quotient DESC, shard) AS r FROM sq) WHERE r <= seats GROUP BY nth, shard),
b AS (SELECT sh.nth, sh.shard, CAST(ceil(shard_size / 8.0) AS BIGINT) AS m, least(coalesce(quota, 0), 2 * CAST(ceil(shard_size / 8.0) AS BIGINT)) AS quota,
             CAST('0x' || substr(md5('mix-1|' || key || '|' || CAST(sh.shard AS VARCHAR)), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(shard_size / 8.0) AS BIGINT)) AS start
      FROM sh LEFT JOIN sw ON sh.nth = sw.nth AND sh.shard = sw.shard),
c AS (SELECT *, CASE WHEN m > 0 THEN quota // greatest(m, 1) ELSE 0 END AS rounds, CASE WHEN m > 0 THEN start + quota % greatest(m, 1) ELSE start END AS stop FROM b),
og AS (SELECT nth, shard, order_key, CAST(sum(size) AS BIGINT) AS of_key FROM laid GROUP BY nth, shard, order_key),
p AS (SELECT *, CAST(sum(of_key) OVER (PARTITION BY nth, shard ORDER BY order_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last FROM og),
e AS (SELECT p.*, rounds, greatest(0, least(of_key, least(stop, m) * 8 - last + of_key)) AS high, greatest(0, least(of_key, start * 8 - last + of_key)) AS low,
             greatest(0, least(of_key, greatest(stop - m, 0) * 8 - last + of_key)) AS wrap
      FROM p JOIN c ON p.nth = c.nth AND p.shard = c.shard)
SELECT laid.doc_id, laid.size, laid.source_size, laid.target,
       CAST(rounds * size + wrap * size // greatest(of_key, 1) + high * size // greatest(of_key, 1) - low * size // greatest(of_key, 1) AS BIGINT) AS taken
FROM laid JOIN e ON laid.nth = e.nth AND laid.shard = e.shard AND laid.order_key = e.order_key
"""
