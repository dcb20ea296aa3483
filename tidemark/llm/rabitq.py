"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index. sqrt(n) of the n different vectors, chosen by hash, are pivots; every vector belongs to its
nearest pivot, is centred on it and rotated by a seeded random orthogonal matrix. Of the unit
direction o, only the signs are kept: with x = signs / sqrt(d), a vector's record is its packed bits,
its norm and f = <x, o>. A pivot's vectors are spread over blocks of packed records, so a pivot with a
third of all vectors is many blocks.

Search. A query visits its nearest pivots, as many as it takes for RECALL of the true neighbours of a
bounded sample of CALIBRATION queries to lie with them; those are searched in all blocks to find this
out. Queries travel in packed rows to lots of blocks, so that what they send grows with their number
alone, and a block's vectors move once; a block meets each packet of its lot, and the queries in it that
visit the block. There, for a query's unit direction q, <x, q> / f estimates <o, q>; the error lies
within epsilon * sqrt((1 - f^2) / (f^2 (d - 1))) but for a probability that falls exponentially with
epsilon^2. This gives bounds on every distance: vectors whose lower bound is under the k-th smallest upper
bound are reranked by their exact distance, and each visit sends on k + 1 results. With `visits` as large as the number of pivots every block is searched.

Where vectors form no groups, neighbours lie with many pivots, and the number of visits, which follows
the data, grows with the number of pivots; where they do, it hardly grows, and the work is about
n^1.5 for the pivots and n for the search of n / 100 queries.

Equal vectors are one entry with their k + 1 smallest ids, which is all that a result can hold,
and equal queries are searched once, so groups of copies cost what one vector costs.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; null
ids neither; a query is searched among the vectors of its own length; ties go to the smaller id;
repeated rows of one id count once for each different vector; fewer than k candidates give all of
them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable, pieces, read

EPSILON = 2.5
RECALL = 0.97
CALIBRATION = 64
CODES_AT_ONCE = 4096
QUERIES_AT_ONCE = 256
#: A packet of so many queries is about as large as a block of codes and vectors.
QUERIES_A_PACKET = 4096
#: Blocks are searched in so many lots at most; a query travels once to each lot that holds a block it visits.
LOTS = 128
#: Distances from vectors to pivots that a task holds at once.
DISTANCES_AT_ONCE = 4_000_000
SEED = 20


@lru_cache(maxsize=4)
def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norm and f of each vector."""
    moved = (vectors - centre) @ rotation(vectors.shape[1], seed)
    norm = np.linalg.norm(moved, axis=1)
    unit = moved / np.maximum(norm, 1e-300)[:, None]
    return np.packbits(moved > 0, axis=1), norm, np.abs(unit).sum(1) / np.sqrt(vectors.shape[1])


def bounds(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, f: np.ndarray, d: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances; queries are centred and rotated."""
    size = np.linalg.norm(queries, axis=1)
    unit = queries / np.maximum(size, 1e-300)[:, None]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    safe = np.maximum(f, 1e-6)
    inner = (unit.astype(np.float32) @ signs.T) / np.float32(np.sqrt(d)) / safe
    error = epsilon * np.sqrt(np.maximum(1 - f**2, 0) / (safe**2 * max(d - 1, 1))) + 1e-5
    scale = 2 * np.outer(size, norm)
    middle = size[:, None] ** 2 + norm**2
    return middle - scale * np.minimum(inner + error, 1), middle - scale * np.maximum(inner - error, -1)


def valid(df: DataFrame) -> DataFrame:
    """vec_id and embedding (an array of float where the table has one, else of double) of the vectors that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if df.select("embedding").schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _matrix(column: pa.Array) -> np.ndarray:
    """Of vectors of one length without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float) if len(column) else np.empty((0, 0))


def _to_bytes(vectors: np.ndarray) -> bytes:
    """In single precision where that loses nothing; the length tells which."""
    small = vectors.astype(np.float32)
    return (small if (small == vectors).all() else vectors).tobytes()


def _from_bytes(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * d else np.float64).reshape(n, d).astype(float)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances less the vectors' own squares) for slices of the vectors."""
    squares, step = (pivots**2).sum(1), max(1, DISTANCES_AT_ONCE // max(1, len(pivots)))
    for start in range(0, len(vectors), step):
        yield start, squares - 2 * vectors[start : start + step] @ pivots.T


def lowest(entries: DataFrame, wanted: int, n: int, seed: int | None = None) -> list[Row]:
    """The `wanted` of n entries with the smallest hashes, in that order.

    Hashes are even, so those below a bound hold them but for a chance below 1e-9; only those come to the driver, where a limit
    would bring as many from every partition. Where they hold too few, the bound rises until they do.
    """
    place = F.xxhash64("entry") if seed is None else F.xxhash64("entry", F.lit(seed))
    expected = wanted + 8 * math.sqrt(wanted) + 40
    while True:
        bound = -(2**63) + math.ceil(2**64 * min(1.0, expected / max(1, n)))
        found = (entries if bound >= 2**63 else entries.filter(place < F.lit(bound))).select(place.alias("place"), "entry", "embedding").collect()
        if len(found) >= min(wanted, n) or bound >= 2**63:
            return sorted(found, key=lambda r: (r.place, r.entry))[:wanted]
        expected *= 4


class Index:
    """Blocks of codes and vectors by pivot. Only pivots and their numbers of blocks are known outside."""

    def __init__(self, entries: DataFrame, d: int, epsilon: float, seed: int) -> None:
        self.d, self.epsilon, self.seed = d, epsilon, seed
        n = entries.count()
        sample = lowest(entries, math.isqrt(max(1, n - 1)) + 1, n)
        self.pivots = np.array([r.embedding for r in sample], float).reshape(-1, d)
        self.placed = durable(self.place(entries))
        found = {r.pivot: r.n for r in self.placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # one row a pivot
        self.first = np.concatenate([[0], np.cumsum([-(-found.get(p, 0) // CODES_AT_ONCE) for p in range(len(self.pivots))])]).astype(int)
        self.blocks = durable(self._packed())

    def place(self, entries: DataFrame) -> DataFrame:
        """entry, embedding, pivot."""
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = [part.argmin(1) for _, part in distances(_matrix(batch.column("embedding")), pivots)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(near) if near else [], pa.int64())], names=["entry", "embedding", "pivot"])

        return entries.select("entry", "embedding").mapInArrow(run, f"entry long, embedding {entries.schema['embedding'].dataType.simpleString()}, pivot long")

    def _packed(self) -> DataFrame:
        """A pivot's vectors over its blocks: codes, norm and f beside the vectors themselves."""
        d, pivots, seed = self.d, self.pivots, self.seed

        def pack(table: pa.Table) -> pa.Table:
            vectors, pivot = _matrix(table.column("embedding").combine_chunks()), table.column("pivot")[0].as_py()
            codes, norm, f = encode(vectors, pivots[pivot], seed)
            values = [table.column("entry").to_numpy().astype("<i8").tobytes(), _to_bytes(vectors), codes.tobytes(), norm.tobytes(), f.tobytes()]
            named = zip(("entries", "vectors", "codes", "norm", "f"), values, strict=True)
            return pa.table({"block": table.column("block").slice(0, 1), "pivot": table.column("pivot").slice(0, 1)} | {n: pa.array([v], pa.binary()) for n, v in named})

        spans = self.placed.sparkSession.createDataFrame([(p, int(self.first[p]), int(self.first[p + 1] - self.first[p])) for p in range(len(pivots)) if self.first[p + 1] > self.first[p]], "pivot long, first long, n long")
        rows = self.placed.join(F.broadcast(spans), "pivot")  # one row a pivot, and pivots are broadcast anyway
        rows = rows.select((F.col("first") + F.pmod(F.xxhash64("entry", F.lit(1)), F.col("n"))).alias("block"), "pivot", "entry", "embedding")
        return rows.groupBy("block").applyInArrow(pack, "block long, pivot long, entries binary, vectors binary, codes binary, norm binary, f binary")

    def visit(self, queries: DataFrame, k: int, visits: int) -> DataFrame:
        """q, entry, score: the k + 1 nearest (with ties) that queries (entry, embedding) find in each block of their `visits` nearest pivots."""
        d, pivots, epsilon, seed = self.d, self.pivots, self.epsilon, self.seed
        visits, blocks_of = min(visits, len(pivots)), np.diff(self.first)
        together = max(1, -(-int(self.first[-1]) // LOTS))  # blocks a lot

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, QUERIES_A_PACKET):
                vectors, asked = _matrix(batch.column("embedding")), batch.column("entry").to_numpy().astype("<i8")
                near = np.zeros((len(asked), len(pivots)), bool)
                for start, part in distances(vectors, pivots):
                    np.put_along_axis(near[start : start + len(part)], np.argpartition(part, visits - 1, axis=1)[:, :visits], True, axis=1)
                blocks = np.repeat(near, blocks_of, axis=1)
                for lot in range(-(-blocks.shape[1] // together)):
                    own = blocks[:, lot * together : (lot + 1) * together]
                    if len(here := np.flatnonzero(own.any(1))):
                        values = [asked[here].tobytes(), _to_bytes(vectors[here]), np.packbits(own[here], axis=1).tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names=["lot", "asked", "asked_vectors", "stops"])

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                everyone, (byte, bit) = np.frombuffer(row["asked"], "<i8"), divmod(row["block"] % together, 8)
                here = np.flatnonzero(np.frombuffer(row["stops"], np.uint8).reshape(len(everyone), -1)[:, byte] >> (7 - bit) & 1)
                if not len(here):
                    continue
                entry, norm, f = np.frombuffer(row["entries"], "<i8"), np.frombuffer(row["norm"]), np.frombuffer(row["f"])
                own, codes = _from_bytes(row["vectors"], len(entry), d), np.frombuffer(row["codes"], np.uint8).reshape(len(norm), -1)
                everyones = _from_bytes(row["asked_vectors"], len(everyone), d)
                for some in np.split(here, range(QUERIES_AT_ONCE, len(here), QUERIES_AT_ONCE)):
                    asked, vectors = everyone[some], everyones[some]
                    low, high = bounds((vectors - pivots[row["pivot"]]) @ rotation(d, seed), codes, norm, f, d, epsilon)
                    limit = np.partition(high, k, axis=1)[:, k] if len(entry) > k else np.full(len(asked), np.inf)
                    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for i in range(len(asked)):
                        at = np.flatnonzero(low[i] <= limit[i])
                        score = np.sqrt(((own[at] - vectors[i]) ** 2).sum(1))
                        if len(at) > k + 1:  # all that tie with the k + 1-st stay: which of them counts is decided by id
                            near = score <= np.partition(score, k)[k]
                            at, score = at[near], score[near]
                        out.append((np.full(len(at), asked[i]), entry[at], score))
                    q, e, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(e, pa.int64()), pa.array(s, pa.float64())], names=["q", "entry", "score"])

        dealt = queries.select("entry", "embedding").repartition(max(1, -(-queries.count() // QUERIES_A_PACKET)))
        packets = dealt.mapInArrow(pack, "lot long, asked binary, asked_vectors binary, stops binary")
        lots = self.blocks.withColumn("lot", F.floor(F.col("block") / together))
        # By bytes, Spark would leave this a few tasks, though it is most of the work. Without the hint it judges
        # by the small table of queries, and broadcasts all that is sent from it.
        tasks = -(-int(self.first[-1]) // (2 * together))
        joined = lots.repartition(tasks, "lot").join(packets.repartition(tasks, "lot").hint("merge"), "lot")
        return joined.mapInArrow(rerank, "q long, entry long, score double")

    def needed_visits(self, queries: DataFrame, k: int, recall: float) -> int:
        """How many nearest pivots hold `recall` of the k nearest entries of at most CALIBRATION queries, chosen by hash."""
        chosen = lowest(queries, CALIBRATION, queries.count(), 3)
        asked = {r.entry: np.array(r.embedding) for r in chosen}
        sample = queries.sparkSession.createDataFrame([(r.entry, r.embedding) for r in chosen], "entry long, embedding array<double>")
        near = _in_order(self.visit(sample, k, len(self.pivots)), k).filter(F.col("entry") != F.col("q"))
        homes: dict[int, list[int]] = {}
        for r in near.join(self.placed.select("entry", "pivot"), "entry").select("q", "pivot").collect():  # about k rows a query
            homes.setdefault(r.q, []).append(r.pivot)
        ranks: list[int] = []
        for q, own in homes.items():
            order = np.argsort(next(distances(asked[q][None], self.pivots))[1][0], kind="stable")
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            ranks += place[own].tolist()
        return int(np.sort(ranks)[math.ceil(recall * len(ranks)) - 1]) + 1 if ranks else 1


def _in_order(near: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest entries of each query; rank() keeps all that tie with the last."""
    return near.withColumn("nth", F.rank().over(Window.partitionBy("q").orderBy("score"))).filter(F.col("nth") <= k + 1)


def _nearest_of_length(points: DataFrame, d: int, k: int, epsilon: float, seed: int, visits: int | None, spent: list[DataFrame]) -> DataFrame:
    """query_id, vec_id, score of points (vec_id, embedding, asked) of one length; k or more a query. Tables in `spent` go when the points are read."""
    # the rank filter prunes groups of copies before the shuffle
    copies = points.withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    entries = copies.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = durable(entries.withColumn("entry", F.xxhash64(F.col("ids")[0], F.col("embedding").cast("array<double>"))))
    # merge joins: the files of both tables are a fraction of what they take in memory, and Spark goes by files
    query_of = durable(points.filter("asked").join(entries.select("embedding", "entry").hint("merge"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("q")))
    discard(*spent)
    ids_of = durable(entries.select("entry", "ids"))
    index = Index(entries, d, epsilon, seed)
    discard(entries)
    wanted = durable(index.placed.join(query_of, F.col("entry") == F.col("q"), "left_semi"))
    visits = visits or index.needed_visits(wanted, k, RECALL)
    discard(index.placed)
    near = _in_order(index.visit(wanted, k, visits), k)
    ids = near.join(ids_of.hint("merge"), "entry").select("q", "score", F.explode("ids").alias("vec_id"))
    ids = ids.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("nth") <= k + 1)
    return query_of.join(ids, "q").filter("vec_id <> query_id").select("query_id", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, k: int = 10, epsilon: float = EPSILON, seed: int = SEED, visits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest of each query row.

    visits: how many nearest pivots a query visits; by default what RECALL takes on a sample of queries.
    """
    points = durable(valid(df).distinct().withColumn("asked", F.coalesce(is_query, F.lit(False))))
    lengths = sorted(r.d for r in points.groupBy(F.size("embedding").alias("d")).agg(F.count("*")).collect())
    parts = [_nearest_of_length(points.filter(F.size("embedding") == d), d, k, epsilon, seed, visits, [points] if d == lengths[-1] else []) for d in lengths]
    found = df.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for part in parts:
        found = found.unionByName(part)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_rabitq(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
