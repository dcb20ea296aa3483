"""Centroid clustering of integer vectors: Lloyd rounds on distinct vectors with multiplicities.

Quantising. Each component x becomes floor(scale * x). A vector is kept as its packed integers, in
one, two or four bytes each (the least that hold all of them), so equal vectors are equal keys.

Rounds. Equal vectors are grouped to one row with their number, which combines before the shuffle,
so that a vector with a third of all rows costs what any other costs. Every round sends the
centroids (n_clusters x d numbers) to the tasks; a task assigns its distinct vectors and adds up
components times multiplicities as whole numbers; Spark sums the tasks' sums, and one row for each
centroid and component comes back. Ties go to the smaller number; a new centroid is the floor of
sum / count, all in integers; centroids without vectors stay.

Assignments return to the rows by a join on the packed vector. Vectors held by more than one row
in HOT_SHARE of all are HOT_SHARE at most: they are broadcast, and only the others meet by shuffle.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take
no part, nor do those with a component beyond LIMIT after scaling (their squared distances do not
fit 64 bits); with fewer vectors than n_clusters each one starts a centroid; repeated rows count,
and are returned, as often as they stand there; null ids are clustered too and start a centroid
last; an inertia beyond 64 bits is null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, read

#: Largest absolute component after scaling: d = 64 squares of differences of two such fit 63 bits.
LIMIT = 1 << 27
#: Sums of products of components up to this size are exact in doubles (64 * 2^44 < 2^53).
EXACT_IN_DOUBLES = 1 << 22
HOT_SHARE = 4096
TYPES = (np.int8, np.int16, np.int32)


def pack(q: np.ndarray) -> list[bytes]:
    """Each row as bytes of the narrowest of TYPES that holds it; the length tells which."""
    most = np.maximum(q.max(1, initial=0), -1 - q.min(1, initial=0)) if len(q) else np.zeros(0)
    out: list[bytes] = [b""] * len(q)
    done = np.zeros(len(q), bool)
    for kind in TYPES:
        here = ~done & (most <= np.iinfo(kind).max)
        for i, row in zip(np.flatnonzero(here).tolist(), q[here].astype(kind).view(np.uint8), strict=True):
            out[i] = row.tobytes()
        done |= here
    return out


def unpack(vectors: pa.Array, d: int) -> np.ndarray:
    """The integers of packed vectors, a row each."""
    values = [v.as_py() for v in vectors]
    width = np.array([len(v) // d for v in values], np.int64)
    out = np.empty((len(values), d), np.int64)
    for kind in TYPES:
        here = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(here):
            out[here] = np.frombuffer(b"".join(values[i] for i in here), kind).reshape(-1, d)
    return out


def quantised(df: DataFrame, d: int, scale: int) -> DataFrame:
    """vec_id, vector (packed) of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & F.floor(x * scale).between(-LIMIT, LIMIT))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.size("embedding") == d).filter(fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(pack(np.floor(x * scale).astype(np.int64)), pa.binary())], names=["vec_id", "vector"])

    return rows.mapInArrow(run, "vec_id long, vector binary")


def assign(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and the squared distance, exactly."""
    small = max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_IN_DOUBLES
    a, b = (q.astype(float), centroids.astype(float)) if small else (q, centroids)
    apart = ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    near = apart.argmin(1)
    return near, apart[np.arange(len(q)), near]


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, component, total (decimal): components times multiplicities; component -1 holds the number of rows."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, d + 1), object)
        for batch in batches:
            q, n = unpack(batch.column("vector"), d), batch.column("n").to_numpy()
            near, _ = assign(q, centroids)
            fits = float(np.abs(q).max(initial=1)) * float(n.sum()) < 2**62
            for c in np.unique(near):
                own, times = q[near == c], n[near == c]
                sums = times @ own if fits else times.astype(object) @ own.astype(object)
                totals[c, :-1] += sums.astype(object)
                totals[c, -1] += int(times.sum())
        at = [(c, j) for c in range(k) if totals[c, -1] for j in range(d + 1)]
        columns = [pa.array([c for c, _ in at], pa.int32()), pa.array([-1 if j == d else j for _, j in at], pa.int32()), pa.array([str(totals[i]) for i in at], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "part"])

    parts = distinct.select("vector", "n").mapInArrow(run, "cluster int, component int, part string")
    return parts.groupBy("cluster", "component").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def moved(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means; n_clusters x (d + 1) rows come to the driver."""
    out, total = centroids.copy(), {(r.cluster, r.component): int(r.total) for r in sums.collect()}
    for (c, j), value in total.items():
        if j >= 0:
            out[c, j] = value // total[c, -1]
    return out


def lloyd(rows: DataFrame, d: int, n_clusters: int, rounds: int, salt: str) -> tuple[DataFrame, np.ndarray]:
    """Distinct vectors (vector, n, cluster, distance) of rows (vec_id, vector) and the final centroids."""
    distinct = durable(rows.groupBy("vector").agg(F.count("*").alias("n")))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.select("vector", order.alias("nth")).orderBy(F.col("nth").asc_nulls_last(), "vector").limit(n_clusters).select("vector").collect()
    centroids = unpack(pa.array([bytes(r.vector) for r in first], pa.binary()), d)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(weighted_sums(distinct, centroids), centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, apart = assign(unpack(batch.column("vector"), d), centroids) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(apart, pa.int64())], names=["vector", "n", "cluster", "distance"])

    return durable(distinct.select("vector", "n").mapInArrow(last, "vector binary, n long, cluster int, distance long")), centroids


def clusters(df: DataFrame, d: int = 64, scale: int = 64, n_clusters: int = 16, rounds: int = 3, salt: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long) and its sha256, for each row that takes part.

    Centroids start as the vectors whose sha256 of salt and vec_id is smallest.
    """
    spark = df.sparkSession
    rows = durable(quantised(df, d, scale))
    assigned, centroids = lloyd(rows, d, n_clusters, rounds, salt)
    # one row a centroid
    found = assigned.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum((F.col("n").cast("decimal(18,0)") * F.col("distance").cast("decimal(19,0)"))).alias("inertia")).collect()
    n_rows, inertia = sum(r.n for r in found), sum(int(r.inertia) for r in found)
    fits = lambda x: x if x < 1 << 63 else None
    about = [(r.cluster, fits(int(r.inertia)), fits(inertia), centroids[r.cluster].tolist(), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in found]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    is_hot = F.col("n") * HOT_SHARE > n_rows
    hot, rest = (assigned.filter(c).select("vector", "cluster", "distance") for c in (is_hot, ~is_hot))
    hot = F.broadcast(hot)  # HOT_SHARE rows at most, as each stands for more than n_rows / HOT_SHARE rows
    back = rows.join(hot, "vector").unionByName(rows.join(hot, "vector", "left_anti").join(rest, "vector"))
    return back.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op11_weighted_kmeans(spark, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings")).drop("centroid")


def _assigned(number: int) -> str:
    apart = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)])"
    return f"""
d{number} as (select k.id, c.c, {apart}::bigint as away from kept k cross join c{number} c),
a{number} as (select id, c, away from (select *, row_number() over (partition by id order by away, c) as nth from d{number}) where nth = 1)"""


def _centroids(number: int) -> str:
    return f"""
p{number} as (select a.c, j, sum(k.v[j]) as s, count(*) as n from a{number - 1} a join kept k using (id) cross join range(1, 65) r(j) group by a.c, j),
c{number} as (select o.c, coalesce(m.v, o.v) as v from c{number - 1} o left join
  (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as v from p{number} group by c) m using (c))"""


OP11_SQL = f"""
with numbered as (
  select row_number() over () as id, vec_id, embedding from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
kept as (select id, vec_id, [floor(64 * x::double)::bigint for x in embedding] as v from numbered),
c0 as (select row_number() over (order by h) - 1 as c, v from (select sha256('1:' || vec_id) as h, v from kept order by h limit 16)),
{_assigned(0)},{_centroids(1)},{_assigned(1)},{_centroids(2)},{_assigned(2)},{_centroids(3)},{_assigned(3)}
select k.vec_id, a.c::int as cluster, a.away as distance, (sum(a.away) over (partition by a.c))::bigint as cluster_inertia,
  (sum(a.away) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a3 a join kept k using (id) join c3 c using (c)"""
