import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rabitq


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in good:
        if q % 10 == 0:
            near = sorted({(float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q})
            out[q] = [(i, s) for s, i in near[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("visits", [None, 10_000])
def test_equals_brute_force_with_copies(spark, monkeypatch, visits):
    monkeypatch.setattr(rabitq, "CODES_AT_ONCE", 10)
    monkeypatch.setattr(rabitq, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(rabitq, "RECALL", 1.0)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 32))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.3 * rng.standard_normal(32)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(300)]
    bad = [(2000, None), (2010, [0.0] * 32), (2020, [None] + [1.0] * 31), (2030, [float("nan")] + [1.0] * 31), (2040, [1.0, 2.0]), (2050, []), (None, [1.0] * 32)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, block string, score int")
    got, want = result(rabitq.nearest(df, F.col("vec_id") % 10 == 0, visits=visits)), brute(rows, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert [i for i, _ in got[710]] == [0, *range(700, 709)]
    for q in want:
        for i, s in got[q]:
            assert s == dict((j, t) for j, t in brute([r for r in rows if r[0] in (q, i)] , 10)[q])[i]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert rabitq.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (10, [3.0, 0.0])], schema)
    assert result(rabitq.nearest(few, F.col("vec_id") % 10 == 0)) == {0: [(1, 2**0.5), (10, 2.0)], 10: [(0, 2.0), (1, 10**0.5)]}
    none = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert rabitq.nearest(none, F.col("vec_id") % 10 == 0).count() == 0


def recall(df, x, every):
    got, x, hits = result(rabitq.nearest(df, F.col("vec_id") % every == 0)), x.astype(float), 0
    for q in range(0, len(x), every):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for i, _ in got[q]})
    assert len(got) == -(-len(x) // every)
    return hits / (10 * len(got))


@pytest.mark.parametrize("grouped", [False, True])
def test_recall_at_volume(spark, monkeypatch, grouped):
    """Unclustered vectors are the hardest case; clustered ones need few visits."""
    seen = []
    original = rabitq.Index.needed_visits
    monkeypatch.setattr(rabitq.Index, "needed_visits", lambda self, *a: seen.append((original(self, *a), len(self.pivots))) or seen[-1][0])
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    if grouped:
        x = (3 * rng.standard_normal((200, 64))[rng.integers(0, 200, 4000)] + 0.3 * x).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall(df, x, 10) >= 0.93
    assert seen[0][1] == 64 and (seen[0][0] <= 8 if grouped else seen[0][0] > 8)


def test_extra_columns_and_names(spark):
    names = ["q", "entry", "pivot", "packet", "asked", "nth", "query_id", "rank", "ids", "block"]
    plain = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    want = result(rabitq.nearest(plain, F.col("vec_id") % 10 == 0))
    assert result(rabitq.nearest(plain.withColumns({n: F.lit("x") for n in names}), F.col("vec_id") % 10 == 0)) == want


def test_vectors_of_each_length_are_searched(spark):
    rows = [(i, [float(i + 1)] * (2 + i % 2)) for i in range(8)]
    got = result(rabitq.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), F.col("vec_id") < 2, k=2))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [2, 4], 1: [3, 5]}


@pytest.mark.parametrize(("wanted", "n"), [(1, 3000), (55, 3000), (2990, 3000), (4000, 3000), (55, 3_000_000), (55, 10)])
def test_lowest_hashes_without_a_limit_of_every_partition(spark, wanted, n):
    """n, the number of entries, only sets the first bound: a wrong one costs more tries or more rows."""
    rows = spark.range(3000, numPartitions=40).select(F.xxhash64("id").alias("entry"), F.array(F.col("id").cast("double")).alias("embedding"))
    want = [r.entry for r in rows.orderBy(F.xxhash64("entry"), "entry").limit(wanted).collect()]
    assert [r.entry for r in rabitq.lowest(rows, wanted, n)] == want[:wanted]
    assert [r.entry for r in rabitq.lowest(rows, 20, n, 3)] == [r.entry for r in rows.orderBy(F.xxhash64("entry", F.lit(3)), "entry").limit(20).collect()]


def broadcasts(node):
    """Bytes of each broadcast of a plan that has run."""
    name = node.nodeName()
    if name == "BroadcastExchange":
        yield node.metrics().apply("dataSize").value()
    inner = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else []
    for x in inner or [node.children().apply(i) for i in range(node.children().size())]:
        yield from broadcasts(x)


def test_what_queries_send_to_blocks_is_not_broadcast(spark, monkeypatch):
    """Files of rows that repeat a vector for each block are small, the rows are not: Spark took them for a small table."""
    monkeypatch.setattr(rabitq, "CODES_AT_ONCE", 10)
    x = np.random.default_rng(5).standard_normal((6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry long, embedding array<double>")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1200k")
    try:
        index = rabitq.Index(df, 64, rabitq.EPSILON, rabitq.SEED)
        found = index.visit(df.filter("entry % 20 = 0"), 10, len(index.pivots))
        assert {r.q for r in found.collect()} == set(range(0, 6000, 20))
    finally:
        spark.conf.set(threshold, before)
    assert max(broadcasts(found._jdf.queryExecution().executedPlan()), default=0) < 10e6


def test_lots_packets_and_element_type_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = result(rabitq.nearest(df, F.col("vec_id") % 10 == 0, visits=5))
    assert len(want) == 60 and {len(v) for v in want.values()} == {10}
    assert [rabitq.valid(df.withColumnRenamed("embedding", n)).schema["embedding"].dataType.simpleString() for n in ("embedding", "Embedding")] == ["array<float>"] * 2
    for name, value in (("LOTS", 3), ("QUERIES_A_PACKET", 20), ("QUERIES_AT_ONCE", 3)):
        monkeypatch.setattr(rabitq, name, value)
    assert result(rabitq.nearest(df.withColumn("embedding", F.col("embedding").cast("array<double>")), F.col("vec_id") % 10 == 0, visits=5)) == want
