"""What the fits of out-of-fold scores read."""

from pyspark.sql import functions as F

from tidemark.operators import learners as op
from tidemark.plans import catalog


def test_tasks_of_a_fit_follow_the_rows(spark, monkeypatch):
    d = spark.range(1000).select("id", F.xxhash64("id").alias("x")).repartition(32)
    cores = spark.sparkContext.defaultParallelism
    assert op.for_fits(d, ["id"]).rdd.getNumPartitions() == cores
    monkeypatch.setattr(op, "FIT_ROWS", 90)
    ways = [op.for_fits(x, ["id"]) for x in (d, d.repartition(7))]
    assert [x.rdd.getNumPartitions() for x in ways] == [12, 12] and ways[0].rdd.glom().collect() == ways[1].rdd.glom().collect()
    assert sorted(ways[0].collect()) == sorted(d.collect())
    assert op.for_fits(d.limit(0), ["id"]).count() == 0


def test_shuffle_partitions_do_not_multiply_tasks(spark, monkeypatch):
    read = []
    monkeypatch.setattr(op, "out_of_fold", lambda folds, *args: read.append(folds.rdd.getNumPartitions()) or folds.withColumns({c: F.lit(0.0) for n in op.BASE for c in ([f"{n}_{i}" for i in range(3)] if n == "outcome" else [n])}))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        catalog.queries()["oof_scores"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert read == [spark.sparkContext.defaultParallelism]
