"""Queries on point-in-time records join no pairs that their results leave out."""

from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.plans import catalog, event_queries

SF = "/root/testdata/sf0.001"


def test_queries_meet_few_pairs(spark, monkeypatch):
    signals, events = event_queries._signals(spark, SF), event_queries._events(spark, SF)
    key = ["symbol", "day", "dataset"]
    want = {tuple(r) for r in pit.capped(pit.as_of(signals, events), ["symbol", "day"]).select(*key, "event_id").collect()}
    counts = {tuple(r) for r in pit.as_of(signals, events).groupBy(*key).count().collect()}
    whole, met = pit.as_of, []

    def watched(left, right):
        out = whole(left, right)
        met.append((right.count(), right.select("symbol", "dataset", "available_day").distinct().count()))
        return out

    monkeypatch.setattr(pit, "as_of", watched)
    more = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("event_id", F.col("event_id") * 2 + F.col("copy")).drop("copy")
    monkeypatch.setattr(event_queries, "_events", lambda *_: more)
    doubled = {(s, d, k, n) for s, d, k, n in catalog.queries()["pit_as_of"](spark, SF).select(*key, "n").collect()}
    assert doubled == {(s, d, k, 2 * n) for s, d, k, n in counts} and [n for n, _ in met] == [n for _, n in met]
    monkeypatch.setattr(event_queries, "_events", lambda *_: events)
    met.clear()
    assert {tuple(r) for r in catalog.queries()["pit_capped"](spark, SF).select(*key, "event_id").collect()} == want and not met
