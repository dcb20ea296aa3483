"""Records chosen by number against the join of all pairs."""

import datetime as dt
import random

from tidemark.operators import pit

DAY = dt.date(2024, 1, 1)


def test_numbers_choose_what_the_join_of_all_pairs_does(spark):
    rng = random.Random(5)
    at = lambda n: DAY + dt.timedelta(days=n)
    signals = spark.createDataFrame([(s, at(d), d) for s in ("A", "B", "none") for d in range(0, 500, 7)], "symbol string, day date, weight_of_signal int")
    rows = []
    for i in range(1500):
        happened = rng.randrange(500)
        rows.append((i, rng.choice("AAAB"), rng.choice(["news", "social", "fundamentals", "financial_disclosures", "macro", "macro", "other", None]), rng.choice(["x", "y", "z", None]), at(happened), at(happened + rng.randrange(4)), rng.random(), True))
    rows += [(5000 + i, "A", "news", "x", at(100), at(100), 0.5, True) for i in range(60)]  # more on one day than the limit
    rows += [(6000, "A", "news", "x", None, at(3), 0.1, True), (6001, "A", "news", "x", at(3), None, 0.1, True), (6002, "A", "news", "x", at(9), at(3), 0.1, True)]
    events = pit.prepare(spark.createDataFrame(rows, "event_id long, symbol string, dataset string, series string, event_day date, available_day date, sentiment double, verified boolean"))[0].repartition(3)
    key = ["symbol", "day"]
    pick = lambda d: sorted(tuple(r) for r in d.select("symbol", "day", "event_id", "age_days", "weight_of_signal").collect())
    got = pick(pit.recent(signals, events, key))
    assert got == pick(pit.capped(pit.as_of(signals, events), key)) and len(got) > 3000
    assert pit.recent(signals, events.filter("false"), key).count() == 0 and pit.recent(signals.filter("false"), events, key).count() == 0
