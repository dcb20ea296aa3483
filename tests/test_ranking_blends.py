"""Rankings by date, dealt so that a task's rows do not grow with the table."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learners as op

DAY = dt.date(2024, 1, 1)
BLENDS = {"rank-only": {"rank": 1.0}, "both": {"rank": 0.5, "other": 0.5}}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = [(DAY + dt.timedelta(days=day), f"S{s:02}", *(float(rng.integers(0, 9)) for _ in range(2)), float(rng.normal()), int(rng.random() < 0.5)) for day in range(100) for s in range(12)]
    return spark.createDataFrame(rows, "day date, symbol string, rank double, other double, ret double, up int").repartition(3)


def test_tasks_hold_a_bounded_number_of_rows(data, monkeypatch):
    monkeypatch.setattr(op, "DATE_ROWS", 40, raising=False)
    got = op.percentiles(data, "day", ["rank", "other"]).withColumn("task", F.spark_partition_id()).toPandas()
    assert got.groupby("task").size().max() <= 5 * 40 and got.task.nunique() > 12  # ranges of dates are estimated from samples
    assert (got.groupby("day").task.nunique() == 1).all() and len(got) == 1200
    for c in ("rank", "other"):
        want = (got.groupby("day")[c].rank(method="average") - 1) / 11
        assert np.allclose(got[f"pct_{c}"], want)


def test_parts_are_ranked_once_and_after_the_choice_of_dates(data):
    columns = ["rank", "other"]
    whole = op.chosen_blend(op.percentiles(data, "day", columns), "day", "ret", "up", ["symbol"], BLENDS, top=3)
    parts = op.inner_block(data, "day")
    once = op.blends_of_parts(op.percentiles(parts, "day", columns), "day", "ret", "up", ["symbol"], BLENDS, top=3)
    a, b = (x.toPandas().sort_values("blend").reset_index(drop=True) for x in (whole, once))
    assert list(a.columns) == list(b.columns) and a.selected.sum() == 1 and np.allclose(a.drop(columns="blend").astype(float), b.drop(columns="blend").astype(float))
    for part in ("inner", "test"):
        one = op.blend_metrics(op.percentiles(parts.filter(F.col("part") == part), "day", columns), "day", "ret", "up", ["symbol"], BLENDS, top=3).toPandas().sort_values("blend").reset_index(drop=True)
        for c in ("top_direction_pct", "top_return", "lift"):
            assert np.allclose(one[c], b[c if part == "inner" else f"test_{c}"])
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # both parts in one pass
    assert op.blends_of_parts(op.percentiles(parts.filter("part = 'test'"), "day", columns), "day", "ret", "up", ["symbol"], BLENDS).count() == 0
    assert op.percentiles(data.limit(0), "day", columns).count() == 0
