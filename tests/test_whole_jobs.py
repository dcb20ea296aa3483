"""Queries over the whole job, against brute force."""

import math

import numpy as np
import pytest

from tidemark.operators import portfolio
from tidemark.plans import catalog


def vectors(spark, path):
    """300 rows with copies; -> (vectors, labels, distances, row by row the others by distance and id)."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.4, (300, 64)).astype(np.float32).astype(float)
    x[200:230], label = x[7], rng.integers(0, 10, 300)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).mean(2))
    return label, d, [np.array(sorted((j for j in range(300) if j != i), key=lambda j, i=i: (d[i, j], j))) for i in range(300)]


@pytest.mark.parametrize("most", [64, 4096])
def test_neighbours_of_all_rows(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(portfolio, "BLOCK_ROWS", most)
    monkeypatch.setattr(portfolio, "QUERY_ROWS", most // 8)
    label, d, near = vectors(spark, tmp_path)
    got = {r["query"]: r for r in catalog.queries()["neighbour_coverage"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(0, 300, 10))
    for i, r in got.items():
        s = d[i, near[i][:18]]
        c = max(0.0, min(100.0, 104 - s[0] * 24 - s.mean() * 31 - s[int(17 * 0.75)] * 11 + min(8.0, math.log10(299) * 3.5)))
        assert r.coverage == pytest.approx(c, abs=2e-6) and r.ood_risk == pytest.approx(1 - c / 100, abs=2e-6)
    got = {r["query"]: r for r in catalog.queries()["knn_neighbors"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(0, 300, 25))
    for i, r in got.items():
        s = near[i][:18]
        assert r.neighbours == 18 and (r.label_mean, r.nearest, r.average) == pytest.approx((label[s].mean(), d[i, s].min(), d[i, s].mean()), abs=2e-6)
