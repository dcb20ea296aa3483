"""The rows with the highest scores, of which only those on the border are sorted."""

from tidemark.operators import metrics


def test_only_the_border_is_sorted(spark):
    rows = [(g, None if i % 9 == 0 else float(i * 7 % 5), i, None if i % 13 == 0 else i % 3 % 2) for g, n in (("a", 97), ("b", 3), (None, 40)) for i in range(n)]
    d = spark.createDataFrame(rows, "model string, score double, id int, actual int").repartition(3)
    for share in (0.1, 0.45, 1.0):
        out = metrics.top_share(d, ["model"], "score", ["id"], share=share)
        assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.model: (r.selected, r.hit_rate) for r in out.collect()}
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0.0), r[2]))
            top = own[: max(1, -(-len(own) * round(share * 100) // 100))]
            known = [r[3] for r in top if r[3] is not None]
            assert got[g][0] == len(top) and (got[g][1] is None if not known else abs(got[g][1] - sum(known) / len(known)) < 1e-12)
