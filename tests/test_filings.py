"""Growth of filings against those of the year before, without a join of all pairs."""

from tidemark.sources import normalize


def test_filings_meet_no_pairs(spark):
    """One period with many filings a year: the join of all pairs is gone, the last earlier one counts."""
    rows = [("a", y * 1000 + i, y, "Q1", f"{y + i % 2}-03-{i % 28 + 1:02}", c, float(i + y)) for y in (2001, 2002, 2003) for i in range(40) for c in ("revenue", "income") if i % 5 or c == "income"]
    rows += [(None, 1, 2001, "Q1", "2001-03-01", "revenue", 1.0), (None, 2, 2002, "Q1", "2002-03-01", "revenue", 2.0)]
    d = spark.createDataFrame(rows, "id string, accession int, fiscal_year int, period string, day string, concept string, value double")
    out = normalize.filings(d.selectExpr("id", "accession", "fiscal_year", "period", "to_date(day) AS event_day", "concept", "value"), ["id"], ("revenue", "income"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    facts = {}
    for i, a, y, p, day, c, v in rows:
        facts.setdefault((i, a, y, p, day), {})[c] = v
    got = {(r.id, r.accession): r for r in out.collect()}
    assert len(got) == len(facts)
    for (i, a, y, p, day), own in facts.items():
        known = [((e, b), f) for (j, b, z, q, e), f in facts.items() if i is not None and j == i and z == y - 1 and q == p and (e, b) < (day, a)]
        last = max(known, key=lambda k: k[0])[1] if known else {}
        for c in ("revenue", "income"):
            v, base = own.get(c), last.get(c)
            want = None if v is None or base is None else max(-1.0, min(1.0, (v - base) / max(1.0, abs(base))))
            assert got[i, a][f"{c}_growth"] == want
