"""Operators against direct computations, and properties that must hold on any data."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars, series
from tidemark.operators import bars, indicators, labels, metrics, models, panel, pit, portfolio
from tidemark.operators import structure, trades
from tidemark.sources import lake, normalize
from tidemark.streaming import market as stream

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def candles(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(3):
        close = 100.0
        for i in range(400):
            o, close = close, close * math.exp(rng.normal(0, 0.02))
            hi, lo = max(o, close) * (1 + abs(rng.normal(0, 0.005))), min(o, close) * (1 - abs(rng.normal(0, 0.005)))
            rows.append(("US", f"S{s}", "a", DAY + dt.timedelta(days=i), o, hi, lo, close, float(rng.integers(100, 5000)), 3))
    return spark.createDataFrame(rows, "market string, symbol string, sector string, day date, open double, high double, low double, close double, volume double, trade_count long")


def test_ema_equals_pandas(spark, candles):
    got = series.ema(candles, "close", 26, ["symbol"], ["day"], "e").toPandas().sort_values(["symbol", "day"])
    want = got.groupby("symbol").close.transform(lambda x: x.ewm(span=26, adjust=False).mean())
    assert np.allclose(got.e, want, rtol=1e-10)
    with pytest.raises(ValueError):
        series.ema(candles, "close", 51, ["symbol"], ["day"], "e")


def test_features_do_not_see_the_future(spark, candles):
    full = indicators.scores(indicators.alpha_frame(indicators.bollinger(candles)))
    columns = ["symbol", "day", "macd_hist", "rsi", "squeeze_score", "vwap_gap", "trend_score", "factor_quality", "momentum_20"]
    cut = DAY + dt.timedelta(days=250)
    a = full.filter(F.col("day") <= cut).select(*columns).toPandas().sort_values(["symbol", "day"]).reset_index(drop=True)
    b = indicators.scores(indicators.alpha_frame(indicators.bollinger(candles.filter(F.col("day") <= cut)))).select(*columns).toPandas().sort_values(["symbol", "day"]).reset_index(drop=True)
    for c in columns[2:]:
        assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-9), c


def test_order_of_rows_does_not_matter(spark, candles):
    a = sorted(map(str, structure.liquidity_sweeps(candles).collect()))
    assert a == sorted(map(str, structure.liquidity_sweeps(candles.orderBy(F.rand(3)).repartition(5)).collect())) and a


def test_validation_reasons(spark):
    cases = [((1.0, 2.0, 0.5, 1.5, 1.0), None), ((1.0, 2.0, 0.5, 0.0, 1.0), "non_positive_close"), ((1.0, 2.0, 0.5, None, 1.0), "non_positive_close"), ((-1.0, 2.0, 0.5, 1.0, 1.0), "non_positive_price"),
             ((1.0, 0.5, 0.6, 1.0, 1.0), "high_below_low"), ((1.0, 0.9, 0.5, 0.8, 1.0), "high_below_open_or_close"), ((1.0, 2.0, 1.5, 1.8, 1.0), "low_above_open_or_close"), ((1.0, 2.0, 0.5, 1.5, -1.0), "negative_volume"), ((None, None, None, 1.0, None), None), ((float("nan"), 2.0, 1.0, 1.5, 1.0), None)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, open double, high double, low double, close double, volume double")
    got = [r.reason for r in df.withColumn("reason", bars.validation_reason()).orderBy("i").collect()]
    assert got == [r for _, r in cases]


def outcome(rows, t, h, target, stop):
    entry = rows[t + 1][0]
    path = rows[t + 1 : t + 1 + h]
    event = bar = None
    for k, (_, hi, lo, _) in enumerate(path, 1):
        up, down = (hi - entry) / entry * 100 >= target, (lo - entry) / entry * 100 <= -stop
        if up or down:
            event, bar = ("ambiguous" if up and down else "target" if up else "stop"), k
            break
    top, low = max(entry, *(r[1] for r in path)), min(entry, *(r[2] for r in path))
    return event, bar, (top / entry - 1) * 100, (low / entry - 1) * 100, (path[-1][3] / entry - 1) * 100


def test_triple_barrier_and_confidence_equal_a_loop(spark, candles):
    h, target, stop = 10, 3.0, 2.0
    d = candles.withColumns({"target_pct": F.lit(target), "stop_pct": F.lit(stop)})
    got = labels.triple_barrier(d, h).orderBy("symbol", "day").collect()
    raw = candles.toPandas().sort_values(["symbol", "day"])
    kinds = set()
    for s, g in raw.groupby("symbol"):
        rows = list(zip(g.open, g.high, g.low, g.close))
        mine = [r for r in got if r.symbol == s]
        assert len(mine) == len(rows) - 1
        for t, r in enumerate(mine):
            event, bar, up, down, final = outcome(rows, t, h, target, stop)
            kinds.add(event)
            assert (r.event, r.event_bar) == (event, bar)
            assert (r.max_upside, r.max_drawdown, r.forward_return) == pytest.approx((up, down, final))
            assert not (r.target_wins and r.stop_wins)
    assert kinds == {None, "target", "stop", "ambiguous"} or kinds == {None, "target", "stop"}
    out = labels.labelled(candles, h, 8.0, 5.0).toPandas()
    assert out.confidence.between(0.12, 1).all() and out.noise.between(0, 100).all() and len(out) == 3 * (400 - 55 - h)


def test_metrics_equal_direct(spark):
    rng = random.Random(1)
    rows = [("g", rng.randrange(11) / 10, rng.randrange(2)) for _ in range(300)]
    r = metrics.auc_ap(spark.createDataFrame(rows, "g string, p double, y int"), ["g"], "p", "y").first()
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    assert r.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    hits, total = 0, 0.0
    for i, (p, y) in enumerate(sorted(((p, y) for _, p, y in rows), reverse=True), 1):
        hits += y
        total += y * hits / i
    assert r.average_precision == pytest.approx(total / len(pos))
    assert metrics.auc_ap(spark.createDataFrame([("g", 0.5, 1)], "g string, p double, y int"), ["g"], "p", "y").first().auc is None


def test_fits_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [1.0, -0.3, 2.0] + rng.normal(size=500)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, label double")
    got = panel.ridge(df, ("a", "b", "c"), 0.5)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    want = np.linalg.solve(z.T @ z / 500 + 0.5 * np.eye(3), z.T @ (y - y.mean()) / 500)
    assert [got["a"], got["b"], got["c"]] == pytest.approx(want.tolist(), abs=1e-9)
    p = rng.uniform(0.05, 0.95, 2000)
    t = (rng.random(2000) < 1 / (1 + np.exp(-(0.3 + 0.6 * np.log(p / (1 - p)))))).astype(int)
    a, b = models.fit_platt(spark.createDataFrame([(float(i), int(j)) for i, j in zip(p, t)], "p double, y int"), "p", "y")
    assert a == pytest.approx(0.3, abs=0.15) and b == pytest.approx(0.6, abs=0.12)
    knots = models.isotonic(spark.createDataFrame([(float(i), int(j)) for i, j in zip(p, t)], "p double, y int"), "p", "y", 50)
    assert all(u <= v + 1e-12 for (_, u), (_, v) in zip(knots, knots[1:]))
    coef, base, centre, scale = models.linear_kernel(x, y, np.ones(500), epochs=3000, penalty=0.0)
    assert base + (x - centre) / scale @ coef == pytest.approx(np.c_[np.ones(500), x] @ np.linalg.lstsq(np.c_[np.ones(500), x], y, rcond=None)[0], abs=0.05)


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=8), st.floats(0.05, 1))
@settings(max_examples=60, deadline=None)
def test_capped_simplex(values, cap):
    """The projection keeps the order, and no weight that can grow is further below its value than one that can shrink."""
    v = np.array(values)
    w = models.simplex_projection(v, cap)
    assert w.sum() == pytest.approx(1) and w.min() >= -1e-12 and w.max() <= max(cap, 1 / len(values)) + 1e-9
    slope, up, down = w - v, w < max(cap, 1 / len(v)) - 1e-9, w > 1e-9
    assert not up.any() or not down.any() or slope[down].max() <= slope[up].min() + 1e-7


def test_stack_is_the_minimum(spark):
    rng = np.random.default_rng(9)
    p, y, w = rng.uniform(0.05, 0.95, (400, 4)), rng.integers(0, 2, 400), rng.uniform(0.1, 2, 400)
    p[:, 1] = np.clip(y * 0.6 + 0.2 + rng.normal(0, 0.05, 400), 0.01, 0.99)
    got = models.fit_stack(spark.createDataFrame([(*map(float, a), int(b), float(c)) for a, b, c in zip(p, y, w)], "a double, b double, c double, d double, y int, w double"), list("abcd"), "y", "w")
    weights = np.array([got[n] for n in "abcd"])
    loss = lambda u: (w * (p @ u - y) ** 2).sum() / w.sum() + 0.18 * ((u - 0.25) ** 2).sum()
    assert weights[1] == pytest.approx(0.35) and weights.sum() == pytest.approx(1)
    for _ in range(300):
        other = models.simplex_projection(weights + rng.normal(0, 0.05, 4), 0.35)
        assert loss(weights) <= loss(other) + 1e-9


def test_as_of_never_leaks(spark):
    rng = random.Random(3)
    day = lambda k: DAY + dt.timedelta(days=k)
    events = [(i, f"S{rng.randrange(3)}", rng.choice(list(pit.MAX_AGE)), day(e := rng.randrange(600)), day(e + rng.randrange(9)), rng.uniform(-1, 1), "1", rng.random() < 0.9, 0.6, 0.8) for i in range(500)]
    signals = [(f"S{s}", day(k)) for s in range(3) for k in range(0, 700, 23)]
    ev = spark.createDataFrame(events, "event_id long, symbol string, dataset string, event_day date, available_day date, sentiment double, series string, verified boolean, relevance double, source_quality double")
    sg = spark.createDataFrame(signals, "symbol string, day date")
    kept, excluded = pit.prepare(ev)
    got = {(r.symbol, r.day, r.event_id) for r in pit.as_of(sg, kept).collect()}
    want = {(s, d, i) for s, d in signals for i, t, k, e, a, *_, v, _, _ in events if v and s == t and a <= d and e <= d and (d - a).days <= pit.MAX_AGE[k]}
    assert got == want and want
    assert sum(r.n for r in excluded.collect()) == sum(not e[7] for e in events)
    out = pit.event_features(sg, kept, ["symbol", "day"]).collect()
    assert len(out) == len(signals) and all(r.join_violations == 0 and (r.latest_available is None or r.latest_available <= r.day) for r in out)


def test_lake_upsert_is_idempotent(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    schema = lake.SCHEMA + ", seq long"
    row = lambda s, t, c, seq, hi=None: ("US", "1d", s, t, c, hi or c + 1, c - 1, c, 10.0, "x", None, "2024-01-01", seq)
    first = spark.createDataFrame([row("A", "2024-01-01", 5.0, 1), row("A", "2024-01-01", 6.0, 2), row("A", "2024-01-02", 7.0, 3), row("B", "2024-01-01", 9.0, 4), row("B", "2024-01-02", 9.0, 5, 1.0)], schema)
    assert lake.upsert(spark, root, first, ["seq"]) == {"stored": 3, "inserted": 3, "rejected": 1}
    assert lake.upsert(spark, root, first, ["seq"])["inserted"] == 0
    lake.upsert(spark, root, spark.createDataFrame([row("A", "2024-01-01", 8.0, 1)], schema), ["seq"])
    assert [(r.timestamp, r.close) for r in lake.read_rows(spark, root, "US", "A").collect()] == [("2024-01-01", 8.0), ("2024-01-02", 7.0)]
    assert lake.read_panel(spark, root, "US", ["A", "B"], 1).count() == 2
    lake.create_view(spark, root)
    assert spark.sql("select count(*) from ohlcv").first()[0] == 3
    assert "symbol=A" in str(lake.read(spark, root).filter("symbol = 'A'").inputFiles())


def test_streams_equal_static_rows(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1, 10)
    rows = [(f"S{rng.randrange(2)}", start + dt.timedelta(seconds=20 * i), float(rng.randrange(1, 50)), 1.0 if i == 7 else float(rng.randrange(4)), "x", i) for i in range(600)]
    df = spark.createDataFrame(rows, stream.TICK_SCHEMA)
    for k in range(3):
        df.filter(f"trade_id >= {k * 200} and trade_id < {k * 200 + 200}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    for name, make in (("bars", stream.minute_bars), ("sessions", stream.sessions)):
        live = make(stream.read_ticks(spark, f"{tmp_path}/ticks", 1))
        stream.run_available(live, f"{tmp_path}/c-{name}", f"{tmp_path}/o-{name}")
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/o-{name}").collect()}
        assert got <= {tuple(r) for r in make(df).collect()}  # windows that the watermark has not closed are still open
        assert got or name == "sessions"
    good, bad = stream.fresh(df.withColumn("seen", F.when(F.col("trade_id") == 7, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts"))), "seen")
    assert {r.reason for r in bad.collect()} == {"bad_value", "stale"} and good.count() + bad.count() == 600
    assert stream.deduplicated(df.unionByName(df), ["symbol", "trade_id"]).count() == 600


def test_ledger_stream(spark, tmp_path):
    start = pd.Timestamp("2024-01-01 10:00")
    path = [100, 101, 99, 94, 95, 96, 103, 104]
    rows = [("a", (start + pd.Timedelta(minutes=i)).to_pydatetime(), "S", float(p), 70.0 if i != 4 else 50.0) for i, p in enumerate(path)]
    spark.createDataFrame(rows, "agent string, ts timestamp, symbol string, price double, score double").coalesce(1).write.parquet(f"{tmp_path}/s")
    live = stream.paper_ledger(spark.readStream.schema("agent string, ts timestamp, symbol string, price double, score double").parquet(f"{tmp_path}/s"))
    stream.run_available(live, f"{tmp_path}/c", f"{tmp_path}/o")
    got = spark.read.parquet(f"{tmp_path}/o").orderBy("ts").collect()
    assert [r.action for r in got] == ["buy", "stop", "buy", "take", "buy"] and got[1].price == 94
    assert all(r.cash >= 0 for r in got)


def test_scalars_in_sql_and_columns(spark):
    names = scalars.register_all(spark)
    assert "tm_clamp" in names
    r = spark.sql("select tm_clamp(5D, 0D, 1D) a, tm_number('x', 3D) b, tm_number('NaN', 4D) c, tm_pct_from(0D, 1D) d, tm_iso_week(date'2024-12-30') e, tm_clamp(null, 0D, 1D) f, tm_pct_change(2D, 1D) g").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (1.0, 3.0, 4.0, 0.0, "2025-W01", None, 100.0)
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.1, 3.0)], "x double")
    assert [r[0] for r in df.select(scalars.erfc("x")).collect()] == pytest.approx([math.erfc(x) for x in (0.0, 0.3, 1.1, 3.0)], abs=2e-7)
    close = spark.range(1).select(scalars.market_close(F.lit("2026-01-15").cast("date"), F.lit("ASX")).cast("string")).first()[0]
    assert close == "2026-01-15 05:10:00"
    ts = spark.createDataFrame([("2024-01-05",), ("2024-01-05T10:00:00Z",), ("nonsense",)], "t string").select(scalars.iso_timestamp("t").cast("string")).collect()
    assert [r[0] for r in ts] == ["2024-01-05 23:59:59", "2024-01-05 10:00:00", None]


def test_normalizers(spark):
    df = spark.createDataFrame([("s", ["a", "b"], [["1", "2"], ["3", "4"]])], "symbol string, fields array<string>, items array<array<string>>")
    assert [(r.pos, r.row) for r in normalize.columnar(df, "fields", "items").collect()] == [(0, {"a": "1", "b": "2"}), (1, {"a": "3", "b": "4"})]
    nested = spark.createDataFrame([("s", {"income": {"Q1": {"2024-03-31": 5.0}}})], "symbol string, m map<string,map<string,map<string,double>>>")
    assert tuple(normalize.statements(nested, "m").first()) == ("s", "income", "Q1", "2024-03-31", 5.0)


def test_coverage_and_empty_inputs(spark, candles):
    receipts = spark.createDataFrame([("S0", DAY, DAY + dt.timedelta(days=9)), ("S0", DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=3)), ("S0", DAY + dt.timedelta(days=20), DAY + dt.timedelta(days=20))], "symbol string, start_day date, end_day date")
    got = pit.covered(candles.select("symbol", "day"), receipts).filter("covered").collect()
    assert sorted((r.day - DAY).days for r in got) == [*range(10), 20]
    none = candles.filter("false")
    for f in (structure.fair_value_gaps, structure.fibonacci, structure.wyckoff, structure.volatility, indicators.scores, lambda d: labels.labelled(d, 5, 8.0, 5.0), lambda d: bars.quality(d, ["symbol"])):
        assert f(none).count() == 0
    assert trades.totals(spark.createDataFrame([], "symbol string, ts timestamp, price double, size double, exchange string, trade_id long"), ["symbol"]).count() == 0
    assert portfolio.POLICY["stop_loss"] == 4.0


def test_alpha_expressions(spark, candles):
    from tidemark.operators import alpha

    e = ("neg", ("zscore", ("delta", ("col", "close"), 3), 20))
    got = alpha.with_expressions(candles, [e, ("rank", ("col", "close"), 30)]).toPandas().sort_values(["symbol", "day"])
    step = got.groupby("symbol").close.transform(lambda x: x.diff(3).fillna(0))
    mean = step.groupby(got.symbol).transform(lambda x: x.rolling(20, min_periods=1).mean())
    sd = step.groupby(got.symbol).transform(lambda x: x.rolling(20, min_periods=1).std(ddof=0)).where(lambda x: x > 1e-12, 1.0)
    assert np.allclose(got[alpha.name_of(e)], -((step - mean) / sd).clip(-6, 6), atol=1e-6)
    assert alpha.text(e) == "neg(zscore(delta(close, 3), 20))" and alpha.depth(e) == 3 and alpha.size(e) == 4
    kids = alpha.breed(list(alpha.SEEDS.values()), random.Random(1))
    assert len(kids) == 12 and len({alpha.text(k) for k in kids}) == 12


def test_alpha_statistics_equal_a_direct_loop(spark):
    from tidemark.operators import alpha

    rng = np.random.default_rng(4)
    rows = []
    for sym, n in (("A", 130), ("B", 90), ("C", 20)):
        x, y = rng.normal(0, 1, n).round(1), rng.normal(0, 1, n)
        rows += [(sym, DAY + dt.timedelta(days=i), float(x[i]), float(-x[i] + rng.normal(0, 0.5)), float(y[i] + 0.2 * x[i]), "train" if i < n * 0.6 else "validation" if i < n * 0.8 else "test") for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, day date, momentum_5 double, vwap_gap double, label double, part string").withColumn("market", F.lit("US"))
    got = {r["name"]: r for r in alpha.evaluate(df, {"m": ("col", "momentum_5"), "v": ("col", "vwap_gap")}, accepted={"m": ("col", "momentum_5")})}
    pdf = df.toPandas().sort_values(["symbol", "day"])
    cor = lambda a, b: float(np.corrcoef(a, b)[0, 1])
    for name, column in (("m", "momentum_5"), ("v", "vwap_gap")):
        r, rolling, ranks = got[name], [], []
        full = cor(pdf[column], pdf.label)
        for _, g in pdf.groupby("symbol"):
            ranks.append(cor(g[column].rank(), g.label.rank()))
            if len(g) >= 24:
                width = min(60, max(18, len(g) // 4))
                rolling += [cor(g[column][k : k + width], g.label[k : k + width]) for k in range(0, len(g) - width + 1, max(6, width // 3))]
        part = {p: cor(g[column], g.label) for p, g in pdf.groupby("part")}
        share, stable = np.mean([x * full >= 0 for x in rolling]), abs(np.mean(rolling)) / (np.std(rolling) + 0.05)
        assert (r["ic"], r["rank_ic"], r["stability"], r["positive_share"]) == pytest.approx((full, np.mean(ranks), stable, share), abs=1e-9)
        penalty = min(24, max(0, abs(part["train"]) - (abs(part["validation"]) + abs(part["test"])) / 2) * 55 + 8 * (part["train"] * part["validation"] < 0) + 10 * (part["train"] * part["test"] < 0) + 6 * (part["validation"] * part["test"] < 0) + max(0, 0.55 - share) * 10)
        overlap = abs(cor(pdf.momentum_5, pdf.vwap_gap)) if name == "v" else 0
        # momentum_5 names no unit-free word, vwap_gap does; both are short, rich and complete
        want = abs(part["validation"]) * 42 + abs(part["test"]) * 34 + abs(np.mean(ranks)) * 20 + min(12, stable * 4.5) + share * 8 + (6 if name == "v" else 5) * 1.4 - overlap * 12 - 0.85 - penalty
        assert r["fitness"] == pytest.approx(want, abs=1e-9) and r["max_overlap"] == pytest.approx(overlap, abs=1e-9)


def test_registries(spark):
    from tidemark.operators import scoring

    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "id int, x string, y int")
    assert sorted(map(tuple, scoring.upsert_keeping(old, new, ["id"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    names = spark.createDataFrame([("Apple Inc. Common Stock", "stock"), ("Example Acquisition Inc. - Warrants", "stock"), ("Example 7% Preferred Stock", "stock"), ("Bear ETF", "ETF"), ("BHP Group Ltd", "Common Stock")], "n string, k string")
    assert [r[0] for r in names.select(scoring.eligible(F.col("n"), F.col("k"))).collect()] == [True, False, False, False, True]


def test_record_stores(spark, tmp_path):
    from tidemark.sources import lake, records

    root = str(tmp_path)
    schema = "dataset string, market string, exchange string, symbol string, source string, id string, url string, event_time string, available_at string, revision string, first_seen_at string, verified boolean, unverified boolean, method string, value double"
    row = lambda i, day, value, verified=True: ("news", "US", "X", "S1", "feed", i, None, day, day, None, None, verified, None, None, value)
    first = spark.createDataFrame([row("a", "2024-01-01", 1.0), row("b", "2024-01-05", 2.0), row("c", "2024-01-03", 3.0, False), row("d", "", 4.0)], schema)
    assert records.upsert_records(spark, root, first) == 3
    assert records.upsert_records(spark, root, spark.createDataFrame([row("a", "2024-01-01", 9.0)], schema)) == 3
    got = records.read_records(spark, root, "news", "US", ["S1"])
    assert {r.record_key.split(":")[4]: '"value":9.0' in r.payload_json for r in got.collect()} == {"a": True, "b": False}
    assert records.read_records(spark, root, "news", "US", ["S1"], known_by="2024-01-04").count() == 1
    keys = records.keyed_records(spark.createDataFrame([row(None, "2024-01-01", 1.0), row(None, "2024-01-01", 2.0)], schema)).collect()
    assert len({r.record_key for r in keys}) == 2 and all(len(r.record_key.split(":")[4]) == 32 for r in keys)

    (tmp_path / "in.json").write_text('{"market":"US","interval":"1d","symbol":"A","timestamp":"2024-01-01","open":1,"high":3,"low":1,"close":2,"volume":5,"source":"alpaca-us-bars","saved_at":"2024-02-01"}\nnot json\n')
    assert records.ingest_candles(spark, f"{root}/lake", str(tmp_path / "in.json"))["stored"] == 1
    assert lake.read(spark, f"{root}/lake").first().close == 2.0

    rows = spark.createDataFrame([("US", "A", 1.5), ("ASX", "B", 2.5)], "market string, symbol string, score double")
    records.write_oof(rows, f"{root}/oof")
    (tmp_path / "oof" / "broken.json").write_text("{oops\n")
    good, bad = records.read_oof(spark, f"{root}/oof", "market string, symbol string, score double")
    assert sorted(map(tuple, good.collect())) == [("ASX", "B", 2.5), ("US", "A", 1.5)] and [r[0] for r in bad.collect()] == ["{oops"]


def test_quarantine_is_the_same_after_a_rerun(spark, tmp_path):
    from tidemark.sources import lake

    schema = "market string, interval string, symbol string, timestamp string, open double, high double, low double, close double, volume double, source string, available_at string, saved_at string, seq int"
    bad = spark.createDataFrame([("US", "1d", "A", "2024-01-01", 100.0, 98.0, 90.0, 95.0, 1.0, "alpaca-us-bars", None, "x", 1)], schema)
    for _ in range(2):
        assert lake.upsert(spark, str(tmp_path), bad, ["seq"])["rejected"] == 1
        assert spark.read.parquet(f"{tmp_path}/quarantine").count() == 1
    assert not list((tmp_path / "stage").iterdir())


def test_filings_do_not_look_ahead(spark):
    from tidemark.sources import normalize

    f = lambda acc, year, day, revenue, income: [("x", acc, year, "FY", DAY + dt.timedelta(days=day), "revenue", revenue), ("x", acc, year, "FY", DAY + dt.timedelta(days=day), "income", income)]
    rows = f(1, 2000, 0, 100.0, 10.0) + f(2, 2001, 365, 150.0, 30.0) + f(3, 2000, 400, 300.0, 3.0) + f(4, 2001, 500, 150.0, 900.0)
    got = {r.accession: r for r in normalize.filings(spark.createDataFrame(rows, "id string, accession int, fiscal_year int, period string, event_day date, concept string, value double"), ["id"], ("revenue", "income")).collect()}
    assert got[1].revenue_growth is None and got[1].margin == 0.1
    assert got[2].revenue_growth == 0.5 and got[2].income_growth == 1.0  # the restatement of day 400 is not known yet
    assert got[4].revenue_growth == -0.5 and got[4].margin == 1.0


def test_predictions_mature_however_long_it_takes(spark):
    days = [0, 1, 2, 200, 900, 901]
    bars_ = spark.createDataFrame([("A", DAY + dt.timedelta(days=d), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i) for i, d in enumerate(days)], "symbol string, day date, open double, high double, low double, close double")
    samples = spark.createDataFrame([(i, s, DAY + dt.timedelta(days=d)) for i, (s, d) in enumerate([("A", 0), ("A", 1), ("A", 900), ("B", 0), ("A", -5)])], "id int, symbol string, day date")
    got = {r.id: r for r in labels.mature(samples, bars_, 3, F.lit(DAY + dt.timedelta(days=900))).collect()}
    assert [(got[i].bars_seen, got[i].resolved) for i in range(5)] == [(3, True), (3, True), (0, False), (0, False), (3, True)]
    assert got[1].forward_return == pytest.approx((15 / 12 - 1) * 100) and got[0].max_upside == pytest.approx((15 / 11 - 1) * 100) and got[4].max_drawdown == pytest.approx((9 / 10 - 1) * 100)


def test_overlay_and_sessions(spark):
    from tidemark.operators import evidence

    at = lambda m, t: (m, t)
    d = spark.createDataFrame([at("ASX", "2026-08-11 02:00:00"), at("ASX", "2026-08-11 07:00:00"), at("US", "2026-08-09 04:00:00")], "market string, t string")
    assert [str(r[0]) for r in d.select(evidence.completed_session(F.col("t").cast("timestamp"), "market")).collect()] == ["2026-08-10", "2026-08-11", "2026-08-07"]
    candles_ = spark.createDataFrame([("CAR", dt.date(2026, 7, 10), 26.12, 26.56, 26.01, 26.37, 557286.0)], "symbol string, day date, open double, high double, low double, close double, volume double")
    quotes = spark.createDataFrame([("CAR", dt.date(2026, 7, 12), 26.1, 1, True), ("CAR", dt.date(2026, 7, 14), 26.1, 2, True), ("CAR", dt.date(2026, 7, 13), 25.0, 3, True), ("CAR", dt.date(2026, 7, 13), 25.79, 4, True), ("CAR", dt.date(2026, 7, 10), 30.0, 5, False)], "symbol string, day date, price double, at int, time_verified boolean")
    got = evidence.merge_quotes(candles_, quotes, F.lit(dt.date(2026, 7, 13))).orderBy("day").collect()
    assert [(r.day.day, r.close, r.overlaid) for r in got] == [(10, 26.37, False), (13, 25.79, True)]


def test_learners_find_planted_signals(spark):
    from tidemark.operators import learners, panel

    rng = np.random.default_rng(12)
    n, days = 4000, 80
    x = rng.normal(0, 1, (n, 3))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.6, n)
    rows = [(i, DAY + dt.timedelta(days=int(i % days)), *map(float, x[i]), float(y[i]), float(y[i] > 0), 0.0 if y[i] > 1 else 1.0 if y[i] < -1 else 2.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, day date, a double, b double, c double, label double, up double, path double")
    folds = panel.walk_forward(df, "day", folds=2, purge=3).persist()
    out = learners.out_of_fold(folds, ["a", "b", "c"], learners.BASE).toPandas()
    assert set(out.part) == {"test"} and not out.id.duplicated().any()
    for k, g in out.groupby("fold"):
        assert folds.filter(f"fold = {k} and part = 'train'").agg(F.max("day")).first()[0] < g.day.min() - dt.timedelta(days=2)
    assert ((out.elastic_up > 0.5) == (out.up == 1)).mean() > 0.85 and ((out.forest_up > 0.5) == (out.up == 1)).mean() > 0.8 and ((out.boosted_up > 0.5) == (out.up == 1)).mean() > 0.8
    assert np.corrcoef(out.ridge_return, out.label)[0, 1] > 0.9 and np.corrcoef(out.boosted_return, out.label)[0, 1] > 0.8
    assert np.allclose(out[["outcome_0", "outcome_1", "outcome_2"]].sum(axis=1), 1) and ((out[["outcome_0", "outcome_1", "outcome_2"]].to_numpy().argmax(1)) == out.path).mean() > 0.7
    model = learners.fit(df, ["a", "b", "c"], learners.BASE["forest_up"])
    assert [f for f, _ in learners.tree_importance(model, ["a", "b", "c"])] == ["a", "b", "c"]
    scored = df.withColumn("score", F.lit(0.8) - 0.3 * (F.col("c") > 1).cast("int"))
    risky = learners.risk_head(scored, scored, ["a", "b"], "score", "up").toPandas()
    assert (risky.adjusted <= risky.score + 1e-12).all() and risky[risky.a < -1].adjusted.mean() < risky[risky.a > 1].adjusted.mean() - 0.1
    few = learners.event_expert(df.withColumn("cover", F.lit(1.0)), df.withColumn("cover", (F.col("id") % 2).cast("double")), ["a", "b"], "cover", "up").toPandas()
    assert few.event_score.isna().mean() == 0.5 and learners.event_expert(df.withColumn("cover", F.lit(0.0)), df, ["a"], "cover", "up") is None


def test_pruning_equals_a_direct_loop(spark):
    from tidemark.operators import learners

    rng = np.random.default_rng(13)
    y = rng.integers(0, 2, 500)
    base = np.clip(0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.15, 500), 0.01, 0.99)
    m = np.c_[base, np.clip(base + rng.normal(0, 0.02, 500), 0.01, 0.99), rng.uniform(0.01, 0.99, 500), np.clip(base + rng.normal(0, 0.01, 500), 0.01, 0.99), rng.uniform(0.3, 0.7, 500)]
    names, w = list("abcde"), rng.uniform(0.1, 2, 500)
    got, dropped = learners.prune(spark.createDataFrame([(*map(float, r), int(t), float(v)) for r, t, v in zip(m, y, w)], ", ".join(f"{n} double" for n in names) + ", y int, w double"), names, "y", "w")
    kept = list(range(5))
    brier = [(w * (m[:, i] - y) ** 2).sum() for i in range(5)]
    changed = True
    while changed and len(kept) > 3:
        changed = False
        for i, j in ((i, j) for k, i in enumerate(kept) for j in kept[k + 1 :]):
            if abs(np.corrcoef(m[:, i] - y, m[:, j] - y)[0, 1]) > 0.8:
                kept.remove(j if brier[i] <= brier[j] else i)
                changed = True
                break
    assert got == [names[i] for i in kept] and len(dropped) == 2
