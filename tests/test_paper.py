"""Paper trading: by hand, by limits, and stream against rows at rest."""

import datetime as dt
import math
import random

import pandas as pd
import pytest

from tidemark.streaming import market, paper

START = dt.datetime(2025, 3, 3, 10)
NAMES = [c.split()[0] for c in paper.SIGNAL.split(", ")]


def signal(agent, minutes, symbol, price, score, sector="s", threshold=60.0, allowed=True, cost=0.0, **kw):
    at = START + dt.timedelta(minutes=minutes)
    return (agent, at, kw.get("event", f"{agent}{minutes}{symbol}"), symbol, sector, price, score, threshold, allowed, kw.get("stop", 4.0), kw.get("take", 6.0), kw.get("exit", 40.0), kw.get("hold", 15.0), cost)


def run(rows, limits=None, account=None):
    limits = limits or paper.Limits()
    account = account or paper.Account(limits.capital)
    return paper.steps(("a",), iter([pd.DataFrame(rows, columns=NAMES)]), account, limits), account


def test_by_hand():
    rows = [signal("a", 0, "X", 100.0, 70, cost=1.0), signal("a", 1, "X", 93.0, 70, cost=1.0), signal("a", 2, "Y", 50.0, 59.0), signal("a", 3, "Z", 50.0, 90.0, allowed=False), signal("a", 4, "W", 10.0, 80.0), signal("a", 5, "W", 11.0, 30.0), signal("a", 6, "W", None, 80.0), signal("a", 7, "W", -1.0, 80.0)]
    got, account = run(rows)
    qty = math.floor(10_000 / 101)  # a tenth of the equity, the smallest of the limits
    cash = 100_000 - qty * 101
    assert got[0][1:7] == (pd.Timestamp(START), "X", "buy", "score", float(qty), 100.0) and math.isclose(got[0][8], cash)
    assert got[1][3:6] == ("sell", "stop", float(qty)) and math.isclose(got[1][7], (93 * 0.99 / 101 - 1) * 100)
    assert [g[2:5] for g in got[2:]] == [("W", "buy", "score"), ("W", "sell", "take")] and account.positions == {} and account.streak == 0
    assert run([signal("a", 0, "X", 100.0, 70, hold=1.0), signal("a", 2000, "X", 100.0, 70, hold=1.0)])[0][1][4] == "time"
    assert run([signal("a", 0, "X", 100.0, 70), signal("a", 1, "X", 101.0, 39.0)])[0][1][4] == "signal"


def test_losing_streak_halves_and_pauses():
    rows = [r for i in range(7) for r in (signal("a", 2000 * i, f"L{i}", 100.0, 70), signal("a", 2000 * i + 1, f"L{i}", 90.0, 70))]
    got, account = run(rows)
    bought = [g[5] * 100 for g in got if g[3] == "buy"]
    assert len(bought) == 5 and account.paused and account.scale == 0.25 and bought[3] < 0.6 * bought[2]


def test_limits_hold_and_broken_ones_are_repaired():
    rng, limits = random.Random(3), paper.Limits()
    price = {f"S{i}": 50.0 for i in range(12)}
    rows = []
    for m in range(0, 6000, 60):
        for s in price:
            price[s] *= math.exp(rng.gauss(0, 0.03))
            rows.append(signal("a", m, s, price[s], rng.uniform(30, 90), sector=f"c{int(s[1:]) % 4}", stop=9.0, take=12.0, cost=0.1))
    got, account = run(rows, limits)
    assert len(got) > 40 and {g[4] for g in got} >= {"score", "stop", "take", "signal"}
    assert all(g[5] == int(g[5]) and g[8] >= 0 for g in got)
    assert len(account.positions) <= limits.positions
    start = paper.Account(1000.0, {s: {"qty": 100.0, "basis": 900.0, "price": 10.0, "sector": s, "score": 50.0 + i, "opened": 0.0} for i, s in enumerate("ABC")})
    out, after = run([signal("a", 0, s, 10.0, 90.0, sector=s, hold=1e9) for s in "ABC"], limits, start)
    assert [g[2:5] for g in out][0] == ("A", "sell", "limits") and all(g[3] == "sell" for g in out) and sum(g[5] * g[6] for g in out) <= 0.3 * 4000 + 1e-9


def test_replays_change_nothing():
    rows = [signal("a", i, s, 50.0 + i, 70.0) for i in range(5) for s in ("X", "Y")]
    once, account = run(rows)
    before = dict(vars(account))
    again, after = run(rows, account=account)
    assert again == [] and vars(after) == before
    late, _ = run([signal("a", 2, "Z", 10.0, 90.0), signal("a", 4, "Z", 10.0, 90.0)], account=after)
    assert [g[2] for g in late] == ["Z"]  # the moment gone by is left out, a new event of the last one counts


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_rows_at_rest(spark, tmp_path, files):
    rng = random.Random(8)
    rows = [signal(a, m, s, 40 + 10 * rng.random(), rng.uniform(30, 90), sector=s, cost=0.1) for m in range(0, 300, 5) for a in ("p", "q") for s in ("X", "Y", "Z")]
    source = tmp_path / "in"
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part + part[:3], paper.SIGNAL).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(paper.SIGNAL).parquet(str(source))
        market.run_available(paper.trades(stream), str(tmp_path / "check"), str(tmp_path / "out"))
    key = lambda d: sorted(map(str, d.collect()))
    want = paper.trades(spark.createDataFrame(rows, paper.SIGNAL))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want) and want.count() > 10
    assert paper.trades(spark.createDataFrame([], paper.SIGNAL)).count() == 0


def test_batches_of_any_size_give_the_same(spark):
    rng = random.Random(9)
    rows = [signal(a, m, s, 40 + 10 * rng.random(), rng.uniform(30, 90), sector=s) for a in ("p", "q", "r") for m in range(0, 200, 5) for s in ("X", "Y", "Z")]
    frame = pd.DataFrame(rows, columns=NAMES)
    whole = pd.concat(list(paper.in_order(iter([frame]), paper.Limits())))
    for size in (1, 2, 7, 100):
        parts = [frame.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(frame), size)]
        got = pd.concat([p for p in paper.in_order(iter(parts), paper.Limits()) if len(p)])
        assert got.astype(str).values.tolist() == whole.astype(str).values.tolist() and len(got) > 10
