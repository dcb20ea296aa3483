"""Paper trading of agents: many positions under limits, as keyed state over a stream, or over rows at rest.

What rows alone decide (scores, thresholds, gates, costs, lines) arrives as columns; the state of an agent is its money, positions, losing
streak, the day's turnover, and the marks of the events of its last moment, so that a replayed event changes nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIGNAL = "agent string, ts timestamp, event_id string, symbol string, sector string, price double, score double, threshold double, allowed boolean, stop double, take double, exit_score double, hold_days double, cost_pct double"
OUT = "agent string, ts timestamp, symbol string, action string, reason string, qty double, price double, realised_pct double, cash double, equity double"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Limits:
    capital: float = 100_000.0
    positions: int = 6
    position: float = 0.12
    sector: float = 0.25
    cash: float = 0.25
    turnover: float = 0.30
    ticket_cash: float = 0.20
    ticket_equity: float = 0.10


@dataclass
class Account:
    cash: float
    #: symbol -> qty, basis (what it cost), price (last), sector, score (at entry), opened
    positions: dict[str, dict] = field(default_factory=dict)
    streak: int = 0
    scale: float = 1.0
    paused: bool = False
    day: str = ""
    turnover: float = 0.0
    last: float = -math.inf
    seen: list[str] = field(default_factory=list)

    @property
    def equity(self) -> float:
        return self.cash + sum(p["qty"] * p["price"] for p in self.positions.values())

    def in_sector(self, sector: str) -> float:
        return sum(p["qty"] * p["price"] for p in self.positions.values() if p["sector"] == sector)

    def broken(self, limits: Limits) -> bool:
        """Whether a limit is not kept at the last prices."""
        e = max(1.0, self.equity)
        return (
            len(self.positions) > limits.positions or any(p["qty"] * p["price"] > e * limits.position + 1e-6 for p in self.positions.values())
            or any(self.in_sector(s) > e * limits.sector + 1e-6 for s in {p["sector"] for p in self.positions.values()}) or self.cash < e * limits.cash - 1e-6
        )

    def sell(self, symbol: str, qty: float, price: float, cost_pct: float) -> float:
        """Sells and returns the gain in per cent of what the part cost."""
        p = self.positions[symbol]
        net, basis = qty * price * (1 - cost_pct / 100), p["basis"] * qty / p["qty"]
        self.cash += net
        self.turnover += qty * price
        gain = (net - basis) / max(1e-12, basis) * 100
        if p["qty"] - qty <= 1e-9:
            del self.positions[symbol]
            self.streak = 0 if gain > 0 else self.streak + 1
            self.scale = 1.0 if self.streak < 3 else 0.5 if self.streak < 5 else 0.25
            self.paused = self.paused or self.streak >= 5
        else:
            p["qty"], p["basis"] = p["qty"] - qty, p["basis"] - basis
        return gain


def moment(account: Account, rows: list, limits: Limits) -> Iterator[tuple]:
    """One moment of one agent, rows by symbol: repairs of broken limits, exits, then entries. (ts, symbol, action, reason, qty, price, realised)."""
    ts = rows[0].ts
    if (day := str(ts.date())) != account.day:
        account.day, account.turnover = day, 0.0
    by_symbol = {r.symbol: r for r in rows}
    for s, p in account.positions.items():
        if s in by_symbol:
            p["price"] = by_symbol[s].price
    sold, frozen = set(), account.broken(limits)
    if frozen:  # gradually, the weakest entries first, within the day's turnover
        for s in sorted((s for s in account.positions if s in by_symbol), key=lambda s: (account.positions[s]["score"], account.positions[s]["opened"], s)):
            if not account.broken(limits):
                break
            r, p, e = by_symbol[s], account.positions[s], max(1.0, account.equity)
            most = math.floor(max(0.0, e * limits.turnover - account.turnover) / r.price)
            if most <= 0:
                break
            value = p["qty"] * r.price
            needed = max(value if len(account.positions) > limits.positions else 0.0, value - e * limits.position, account.in_sector(p["sector"]) - e * limits.sector, e * limits.cash - account.cash)
            qty = min(p["qty"], most, max(1, math.ceil(max(0.0, needed) / r.price)))
            sold.add(s)
            yield ts, s, "sell", "limits", qty, r.price, account.sell(s, qty, r.price, r.cost_pct)
    for s in [s for s in account.positions if s in by_symbol and s not in sold]:
        r, p = by_symbol[s], account.positions[s]
        gain = (r.price * p["qty"] / max(1e-12, p["basis"]) - 1) * 100
        held = (ts.timestamp() - p["opened"]) / 86_400
        reason = "stop" if gain <= -r.stop else "take" if gain >= r.take else "signal" if r.score < r.exit_score else "time" if held > r.hold_days else None
        if reason:
            sold.add(s)
            yield ts, s, "sell", reason, p["qty"], r.price, account.sell(s, p["qty"], r.price, r.cost_pct)
    if frozen:
        return
    for r in rows:
        if account.paused or r.symbol in sold or not r.allowed or r.score < r.threshold or (r.symbol not in account.positions and len(account.positions) >= limits.positions):
            continue
        e, own = max(1.0, account.equity), account.positions.get(r.symbol)
        ticket = min(
            max(0.0, account.cash - e * limits.cash), account.cash * limits.ticket_cash, e * limits.ticket_equity * account.scale, e * limits.position - (own["qty"] * r.price if own else 0.0),
            max(0.0, e * limits.turnover - account.turnover), max(0.0, e * limits.sector - account.in_sector(r.sector)),
        )
        each = r.price * (1 + r.cost_pct / 100)
        qty = math.floor(ticket / each)
        if qty <= 0:
            continue
        account.cash -= qty * each
        account.turnover += qty * r.price
        p = account.positions.setdefault(r.symbol, {"qty": 0.0, "basis": 0.0, "sector": r.sector, "score": r.score, "opened": ts.timestamp()})
        p["qty"], p["basis"], p["price"] = p["qty"] + qty, p["basis"] + qty * each, r.price
        yield ts, r.symbol, "buy", "score", float(qty), r.price, None


def steps(key: tuple, frames: Iterator[pd.DataFrame], account: Account, limits: Limits) -> list[tuple]:
    """All new moments of an agent in order. Rows without a price, of a moment gone by, or already seen are left out."""
    rows = pd.concat(list(frames)).dropna(subset=["ts", "symbol", "event_id", "price"])
    rows = rows[rows.price > 0].fillna({"score": 0.0, "threshold": math.inf, "allowed": False, "sector": "Unknown", "stop": math.inf, "take": math.inf, "exit_score": -math.inf, "hold_days": math.inf, "cost_pct": 0.0})
    rows = rows.sort_values(["ts", "symbol", "event_id"]).drop_duplicates("event_id").drop_duplicates(["ts", "symbol"])
    out = []
    for ts, now in rows.groupby("ts", sort=True):
        at = ts.timestamp()
        new = [r for r in now.itertuples() if at > account.last or (at == account.last and r.event_id not in account.seen)]
        if at < account.last or not new:
            continue
        account.seen = sorted(({*account.seen} if at == account.last else set()) | {r.event_id for r in new})
        account.last = at
        for event in moment(account, new, limits):
            out.append((key[0], *event, account.cash, account.equity))
    return out


def restored(text: str | None, limits: Limits) -> Account:
    return Account(**json.loads(text)) if text else Account(limits.capital)


def in_order(batches: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    """Trades from rows sorted by agent and moment; holds one agent's account and one moment's rows beyond a batch."""
    account, agent, held = Account(limits.capital), None, None

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal account, agent
        out = []
        for name, own in rows.groupby("agent", sort=False):
            if name != agent:
                account, agent = Account(limits.capital), name
            out += steps((name,), iter([own]), account, limits)
        return pd.DataFrame(out, columns=COLUMNS)

    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = rows.iloc[-1]
        open_ = (rows.agent == last.agent) & (rows.ts == last.ts)
        held = rows[open_]
        yield done(rows[~open_])
    if held is not None:
        yield done(held)


def trades(signals: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Trades of each agent (columns OUT) from signals (columns SIGNAL): a stateful stream, or the same rules over rows at rest.

    At rest rows are dealt by agent and sorted by moment, and a task reads them in order batch by batch; in a stream an agent's state is its
    account. Rows without agent, moment or price are left out.
    """
    limits = limits or Limits()
    signals = signals.filter("agent is not null and ts is not null and price > 0")
    if not signals.isStreaming:
        return signals.repartition("agent").sortWithinPartitions("agent", "ts", "symbol", "event_id").mapInPandas(lambda batches: in_order(batches, limits), OUT)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account = restored(state.get[0] if state.exists else None, limits)
        out = steps(key, rows, account, limits)
        state.update((json.dumps(asdict(account)),))
        yield pd.DataFrame(out, columns=COLUMNS)

    return signals.groupBy("agent").applyInPandasWithState(step, OUT, "account string", "append", GroupStateTimeout.NoTimeout)
