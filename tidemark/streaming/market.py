"""Structured Streaming over ticks: bars, sessions, deduplication, lateness, footprints and a paper ledger.

The same functions take static frames, where watermarks do nothing, so results can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.series import moment_key

TICK_SCHEMA = "symbol string, ts timestamp, price double, size double, exchange string, trade_id long"


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder; the checkpoint remembers which were read."""
    return spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh(ticks: DataFrame, seen_at: str, most: str = "15 minutes") -> tuple[DataFrame, DataFrame]:
    """(usable ticks, rejected with reason): bad values and ticks that arrive too late go aside."""
    reason = F.when(F.col("ts").isNull(), "missing_timestamp").when(~(F.col("price") > 0) | ~(F.col("size") > 0) | F.col("price").isNull() | F.col("size").isNull(), "bad_value").when(F.col(seen_at) > F.col("ts") + F.expr(f"interval {most}"), "stale")
    judged = ticks.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def deduplicated(ticks: DataFrame, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Each key once; state is kept for the lateness only."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys) if ticks.isStreaming else ticks.dropDuplicates(keys)


def minute_bars(ticks: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    at = moment_key()
    g = ticks.filter("price > 0 and size > 0").withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("notional"), F.count("*").alias("trades"),
    )
    return g.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", (F.col("notional") / F.col("volume")).alias("vwap"), "trades")


def sessions(ticks: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Runs of trading without a pause of `gap`."""
    g = ticks.filter("price > 0 and size > 0").withWatermark("ts", lateness).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("trades"), F.sum("size").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades", "volume")


LEDGER_OUT = "agent string, ts timestamp, symbol string, action string, qty double, price double, cash double, equity double"
LEDGER_STATE = "cash double, qty double, entry double, symbol string, last_ts timestamp"


def ledger_steps(key: tuple, rows: Iterator[pd.DataFrame], state: tuple | None, capital: float, stop: float, take: float, cost_pct: float) -> tuple[list[tuple], tuple]:
    """One agent's events in order of time: buy on a high score, sell on a stop, a target or a low score."""
    cash, qty, entry, held, last = state or (capital, 0.0, 0.0, "", pd.Timestamp(0))
    out = []
    for frame in rows:
        for r in frame.sort_values(["ts", "symbol"]).itertuples():
            if r.ts < last or not r.price > 0:
                continue  # stale or without a real price
            last = r.ts
            action = ""
            if qty > 0 and r.symbol == held:
                gain = (r.price / entry - 1) * 100
                action = "stop" if gain <= -stop else "take" if gain >= take else "exit" if r.score < 40 else ""
                if action:
                    cash += qty * r.price * (1 - cost_pct / 100)
                    out.append((key[0], r.ts, held, action, qty, r.price, cash, cash))
                    qty, entry, held = 0.0, 0.0, ""
            elif qty == 0 and r.score >= 60:
                qty = cash * 0.2 / (r.price * (1 + cost_pct / 100))
                cash -= qty * r.price * (1 + cost_pct / 100)
                entry, held = r.price, r.symbol
                out.append((key[0], r.ts, held, "buy", qty, r.price, cash, cash + qty * r.price))
    return out, (cash, qty, entry, held, last)


def paper_ledger(signals: DataFrame, capital: float = 100_000.0, stop: float = 4.0, take: float = 6.0, cost_pct: float = 0.1) -> DataFrame:
    """Trades of each agent from a stream of (agent, ts, symbol, price, score); cash and position are state."""
    names = [c.split()[0] for c in LEDGER_OUT.split(", ")]

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = ledger_steps(key, rows, state.get if state.exists else None, capital, stop, take, cost_pct)
        state.update(now)
        yield pd.DataFrame(out, columns=names)

    return signals.groupBy("agent").applyInPandasWithState(step, LEDGER_OUT, LEDGER_STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Process what is there and stop: an incremental batch. Files and offsets make it exactly once."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
