"""Portfolios and paper trading: exposure, costs, order intents, decision scores, bandit replay."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp

#: Policy in per cent (fixed defaults).
POLICY = {"reserve_cash": 15.0, "max_position": 20.0, "max_sector": 35.0, "max_gross": 100.0, "stop_loss": 4.0, "max_drawdown": 12.0}
#: Rows and queries of a packed block of vectors, and queries that are compared at once.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
QUERIES_AT_ONCE = 256
#: Market: commission, half spread, largest participation (fixed values).
COSTS = {"ASX": (0.08, 0.055, 0.01), "US": (0.045, 0.025, 0.005), "CN": (0.07, 0.045, 0.008)}


def by_market(market: Column, place: int) -> Column:
    out = F.lit(None).cast("double")
    for name, values in COSTS.items():
        out = F.when(market == name, F.lit(values[place])).otherwise(out)
    return out


def weigh(positions: DataFrame, by: list[str]) -> DataFrame:
    """positions (qty, avg_price, current_price, change_5d_pct, volatility_pct, total_capital) with value, pnl_pct, weight_pct, stop_hit and flags."""
    p = positions.filter((F.col("qty") > 0) & (F.col("current_price") > 0))
    value, cost = F.round(F.col("qty") * F.col("current_price"), 2), F.round(F.col("qty") * F.col("avg_price"), 2)
    p = p.withColumns({"value": value, "cost": cost}).withColumn("pnl_pct", F.when(F.col("cost") > 0, (F.col("value") - F.col("cost")) / F.nullif("cost", F.lit(0.0)) * 100).otherwise(0.0))
    p = p.withColumn("weight_pct", F.coalesce(F.try_divide("value", "total_capital") * 100, F.lit(0.0)))
    stop = (F.col("pnl_pct") <= -POLICY["stop_loss"]) | (F.col("change_5d_pct") <= -POLICY["stop_loss"])
    flags = F.array_compact(F.array(F.when(F.col("weight_pct") > POLICY["max_position"], "POSITION_CONCENTRATION"), F.when(stop, "STOP_LOSS_BREACH"), F.when(~stop & (F.col("volatility_pct") > POLICY["stop_loss"]), "VOLATILITY_ABOVE_STOP")))
    return p.withColumns({"stop_hit": stop, "flags": flags})


def exposure(positions: DataFrame, by: list[str]) -> DataFrame:
    """One row for each portfolio: gross exposure, cash, warnings, blockers, risk score, status. Sectors are added up first."""
    w = weigh(positions, by)
    sectors = w.groupBy(*by, "sector").agg(
        F.sum("value").alias("value"), F.max("weight_pct").alias("top_"), F.max("total_capital").alias("capital"), F.max("current_drawdown_pct").alias("dd_"),
        F.count_if(F.array_contains("flags", "POSITION_CONCENTRATION")).alias("w1_"), F.count_if(F.array_contains("flags", "VOLATILITY_ABOVE_STOP")).alias("w2_"), F.count_if("stop_hit").alias("b1_"),
    ).withColumn("sw_", F.col("value") / F.col("capital") * 100)
    g = sectors.groupBy(*by).agg(
        F.sum("value").alias("invested"), F.max("capital").alias("total_capital"), F.max("top_").alias("concentration"), F.max("sw_").alias("sector_concentration"), F.max("dd_").alias("dd_"),
        F.sum(F.col("w1_") + F.col("w2_")).alias("w_"), F.count_if(F.col("sw_") > POLICY["max_sector"]).alias("ws_"), F.sum("b1_").alias("b_"),
    )
    cash = F.greatest(F.lit(0.0), F.col("total_capital") - F.col("invested"))
    gross = F.col("invested") / F.col("total_capital") * 100
    g = g.withColumns({"available_cash": cash, "gross_exposure_pct": gross, "reserve_cash": F.col("total_capital") * POLICY["reserve_cash"] / 100})
    one = lambda c: F.when(c, 1).otherwise(0)
    g = g.withColumns({
        "warnings": F.col("w_") + F.col("ws_"),
        "blockers": F.col("b_") + one(F.col("gross_exposure_pct") > POLICY["max_gross"]) + one(F.col("available_cash") < F.col("reserve_cash")) + one(F.col("dd_") >= POLICY["max_drawdown"]),
    })
    over = lambda c, limit, k: F.greatest(F.lit(0.0), c - limit) * k
    score = 100 - over(F.col("gross_exposure_pct"), 70.0, 0.35) - over(F.col("concentration"), POLICY["max_position"], 1.25) - over(F.col("sector_concentration"), POLICY["max_sector"], 0.8) - F.col("warnings") * 4 - F.col("blockers") * 14 - F.least(F.lit(22.0), F.col("dd_") * 1.4)
    return g.withColumns({
        "available_for_trades": F.greatest(F.lit(0.0), F.col("available_cash") - F.col("reserve_cash")), "risk_score": clamp(score, 0.0, 100.0),
        "status": F.when(F.col("blockers") > 0, "blocked").when(F.col("warnings") > 0, "warning").otherwise("within-policy"),
    }).drop("w_", "ws_", "b_", "dd_")


def trade_cost(df: DataFrame) -> DataFrame:
    """cost_pct of a trade (market, notional, average_dollar_volume, atr_pct, volume_ratio, spread_pct, degraded) and capacity_blocked."""
    m = F.col("market")
    half = F.when(F.col("spread_pct") > 0, F.col("spread_pct") / 2).otherwise(by_market(m, 1))
    slip = F.least(F.lit(0.45), 0.012 + F.abs("atr_pct") * 0.012 + F.greatest(F.lit(0.0), 0.9 - F.greatest(F.lit(0.05), F.col("volume_ratio"))) * 0.08)
    adv = F.col("average_dollar_volume")
    part = F.when((F.col("notional") > 0) & (adv > 0), F.try_divide(F.col("notional"), adv)).otherwise(0.0)
    impact = F.least(F.lit(0.8), (0.055 + F.abs("atr_pct") * 0.008) * F.sqrt(part))
    return df.withColumns({
        "half_spread_pct": half, "slippage_pct": slip, "participation": part, "impact_pct": impact,
        "cost_pct": by_market(m, 0) + half + slip + impact + F.when(F.col("degraded"), 0.025).otherwise(0.0),
        "capacity_blocked": F.coalesce((adv > 0) & (F.col("notional") > adv * by_market(m, 2) * 1.05), F.lit(False)),
    })


def order_intents(orders: DataFrame) -> DataFrame:
    """Errors in fixed order, intent_id and status of paper orders; nothing is ever sent."""
    value = F.greatest(F.lit(0.0), F.col("qty") * F.col("limit_price"))
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    errors = F.array_compact(F.array(
        F.when(F.col("mode") != "paper", "mode"), F.when(~F.col("side").isin("BUY", "SELL"), "side"), F.when(F.coalesce(F.length("symbol"), F.lit(0)) == 0, "symbol"),
        F.when(F.col("qty") <= 0, "quantity"), F.when(F.col("limit_price") <= 0, "price"), F.when(F.coalesce(F.length("idempotency_key"), F.lit(0)) == 0, "idempotency_key"),
        F.when(buy & ~F.col("new_orders_allowed"), "risk_policy"), F.when(buy & (value > F.col("available_for_trades") + 0.01), "cash"), F.when(buy & (value > F.col("total_capital") * POLICY["max_position"] / 100 + 0.01), "position_cap"),
        F.when(sell & (F.col("held_qty") <= 0), "no_position"), F.when(sell & (F.col("held_qty") > 0) & (F.col("qty") > F.col("held_qty") + 1e-7), "held_quantity"),
    ))
    canonical = F.concat_ws("|", "market", "symbol", "side", F.col("qty").cast("string"), F.col("limit_price").cast("string"), "idempotency_key")
    return orders.withColumns({"notional": F.round(value, 2), "errors": errors, "intent_id": F.substring(F.sha2(canonical, 256), 1, 24), "status": F.when(F.size(errors) == 0, "approved-for-audit-only").otherwise("rejected")})


def decision_scores(df: DataFrame) -> DataFrame:
    """score of five agent styles from an analysis row; see the columns used."""
    c = F.col
    styles = {
        "reversion": 46 + (50 - c("rsi")) * 0.75 + c("max_upside") * 2.4 + (c("confidence") - 55) * 0.22 + c("market_bias") * 0.55 + c("evidence") * 0.08,
        "breakout": 35 + (c("confidence") - 48) * 0.42 + c("max_upside") * 3.1 + (c("trend") - 48) * 0.22 + (c("volume_ratio") - 1) * 11 + F.greatest(F.lit(0.0), c("change5")) * 0.45 + c("max_prob") * 0.08 + c("market_bias") * 0.7,
        "news-flow": 34 + c("evidence") * 0.34 + c("factor") * 0.2 + c("target_prob") * 0.12 + c("final_return") * 2.6 + (c("trend") - 50) * 0.12 + c("market_bias") * 0.55,
        "risk-balanced": 28 + c("confidence") * 0.24 + c("target_prob") * 0.18 + c("final_prob") * 0.1 + (c("risk") - 45) * 0.28 + F.greatest(F.lit(0.0), c("trend") - 50) * 0.14 + c("evidence") * 0.08 - F.greatest(F.lit(0.0), c("downside") - 45) * 0.18,
        "momentum": 38 + (c("confidence") - 50) * 0.5 + c("final_return") * 3.2 + c("max_upside") * 1.1 + (c("trend") - 50) * 0.24 + (c("volume_ratio") - 1) * 8 + c("evidence") * 0.08 + c("market_bias") * 0.9,
    }
    rows = F.array(*(F.struct(F.lit(name).alias("style"), clamp(value, 0.0, 100.0).alias("score")) for name, value in styles.items()))
    return df.withColumn("s_", F.explode(rows)).select("*", "s_.style", "s_.score").drop("s_")


def bandit(df: DataFrame, by: list[str], p: str, y: str, ret: str, thresholds: tuple[float, ...], prior: float = 1.0) -> DataFrame:
    """Beta posterior and objective of each threshold; best marks the eligible one with the highest posterior mean."""
    d = df.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds)))).filter(F.col(p) >= F.col("threshold") - 1e-9)
    g = d.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("wins"), F.avg(ret).alias("mean_return"))
    g = g.withColumns({"posterior": (F.col("wins") + prior) / (F.col("n") + 2 * prior), "objective": F.col("mean_return") * F.sqrt(F.col("n").cast("double")), "eligible": F.col("n") >= 20})
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("eligible"), F.desc("posterior"), F.desc("objective"), "threshold")) == 1
    return g.withColumn("best", best)


def nearest(df: DataFrame, queries: DataFrame, dims: int, k: int = 18, extra: tuple[str, ...] = ()) -> DataFrame:
    """query, id, distance (root mean square) and extra (double) of the k nearest of all rows of df (id, x) for each of queries.

    Exact; ties go to the smaller id, and a row is no neighbour of its own id. Rows and queries meet
    in packed blocks; a task keeps the k best of a query over all blocks that it sees. Rows without id
    take no part, neither do arrays of another length or with null or non-finite numbers.
    """

    def packed(rows: DataFrame, names: tuple[str, ...], most: int) -> tuple[DataFrame, int]:
        x = F.col("x").cast("array<double>")
        fine = F.col("id").isNotNull() & (F.size("x") == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        rows = rows.filter(fine).select(F.col("id").cast("long").alias("id"), x.alias("x"), *(F.col(c).cast("double").alias(c) for c in names))
        n = max(1, -(-rows.count() // most))

        def pack(table: pa.Table) -> pa.Table:
            columns = [table.column("id").to_numpy().astype("<i8"), np.stack(table.column("x").to_numpy()), *(table.column(c).to_numpy().astype("<f8") for c in names)]
            return pa.table({"block_": table.column("block_").slice(0, 1)} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("id", "x", *names), columns, strict=True)})

        blocks = rows.withColumn("block_", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("block_")
        return blocks.applyInArrow(pack, ", ".join(["block_ long", *(f"`{c}` binary" for c in ("id", "x", *names))])), n

    def found(row: dict) -> list[np.ndarray]:
        """query, id, distance and extra of a pair of blocks: the k best of each query."""
        ids, asked = np.frombuffer(row["id"], "<i8"), np.frombuffer(row["asked_"], "<i8")
        x, qx = np.frombuffer(row["x"]).reshape(-1, dims), np.frombuffer(row["qx_"]).reshape(-1, dims)
        square, at_query, at_row, score = (x * x).sum(1), [], [], []
        for first in range(0, len(asked), QUERIES_AT_ONCE):
            q, own = qx[first : first + QUERIES_AT_ONCE], asked[first : first + QUERIES_AT_ONCE]
            size = (q * q).sum(1)
            rough = np.where(own[:, None] == ids, np.inf, size[:, None] + square - 2 * (q @ x.T))
            # the margin is above the rounding of the product; the exact distances decide
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (size + square.max()) if len(ids) > k else np.full(len(q), np.inf)
            for j in range(len(q)):
                near = np.flatnonzero((rough[j] <= limit[j]) & (own[j] != ids))
                exact = ((x[near] - q[j]) ** 2).sum(1)
                best = np.lexsort((ids[near], exact))[:k]
                at_query.append(np.full(len(best), own[j]))
                at_row.append(near[best])
                score.append(np.sqrt(exact[best] / dims))
        where = np.concatenate(at_row)
        return [np.concatenate(at_query), ids[where], np.concatenate(score), *(np.frombuffer(row[c], "<f8")[where] for c in extra)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                new = found(row)
                if row["at_"] in kept:
                    new = [np.concatenate(pair) for pair in zip(kept[row["at_"]], new, strict=True)]
                order = np.lexsort((new[1], new[2], new[0]))
                q = new[0][order]
                kept[row["at_"]] = [v[order[np.arange(len(q)) - np.searchsorted(q, q) < k]] for v in new]
        for columns in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(v, from_pandas=True) for v in columns], names=["query", "id", "distance", *extra])

    rows, _ = packed(df, extra, BLOCK_ROWS)
    asked, n = packed(queries, (), QUERY_ROWS)
    asked = asked.select(F.col("block_").alias("at_"), F.col("id").alias("asked_"), F.col("x").alias("qx_"))
    # by hash, so that the blocks of one block of queries come to one task
    blocks = rows.drop("block_").withColumn("at_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(asked.hint("shuffle_hash"), "at_")
    near = blocks.mapInArrow(search, ", ".join(["query long, id long, distance double", *(f"`{c}` double" for c in extra)]))
    return near.withColumn("k_", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).filter(F.col("k_") <= k).drop("k_")


def knn(df: DataFrame, queries: DataFrame, dims: int, k: int = 18) -> DataFrame:
    """Weighted label means and coverage of the k nearest of all rows for each query: id, x (array), label, weight."""
    near = nearest(df, queries, dims, k, ("label", "weight"))
    return near.groupBy("query").agg(F.count("*").alias("neighbours"), (F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("label_mean"), F.min("distance").alias("nearest"), F.avg("distance").alias("average"))


def news_scores(docs: DataFrame, terms: dict[str, list[str]], weights: dict[str, float], text: str = "text") -> DataFrame:
    """Hits of each family of terms and a clamped sentiment; term lists are expressions, not a join.

    Weighted hits are summed as decimals, so that a sentiment on the border of a stance lies on it.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = {name: F.regexp_count(lowered, F.lit("|".join(words))) for name, words in terms.items()}
    out = docs.withColumns({f"{name}_hits": h for name, h in hits.items()})
    score = sum((F.col(f"{name}_hits").cast("decimal(10,0)") * F.lit(Decimal(str(w))) for name, w in weights.items()), F.lit(Decimal(0))).cast("double")
    return out.withColumn("sentiment", clamp(score / 2, -1.0, 1.0)).withColumn("stance", F.when(F.col("sentiment") >= 0.5, "positive").when(F.col("sentiment") <= -0.5, "negative").otherwise("neutral"))
