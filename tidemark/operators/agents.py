"""Paper agents as tables: generations, constraints, rewards, policies, gates; provider plans and universe samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp

W = Window
#: Limits of an agent's book (fixed values).
CONSTRAINTS = {"max_positions": 6, "max_position_pct": 0.12, "max_sector_pct": 0.25, "min_cash_pct": 0.25}
#: Words in a provider's name that tell its tier, in the order in which they are tested (fixed values).
TIERS = {
    "licensed": ("ibkr", "futu", "moomoo", "lseg", "market-source", "polygon", "massive"),
    "limited": ("eodhd", "twelvedata", "alphavantage", "tushare", "alpaca", "finnhub", "tiingo", "marketaux"),
    "free_support": ("stockanalysis", "yahoo", "nasdaq", "fred", "stooq", "satoshimacro", "eastmoney", "tencent", "asx-official", "gdelt", "baostock"),
}
#: Entry confidence of a style without a policy (fixed values).
STYLE_ENTRY = {"momentum": 58, "reversion": 56, "breakout": 60, "news-flow": 57, "risk-balanced": 55}


def generation_summary(agents: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a generation's agents: capital, equity, return, trades, win rate, positions."""
    g = agents.groupBy(*by).agg(F.count("*").alias("agents"), *(F.sum(c).alias(c) for c in ("initial_capital", "equity", "closed_trades", "wins", "losses", "positions")))
    pct = F.when(F.col("initial_capital") > 0, (F.col("equity") / F.col("initial_capital") - 1) * 100).otherwise(F.lit(0.0))
    return g.withColumns({"return_pct": pct, "win_rate_pct": F.coalesce(F.try_divide(F.col("wins") * 100, F.col("closed_trades")), F.lit(0.0))})


def constraint_audit(agents: DataFrame, positions: DataFrame, limits: dict = CONSTRAINTS) -> DataFrame:
    """agents (agent, equity, cash) with what their positions (agent, symbol, sector, qty, price) break; new buys are frozen then."""
    equity = F.greatest(F.col("equity"), F.lit(1.0))
    value = F.col("qty") * F.col("price")
    sector = positions.groupBy("agent", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")).alias("sector")).agg(F.sum(value).alias("v_"))
    sectors = sector.groupBy("agent").agg(F.max("v_").alias("sector_"), F.array_sort(F.collect_list(F.struct((-F.col("v_")).alias("v"), "sector"))).alias("sectors_"))
    held = positions.groupBy("agent").agg(F.count("*").alias("positions"), F.max(value).alias("largest_"), F.array_sort(F.collect_list(F.struct("symbol", value.alias("v")))).alias("values_"))
    d = agents.select("agent", "equity", "cash").join(held, "agent", "left").join(sectors, "agent", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    share = lambda x: x["v"] / equity
    over = F.filter(F.coalesce("values_", F.array().cast("array<struct<symbol:string,v:double>>")), lambda x: share(x) > limits["max_position_pct"] + 1e-9)
    sector_over = F.filter(F.coalesce("sectors_", F.array().cast("array<struct<v:double,sector:string>>")), lambda x: -share(x) > limits["max_sector_pct"] + 1e-9)
    d = d.withColumns({
        "positions": F.coalesce("positions", F.lit(0)), "cash_pct": F.col("cash") / equity, "largest_pct": zero("largest_") / equity, "sector_pct": zero("sector_") / equity,
        "over_positions": F.size(over), "over_sectors": F.size(sector_over),
    })
    n = (F.col("positions") > limits["max_positions"]).cast("int") + F.col("over_positions") + F.col("over_sectors") + (F.col("cash_pct") + 1e-9 < limits["min_cash_pct"]).cast("int")
    return d.select("agent", "positions", "cash_pct", "largest_pct", "sector_pct", "over_positions", "over_sectors", n.alias("violations"), (n > 0).alias("frozen"))


def rewards(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Reward of each step of an agent (equity, turnover, largest position value, degraded and valid items): its return less penalties.

    Penalties: 0.55 of a deeper drawdown, 0.08 of turnover, 0.1 of concentration beyond 12 %, 0.12 of the share of degraded data.
    """
    w = W.partitionBy(*by).orderBy(order)
    equity, before = F.greatest(F.col("equity"), F.lit(1.0)), F.greatest(F.coalesce(F.lag("equity").over(w), F.col("equity")), F.lit(1.0))
    d = steps.withColumns({"e_": equity, "b_": before, "top_": F.greatest(F.lit(1.0), F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)))})
    d = d.withColumn("was_", F.coalesce(F.lag("top_").over(w), F.col("b_")))
    fall = lambda top, now: F.greatest(F.lit(0.0), (top - now) / F.greatest(F.lit(1.0), top) * 100)
    c = F.col
    parts = {
        "raw_return": (c("e_") - c("b_")) / c("b_") * 100, "drawdown_penalty": F.greatest(F.lit(0.0), fall(c("top_"), c("e_")) - fall(c("was_"), c("b_"))) * 0.55, "turnover_penalty": c("turnover") / c("e_") * 8,
        "concentration_penalty": F.greatest(F.lit(0.0), c("largest") / c("e_") * 100 - 12) * 0.1, "degradation_penalty": c("degraded") / F.greatest(F.lit(1), c("valid")) * 0.12,
    }
    d = d.withColumns(parts)
    return d.withColumn("reward", c("raw_return") - c("drawdown_penalty") - c("turnover_penalty") - c("concentration_penalty") - c("degradation_penalty")).drop("e_", "b_", "top_", "was_")


def policy_ranking(policies: DataFrame, by: list[str]) -> DataFrame:
    """Styles of a regime by (eligible, posterior mean, objective); the first is selected if it is eligible.

    behaviour_probability: an eligible style's share of the eligible posterior means.
    """
    a, b = (F.greatest(F.lit(1.0), F.coalesce(c, F.lit(1.0))) for c in ("alpha", "beta"))
    d = policies.withColumns({"posterior": a / (a + b), "objective": F.coalesce("objective", F.lit(0.0)), "eligible": F.coalesce("eligible", F.lit(False))})
    mass = F.when(F.col("eligible"), F.greatest(F.col("posterior"), F.lit(1e-6)))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("eligible"), F.desc(F.round("posterior", 9)), F.desc("objective"), "style"))
    share = F.coalesce(mass / F.sum(mass).over(W.partitionBy(*by)), F.lit(0.0))
    return d.withColumns({"rank": rank, "selected": (rank == 1) & F.col("eligible"), "behaviour_probability": share}).drop("alpha", "beta")


def entry_threshold(style: Column | str, eligible: Column | str, threshold: Column | str, bias: Column | str) -> Column:
    """Confidence at which an agent buys: of its eligible policy, within 50 and 78, else of its style less 0.35 of its bias, within 49 and 68."""
    style, eligible, threshold, bias = (F.col(x) if isinstance(x, str) else x for x in (style, eligible, threshold, bias))
    own = F.lit(58)
    for name, value in STYLE_ENTRY.items():
        own = F.when(style == name, F.lit(value)).otherwise(own)
    return F.when(F.coalesce(eligible, F.lit(False)) & (F.coalesce(threshold, F.lit(0.0)) > 0), clamp(threshold * 100, 50.0, 78.0)).otherwise(clamp(own - F.coalesce(bias, F.lit(0.0)) * 0.35, 49.0, 68.0))


def trade_gate(items: DataFrame, selectors: DataFrame) -> DataFrame:
    """items (style, regime, policy_eligible, model_eligible) with allowed and the reason; selectors: one selected_style a regime.

    A regime without a selector takes that of 'all'; a selector without a style (null or empty) refuses no style.
    """
    named = selectors.select(F.col("regime").alias("r_"), F.col("selected_style").alias("own_"))
    general = named.filter("r_ = 'all'").agg(F.max("own_").alias("any_"))
    # one row, by construction of a global aggregate
    d = items.join(named.filter("r_ <> 'all'"), F.col("regime") == F.col("r_"), "left").crossJoin(F.broadcast(general))
    chosen = F.when(F.col("r_").isNotNull(), F.col("own_")).otherwise(F.col("any_"))
    reason = F.when(~F.coalesce("policy_eligible", F.lit(False)), "policy").when((chosen != "") & ~chosen.eqNullSafe(F.col("style")), "other_style").when(~F.coalesce("model_eligible", F.lit(False)), "model").otherwise("passed")
    return d.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "passed").drop("r_", "own_", "any_")


def provider_tier(name: Column | str) -> Column:
    value = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    out = F.lit("unknown")
    for tier, words in reversed(TIERS.items()):
        out = F.when(value.rlike("|".join(words)), F.lit(tier)).otherwise(out)
    return out


def provider_plan(candidates: DataFrame) -> DataFrame:
    """candidates (market, place, name, configured) -> primary and support of each market, and how many limited sources a task may ask.

    Primary: the first configured source of the limited tier, else a free one, else a licensed one, else the first of all. Support:
    the first other free one, else the first other.
    """
    d = candidates.withColumn("tier", provider_tier("name"))
    on = F.coalesce("configured", F.lit(True))
    first = lambda ok: F.min(F.when(ok, F.struct("place", "name")))
    g = d.groupBy("market").agg(*(first(on & (F.col("tier") == t)).alias(t) for t in ("limited", "free_support", "licensed")), first(F.lit(True)).alias("any"), F.collect_list(F.struct("place", "name", ((F.col("tier") == "free_support") & on).alias("free"))).alias("rows"))
    primary = F.coalesce("limited", "free_support", "licensed", "any")["name"]
    others = F.array_sort(F.filter("rows", lambda x: x["name"] != F.col("primary")))
    support = F.coalesce(F.try_element_at(F.filter("others", lambda x: x["free"]), F.lit(1)), F.try_element_at("others", F.lit(1)))["name"]
    cap = F.when(F.upper("market") == "US", 4).when(F.upper("market") == "ASX", 2).otherwise(1)
    return g.withColumn("primary", primary).withColumn("others", others).select("market", "primary", support.alias("support"), cap.alias("limited_cap"))


def stratified_symbols(df: DataFrame, by: list[str], symbol: str, count: int) -> DataFrame:
    """`count` symbols of each group, evenly spaced over their order, the same every time."""
    w = W.partitionBy(*by).orderBy(symbol)
    d = df.select(*by, symbol).distinct().withColumns({"at_": F.row_number().over(w) - 1, "n_": F.count("*").over(W.partitionBy(*by))})
    # the k-th of them stands at floor((k + 0.5) n / count); its number is found back from the place
    k = F.floor(F.col("at_") * count / F.col("n_"))
    near = F.array_distinct(F.transform(F.array(k - 1, k, k + 1), lambda x: F.when((x >= 0) & (x < count), F.floor((2 * x + 1) * F.col("n_") / (2 * count)))))
    return d.filter((F.col("n_") <= count) | F.array_contains(near, F.col("at_"))).drop("at_", "n_")
