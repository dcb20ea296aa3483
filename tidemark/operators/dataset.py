"""The training panel of a market: symbols x days x horizons with features, outcomes, ranks and weights, and its version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.functions.series import ahead, ordered
from tidemark.operators import bars as candles
from tidemark.operators import labels
from tidemark.operators.indicators import BY, ORDER, alpha_frame, true_range
from tidemark.operators.panel import FACTORS, ordinal_rank

W = Window
FIRST_BAR, LEAST_BARS = 55, 70
KEY = ["market", "symbol", "day", "horizon"]
#: Columns ranked within each market, date and horizon; True: the largest value ranks lowest.
RANKED = {"change5": ("momentum_5", False), "change20": ("momentum_20", False), "volume_ratio": ("volume_ratio_20", False), "volatility": ("volatility_10", True), "liquidity": ("dollar_liquidity", False), "trend": ("trend_gap_20", False), "pressure": ("candle_body_pressure", False), "profile": ("vwap_gap", False)}


def market_dataset(bars: DataFrame, horizons: list[int], target: float = 5.0, stop: float = 4.0, cost_pct=0.0, events: DataFrame | None = None, least_coverage: float = 0.6) -> DataFrame:
    """One row for each symbol, day and horizon whose outcome is complete; bars have one row a symbol and day.

    All horizons share one sort of the bars: each bar collects the path of the longest one, and shorter ones are its start. Symbols with fewer
    than LEAST_BARS bars and the first FIRST_BAR bars are left out. events (market, symbol, day, feature columns) are point-in-time features
    as of the signal's day; they are taken in only if `least_coverage` of the symbols have any, and count as 0 where a row has none.

    Columns: KEY, sector, FACTORS, the events' columns, entry, target_pct, stop_pct, barrier_class (0 stop, 1 neither, 2 target, 3 both in one
    bar), forward_return, max_upside, max_drawdown, direction, return_rank, relevance, rank_<name> in [-1, 1], breadth, confidence,
    evaluation_weight, training_weight (balanced over classes, then over dates).
    """
    w = ordered(BY, ORDER)
    longest = max(horizons)
    d = labels.with_path(true_range(alpha_frame(candles.quality(bars, BY))), longest)
    d = d.withColumns({"weights_": F.collect_list("sample_weight").over(ahead(w, longest)), "row_": F.row_number().over(w), "n_": F.count("*").over(W.partitionBy(*BY)), "dollar_liquidity": F.log1p(F.greatest(F.lit(0.0), F.col("close")) * F.greatest(F.lit(0.0), F.col("volume")))})
    middle = bars.filter("volume > 0").groupBy(*BY).agg(F.percentile("volume", 0.5).alias("middle_"))
    d = d.filter((F.col("row_") > FIRST_BAR) & (F.col("n_") >= LEAST_BARS)).join(middle, BY, "left")
    d = d.withColumns({"liquidity_": clamp(F.sqrt(F.greatest(F.lit(0.0), F.col("volume")) / F.greatest(F.lit(1.0), F.coalesce("middle_", F.lit(1.0)))), 0.25, 1.0), "recency_": 0.85 + 0.15 * (F.col("row_") - 1) / F.greatest(F.lit(1), F.col("n_") - 1)})
    d = d.withColumn("horizon", F.explode(F.array(*map(F.lit, sorted(set(horizons)))))).filter(F.size("path_") >= F.col("horizon"))
    h = F.col("horizon")
    d = d.withColumns({"path_": F.slice("path_", 1, h), "weights_": F.slice("weights_", 1, h), **labels.target_and_stop(h, target, stop)})
    d = labels.label_confidence(labels.outcomes(d, cost_pct), h)
    d = d.withColumns({
        "barrier_class": F.when(F.col("event") == "ambiguous", 3).when(F.col("stop_wins"), 0).when(F.col("target_wins"), 2).otherwise(1), "direction": (F.col("forward_return") > 0).cast("int"),
        "evaluation_weight": clamp(F.col("sample_weight") * F.col("liquidity_"), 0.05, 1.0)})
    d = d.withColumn("own_", clamp(F.col("evaluation_weight") * clamp("confidence", 0.2, 1.0) * F.col("recency_"), 0.05, 1.35))
    d, more = _with_events(d, events, least_coverage)
    d = _ranked(d.select(*KEY, "sector", *FACTORS, *more, "dollar_liquidity", "entry", "target_pct", "stop_pct", "barrier_class", "forward_return", "max_upside", "max_drawdown", "direction", "target_wins", "stop_wins", "confidence", "evaluation_weight", "own_"))
    return balanced(d).drop("own_", "target_wins", "stop_wins", "dollar_liquidity")


def _with_events(d: DataFrame, events: DataFrame | None, least: float) -> tuple[DataFrame, list[str]]:
    if events is None:
        return d, []
    names = [c for c in events.columns if c not in ("market", "symbol", "day")]
    have = d.select("market", "symbol").distinct().join(events.select("market", "symbol", F.lit(1).alias("has_")).distinct(), ["market", "symbol"], "left").agg(F.avg(F.coalesce("has_", F.lit(0)))).first()[0]
    if (have or 0.0) < least:
        return d, []
    d = d.join(events.withColumn("event_coverage", F.lit(1.0)), ["market", "symbol", "day"], "left").fillna(0.0, [*names, "event_coverage"])
    return d, [*names, "event_coverage"]


def _ranked(d: DataFrame) -> DataFrame:
    """return_rank, relevance, rank_<name>, breadth within each market, date and horizon."""
    by = ["market", "day", "horizon"]
    grade = F.when(F.col("target_wins"), 3.0).when(F.col("stop_wins"), 0.0).when(F.col("direction") == 1, 2.0).otherwise(1.0)
    down = {f"down_{c}": -F.col(c) for c, reverse in RANKED.values() if reverse}
    d = d.withColumns(down)
    ranks = {f"rank_{n}": ordinal_rank(f"down_{c}" if reverse else c, by, ["symbol"]) * 2 - 1 for n, (c, reverse) in RANKED.items()}
    d = d.withColumns({**ranks, "return_rank": ordinal_rank("forward_return", by, ["symbol"]), "breadth": F.avg((F.col("momentum_5") > 0).cast("double")).over(W.partitionBy(*by))})
    return d.withColumn("relevance", grade * 3 + F.col("return_rank") * 2).drop(*down)


def balanced(d: DataFrame) -> DataFrame:
    """training_weight from own_: times min(2, 0.5 / rate) for targets and stops, then every date of a market and horizon near the same mass."""
    group = ["market", "horizon"]
    share = lambda c: F.avg(F.col(c).cast("double"))
    rates = d.groupBy(*group).agg(share("target_wins").alias("t_"), share("stop_wins").alias("s_"))  # one row a market and horizon
    least = lambda c: F.least(F.lit(2.0), 0.5 / F.col(c))
    cls = F.when(F.col("target_wins") & (F.col("t_") > 0), least("t_")).when(F.col("stop_wins") & (F.col("s_") > 0), least("s_")).otherwise(F.lit(1.0))
    d = d.join(rates, group).withColumn("class_", clamp(F.col("own_") * cls, 0.05, 1.5))
    mass = d.groupBy(*group, "day").agg(F.sum("class_").alias("mass_"))
    middle = mass.groupBy(*group).agg(F.percentile("mass_", 0.5).alias("goal_"))
    d = d.join(mass.join(middle, group), [*group, "day"])
    scale = clamp(F.col("goal_") / F.when(F.col("mass_") > 0, F.col("mass_")).otherwise(F.lit(1.0)), 0.25, 4.0)
    return d.withColumn("training_weight", clamp(F.col("class_") * scale, 0.02, 2.0)).drop("t_", "s_", "class_", "mass_", "goal_")


def version(rows: DataFrame, digits: int = 8) -> DataFrame:
    """market, row_count and a hash of its rows that order and partitions don't change; doubles count to some digits."""
    columns = sorted(rows.columns)
    plain = rows.select(*(F.round(c, digits).alias(c) if dict(rows.dtypes)[c] == "double" else F.col(c) for c in columns))
    return candles.content_version(plain, ["market"], columns)
