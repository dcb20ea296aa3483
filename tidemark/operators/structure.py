"""Price structure: gaps, sweeps, retracements, phases, volume profiles, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, pct_from
from tidemark.functions.series import ordered
from tidemark.operators.indicators import BY, ORDER, prior_extremes, signed_flow, typical, volume_ratio

#: Retracement ratios (fixed values).
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def _last(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    nth = F.row_number().over(Window.partitionBy(*BY).orderBy(*map(F.desc, ORDER)))
    return df.withColumn("back_", nth).filter(F.col("back_") <= n)


def fair_value_gaps(df: DataFrame) -> DataFrame:
    """One row for each three-bar gap: kind, gap_low, gap_high, size_pct, filled, pressure.

    filled looks at all later bars, so this is a snapshot of the whole series, no feature.
    """
    w = ordered(BY, ORDER)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumns({"lh_": F.lag("high", 2).over(w), "ll_": F.lag("low", 2).over(w), "fl_": F.min("low").over(later), "fh_": F.max("high").over(later)})
    up, down = F.col("low") > F.col("lh_"), F.col("high") < F.col("ll_")
    size = lambda lo, hi: (hi - lo) / F.greatest(F.col("close"), F.lit(0.0001)) * 100
    bull = F.struct(F.lit("bullish_fvg").alias("kind"), F.col("lh_").alias("gap_low"), F.col("low").alias("gap_high"), size(F.col("lh_"), F.col("low")).alias("size_pct"), F.coalesce(F.col("fl_") <= F.col("lh_"), F.lit(False)).alias("filled"))
    bear = F.struct(F.lit("bearish_fvg").alias("kind"), F.col("high").alias("gap_low"), F.col("ll_").alias("gap_high"), size(F.col("high"), F.col("ll_")).alias("size_pct"), F.coalesce(F.col("fh_") >= F.col("ll_"), F.lit(False)).alias("filled"))
    out = df.filter(up | down).select(*BY, *ORDER, F.when(up, bull).otherwise(bear).alias("g")).select(*BY, *ORDER, "g.*")
    weight = F.when(F.col("filled"), 0.35).otherwise(1.0)
    return out.withColumn("pressure", F.when(F.col("kind") == "bullish_fvg", weight).otherwise(-weight))


def gap_pressure(df: DataFrame, bars: int = 60, recent: int = 12) -> DataFrame:
    """Net pressure of the newest gaps of each symbol's last bars."""
    gaps = fair_value_gaps(_last(df, bars))
    return _last(gaps, recent).groupBy(*BY).agg(clamp(F.sum(F.col("pressure") * F.col("size_pct")), -12.0, 12.0).alias("gap_pressure"), F.count("*").alias("gaps"))


def liquidity_sweeps(df: DataFrame, n: int = 10) -> DataFrame:
    """Bars that pass the extreme of the n bars before and close back inside: side, level, depth_pct, pressure."""
    df = prior_extremes(volume_ratio(df), n).withColumn("row_", F.row_number().over(ordered(BY, ORDER))).filter(F.col("row_") > n)
    base = F.greatest(F.col("close"), F.lit(0.0001))
    force = F.greatest(F.lit(1.0), F.col("volume_ratio"))
    above = (F.col("high") > F.col("prior_high")) & (F.col("close") < F.col("prior_high"))
    below = (F.col("low") < F.col("prior_low")) & (F.col("close") > F.col("prior_low"))
    side = lambda name, level, depth, sign: F.struct(F.lit(name).alias("side"), level.alias("level"), depth.alias("depth_pct"), (sign * depth * force).alias("pressure"))
    found = F.array_compact(F.array(
        F.when(above, side("buy_side", F.col("prior_high"), (F.col("high") - F.col("prior_high")) / base * 100, -1)),
        F.when(below, side("sell_side", F.col("prior_low"), (F.col("prior_low") - F.col("low")) / base * 100, 1)),
    ))
    return df.select(*BY, *ORDER, F.explode(found).alias("s")).select(*BY, *ORDER, "s.*")


def fibonacci(df: DataFrame, bars: int = 60) -> DataFrame:
    """One row for each symbol and ratio over the last bars: direction, swing prices, price, distance_pct, nearest."""
    recent = _last(df, bars)
    swing = recent.groupBy(*BY).agg(
        # the first of equal extremes: the largest distance from the end
        F.max(F.struct("high", "back_")).alias("h"), F.min(F.struct(F.col("low"), (-F.col("back_")).alias("b"))).alias("l"), F.min_by("close", "back_").alias("last"), F.count("*").alias("lookback"),
    )
    high, low = F.col("h.high"), F.col("l.low")
    up = -F.col("l.b") > F.col("h.back_")
    span = F.greatest(high - low, high * 0.0001)
    levels = F.array(*(F.struct(F.lit(x).alias("ratio"), F.when(up, high - span * x).otherwise(low + span * x).alias("price")) for x in RATIOS))
    out = swing.select(*BY, "lookback", "last", F.when(up, "upswing").otherwise("downswing").alias("direction"), high.alias("swing_high"), low.alias("swing_low"), F.explode(levels).alias("v"))
    out = out.select(*BY, "lookback", "direction", "swing_high", "swing_low", F.col("v.ratio").alias("ratio"), F.col("v.price").alias("price"), pct_from(F.col("v.price"), F.col("last")).alias("distance_pct"))
    nearest = F.row_number().over(Window.partitionBy(*BY).orderBy(F.abs("distance_pct"), "ratio")) == 1
    return out.withColumn("nearest", nearest)


def wyckoff(df: DataFrame, bars: int = 60) -> DataFrame:
    """phase and confidence of each symbol's last bars; symbols with fewer than 20 are insufficient."""
    recent = _last(df, bars).withColumn("n_", F.count("*").over(Window.partitionBy(*BY)))
    early = F.col("n_") - F.col("back_") < F.floor(F.col("n_") / 2)
    width = (F.col("high") - F.col("low")) / F.greatest(F.col("close"), F.lit(0.0001)) * 100
    g = recent.groupBy(*BY).agg(
        F.max("n_").alias("lookback"), F.max("high").alias("h"), F.min("low").alias("l"), F.min_by("close", "back_").alias("last"), F.max_by("close", "back_").alias("first"),
        F.avg(F.when(early, F.col("volume"))).alias("v1"), F.avg(F.when(~early, F.col("volume"))).alias("v2"), F.avg(width).alias("w"), F.avg(F.when(F.col("back_") <= 12, width)).alias("w12"),
    )
    g = g.withColumns({
        "slope_pct": pct_from("first", "last"), "range_position": (F.col("last") - F.col("l")) / F.greatest(F.col("h") - F.col("l"), F.col("last") * 0.0001),
        "volume_expansion": F.coalesce(F.try_divide(F.col("v2"), F.col("v1")), F.lit(1.0)), "compression": 1 - clamp(F.col("w12") / F.greatest(F.col("w"), F.lit(0.0001)), 0.0, 2.0),
    })
    s, p = F.col("slope_pct"), F.col("range_position")
    phase = F.when(F.col("lookback") < 20, "insufficient").when((s >= 6) & (p >= 0.58), "markup").when((s <= -6) & (p <= 0.42), "markdown").when((F.abs(s) < 6) & (p <= 0.48), "accumulation").when((F.abs(s) < 6) & (p >= 0.52), "distribution").otherwise("range")
    confidence = clamp(F.abs(s) * 2.2 + F.abs(p - 0.5) * 55 + F.greatest(F.lit(0.0), F.col("volume_expansion") - 1) * 12 + F.greatest(F.lit(0.0), F.col("compression")) * 18, 10.0, 92.0)
    return g.select(*BY, "lookback", phase.alias("phase"), F.when(F.col("lookback") < 20, 0.0).otherwise(confidence).alias("confidence"), "slope_pct", "range_position", "volume_expansion", "compression")


def volume_profile(df: DataFrame, by: list[str], buckets: int = 18) -> DataFrame:
    """Volume at equal steps of price, with point of control (poc) and value area (in_value_area) of 70 %.

    Buckets without volume are not listed. The area takes buckets by volume while the share
    before them is under 0.7; among equals the lower price comes first.
    """
    every = Window.partitionBy(*by)
    df = df.withColumns({"lo_": F.min("low").over(every), "hi_": F.max("high").over(every)})
    width = F.greatest((F.col("hi_") - F.col("lo_")) / buckets, F.greatest(F.col("hi_"), F.lit(1.0)) * 0.0001)
    bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((typical() - F.col("lo_")) / width).cast("int")))
    g = df.withColumns({"width_": width}).withColumn("bucket", bucket).groupBy(*by, "bucket", "lo_", "width_").agg(F.round(F.sum("volume"), 4).alias("volume"), F.sum(F.col("volume") * typical()).alias("notional"))
    rank = Window.partitionBy(*by).orderBy(F.desc("volume"), "bucket")
    total = F.sum("volume").over(every)
    ahead = F.coalesce(F.sum("volume").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return g.withColumns({
        "price": F.col("lo_") + (F.col("bucket") + 0.5) * F.col("width_"), "share_pct": F.coalesce(F.try_divide(F.col("volume"), total) * 100, F.lit(0.0)),
        "poc": F.row_number().over(rank) == 1, "in_value_area": F.coalesce(F.try_divide(ahead, total) < 0.7, F.lit(True)),
    }).drop("lo_", "width_")


def anomalies(df: DataFrame) -> DataFrame:
    """Breakouts, selloffs and volume shocks against each symbol's own thresholds."""
    df = volume_ratio(signed_flow(df))
    limits = df.groupBy(*BY).agg(
        F.greatest(F.lit(1.8), F.avg("volume_ratio") + F.stddev_pop("volume_ratio") * 1.2).alias("v_"), F.greatest(F.lit(1.2), F.stddev_pop("return_pct") * 1.35).alias("r_"),
    )
    v, r = F.col("v_"), F.col("r_")
    loud = F.col("volume_ratio") >= v * 0.75
    kind = F.when((F.col("return_pct") >= r) & loud, "breakout").when((F.col("return_pct") <= -r) & loud, "selloff").when((F.col("volume_ratio") >= v) & (F.abs("return_pct") >= r * 0.45), "volume_shock")
    return df.join(limits, BY).withColumn("kind", kind).filter("kind is not null").drop("v_", "r_")


def regime_path(df: DataFrame) -> DataFrame:
    """state of every bar from ten-bar drift and 20-bar volatility against 1.35 times the symbol's median."""
    from tidemark.functions.series import trailing

    w = ordered(BY, ORDER)
    df = df.withColumn("ret_", F.coalesce(pct_from(F.lag("close").over(w), F.col("close")), F.lit(0.0)))
    df = df.withColumns({"drift_": F.avg("ret_").over(trailing(w, 10)), "vol_": F.stddev_pop("ret_").over(trailing(w, 20))})
    # the upper median is an order statistic of ranks, so no array of the series is built
    place = F.row_number().over(Window.partitionBy(*BY).orderBy("vol_", *ORDER))
    n = F.count("*").over(Window.partitionBy(*BY))
    df = df.withColumns({"place_": place, "n_": n})
    median = F.max(F.when(F.col("place_") == F.floor(F.col("n_") / 2) + 1, F.col("vol_"))).over(Window.partitionBy(*BY))
    state = F.when((F.col("vol_") > median * 1.35) & (F.col("drift_") < 0), "risk_off_high_vol").when(F.col("drift_") > 0.12, "risk_on_trend").when(F.col("drift_") < -0.12, "bearish_drift").otherwise("range_mean_reversion")
    return df.withColumn("state", state).drop("ret_", "drift_", "vol_", "place_", "n_")


def transitions(states: DataFrame, by: list[str] = BY, order: list[str] = ORDER) -> DataFrame:
    """Counts and probabilities of going from one state to the next."""
    pairs = states.withColumn("next_state", F.lead("state").over(ordered(by, order))).filter("next_state is not null")
    counted = pairs.groupBy(*by, "state", "next_state").agg(F.count("*").alias("n"))
    return counted.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "state")))


def volatility(df: DataFrame) -> DataFrame:
    """EWMA (decay 0.94 over 180 returns) and Parkinson (120 bars) annual volatility, and the shock ratio."""
    w = ordered(BY, ORDER)
    df = df.withColumn("ret_", F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)))
    recent = _last(df, 180)
    k = F.col("back_")
    ewma = F.sum(F.when(F.col("ret_").isNotNull(), 0.06 * F.pow(F.lit(0.94), k - 1) * F.col("ret_") * F.col("ret_")))
    spread = F.when((k <= 120) & (F.col("low") > 0) & (F.col("high") > F.col("low")), F.pow(F.ln(F.col("high") / F.col("low")), F.lit(2.0)) / (4 * F.ln(F.lit(2.0))))
    fresh, older = F.avg(F.when(k <= 20, F.abs("ret_"))), F.avg(F.when((k > 20) & (k <= 80), F.abs("ret_")))
    return recent.groupBy(*BY).agg(
        (F.sqrt(ewma) * F.sqrt(F.lit(252.0)) * 100).alias("ewma_annual_pct"), F.coalesce(F.sqrt(F.avg(spread)) * F.sqrt(F.lit(252.0)) * 100, F.lit(0.0)).alias("parkinson_annual_pct"),
        F.coalesce(fresh / F.greatest(F.lit(1e-9), older), F.lit(0.0)).alias("shock_ratio"),
    )


def gbm_forecast(df: DataFrame, horizon: int = 5, bars: int = 120, z: float = 1.281551565545) -> DataFrame:
    """Expected, 10 % and 90 % returns of a geometric Brownian motion, and a capped single-asset weight."""
    w = ordered(BY, ORDER)
    prev = F.lag("close").over(w)
    df = df.withColumns({"log_": F.when(prev > 0, F.ln(F.col("close") / prev)), "ret_": F.when(prev > 0, F.col("close") / prev - 1)})
    g = _last(df, bars).groupBy(*BY).agg(F.avg("log_").alias("mu"), F.stddev_pop("log_").alias("sigma"), F.avg(F.when(F.col("back_") <= 80, F.col("ret_"))).alias("m"), F.var_pop(F.when(F.col("back_") <= 80, F.col("ret_"))).alias("v"))
    drift = (F.col("mu") - 0.5 * F.col("sigma") * F.col("sigma")) * horizon
    swing = z * F.col("sigma") * horizon**0.5
    pct = lambda x: (F.exp(x) - 1) * 100
    weight = clamp(F.col("m") * horizon / F.greatest(F.col("v") * horizon, F.lit(1e-8)) / 6, -0.25, 0.35) * 100
    return g.select(*BY, (F.col("mu") * 25200).alias("drift_annual_pct"), pct(F.col("mu") * horizon).alias("expected_pct"), pct(drift - swing).alias("p10_pct"), pct(drift + swing).alias("p90_pct"), weight.alias("weight_pct"))


def latest(df: DataFrame, columns: list[str]) -> DataFrame:
    """The last bar's values of each symbol."""
    return df.groupBy(*BY).agg(F.max_by(F.struct(*columns), F.struct(*ORDER)).alias("x")).select(*BY, "x.*")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
