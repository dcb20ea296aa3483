"""Labels from later bars: entries, barriers, outcomes, confidence. They look ahead by design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, pct_change, pct_from
from tidemark.functions.series import ahead, ordered
from tidemark.operators.bars import quality
from tidemark.operators.indicators import BY, ORDER, true_range, typical


def forward_returns(df: DataFrame, h: int) -> DataFrame:
    """forward_return (close to close), forward_vwap_return, max_upside, max_drawdown over the next h bars; null near the end."""
    w = ordered(BY, ORDER)
    full = F.lead("close", h).over(w).isNotNull()
    tp = typical()
    df = df.withColumns({"tv_": tp * F.col("volume"), "full_": full})
    vw = F.try_divide(F.sum("tv_").over(ahead(w, h)), F.sum("volume").over(ahead(w, h)))
    when = lambda c: F.when(F.col("full_"), c)
    return df.withColumns({
        "forward_return": when(pct_from(F.col("close"), F.lead("close", h).over(w))), "forward_vwap_return": when(pct_from(F.col("close"), vw)),
        "max_upside": when(pct_from(F.col("close"), F.max("high").over(ahead(w, h)))), "max_drawdown": when(pct_from(F.col("close"), F.min("low").over(ahead(w, h)))),
    }).drop("tv_", "full_")


def barrier_width(h: int | Column, base: float, k: float, floor: float, top: float) -> Column:
    """A barrier in per cent from atr_pct and the root of the horizon, held in bounds."""
    scale = F.sqrt(F.greatest(F.lit(1.0), h) / 15) if isinstance(h, Column) else (max(1.0, h) / 15) ** 0.5
    return clamp(F.greatest(F.lit(base * 0.55), F.greatest(F.lit(0.15), F.col("atr_pct")) * (scale * k)), max(floor, base * 0.55), top)


def target_and_stop(h: int | Column, target: float, stop: float) -> dict[str, Column]:
    return {"target_pct": barrier_width(h, target, 2.35, 0.6, max(target * 1.8, 1.5)), "stop_pct": barrier_width(h, stop, 1.65, 0.5, max(stop * 1.6, 1.0))}


def barriers(df: DataFrame, h: int, target: float, stop: float) -> DataFrame:
    """target_pct and stop_pct: widened by the ATR and the root of the horizon, held in bounds."""
    return true_range(df).withColumns(target_and_stop(h, target, stop))


def triple_barrier(df: DataFrame, h: int, cost_pct: float = 0.0) -> DataFrame:
    """Outcome over the h bars after the signal, entered at the next open; needs target_pct and stop_pct.

    event: the barrier touched first (target, stop, ambiguous if both in one bar) or null, and
    event_bar. Touches are gross, forward_return is net of cost. Signals on the last bar have none.
    """
    return outcomes(with_path(df, h), cost_pct)


def with_path(df: DataFrame, h: int) -> DataFrame:
    """entry (the next open) and path_ (high, low, close of the next h bars)."""
    w = ordered(BY, ORDER)
    return df.withColumns({"entry": F.lead("open", 1).over(w), "path_": F.collect_list(F.struct("high", "low", "close")).over(ahead(w, h))})


def outcomes(df: DataFrame, cost_pct: float | Column = 0.0) -> DataFrame:
    """What triple_barrier() adds, from entry, path_, target_pct and stop_pct of each row alone."""
    e, t, s = F.col("entry"), F.col("target_pct"), F.col("stop_pct")
    up, down = lambda x: pct_change(x["high"], e) >= t, lambda x: pct_change(x["low"], e) <= -s
    numbered = F.transform("path_", lambda x, i: F.struct(F.when(up(x) & down(x), "ambiguous").when(up(x), "target").when(down(x), "stop").alias("event"), (i + 1).alias("bar")))
    first = F.try_element_at(F.filter(numbered, lambda x: x["event"].isNotNull()), F.lit(1))
    top, bottom = F.greatest(e, F.array_max(F.transform("path_", lambda x: x["high"]))), F.least(e, F.array_min(F.transform("path_", lambda x: x["low"])))
    df = df.filter(F.col("entry") > 0).withColumns({
        "event_": first, "max_upside": pct_change(top, e), "max_drawdown": pct_change(bottom, e), "bars_seen": F.size("path_"),
        "forward_return": pct_change(F.element_at("path_", -1)["close"], e) - cost_pct,
    })
    hit_t, hit_s = F.col("max_upside") >= t, F.col("max_drawdown") <= -s
    df = df.withColumns({"event": F.col("event_.event"), "event_bar": F.col("event_.bar"), "hit_target": hit_t, "hit_stop": hit_s})
    first_is = lambda name: F.coalesce(F.col("event") == name, F.lit(False))
    df = df.withColumns({"target_wins": F.col("hit_target") & (~F.col("hit_stop") | first_is("target")), "stop_wins": F.col("hit_stop") & (~F.col("hit_target") | first_is("stop"))})
    adjusted = F.when(F.col("target_wins"), F.least("max_upside", "target_pct")).when(F.col("stop_wins"), -s).otherwise(F.col("forward_return"))
    return df.withColumn("risk_adjusted_return", adjusted).drop("event_")


def label_confidence(df: DataFrame, h: int | Column) -> DataFrame:
    """confidence (0.12 to 1) and noise (0 to 100) of triple_barrier() rows that still have path_ and sample_weight."""
    e, up, down = F.col("entry"), F.col("max_upside"), F.abs("max_drawdown")
    t, s, r = F.col("target_pct"), F.col("stop_pct"), F.col("forward_return")
    floor = lambda x: F.greatest(F.lit(0.5), x)
    closes = F.transform("path_", lambda x: x["close"])
    moves = F.transform(F.arrays_zip(closes.alias("c"), F.concat(F.array(e), F.slice(closes, 1, F.size(closes) - 1)).alias("p")), lambda x: pct_change(x["c"], x["p"]))
    signs = F.filter(F.transform(closes, lambda c: F.when(pct_change(c, e) > 0.15, 1).when(pct_change(c, e) < -0.15, -1).otherwise(0)), lambda x: x != 0)
    df = df.withColumns({"moves_": moves, "signs_": signs})
    n = F.size("moves_").cast("double")
    total = lambda f: F.aggregate("moves_", F.lit(0.0), lambda a, x: a + f(x))
    df = df.withColumns({"mean_": total(lambda x: x) / n, "gross_": total(F.abs), "flips_": F.aggregate("signs_", F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), lambda a, x: F.struct((a["n"] + F.when((a["last"] != 0) & (a["last"] != x), 1).otherwise(0)).alias("n"), x.alias("last")))["n"]})
    df = df.withColumn("vol_", F.sqrt(F.aggregate("moves_", F.lit(0.0), lambda a, x: a + (x - F.col("mean_")) * (x - F.col("mean_"))) / n))
    weights = F.col("weights_")
    worst = F.least(F.col("sample_weight"), F.array_min(weights))
    future = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / F.size(weights)
    chop = F.col("gross_") / F.greatest(F.lit(0.35), F.abs(r))
    conflict = F.least(F.greatest(F.lit(0.0), up) / floor(t), F.greatest(F.lit(0.0), down) / floor(s))
    df = df.withColumns({"worst_": worst, "future_": future, "chop_": chop, "conflict_": conflict})
    chop, conflict, flips, gross = F.col("chop_"), F.col("conflict_"), F.col("flips_"), F.col("gross_")
    near = (F.abs(up - t) / floor(t) < 0.12) | (F.abs(down - s) / floor(s) < 0.12)
    same_bar = F.coalesce(F.col("event") == "ambiguous", F.lit(False))
    undecided = (F.abs(r) <= F.greatest(F.lit(0.35), t * 0.16)) & ((up >= t * 0.45) | (down >= s * 0.45))
    off = lambda cond, x: F.when(cond, x).otherwise(F.lit(0.0))
    raw = (
        0.34 + F.col("worst_") * 0.42 + F.col("future_") * 0.18 - off(near, F.lit(0.14)) - off(F.col("hit_target") & F.col("hit_stop"), F.lit(0.10)) - off(same_bar, F.lit(0.18)) - off(undecided, F.lit(0.10))
        - off((chop >= 4.5) & (gross >= F.greatest(F.lit(1.2), t * 0.55)), F.lit(0.08)) - off(conflict >= 0.55, F.least(F.lit(0.14), conflict * 0.09)) - off(flips >= 2, F.least(F.lit(0.10), flips * 0.025))
        - F.least(F.lit(0.12), F.greatest(F.lit(0.0), F.col("vol_") - 2.8) * 0.018) - off(F.col("bars_seen") < h, F.lit(0.16))
    )
    noise = clamp((1 - clamp(raw, 0.0, 1.0)) * 72 + F.least(F.lit(18.0), F.greatest(F.lit(0.0), chop - 2.5) * 2.6) + F.least(F.lit(16.0), conflict * 10) + F.least(F.lit(10.0), flips * 1.8) + off(same_bar, F.lit(8.0)), 0.0, 100.0)
    out = df.withColumns({"confidence": clamp(raw, 0.12, 1.0), "noise": noise, "path_volatility": F.col("vol_"), "direction_flips": flips})
    return out.drop("moves_", "signs_", "mean_", "gross_", "flips_", "vol_", "worst_", "future_", "chop_", "conflict_")


def labelled(df: DataFrame, h: int, target: float, stop: float, cost_pct: float = 0.0, skip: int = 55) -> DataFrame:
    """Bars with outcome, confidence, training_weight and clamped targets y_*; the first `skip` bars of a symbol are left out."""
    w = ordered(BY, ORDER)
    scored = quality(df, BY)
    scored = scored.withColumns({"weights_": F.collect_list("sample_weight").over(ahead(w, h)), "row_": F.row_number().over(w)})
    out = label_confidence(triple_barrier(barriers(scored, h, target, stop), h, cost_pct).filter((F.col("row_") > skip) & (F.col("bars_seen") == h)), h)
    flag = lambda c: F.col(c).cast("int")
    return out.withColumns({
        "training_weight": clamp(F.least("sample_weight", "confidence"), 0.05, 1.0), "y_return": clamp("risk_adjusted_return", -24.0, 24.0), "y_final": clamp("forward_return", -24.0, 24.0),
        "y_max": clamp("max_upside", 0.0, 32.0), "y_target": flag("target_wins"), "y_stop": flag("stop_wins"),
    }).drop("path_", "weights_", "row_")


def mature(samples: DataFrame, bars: DataFrame, h: int, as_of: Column) -> DataFrame:
    """Predictions (id, symbol, day) resolved once h complete bars after them are there by as_of; else resolved is false.

    Each bar knows the h bars from it on; one sort of both tables, newest first, then gives a
    prediction the bar after it. No join, and no limit on how long h bars take.
    """
    bars = bars.filter(F.col("day") <= as_of)
    on = ordered(["symbol"], ["day"]).rowsBetween(0, h - 1)
    path = F.struct(F.count("*").over(on).alias("n"), F.col("open").alias("entry"), F.last("close").over(on).alias("last"), F.max("high").over(on).alias("top"), F.min("low").over(on).alias("bottom"))
    rows = samples.select("id", "symbol", "day", F.lit(0).alias("kind_")).unionByName(bars.select("symbol", "day", F.lit(1).alias("kind_"), path.alias("path_")), allowMissingColumns=True)
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("day"), "kind_").rowsBetween(Window.unboundedPreceding, -1)
    # a bar of the prediction's own day comes after it in this order
    met = rows.withColumn("next_", F.last("path_", ignorenulls=True).over(newest_first)).filter("kind_ = 0")
    of = lambda c: F.col("next_")[c]
    seen = F.coalesce(of("n"), F.lit(0))
    pct = lambda c: F.when(seen >= h, pct_change(of(c), of("entry")))
    return met.select("id", "symbol", "day", seen.alias("bars_seen"), (seen >= h).alias("resolved"), pct("last").alias("forward_return"), pct("top").alias("max_upside"), pct("bottom").alias("max_drawdown"))
