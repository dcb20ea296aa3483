"""Scores and gates over predictions, posts and universes; registries kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp

#: Words of instruments that are no ordinary shares (fixed values).
NOT_ORDINARY = r"(?i)\b(warrants?|units?|rights?|preferred|preference|acquisition|spac|deferred|etf|etp|notes?|fund)\b"


def _weighted(value: Column, weight: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(F.when(value.isNotNull(), weight))), F.avg(value))


def summarize(df: DataFrame, by: list[str]) -> DataFrame:
    """Rates of predictions (predicted, actual, p_target, target, stop, buy, weight, confidence), in per cent, for all, taken and left ones."""
    w, b = F.col("weight"), F.col("buy")
    rate = lambda cond, where: 100 * _weighted(F.when(where, cond.cast("double")), w)
    always = F.lit(True)
    sure = b & (F.col("confidence") >= 0.78) & (w >= 0.72)
    d = F.col("p_target") - F.col("target").cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum("weight").alias("effective_samples"), F.count_if(b).alias("buy_signals"), F.count_if(sure).alias("sure_samples"),
        rate((F.col("predicted") >= 0) == (F.col("actual") >= 0), always).alias("direction_hit_pct"), rate(F.col("target"), b).alias("target_hit_pct"), rate(F.col("stop"), b).alias("stop_pct"),
        rate(F.col("target"), sure).alias("sure_target_pct"), rate(F.col("stop"), ~b).alias("rejected_stop_pct"), _weighted(F.when(b, F.col("actual")), w).alias("mean_return"), _weighted(d * d, w).alias("brier"),
        (100 * F.avg((w < 0.55).cast("double"))).alias("low_quality_pct"),
    )


def calibration_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Points within 10 for the hit rate, mean return and stop rate of resolved predictions."""
    g = df.groupBy(*by).agg(F.count("*").alias("samples"), (100 * F.avg(F.col("target").cast("double"))).alias("hit_pct"), (100 * F.avg(F.col("stop").cast("double"))).alias("stop_pct"), F.avg("actual").alias("mean_return"))
    return g.withColumn("score", clamp((F.col("hit_pct") - 52) / 4 + F.col("mean_return") * 0.18 - F.col("stop_pct") * 0.035, -10.0, 10.0))


def replay_score(df: DataFrame, by: list[str], order: str, ret: str) -> DataFrame:
    """Score of a strategy's trades: mean, win rate, number, and the drawdown of their sum (as a negative number)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("e_", F.sum(ret).over(w)).withColumn("d_", F.col("e_") - F.greatest(F.lit(0.0), F.max("e_").over(w)))
    g = d.groupBy(*by).agg(F.count("*").alias("trades"), F.avg(ret).alias("mean_return"), (100 * F.avg((F.col(ret) > 0).cast("double"))).alias("win_pct"), F.min("d_").alias("max_drawdown"))
    return g.withColumn("score", F.col("mean_return") * 3.4 + (F.col("win_pct") - 50) * 0.18 + F.least(F.lit(12.0), F.col("trades") * 0.35) + F.col("max_drawdown") * 0.45)


def ensemble(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted upside and confidence of available models (model, available, base_weight, upside, confidence, direction_hit_pct, strategy_hit_pct, samples).

    Weights follow results once there are five of them, then the side of a majority of 55 % or more gains a little.
    """
    every = Window.partitionBy(*by)
    perf = clamp(0.76 + (F.col("direction_hit_pct") - 50) * 0.012 + (F.col("strategy_hit_pct") - 50) * 0.009 + F.least(F.lit(0.12), F.col("samples") * 0.004), 0.45, 1.35)
    d = df.filter("available").withColumn("w_", F.col("base_weight") * F.when(F.col("samples") >= 5, perf).otherwise(1.0))
    d = d.withColumn("up_", (F.col("upside") >= 0).cast("int")).withColumn("share_", F.avg(F.col("up_").cast("double")).over(every))
    agree = F.greatest("share_", 1 - F.col("share_"))
    with_most = (F.col("up_") == 1) == (F.col("share_") >= 0.5)
    d = d.withColumns({"agree_": agree, "w_": F.col("w_") * F.when((agree >= 0.55) & with_most, 1.08).otherwise(1.0)})
    g = d.groupBy(*by).agg(F.count("*").alias("models"), (F.sum(F.col("w_") * F.col("upside")) / F.sum("w_")).alias("upside"), (F.sum(F.col("w_") * F.col("confidence")) / F.sum("w_")).alias("confidence"), F.max("agree_").alias("agreement"))
    return g.withColumn("confidence", F.col("confidence") - F.when(F.col("agreement") < 0.55, 6.0).otherwise(0.0))


def social_scores(df: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """impact, score and lifetime in hours of posts; of each group the top posts by impact that are young enough."""
    impact = F.col("relevance") * 0.36 + F.col("influence") * 0.28 + F.col("validity") * 0.18 + F.col("truth") * 0.16 - F.col("manipulation") * 0.18
    hours = F.when(F.col("impact") >= 0.6, 72).when(F.col("impact") >= 0.35, 24).otherwise(12)
    d = df.withColumn("impact", impact).withColumn("ttl_hours", hours).filter(F.col("age_hours") <= F.col("ttl_hours"))
    d = d.withColumn("score", F.col("sentiment") * F.col("impact") * F.col("truth") - F.greatest(F.lit(0.0), F.col("manipulation") - 0.6) * 0.5)
    return d.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("impact"), "id"))).filter(F.col("k_") <= top).drop("k_")


def neighbour_coverage(df: DataFrame, by: list[str], distance: str, samples: str) -> DataFrame:
    """Coverage (0 to 100), weight and out-of-distribution risk from the distances of the neighbours found."""
    g = df.filter(F.col(distance) >= 0).groupBy(*by).agg(F.array_sort(F.collect_list(distance)).alias("d_"), F.max(samples).alias("n_"))
    p75 = F.element_at("d_", (F.floor((F.size("d_") - 1) * 0.75) + 1).cast("int"))
    mean = F.aggregate("d_", F.lit(0.0), lambda a, x: a + x) / F.size("d_")
    score = clamp(104 - F.col("d_")[0] * 24 - mean * 31 - p75 * 11 + F.least(F.lit(8.0), F.log10(F.greatest(F.lit(1), F.col("n_")).cast("double")) * 3.5), 0.0, 100.0)
    return g.withColumn("coverage", score).withColumns({"coverage_weight": clamp(0.22 + F.col("coverage") * 0.0078, 0.22, 1.0), "ood_risk": 1 - F.col("coverage") / 100}).drop("d_", "n_")


def dataset_profile(df: DataFrame, by: list[str], date: str, horizon: int) -> DataFrame:
    """Rows, symbols, dates, independent blocks of dates, effective n, and the share of positive labels."""
    g = df.groupBy(*by).agg(F.count("*").alias("row_count"), F.count_distinct("symbol").alias("symbols"), F.count_distinct(date).alias("dates"), F.sum("weight").alias("w_"), F.sum(F.col("weight") * F.col("weight")).alias("ww_"), F.avg((F.col("label") > 0).cast("double")).alias("positive_share"))
    return g.withColumns({"blocks": F.ceil(F.col("dates") / horizon), "effective_n": F.coalesce(F.try_divide(F.col("w_") * F.col("w_"), F.col("ww_")), F.lit(0.0))}).drop("w_", "ww_")


def eligible(name: Column, kind: Column) -> Column:
    """Ordinary shares only."""
    return ~F.coalesce(name, F.lit("")).rlike(NOT_ORDINARY) & F.lower(F.coalesce(kind, F.lit(""))).isin("stock", "common stock")


def readiness(target: DataFrame, covered: dict[str, DataFrame], least: dict[str, float]) -> DataFrame:
    """Share of the target's symbols in each covering table, and whether it reaches its gate."""
    out = None
    for name, frame in covered.items():
        hit = target.join(frame.select("symbol").distinct().withColumn("in_", F.lit(1)), "symbol", "left").agg(F.count("*").alias("target"), F.count("in_").alias("covered"))
        row = hit.select(F.lit(name).alias("gate"), "target", "covered", F.coalesce(F.try_divide(F.col("covered") * 100.0, F.col("target")), F.lit(0.0)).alias("covered_pct")).withColumn("passed", F.col("covered_pct") >= least[name])
        out = row if out is None else out.unionByName(row)
    return out


def retain(df: DataFrame, by: list[str], newest: str, keep: int, referenced: DataFrame, key: str) -> DataFrame:
    """Rows that may be deleted: beyond the newest `keep` of their group and not referenced."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(newest), F.desc(key)))
    old = df.withColumn("k_", k).filter(F.col("k_") > keep).drop("k_")
    return old.join(referenced.select(key).distinct(), key, "left_anti")


def upsert_keeping(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert in which a null of the incoming row keeps what is stored."""
    rest = [c for c in existing.columns if c not in keys]
    new = incoming.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest))
    return existing.join(new, keys, "full").select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in rest))
