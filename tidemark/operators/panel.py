"""Cross-sections and factor research: ranks, labels, weights, splits, information coefficients, admission."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, pct_from
from tidemark.functions.series import average_rank, ordered, pearson
from tidemark.operators.indicators import BY, ORDER, alpha_frame
from tidemark.operators.labels import forward_returns
from tidemark.operators.selection import totals

W = Window
FACTORS = ("momentum_5", "momentum_20", "trend_gap_20", "trend_gap_60", "vwap_gap", "volume_ratio_20", "volatility_10", "range_position_20", "macd_hist_pct", "atr_pct_14", "candle_body_pressure", "close_location", "overnight_gap", "intraday_return", "volume_price_impulse")


def factor_panel(bars: DataFrame, h: int = 5, skip: int = 60, factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """market, symbol, sector, day, the factors, and label (return of the next h bars)."""
    df = forward_returns(alpha_frame(bars), h).withColumn("row_", F.row_number().over(ordered(BY, ORDER)))
    return df.filter((F.col("row_") > skip) & F.col("forward_return").isNotNull()).select("market", "symbol", "sector", "day", *factors, F.col("forward_return").alias("label"))


def long_form(panel: DataFrame, factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """One row for each factor: factor, value."""
    return panel.unpivot(["market", "symbol", "sector", "day", "label"], list(factors), "factor", "value")


def ordinal_rank(value: str, by: list[str], tie: list[str]) -> Column:
    """(row number - 1) / (n - 1), ties in the given order; 0.5 for a single row."""
    n = F.count("*").over(W.partitionBy(*by))
    return F.when(n > 1, (F.row_number().over(W.partitionBy(*by).orderBy(value, *tie)) - 1) / F.greatest(F.lit(1), n - 1).cast("double")).otherwise(F.lit(0.5))


def cross_ranks(panel: DataFrame, columns: list[str], by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """rank_<column> in [-1, 1] within each date, return_rank in [0, 1], and breadth (share of rising symbols)."""
    by, tie = by or ["day"], tie or ["symbol"]
    out = panel.withColumns({f"rank_{c}": ordinal_rank(c, by, tie) * 2 - 1 for c in columns})
    return out.withColumns({"return_rank": ordinal_rank("label", by, tie), "breadth": F.avg((F.col("label") > 0).cast("double")).over(W.partitionBy(*by))})


def rank_relevance(path_grade: Column, rank: Column) -> Column:
    """Graded relevance of a row for ranking learners."""
    return 3 * path_grade + 2 * rank


def balance_weights(df: DataFrame, date: str, target: str, weight: str) -> DataFrame:
    """weight times the class factor min(2, 0.5 / rate) and the date factor median mass / mass in [0.25, 4]."""
    total = df.groupBy().agg((F.sum(F.col(weight) * F.col(target)) / F.sum(weight)).alias("rate_"))
    mass = df.groupBy(date).agg(F.sum(weight).alias("mass_"))
    middle = mass.groupBy().agg(F.percentile("mass_", 0.5).alias("median_"))
    # one row each, by construction of a global aggregate
    scaled = df.join(mass, date).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(middle))
    own = F.when(F.col(target) == 1, F.col("rate_")).otherwise(1 - F.col("rate_"))
    cls = F.least(F.lit(2.0), 0.5 / F.greatest(F.lit(1e-9), own))
    return scaled.withColumn("balanced", F.col(weight) * cls * clamp(F.col("median_") / F.greatest(F.lit(1e-9), F.col("mass_")), 0.25, 4.0)).drop("rate_", "mass_", "median_")


def chronological_split(df: DataFrame, by: list[str], date: str, train: float = 0.6, valid: float = 0.8, gap: int = 5) -> DataFrame:
    """part: train, validation or test by place of the date, with `gap` dates left out before each cut."""
    place = F.dense_rank().over(W.partitionBy(*by).orderBy(date))
    d = df.withColumn("place_", place).withColumn("n_", F.max("place_").over(W.partitionBy(*by)))
    a, b = F.floor(F.col("n_") * train), F.floor(F.col("n_") * valid)
    part = F.when(F.col("place_") <= a - gap, "train").when(F.col("place_") <= a, None).when(F.col("place_") <= b - gap, "validation").when(F.col("place_") <= b, None).otherwise("test")
    return d.withColumn("part", part).drop("place_", "n_").filter("part is not null")


def walk_forward(df: DataFrame, date: str, folds: int = 5, purge: int = 8, first: float = 0.5) -> DataFrame:
    """Rows with fold and part: expanding training dates, `purge` dates left out, then a block of test dates.

    Dates get numbers by a small window over distinct dates; rows meet the folds by date number,
    so no range join over rows is needed.
    """
    dates = df.select(date).distinct().withColumn("place_", F.row_number().over(W.orderBy(date)))
    n = F.max("place_").over(W.partitionBy())
    start = F.floor(n * first)
    block = F.floor((n - start) / folds)
    dates = dates.withColumns({"start_": start, "block_": block}).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    begin = F.col("start_") + (F.col("fold") - 1) * F.col("block_")
    part = F.when(F.col("place_") <= begin - purge, "train").when((F.col("place_") > begin) & (F.col("place_") <= begin + F.col("block_")), "test")
    return df.join(dates.withColumn("part", part).filter("part is not null").select(date, "fold", "part"), date)


def daily_ic(long: DataFrame, least: int = 8) -> DataFrame:
    """IC, rank IC and quintile spread of each factor and date."""
    by = ["factor", "day"]
    every = W.partitionBy(*by)
    d = long.withColumns({"a_": average_rank("value", by), "b_": average_rank("label", by), "n_": F.count("*").over(every), "lo_": F.row_number().over(every.orderBy("value", "symbol"))})
    fifth = F.floor(F.col("n_") / 5)
    g = d.filter(F.col("n_") >= least).groupBy(*by).agg(
        F.max("n_").alias("symbols"), pearson(F.col("value"), F.col("label")).alias("ic"), pearson(F.col("a_"), F.col("b_")).alias("rank_ic"),
        F.avg(F.when(F.col("lo_") > F.col("n_") - fifth, F.col("label"))).alias("t_"), F.avg(F.when(F.col("lo_") <= fifth, F.col("label"))).alias("l_"),
    )
    return g.select(*by, "symbols", "ic", "rank_ic", F.when(F.col("symbols") >= 20, F.col("t_") - F.col("l_")).alias("spread"))


def ic_summary(daily: DataFrame) -> DataFrame:
    """Means over dates, stability (share of the mean's sign) and ratio to the sample deviation."""
    sd = F.stddev_samp("rank_ic")
    g = daily.groupBy("factor").agg(F.count("*").alias("dates"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.when(sd > 1e-12, F.avg("rank_ic") / sd).alias("icir"), F.avg("spread").alias("spread"), F.avg((F.col("rank_ic") > 1e-9).cast("double")).alias("up_"))
    return g.withColumn("stability", F.when(F.col("rank_ic") >= 0, F.col("up_")).otherwise(1 - F.col("up_"))).drop("up_")


def sector_neutral_ic(long: DataFrame) -> DataFrame:
    """Correlation of value and label after taking out the means of date and sector (groups of two or more)."""
    every = W.partitionBy("factor", "day", "sector")
    d = long.withColumns({"n_": F.count("*").over(every), "v_": F.col("value") - F.avg("value").over(every), "y_": F.col("label") - F.avg("label").over(every)})
    return d.filter("n_ >= 2").groupBy("factor").agg(F.count("*").alias("n"), pearson(F.col("v_"), F.col("y_")).alias("neutral_ic"))


def quality_gate(long: DataFrame) -> DataFrame:
    """Missing share, distinct share, robust outlier share (8 times IQR / 1.349 from the median) and the verdict."""
    q = long.groupBy("factor").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = long.join(q, "factor")
    sd = (F.col("q")[2] - F.col("q")[0]) / 1.349
    out = F.abs(F.col("value") - F.col("q")[1]) > 8 * F.greatest(sd, F.lit(1e-9))
    g = d.groupBy("factor").agg(F.count("*").alias("n"), (F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing"), (F.count_distinct(F.round("value", 8)) / F.count("*")).alias("richness"), (F.count_if(out) / F.count("*")).alias("outliers"), F.stddev_pop("value").alias("sd"))
    return g.withColumn("passed", (F.col("missing") <= 0.02) & (F.col("richness") >= 0.12) & (F.col("outliers") <= 0.06) & (F.col("sd") > 1e-9))


def correlations(panel: DataFrame, factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """left, right, correlation of all pairs of factors over the rows that have both, 0 where one of them does not vary.

    One pass sums four small matrices (numbers of pairs, values, squares and products), from which all pairs follow. Sums are in doubles, so a
    factor's mean should not exceed its deviation by more than a factor of about 10^5.
    """
    k = len(factors)

    def sums(x):
        known = np.isfinite(x)
        m, v = known.astype(float), np.where(known, x, 0.0)
        return np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v]).ravel()

    nothing = F.lit(float("nan"))
    rows = panel.select(F.array(*(F.coalesce(F.col(f).cast("double"), nothing) for f in factors)).alias("x"))
    n, s, q, p = totals(rows, sums, 4 * k * k, ("x",)).reshape(4, k, k)
    n = np.maximum(n, 1)
    spread = (q / n - (s / n) ** 2) * (q.T / n - (s.T / n) ** 2)
    c = np.where(spread > 1e-24, (p / n - s / n * (s.T / n)) / np.sqrt(np.maximum(spread, 1e-300)), 0.0)
    return panel.sparkSession.createDataFrame([(factors[i], factors[j], float(c[i, j])) for i in range(k) for j in range(i + 1, k)], "left string, right string, correlation double")


def clusters(correlated: DataFrame, factors: tuple[str, ...] = FACTORS, limit: float = 0.72) -> dict[str, int]:
    """Cluster number of each factor: groups joined by |correlation| >= limit, numbered by first member. A handful of names."""
    group = {f: {f} for f in factors}
    for r in correlated.filter(F.abs("correlation") >= limit).collect():
        if group[r["left"]] is not group[r["right"]]:
            both = group[r["left"]] | group[r["right"]]
            for f in both:
                group[f] = both
    seen: list[int] = []
    for f in factors:
        if id(group[f]) not in seen:
            seen.append(id(group[f]))
    return {f: seen.index(id(group[f])) for f in factors}


def turnover(long: DataFrame) -> DataFrame:
    """Mean step from bar to bar over the deviation, by factor."""
    step = F.abs(F.col("value") - F.lag("value").over(W.partitionBy("factor", "symbol").orderBy("day")))
    g = long.withColumn("s_", step).groupBy("factor").agg(F.avg("s_").alias("m_"), F.stddev_pop("value").alias("d_"))
    return g.select("factor", F.coalesce(F.try_divide("m_", "d_"), F.lit(0.0)).alias("turnover"))


def rolling_ic(long: DataFrame, window: int = 60, step: int = 20) -> DataFrame:
    """Correlation in strided windows of each symbol's series; a row is copied to the windows that hold it."""
    d = long.withColumn("at_", F.row_number().over(W.partitionBy("factor", "symbol").orderBy("day")) - 1).withColumn("n_", F.count("*").over(W.partitionBy("factor", "symbol")))
    low = F.greatest(F.lit(0), F.ceil((F.col("at_") - window + 1) / step))
    high = F.least(F.floor(F.col("at_") / step), F.floor((F.col("n_") - window) / step))
    d = d.filter((F.col("n_") >= window) & (low <= high)).withColumn("window", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return d.groupBy("factor", "symbol", "window").agg(pearson(F.col("value"), F.col("label")).alias("ic"))


def ridge(panel: DataFrame, factors: tuple[str, ...], penalty: float = 1.0, weight: Column | None = None, limit: float = 6.0) -> dict[str, float]:
    """Closed-form ridge on standardised, clipped factors: one aggregate gives the Gram matrix, numpy solves it.

    The matrix has |factors| squared numbers whatever the number of rows.
    """
    w = weight if weight is not None else F.lit(1.0)
    s = panel.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(factors)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(factors))).first()
    if s is None or s[0] is None:
        return dict.fromkeys((*factors, "intercept"), 0.0)
    k = len(factors)
    z = [clamp((F.col(f) - s[i]) / (s[k + i] or 1.0), -limit, limit) for i, f in enumerate(factors)]
    d = panel.select(*(x.alias(f"z{i}") for i, x in enumerate(z)), F.col("label").alias("y"), w.alias("w"))
    terms = {f"g{i}_{j}": F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")) for i in range(k) for j in range(i, k)}
    terms |= {f"b{i}": F.sum(F.col("w") * F.col(f"z{i}") * (F.col("y"))) for i in range(k)} | {f"u{i}": F.sum(F.col("w") * F.col(f"z{i}")) for i in range(k)} | {"n": F.sum("w"), "ym": F.sum(F.col("w") * F.col("y"))}
    r = d.agg(*(c.alias(n) for n, c in terms.items())).first()
    n, mean = r["n"], r["ym"] / r["n"]
    gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] / n for j in range(k)] for i in range(k)])
    target = np.array([(r[f"b{i}"] - mean * r[f"u{i}"]) / n for i in range(k)])
    return dict(zip(factors, np.linalg.solve(gram + penalty * np.eye(k), target).tolist(), strict=True)) | {"intercept": mean}


def gram(panel: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """The sums that ridge() solves from, as rows left, right, value."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    one = panel.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"g{i}").alias("value")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def softmax_weights(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Weights from scores with temperature max(4, deviation, or 6 if it is 0); exponents held within 8."""
    every = W.partitionBy(*by)
    sd = F.stddev_pop(score).over(every)
    t = F.greatest(F.lit(4.0), F.when(sd > 0, sd).otherwise(F.lit(6.0)))
    e = F.exp(clamp((F.col(score) - F.avg(score).over(every)) / t, -8.0, 8.0))
    return df.withColumn("e_", e).withColumn("weight", F.col("e_") / F.sum("e_").over(every)).drop("e_")


def evidence_score(summary: DataFrame) -> DataFrame:
    """A 100-point score of each factor from strength, stability, ratio and spread, and its admission."""
    part = lambda c, scale, top: F.least(F.lit(float(top)), F.abs(F.coalesce(F.col(c), F.lit(0.0))) / scale * top)
    score = part("rank_ic", 0.05, 40) + clamp((F.col("stability") - 0.5) / 0.2, 0.0, 1.0) * 25 + part("icir", 0.4, 20) + part("spread", 1.0, 15)
    return summary.withColumn("evidence", score).withColumn("admitted", (score >= 55) & (F.col("stability") >= 0.55))




def momentum_label(bars: DataFrame, back: int, ahead: int) -> DataFrame:
    """day, symbol, momentum over `back` bars and label over `ahead` bars."""
    w = ordered(BY, ORDER)
    d = bars.withColumns({"p_": F.lag("close", back).over(w), "n_": F.lead("close", ahead).over(w)}).filter("p_ is not null and n_ is not null")
    return d.select("market", "symbol", "sector", "day", pct_from("p_", "close").alias("momentum"), pct_from("close", "n_").alias("label"))
