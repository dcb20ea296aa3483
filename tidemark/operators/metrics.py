"""Evaluation: classification, ranking, regression, quantiles, drift, intervals, drawdown.

Each metric groups by any columns. Sums over rows are ordinary aggregates with map-side
combination; where ranks are needed, rows are first counted by distinct score, so that ties and
skewed groups shrink before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import Z90, wilson

W = Window


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def confusion(df: DataFrame, by: list[str], p: str = "probability", y: str = "actual", threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy, balanced accuracy, precision, recall, F1, macro F1, MCC."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.count_if(c)
    g = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(n(hit & pos).alias("tp"), n(~hit & ~pos).alias("tn"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    part = lambda a, b: a / F.greatest(F.lit(1.0), b)
    g = g.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "np_": part(tn, tn + fn), "nr_": part(tn, tn + fp)})
    f1 = lambda a, b: 2 * a * b / F.greatest(F.lit(1e-12), a + b)
    g = g.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "nf_": f1(F.col("np_"), F.col("nr_"))})
    return g.withColumns({
        "accuracy": (tp + tn) / (tp + tn + fp + fn), "balanced_accuracy": (F.col("recall") + F.col("nr_")) / 2, "macro_f1": (F.col("f1") + F.col("nf_")) / 2,
        "mcc": F.coalesce(_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)),
    }).drop("np_", "nr_", "nf_")


def reliability(df: DataFrame, by: list[str], bins: int = 10, p: str = "probability", y: str = "actual", weight: str | None = None) -> DataFrame:
    """Mean prediction and outcome in equal bins of the probability; 1 falls in the last."""
    w = F.col(weight) if weight else F.lit(1.0)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(p) * bins + 1e-9).cast("int")))
    g = df.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(w).alias("weight"), (F.sum(w * F.col(p)) / F.sum(w)).alias("predicted"), (F.sum(w * F.col(y)) / F.sum(w)).alias("observed"))
    return g.withColumn("error", F.abs(F.col("predicted") - F.col("observed")))


def brier_ece(df: DataFrame, by: list[str], bins: int = 10, p: str = "probability", y: str = "actual", weight: str | None = None) -> DataFrame:
    """brier, baseline_brier, brier_skill, ece and inversions (later bins that fall over 3 points below an earlier one)."""
    w = F.col(weight) if weight else F.lit(1.0)
    base = df.groupBy(*by).agg((F.sum(w * (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))) / F.sum(w)).alias("brier"), (F.sum(w * F.col(y)) / F.sum(w)).alias("rate"))
    bins_ = reliability(df, by, bins, p, y, weight)
    prev = F.lag("observed").over(W.partitionBy(*by).orderBy("bin"))
    errors = bins_.withColumn("inv_", prev - F.col("observed") > 0.03).groupBy(*by).agg((F.sum(F.col("error") * F.col("weight")) / F.sum("weight")).alias("ece"), F.count_if("inv_").alias("inversions"))
    # the baseline forecasts the rate itself
    out = base.withColumn("baseline_brier", F.col("rate") * (1 - F.col("rate")))
    out = out.withColumn("brier_skill", 1 - _div(F.col("brier"), F.nullif("baseline_brier", F.lit(0.0))))
    return out.join(errors, by) if by else out.crossJoin(F.broadcast(errors))


def auc_ap(df: DataFrame, by: list[str], p: str = "probability", y: str = "actual") -> DataFrame:
    """ROC AUC with average ranks for ties, and average precision (positives first among ties).

    Rows are counted by score first, so a window sees each distinct score once.
    """
    pos = F.col(y) == 1
    g = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("n"), F.count_if(pos).alias("k"))
    up = W.partitionBy(*by).orderBy(p).rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0)), "above": F.coalesce(F.sum("n").over(down), F.lit(0)), "hits": F.coalesce(F.sum("k").over(down), F.lit(0))})
    # a score's k positives come first: their precisions are (hits + i) / (above + i), i = 1..k
    inside = F.when(F.col("k") > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("k"), F.lit(1))), F.lit(0.0), lambda a, i: a + (F.col("hits") + i) / (F.col("above") + i))).otherwise(F.lit(0.0))
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    s = g.withColumn("ap_", inside).groupBy(*by).agg(F.sum("k").alias("positives"), F.sum("n").alias("n"), F.sum(F.col("k") * rank).alias("ranks"), F.sum("ap_").alias("ap_"))
    k, neg = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return s.select(*by, "n", "positives", _div(F.col("ranks") - k * (k + 1) / 2, F.nullif(k * neg, F.lit(0.0))).alias("auc"), _div(F.col("ap_"), F.nullif(k, F.lit(0.0))).alias("average_precision"))


def top_share(df: DataFrame, by: list[str], score: str, order: list[str], y: str = "actual", share: float = 0.1) -> DataFrame:
    """Hit rate of the ceil(share n) rows with the highest score, at least one.

    Scores that count as a whole are summed; only the rows of the score on the border are sorted.
    """
    hit, w = F.col(y).cast("double"), W.partitionBy(*by)
    g = df.groupBy(*by, score).agg(F.count("*").alias("c_"), F.sum(hit).alias("sum_"), F.count(y).alias("known_"))
    g = g.withColumns({"n_": F.sum("c_").over(w), "upto_": F.sum("c_").over(w.orderBy(F.desc(score)))})
    g = g.withColumn("left_", F.greatest(F.lit(1), F.ceil(F.col("n_") * share - 1e-9)) - F.col("upto_") + F.col("c_"))
    border = g.filter("left_ > 0 and left_ < c_").select(*(F.col(c).alias(f"{c}_at_") for c in [*by, score]), "left_")
    ties = df.join(F.broadcast(border), [F.col(c).eqNullSafe(F.col(f"{c}_at_")) for c in [*by, score]])  # one row a group
    ties = ties.withColumn("nth_", F.row_number().over(w.orderBy(*order))).filter(F.col("nth_") <= F.col("left_"))
    parts = g.filter("left_ >= c_").select(*by, "c_", "sum_", "known_").unionByName(ties.select(*by, F.lit(1).cast("long").alias("c_"), hit.alias("sum_"), hit.isNotNull().cast("long").alias("known_")))
    return parts.groupBy(*by).agg(F.sum("c_").alias("selected"), F.try_divide(F.sum("sum_"), F.sum("known_")).alias("hit_rate"))


def regression(df: DataFrame, by: list[str], p: str = "predicted_return", y: str = "actual_return") -> DataFrame:
    e = F.col(p) - F.col(y)
    g = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"), F.var_pop(y).alias("var_"),
        F.avg(((F.col(p) >= 0) == (F.col(y) >= 0)).cast("double")).alias("direction"),
    )
    return g.withColumn("r2", F.when(F.col("var_") > 1e-12, 1 - F.col("rmse") * F.col("rmse") / F.nullif("var_", F.lit(0.0)))).drop("var_")


def order_statistic(df: DataFrame, by: list[str], value: Column, place: Column, out: str) -> DataFrame:
    """The value at a 1-based place (an expression of n_) among each group's values in order, by counting distinct values."""
    g = df.withColumn("v_", value).filter("v_ is not null").groupBy(*by, "v_").agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(W.partitionBy(*by).orderBy("v_"))
    g = g.withColumns({"upto_": upto, "n_": F.sum("c_").over(W.partitionBy(*by))})
    return g.filter(F.col("upto_") >= F.greatest(F.lit(1), F.least(F.col("n_"), place))).groupBy(*by).agg(F.min("v_").alias(out))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, qs: tuple[float, ...]) -> DataFrame:
    """First values whose cumulative weight reaches q of the total: one column q50, q80, .. for each."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.greatest(F.lit(0.0), F.col(weight))).alias("w_"))
    upto = F.sum("w_").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumns({"upto_": upto, "total_": F.sum("w_").over(W.partitionBy(*by))})
    return g.groupBy(*by).agg(*(F.min(F.when(F.col("upto_") >= F.col("total_") * q - 1e-9, F.col(value))).alias(f"q{round(q * 100)}") for q in qs))


def quantile_losses(df: DataFrame, by: list[str], low: str, mid: str, high: str, y: str) -> DataFrame:
    loss = lambda a, c: F.avg(F.greatest(a * (F.col(y) - F.col(c)), (a - 1) * (F.col(y) - F.col(c))))
    inside = (F.col(low) <= F.col(y)) & (F.col(y) <= F.col(high))
    return df.groupBy(*by).agg(loss(0.1, low).alias("pinball_low"), loss(0.5, mid).alias("pinball_mid"), loss(0.9, high).alias("pinball_high"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"))


def conformal(df: DataFrame, by: list[str], low: str, high: str, y: str, alpha: float = 0.2) -> DataFrame:
    """Margin by which an interval must grow to hold 1 - alpha: the ceil((n + 1)(1 - alpha))-th score."""
    score = F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))
    return order_statistic(df, by, score, F.ceil((F.col("n_") + 1) * (1 - alpha) - 1e-9), "margin")


def kish_wilson(df: DataFrame, by: list[str], y: str, weight: str, z: float = Z90) -> DataFrame:
    """Weighted rate, Kish's effective n and Wilson bounds."""
    w = F.greatest(F.lit(0.0), F.col(weight))
    g = df.groupBy(*by).agg(F.count_if(w > 0).alias("n"), F.sum(w).alias("w_"), F.sum(w * w).alias("ww_"), F.sum(w * F.col(y)).alias("wy_"))
    g = g.withColumns({"effective_n": F.coalesce(_div(F.col("w_") * F.col("w_"), F.nullif("ww_", F.lit(0.0))), F.lit(0.0)), "rate": F.coalesce(_div(F.col("wy_"), F.nullif("w_", F.lit(0.0))), F.lit(0.0))})
    lower, upper = wilson(F.col("rate"), F.col("effective_n"), z)
    return g.withColumns({"lower": lower, "upper": upper}).drop("w_", "ww_", "wy_")


def calibration_buckets(df: DataFrame, by: list[str], p: str, y: str, weight: str) -> DataFrame:
    """Six fixed buckets of a probability in per cent: 0-39, 40s to 70s, 80 and more."""
    pct = F.col(p) * 100 + 1e-9
    bucket = F.when(pct < 40, "0-39").when(pct < 50, "40-49").when(pct < 60, "50-59").when(pct < 70, "60-69").when(pct < 80, "70-79").otherwise("80-99")
    w = F.col(weight)
    g = df.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count("*").alias("n"), (F.sum(w * F.col(p)) / F.sum(w) * 100).alias("predicted_pct"), (F.sum(w * F.col(y)) / F.sum(w) * 100).alias("observed_pct"))
    return g.withColumn("error_pct", F.abs(F.col("predicted_pct") - F.col("observed_pct")))


def diagnostics(df: DataFrame, keys: list[str], p: str = "probability", y: str = "actual", least: int = 10) -> DataFrame:
    """Rate, mean prediction and Brier score by each of the keys on its own, in one pass (grouping sets)."""
    d = F.col(p) - F.col(y)
    g = df.groupingSets([[F.col(k)] for k in keys], *map(F.col, keys)).agg(F.grouping_id().alias("id_"), F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg(p).alias("predicted"), F.avg(d * d).alias("brier"))
    last = len(keys) - 1
    names = F.element_at(F.array(*map(F.lit, keys)), F.array_position(F.array(*(F.lit(2 ** len(keys) - 1 - 2 ** (last - i)) for i in range(len(keys)))), F.col("id_").cast("int")).cast("int"))
    return g.filter(F.col("n") >= least).select(names.alias("key"), F.coalesce(*(F.col(k).cast("string") for k in keys)).alias("value"), "n", "rate", "predicted", "brier")


def psi(train: DataFrame, recent: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Population stability index and standardised mean shift of each feature.

    Boundaries are the training values at places floor(n q / bins); a value belongs to the bin of
    the number of boundaries below it. Both sides are counted by value first.
    """
    long = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("e")).select("side", "e.*")
    counted = long(train, 0).unionByName(long(recent, 1)).filter("v is not null").groupBy("feature", "side", "v").agg(F.count("*").alias("c"))
    own = W.partitionBy("feature").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    base = counted.filter("side = 0").withColumns({"upto": F.sum("c").over(own), "n": F.sum("c").over(W.partitionBy("feature"))})
    # value v covers the 0-based places upto - c .. upto - 1
    cut = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / bins), F.col("v")))
    bounds = base.groupBy("feature").agg(F.array(*(cut(q) for q in range(1, bins))).alias("bounds"))
    binned = counted.join(F.broadcast(bounds), "feature").withColumn("bin", F.size(F.filter("bounds", lambda b: b < F.col("v"))))
    g = binned.groupBy("feature", "side", "bin").agg(F.sum("c").alias("c"))
    full = bounds.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    side = lambda k: g.filter(F.col("side") == k).select("feature", "bin", F.col("c").alias(f"c{k}"))
    both = full.join(side(0), ["feature", "bin"], "left").join(side(1), ["feature", "bin"], "left")
    share = lambda k: F.greatest(F.lit(1e-4), F.coalesce(F.col(f"c{k}"), F.lit(0)) / F.sum(f"c{k}").over(W.partitionBy("feature")))
    both = both.withColumns({"p": share(0), "q": share(1)})
    out = both.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    m = counted.groupBy("feature").agg(*((F.sum(F.when(F.col("side") == k, F.col("c") * F.col("v"))) / F.sum(F.when(F.col("side") == k, F.col("c")))).alias(f"m{k}") for k in (0, 1)), (F.sum(F.when(F.col("side") == 0, F.col("c") * F.col("v") * F.col("v"))) / F.sum(F.when(F.col("side") == 0, F.col("c")))).alias("s2"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - F.col("m0") * F.col("m0")))
    return out.join(m, "feature").select("feature", "psi", ((F.col("m1") - F.col("m0")) / F.when(sd > 1e-9, sd).otherwise(F.lit(1.0))).alias("mean_shift"))


def rank_by_date(df: DataFrame, by: list[str], score: str, y: str, order: list[str], least: int = 5, relevance: Column | None = None) -> DataFrame:
    """One row for each date with `least` rows or more: ordinal rank correlation, precision and NDCG of the top tenth, returns."""
    every = W.partitionBy(*by)
    asc = lambda c: F.row_number().over(every.orderBy(c, *order)) - 1
    df = df.withColumns({"n_": F.count("*").over(every), "p_": asc(score), "a_": asc(y), "rel_": relevance if relevance is not None else F.lit(1.0)}).filter(F.col("n_") >= least)
    top = F.greatest(F.lit(1), F.ceil(F.col("n_") * 0.1 - 1e-9))
    ideal = F.row_number().over(every.orderBy(F.desc("rel_"), *order)) - 1
    df = df.withColumns({"top_": F.col("p_") >= F.col("n_") - top, "atop_": F.col("a_") >= F.col("n_") - top, "k_": top, "i_": ideal})
    gain = (F.pow(F.lit(2.0), F.col("rel_")) - 1)
    mid = (F.col("n_") - 1) / 2.0
    g = df.groupBy(*by).agg(
        F.max("n_").alias("symbols"), F.sum((F.col("p_") - mid) * (F.col("a_") - mid)).alias("num_"), F.sum((F.col("p_") - mid) * (F.col("p_") - mid)).alias("den_"),
        (F.count_if(F.col("top_") & F.col("atop_")) / F.max("k_")).alias("precision"), F.avg(F.when(F.col("top_"), F.col(y))).alias("top_return"), F.avg(y).alias("mean_return"),
        F.sum(F.when(F.col("top_"), gain / F.log2(F.col("n_") - F.col("p_") + 1.0))).alias("dcg_"), F.sum(F.when(F.col("i_") < F.col("k_"), gain / F.log2(F.col("i_") + 2.0))).alias("idcg_"),
    )
    return g.select(*by, "symbols", (F.col("num_") / F.col("den_")).alias("rank_ic"), "precision", F.coalesce(_div(F.col("dcg_"), F.nullif("idcg_", F.lit(0.0))), F.lit(0.0)).alias("ndcg"), "top_return", "mean_return")


def rank_summary(daily: DataFrame, by: list[str]) -> DataFrame:
    """Mean rank correlation, its ratio to the sample deviation, precision, NDCG and lift over dates."""
    sd = F.stddev_samp("rank_ic")
    return daily.groupBy(*by).agg(
        F.count("*").alias("dates"), F.avg("rank_ic").alias("rank_ic"), F.when(sd > 1e-12, F.avg("rank_ic") / sd).alias("icir"), F.avg("precision").alias("precision"),
        F.avg("ndcg").alias("ndcg"), F.avg("top_return").alias("top_return"), (F.avg("top_return") - F.avg("mean_return")).alias("lift"),
    )


def newey_west(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Mean and 95 % interval with Bartlett weights; groups under eight rows have none.

    Autocovariances join each row with those up to L places later on its place, an equi join.
    """
    every = W.partitionBy(*by)
    d = df.select(*by, value, (F.row_number().over(every.orderBy(order))).alias("at_"), F.avg(value).over(every).alias("m_"), F.count("*").over(every).alias("n_")).withColumn("d_", F.col(value) - F.col("m_"))
    lags = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n_") / 100.0, F.lit(2.0 / 9)) + 1e-12).cast("int"))
    d = d.withColumn("L_", lags)
    left = d.withColumn("lag_", F.explode(F.sequence(F.lit(0), F.col("L_")))).withColumn("to_", F.col("at_") - F.col("lag_"))
    right = d.select(*(F.col(c).alias(f"r_{c}") for c in by), F.col("at_").alias("r_at"), F.col("d_").alias("r_d"))
    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in by] + [F.col("to_") == F.col("r_at")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    weight = F.when(F.col("lag_") == 0, 1.0).otherwise(2 * (1 - F.col("lag_") / (F.col("L_") + 1.0)))
    var = left.join(right, cond).groupBy(*by).agg(F.sum(weight * F.col("d_") * F.col("r_d")).alias("s_"), F.max("n_").alias("n"), F.max("m_").alias("mean"), F.max("L_").alias("lags"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("s_") / F.col("n")) / F.col("n"))
    return var.filter("n >= 8").select(*by, "n", "lags", "mean", (F.col("mean") - 1.96 * se).alias("lower"), (F.col("mean") + 1.96 * se).alias("upper"))


def drawdown(df: DataFrame, by: list[str], ret: str, order: str) -> DataFrame:
    """Final equity of compounded per-cent returns, and the largest fall from a peak in per cent (in date order)."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("eq_", F.exp(F.sum(F.ln(F.greatest(F.lit(0.01), 1 + F.col(ret) / 100))).over(w)))
    d = d.withColumn("pk_", F.greatest(F.lit(1.0), F.max("eq_").over(w)))
    return d.groupBy(*by).agg(F.max_by("eq_", order).alias("equity"), F.max((F.col("pk_") - F.col("eq_")) / F.col("pk_") * 100).alias("max_drawdown_pct"), F.max_by((F.col("pk_") - F.col("eq_")) / F.col("pk_") * 100, F.col(order)).alias("current_drawdown_pct"))


def block_bootstrap(df: DataFrame, by: list[str], block: str, value: str, draws: int = 400, seed: int = 7) -> DataFrame:
    """95 % interval of a mean from resampled blocks.

    Blocks are summed first; a block's count in a draw is Poisson(1) by a hash, which needs no
    order and no driver, and draws are added up side by side in one aggregate each.
    """
    sums = df.groupBy(*by, block).agg(F.sum(value).alias("s_"), F.count(value).alias("c_"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col(block)), F.lit(1 << 30)) / float(1 << 30)
    #: Cumulative probabilities of a Poisson(1) variable.
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    times = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    d = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("t_", times)
    means = d.groupBy(*by, "draw").agg(_div(F.sum(F.col("t_") * F.col("s_")), F.sum(F.col("t_") * F.col("c_"))).alias("m_"))
    return means.groupBy(*by).agg(F.percentile("m_", 0.025).alias("lower"), F.percentile("m_", 0.975).alias("upper"))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, order: list[str]) -> DataFrame:
    """q values: the running minimum of p m / rank from the largest p down."""
    every = W.partitionBy(*by)
    d = df.withColumns({"rank_": F.row_number().over(every.orderBy(p, *order)), "m_": F.count("*").over(every)})
    down = every.orderBy(F.desc("rank_")).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m_") / F.col("rank_")).over(down))).drop("rank_", "m_")


def expected_value(df: DataFrame, by: list[str], cost: float) -> DataFrame:
    """Mean expected value of normalised target, stop and timeout chances."""
    total = F.greatest(F.lit(1e-9), F.col("p_target") + F.col("p_stop") + F.col("p_timeout"))
    ev = (F.col("p_target") * F.col("gain") - F.col("p_stop") * F.col("loss") + F.col("p_timeout") * F.col("drift")) / total - cost
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ev).alias("expected_value"), F.avg((ev > 0).cast("double")).alias("positive_share"))


def long_gate(df: DataFrame, by: list[str], thresholds: tuple[float, ...], p: str, y: str, ret: str) -> DataFrame:
    """Selected rows, hit rate and mean net return above each threshold; one pass, one row for each threshold."""
    d = df.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds)))).filter(F.col(p) >= F.col("threshold") - 1e-9)
    g = d.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("hit_rate"), F.avg(ret).alias("mean_return"))
    return g.withColumn("qualified", (F.col("n") >= 30) & (F.col("hit_rate") >= 0.5) & (F.col("mean_return") > 0))


def bootstrap_draws(spark, blocks: int, samples: int, seed: int) -> DataFrame:
    """sample, slot, at: which block (0 .. blocks - 1) each slot of each sample draws; made from the seed alone."""
    n = F.lit(blocks)
    rows = spark.range(samples * blocks).select(F.floor(F.col("id") / n).cast("long").alias("sample"), (F.col("id") % n).alias("slot"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("slot").cast("string"))
    return rows.withColumn("at", F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % n)


def resampled_blocks(df: DataFrame, block: str, sums: dict[str, Column], statistics: dict[str, Column], samples: int = 400, seed: int = 20260728, least_blocks: int = 5) -> DataFrame:
    """statistic, blocks, samples, low, high: 95 % intervals from resampling whole blocks (dates) with replacement.

    Rows are summed by block first, so a sample draws sums, not rows: as many draws as samples x blocks, whatever the rows. `sums` are columns of
    rows, `statistics` expressions over their names; samples where a statistic is null don't count, and at least 20 and a quarter must. Empty
    with fewer than `least_blocks` blocks.
    """
    whole = df.filter(F.col(block).isNotNull()).groupBy(block).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    whole = whole.withColumn("at", F.row_number().over(W.orderBy(block)) - 1)  # one row a block
    n = whole.count()
    drawn = bootstrap_draws(df.sparkSession, n, samples if n >= least_blocks else 0, seed).join(whole, "at").groupBy("sample").agg(*(F.sum(c).alias(c) for c in sums))
    values = drawn.select(F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), e.cast("double").alias("value")) for s, e in statistics.items()))).alias("x")).select("x.*").filter("value is not null and not isnan(value)")
    by = W.partitionBy("statistic")  # one row a sample
    values = values.withColumns({"i_": F.row_number().over(by.orderBy("value")) - 1, "n_": F.count("*").over(by)})
    at = lambda q: F.max(F.when(F.col("i_") == F.least(F.col("n_") - 1, F.floor(F.col("n_") * q)), F.col("value")))
    g = values.groupBy("statistic").agg(F.lit(n).alias("blocks"), F.count("*").alias("samples"), at(0.025).alias("low"), at(0.975).alias("high"))
    return g.filter(F.col("samples") >= max(20, samples // 4))
