"""Evidence on models and signals: outcomes, reliability, regimes, roll-ups, live scores, sessions and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import MARKETS, clamp, number, wilson
from tidemark.functions.series import pearson
from tidemark.operators.bars import latest_by

W = Window
#: Two-sided 95 %.
Z95 = 1.959963984540054
#: Regimes in the order in which they are tested (fixed values).
REGIMES = ("low_coverage", "volatile", "overextended", "uptrend", "downtrend", "volume_breakout", "range")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def barrier_summary(df: DataFrame, by: list[str], label: str = "barrier_label") -> DataFrame:
    """Counts and rates in per cent of target, stop and timeout outcomes."""
    share = lambda c: 100 * F.avg(c.cast("double"))
    c = F.coalesce(label, F.lit("unknown"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c == x).alias(x) for x in ("target", "stop")), F.count_if(F.startswith(c, F.lit("timeout"))).alias("timeout"),
                               share(c == "target").alias("target_rate"), share(c == "stop").alias("stop_rate"), share(F.startswith(c, F.lit("timeout"))).alias("timeout_rate"))


def no_trade_diagnostics(df: DataFrame, by: list[str], least: float = 0.55, most: float = 0.62) -> DataFrame:
    """Rows that a gate would refuse (target_probability below least, stop_probability from most on, or resolved as a stop), and how both sides fared."""
    flagged = (number("target_probability") < least) | (number("stop_probability") >= most) | F.coalesce(F.col("barrier_label") == "stop", F.lit(False))
    pct = lambda c: 100 * F.avg(c.cast("double"))
    return df.withColumn("flag_", flagged).groupBy(*by).agg(F.count("*").alias("n"), F.count_if("flag_").alias("flagged"), F.count_if(~F.col("flag_")).alias("tradable"), pct(F.when(F.col("flag_"), F.col("stop_label"))).alias("flagged_stop_rate"), pct(F.when(~F.col("flag_"), F.col("target_label"))).alias("tradable_target_rate"))


def newest_by_signature(df: DataFrame, signature: list[str], at: str, tie: list[str]) -> DataFrame:
    """Of events with one signature the newest."""
    return latest_by(df, signature, [F.desc(at), *tie])


def evidence_metrics(df: DataFrame, by: list[str], key: list[str], order: list[str]) -> DataFrame:
    """Classification evidence of resolved predictions (probability, outcome), each key once, the first in order.

    Confusion, accuracies with a 95 % Wilson interval, Brier skill against the base rate, expected calibration error over
    ten bins, and the accuracy of the top decile. Ranks count rows by probability, so ties at the decile's edge share it.
    """
    once = latest_by(df.filter(F.col("outcome").isNotNull() & F.col("probability").isNotNull()), [*by, *key], [F.col(c) for c in order])
    d = once.select(*by, F.col("probability").alias("p"), (F.col("outcome") >= 0).cast("double").alias("y"))
    bins = d.withColumn("b_", F.least(F.lit(9), F.floor(F.col("p") * 10))).groupBy(*by, "b_").agg(F.count("*").alias("n_"), F.sum("p").alias("p_"), F.sum("y").alias("y_"))
    ece = bins.groupBy(*by).agg((F.sum(F.abs(F.col("p_") - F.col("y_"))) / F.sum("n_") * 100).alias("ece_pct"))
    hit = lambda a, b: F.count_if(a & b)
    up, yes = F.col("p") >= 0.5, F.col("y") == 1
    g = d.groupBy(*by).agg(F.count("*").alias("n"), hit(up, yes).alias("tp"), hit(~up, ~yes).alias("tn"), hit(up, ~yes).alias("fp"), hit(~up, yes).alias("fn"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.var_pop("y").alias("base_"))
    levels = d.groupBy(*by, "p").agg(F.count("*").alias("c_"), F.sum("y").alias("s_")).join(g.select(*by, F.ceil(F.col("n") * 0.1).alias("k_")), by)
    taken = F.greatest(F.lit(0), F.least(F.col("c_"), F.col("k_") - F.col("over_")))
    levels = levels.withColumn("over_", F.coalesce(F.sum("c_").over(W.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    top = levels.groupBy(*by).agg((100 * F.sum(taken * F.col("s_") / F.col("c_")) / F.max("k_")).alias("top_decile_pct"))
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = per(F.col("tp"), F.col("tp") + F.col("fp")), per(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = (F.col("tp") + F.col("tn")) / F.col("n")
    low, high = wilson(accuracy, F.col("n").cast("double"), Z95)
    out = g.join(ece, by).join(top, by)
    return out.select(*by, "n", "tp", "tn", "fp", "fn", (accuracy * 100).alias("accuracy_pct"), ((recall + per(F.col("tn"), F.col("tn") + F.col("fp"))) * 50).alias("balanced_pct"), (precision * 100).alias("precision_pct"), (recall * 100).alias("recall_pct"),
                      (per(2 * precision * recall, precision + recall) * 100).alias("f1_pct"), "brier", F.when(F.col("base_") > 0, 1 - F.col("brier") / F.col("base_")).alias("brier_skill"), "ece_pct", "top_decile_pct", (low * 100).alias("accuracy_low"), (high * 100).alias("accuracy_high"))


def split_overlap(df: DataFrame, part: str, date: str) -> DataFrame:
    """Dates that two parts of a split share: none, if the split is sound."""
    parts = ("train", "validation", "test")
    d = df.groupBy(date).agg(*(F.bool_or(F.col(part) == p).alias(p) for p in parts))
    both = lambda a, b: F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}")
    return d.agg(*(F.count_if(p).alias(f"{p}_dates") for p in parts), both("train", "validation"), both("train", "test"), both("validation", "test"))


def regime_bucket(trend="trend_score", momentum="momentum_score", risk="risk_score", change5="change5", change20="change20", volume_ratio="volume_ratio", rsi="rsi", coverage: Column | str = "coverage") -> Column:
    """The regime of a row by what is visible on its day; the first rule that fits."""
    t, m, r, c5, c20, v, s, c = (number(_c(x), d) for x, d in ((trend, 50.0), (momentum, 50.0), (risk, 50.0), (change5, 0.0), (change20, 0.0), (volume_ratio, 1.0), (rsi, 50.0), (coverage, 100.0)))
    rules = (c < 40, (r < 48) | (F.abs(c5) >= 8) | (v >= 3.2), (s >= 72) | ((c5 >= 6) & (t >= 60)), (t >= 62) & (m >= 56) & (c20 >= 2), (t <= 42) & (c20 <= -2), (v >= 1.35) & (c5 >= 0) & (m >= 52))
    out = F.lit(REGIMES[-1])
    for name, rule in reversed(list(zip(REGIMES, rules, strict=False))):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def _agrees(predicted: str, actual: str) -> Column:
    return ((F.col(predicted) >= 0) == (F.col(actual) >= 0)).cast("double")


def regime_calibration(df: DataFrame, by: list[str], regime: str = "regime", weight: str = "weight") -> DataFrame:
    """Weighted hit rates, returns and a score in [-12, 12] of each regime; rank 1 holds most samples."""
    w = F.col(weight)
    mean = lambda c: F.sum(w * c) / F.sum(w)
    rate = lambda c: 100 * mean(F.col(c).cast("double"))
    g = df.groupBy(*by, regime).agg(F.count("*").alias("n"), F.sum(w).alias("effective"), F.count_if("buy_signal").alias("buys"), (100 * mean(_agrees("predicted_return", "actual_return"))).alias("direction_rate"), rate("target_wins").alias("target_rate"), rate("stop_wins").alias("stop_rate"), mean(F.col("actual_return")).alias("mean_return"))
    score = clamp((F.col("target_rate") - 52) / 3.5 + F.col("mean_return") * 0.25 - F.col("stop_rate") * 0.04, -12.0, 12.0)
    return g.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("effective"), regime)))


def statistical_reliability(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Score and status of a backtest from weighted Wilson bounds (90 %): direction of all rows, target and stop of accepted signals (of all rows, if there are none)."""
    signals = df.withColumn("any_", F.max(F.col("buy_signal").cast("int")).over(W.partitionBy(*by)))
    trade = (F.col("any_") == 0) | F.col("buy_signal")
    w = F.greatest(F.col(weight), F.lit(0.0))
    tw = F.when(trade, w)
    g = signals.groupBy(*by).agg(
        F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * _agrees("predicted_return", "actual_return")).alias("d"), F.sum(tw).alias("tw"), F.sum(tw * tw).alias("tww"),
        F.sum(tw * F.col("target_wins").cast("double")).alias("t"), F.sum(tw * F.col("stop_wins").cast("double")).alias("s"), (F.max("any_") == 1).alias("accepted_only"),
    )
    n, tn = F.col("w") * F.col("w") / F.col("ww"), F.col("tw") * F.col("tw") / F.col("tww")
    (dl, _), (tl, tu), (_, su) = (wilson(F.col(c) / F.col(total), size) for c, total, size in (("d", "w", n), ("t", "tw", tn), ("s", "tw", tn)))
    g = g.select(*by, "accepted_only", tn.alias("effective"), (tl * 100).alias("target_low"), (dl * 100).alias("direction_low"), (su * 100).alias("stop_high"), ((tu - tl) * 50).alias("margin"))
    short = lambda x, k: F.greatest(F.lit(0.0), x) * k
    c = F.col
    score = clamp(100 - short(55 - c("target_low"), 1.25) - short(52 - c("direction_low"), 0.8) - short(c("stop_high") - 52, 0.9) - short(14 - c("effective"), 2.15) - short(c("margin") - 16, 0.75), 0.0, 100.0)
    status = (
        F.when(c("effective") < 10, "collecting").when((c("target_low") >= 58) & (c("direction_low") >= 53) & (c("stop_high") <= 48), "strong")
        .when((c("target_low") < 50) | (c("stop_high") > 58), "weak_lower_bound").when(c("margin") >= 20, "wide_interval").otherwise("usable")
    )
    return g.withColumns({"score": score, "status": status})


#: Statuses of reliability from the weakest to the strongest.
STATUSES = ("weak_lower_bound", "collecting", "wide_interval", "usable", "strong")


def roll_up(df: DataFrame, by: list[str], values: list[str], samples: str = "samples", status: str = "status") -> DataFrame:
    """Symbols' results together: means weighted by samples (1 at least), and the weakest status."""
    n = F.greatest(F.col(samples), F.lit(1))
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status))
    g = df.groupBy(*by).agg(F.count("*").alias("symbols"), F.sum(n).alias("samples"), *((F.sum(F.col(v) * n) / F.sum(n)).alias(v) for v in values), F.min(place).alias("at_"))
    return g.withColumn("weakest", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("at_").cast("int"))).drop("at_")


def roll_up_weights(df: DataFrame, by: list[str], method: str = "method", weight: str = "weight", samples: str = "samples", improvement: str = "improvement_pct", lift: str = "lift_pct") -> DataFrame:
    """Method weights of many symbols as one set that sums to 1: by samples, and more where the holdout improved."""
    quality = 1 + F.greatest(F.lit(0.0), F.col(improvement)) / 100 + F.greatest(F.lit(0.0), F.col(lift)) / 100
    g = df.groupBy(*by, method).agg(F.greatest(F.lit(0.0), F.sum(F.col(weight) * F.greatest(F.col(samples), F.lit(1)) * quality)).alias("w_"))
    return g.select(*by, method, (F.col("w_") / F.nullif(F.sum("w_").over(W.partitionBy(*by)), F.lit(0.0))).alias("weight"))


def date_features(df: DataFrame, date: str, features: list[str], label: str = "label") -> DataFrame:
    """One row a date: mean features, up (whether the median label is above 0) and a weight that grows to 1 at 50 rows."""
    return df.groupBy(date).agg(*(F.avg(f).alias(f) for f in features), F.count("*").alias("n"), (F.percentile(label, 0.5) > 0).cast("int").alias("up"), F.least(F.lit(1.0), F.count("*") / 50).alias("weight"))


def importance(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Point-biserial importance: |correlation| with the label as a share of all, and its sign."""
    one = df.agg(*(pearson(F.col(f).cast("double"), F.col(y).cast("double")).alias(f"c{i}") for i, f in enumerate(features)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("r")) for i, f in enumerate(features)))).alias("x")).select("x.*")
    total = F.sum(F.abs("r")).over(W.partitionBy())  # one row a feature
    return rows.select("feature", F.coalesce(F.try_divide(F.abs("r"), F.nullif(total, F.lit(0.0))), F.lit(0.0)).alias("importance"), F.when(F.col("r") >= 0, 1).otherwise(-1).alias("direction"))


def completed_session(at: Column | str, market: Column | str) -> Column:
    """The last trading day of a market that has closed by a time (UTC); weekends count back to Friday."""
    at, market = _c(at), _c(market)
    out = F.lit(None).cast("date")
    for name, (zone, minutes, _) in MARKETS.items():
        local = F.from_utc_timestamp(at, zone)
        closed = F.hour(local) * 60 + F.minute(local) >= minutes
        last = F.date_sub(F.to_date(local), F.when(closed, 0).otherwise(1))
        back = F.when(F.dayofweek(last) == 1, 2).when(F.dayofweek(last) == 7, 1).otherwise(0)
        out = F.when(market == name, F.date_sub(last, back)).otherwise(out)
    return out


def merge_quotes(candles: DataFrame, quotes: DataFrame, today: Column) -> DataFrame:
    """Candles (symbol, day, open, high, low, close, volume) and the newest good quote of each symbol and day (price, at, time_verified).

    Quotes of weekends, of days to come or of no verified time change nothing. A quote moves its day's close and widens
    its range; on a day without a candle it is one.
    """
    fine = F.col("time_verified") & (F.col("price") > 0) & ~F.dayofweek("day").isin(1, 7) & (F.col("day") <= today)
    newest = latest_by(quotes.filter(fine), ["symbol", "day"], [F.desc("at"), F.desc("price")]).select("symbol", "day", "price")
    both = candles.join(newest, ["symbol", "day"], "full")
    p = F.col("price")
    return both.select("symbol", "day", F.coalesce("open", p).alias("open"), F.greatest("high", p).alias("high"), F.least("low", p).alias("low"), F.coalesce(p, F.col("close")).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), p.isNotNull().alias("overlaid"))


#: Live factors: name -> scale of the input (fixed values); all are held within 10.
def lab_factors() -> dict[str, Column]:
    c = F.col
    raw = {
        "momentum_5": c("change5"), "momentum_20": c("change20") * 0.5, "reversal_5": -c("change5"), "volatility_10": 4 - c("volatility") * 2, "volume_ratio_20": (c("volume_ratio") - 1) * 8,
        "trend_gap_20": (c("close") - c("sma20")) / c("sma20") * 70, "vwap_gap": c("vwap_gap_pct"), "range_position": (c("range_position") - 0.5) * 20,
    }
    return {name: clamp(value, -10.0, 10.0) for name, value in raw.items()}


def lab_scores(df: DataFrame, weights: dict[str, float], research: dict[str, float]) -> DataFrame:
    """layer_score (factors by weight over the mean weight), research_score (by shares of the user's weights), and their sum within 25."""
    factors = lab_factors()
    mean = sum(weights.values()) / len(weights)
    total = sum(research.values())
    layer = sum((factors[n] * (w / mean) for n, w in weights.items()), F.lit(0.0))
    other = sum((factors[n] * (w / total) for n, w in research.items()), F.lit(0.0))
    return df.withColumns({"layer_score": layer, "research_score": other}).withColumn("factor_score", clamp(F.col("layer_score") + F.col("research_score"), -25.0, 25.0))


def micro_tuning(predicted: str = "predicted_return", actual: str = "actual_return", drawdown: str = "max_drawdown", missed: Column | str = "missed", adverse: Column | str = "adverse") -> Column:
    """How far one resolved forecast moves its model: 0.02 to 0.22, more for larger and worse misses."""
    severity = _c(missed).cast("double") + 0.6 * _c(adverse).cast("double") + F.greatest(F.lit(0.0), -F.col(actual)) / 8 + F.greatest(F.lit(0.0), -F.col(drawdown)) / 12
    return clamp(0.02 + F.abs(F.col(predicted) - F.col(actual)) * 0.012 + severity * 0.035, 0.02, 0.22)


def agent_bias(best: Column | str, previous: Column | str) -> tuple[Column, Column]:
    """(aggressiveness, confidence bias) of an agent from its best replay score."""
    return clamp(0.7 + F.greatest(F.lit(0.0), _c(best)) / 38, 0.55, 1.45), clamp(_c(previous) + _c(best) * 0.012, -5.0, 5.0)


def downside_confidence(df: DataFrame, by: list[str], drawdown: str = "max_drawdown", stop: str = "stop_loss", shrink: str = "shrink", stop_risk: str = "stop_risk_pct", agreement: str = "agreement_pct") -> DataFrame:
    """The largest fall to reckon with, from the falls of analogous paths, and how sure of it one may be (0 to 92).

    projected: mean and 75 % quantile of the falls (nearest rank) in equal parts, shrunk, at most 1.22 times the stop. The probability
    rises with the share of paths that fell as far, with the stop risk and with the models' agreement.
    """
    given = (stop, shrink, stop_risk, agreement)
    counted = df.groupBy(*by, F.greatest(F.lit(0.0), -F.col(drawdown)).alias("fall_")).agg(F.count("*").alias("c_"), F.count(drawdown).alias("known_"), *(F.max(c).alias(c) for c in given))
    group = Window.partitionBy(*by)  # one row a distinct fall
    d = counted.withColumns({"n_": F.sum("c_").over(group), "upto_": F.sum("c_").over(group.orderBy("fall_")), **{c: F.max(c).over(group) for c in given}})
    d = d.withColumns({"high_": F.min(F.when(F.col("upto_") >= F.ceil(F.col("n_") * 0.75), F.col("fall_"))).over(group), "mean_": F.sum(F.col("fall_") * F.col("c_")).over(group) / F.col("n_")})
    d = d.withColumn("projected_downside", F.least((F.col("mean_") + F.col("high_")) / 2 * F.col(shrink), F.col(stop) * 1.22))
    g = d.groupBy(*by).agg(F.sum("known_").alias("paths"), (F.sum(F.when(F.col("fall_") >= F.col("projected_downside"), F.col("c_")).otherwise(0)) / F.max("n_")).alias("reached_"), *(F.max(c).alias(c) for c in (*given, "projected_downside")))
    return g.withColumn("probability", clamp(30 + F.col("reached_") * 40 + F.col(stop_risk) * 0.2 + (F.col(agreement) - 50) * 0.1, 0.0, 92.0)).drop("reached_")


def trajectory(df: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """A model's events in order of time, each value with what it was before and its change."""
    w = W.partitionBy(*by).orderBy(at)
    return df.withColumns({f"{v}_before": F.lag(v).over(w) for v in values}).withColumns({f"{v}_impact": F.col(v) - F.col(f"{v}_before") for v in values})


#: Words that tell a model's family from its name, in the order in which they are tested (fixed values).
FAMILIES = {"deep": "lstm|gru|transformer|cnn|neural", "tree": "forest|boost|tree|gbm", "ensemble": "ensemble|stack|blend", "linear": "ridge|logistic|linear|lasso", "baseline": "momentum|naive|mean"}


def model_family(name: Column | str) -> Column:
    out = F.lit("other")
    for family, words in reversed(FAMILIES.items()):
        out = F.when(F.lower(_c(name)).rlike(words), F.lit(family)).otherwise(out)
    return out
