"""Learners on MLlib and what surrounds them: feature vectors, purged out-of-fold predictions, pruning, ranking and risk heads.

Every fit is a distributed MLlib fit over a window of rows; scores are columns. Of models only tables of
the size of the model reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.functions.series import pearson

W = Window
VECTOR = "features_"


@dataclass(frozen=True)
class Learner:
    """A kind of model, its label and how it is set."""

    kind: str
    label: str
    options: dict = field(default_factory=dict)

    def estimator(self):
        common = {"featuresCol": VECTOR, "labelCol": self.label, "predictionCol": "prediction_", **({"weightCol": "weight_"})}
        classes = {"probabilityCol": "probability_", "rawPredictionCol": "raw_"}
        if self.kind == "ridge":
            return LinearRegression(**common, **({"regParam": 0.1, "elasticNetParam": 0.0} | self.options))
        if self.kind == "logistic":
            return LogisticRegression(**common, **classes, **({"regParam": 0.02, "elasticNetParam": 0.2, "maxIter": 40} | self.options))
        if self.kind == "multinomial":
            return LogisticRegression(**common, **classes, family="multinomial", **({"regParam": 0.02, "maxIter": 40} | self.options))
        if self.kind == "forest":
            return RandomForestClassifier(**common, **classes, seed=1, **({"numTrees": 24, "maxDepth": 5, "subsamplingRate": 0.7} | self.options))
        if self.kind == "boosted":
            found = GBTClassifier(**common, seed=1, **({"maxIter": 15, "maxDepth": 3, "stepSize": 0.2} | self.options))
            return found.setProbabilityCol(classes["probabilityCol"]).setRawPredictionCol(classes["rawPredictionCol"])
        if self.kind == "boosted_return":
            return GBTRegressor(**common, seed=1, **({"maxIter": 15, "maxDepth": 3, "stepSize": 0.2} | self.options))
        raise ValueError(f"unknown kind of learner: {self.kind}")


#: The base learners of a horizon. Rankers and quantile trees have no counterpart in MLlib.
BASE = {
    "ridge_return": Learner("ridge", "label"), "elastic_up": Learner("logistic", "up"), "outcome": Learner("multinomial", "path"), "forest_up": Learner("forest", "up"), "boosted_up": Learner("boosted", "up"), "boosted_return": Learner("boosted_return", "label"),
}


def fit(train: DataFrame, features: list[str], learner: Learner, weight: str | None = None) -> PipelineModel:
    """A standardised vector of the features and the model on it; rows with a null feature or label are left out."""
    rows = train.filter(F.col(learner.label).isNotNull()).withColumn("weight_", F.greatest(F.lit(0.05), F.col(weight)) if weight else F.lit(1.0))
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features_", handleInvalid="skip"), StandardScaler(inputCol="raw_features_", outputCol=VECTOR, withMean=True), learner.estimator()]
    return Pipeline(stages=stages).fit(rows)


def scores(model: PipelineModel, rows: DataFrame, learner: Learner, name: str) -> DataFrame:
    """rows with the model's score: a prediction, the probability of class 1, or for a path one probability a class (name_0, name_1, ..)."""
    out = model.transform(rows)
    if learner.kind in ("ridge", "boosted_return"):
        out = out.withColumn(name, F.col("prediction_"))
    elif learner.kind == "multinomial":
        p = vector_to_array("probability_")
        out = out.withColumns({f"{name}_{i}": p[i] for i in range(model.stages[-1].numClasses)})
    else:
        out = out.withColumn(name, clamp(vector_to_array("probability_")[1], 0.001, 0.999))
    return out.select(*rows.columns, *(c for c in out.columns if c == name or c.startswith(f"{name}_")))


#: Rows of a task that a fit reads.
FIT_ROWS = 250_000


def for_fits(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows, kept (they spill to disk) in a part for each FIT_ROWS of them, at least one a core; key tells rows apart.

    Boosting runs hundreds of stages, and each task of each stage sends its report to the driver; left to shuffle
    partitions, few rows are read by many tasks. Trees draw their candidate splits by part and place, so rows stand in
    order: reruns agree, whatever the shuffle partitions.
    """
    whole = df.persist()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-whole.count() // FIT_ROWS))
    out = whole.repartition(parts, *key).sortWithinPartitions(*key).persist()
    out.count()
    whole.unpersist()
    return out


def out_of_fold(df: DataFrame, features: list[str], learners: dict[str, Learner], fold: str = "fold", part: str = "part", weight: str | None = None) -> DataFrame:
    """Test rows of every fold (rows with fold and part: train or test) with the scores of models that saw only the fold's training rows."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):  # a handful of folds
        rows = df.filter(F.col(fold) == k)
        train, test = rows.filter(F.col(part) == "train"), rows.filter(F.col(part) == "test")
        for name, learner in learners.items():
            test = scores(fit(train, features, learner, weight), test, learner, name)
        out = test if out is None else out.unionByName(test, allowMissingColumns=True)
    return out


def assemble(oof: DataFrame, by: list[str], target: str, stop: str, timeout: str, rank: str, low: str, middle: str, high: str, goal: Column | float) -> DataFrame:
    """Scores of several models on one scale.

    Path probabilities are held within 0 and 1 and sum to 1; the quantiles become the probability of reaching `goal` (piecewise linear
    between 10, 50 and 90 %, in order); the ranker's score becomes its place among the rows of the date.
    """
    goal = goal if isinstance(goal, Column) else F.lit(goal)
    p = [clamp(c, 1e-6, 1.0) for c in (target, stop, timeout)]
    total = p[0] + p[1] + p[2]
    q = F.array_sort(F.array(low, middle, high))
    at = lambda a, b, from_, to: from_ + (goal - a) / F.greatest(F.lit(1e-9), b - a) * (to - from_)
    below = F.when(goal <= q[0], F.lit(0.1)).when(goal <= q[1], at(q[0], q[1], 0.1, 0.5)).when(goal <= q[2], at(q[1], q[2], 0.5, 0.9)).otherwise(F.lit(0.9))
    every = W.partitionBy(*by)
    n = F.count(rank).over(every)
    ties = F.count("*").over(W.partitionBy(*by, rank))
    place = (F.rank().over(every.orderBy(rank)) + (ties - 1) / 2.0 - 0.5) / n
    return oof.withColumns({"p_target": p[0] / total, "p_stop": p[1] / total, "p_timeout": p[2] / total, "p_quantile": 1 - below, "p_rank": place})


def _value(name: str) -> Column:
    return F.coalesce(clamp(name, 0.001, 0.999), F.lit(0.5))


def model_skill(df: DataFrame, names: list[str], y: str, weight: str) -> DataFrame:
    """Weighted Brier score of each model against that of the weighted base rate; kept: no worse than it (the best one, if none is)."""
    w, a = F.greatest(F.lit(0.05), F.coalesce(F.col(weight), F.lit(1.0))), F.col(y).cast("double")
    one = df.agg(F.sum(w).alias("w"), F.sum(w * a).alias("wy"), F.sum(w * a * a).alias("wyy"), *(F.sum(w * (_value(n) - a) ** 2).alias(f"b{i}") for i, n in enumerate(names)))
    base = F.col("wyy") / F.col("w") - (F.col("wy") / F.col("w")) ** 2
    rows = one.select(base.alias("baseline"), F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.lit(i).alias("at"), (F.col(f"b{i}") / F.col("w")).alias("brier")) for i, n in enumerate(names)))).alias("x")).select("baseline", "x.*")
    good = F.col("brier") <= F.col("baseline") + 1e-9
    every = W.partitionBy()  # one row a model
    best = F.row_number().over(every.orderBy("brier", "at")) == 1
    return rows.withColumn("kept", good | ((F.max(good.cast("int")).over(every) == 0) & best)).drop("at")


def prune(df: DataFrame, names: list[str], y: str, weight: str, threshold: float = 0.8) -> tuple[list[str], list[tuple[str, str, float]]]:
    """(kept names, dropped (model, because of, residual correlation)): of two models whose residuals correlate beyond the threshold the worse goes, while more than three stay.

    All correlations and Brier scores come from one aggregate.
    """
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    residual = lambda i: _value(names[i]) - F.col(y)
    w = F.greatest(F.lit(0.05), F.coalesce(F.col(weight), F.lit(1.0)))
    row = df.agg(*(pearson(residual(i), residual(j)).alias(f"c{i}_{j}") for i, j in pairs), *(F.sum(w * residual(i) ** 2).alias(f"b{i}") for i in range(len(names)))).first()
    kept, dropped = list(range(len(names))), []
    while len(kept) > 3:
        over = next(((i, j) for i, j in pairs if i in kept and j in kept and abs(row[f"c{i}_{j}"]) > threshold), None)
        if over is None:
            break
        i, j = over
        gone, stays = (j, i) if row[f"b{i}"] <= row[f"b{j}"] else (i, j)
        kept.remove(gone)
        dropped.append((names[gone], names[stays], row[f"c{i}_{j}"]))
    return [names[i] for i in kept], dropped


#: Blends of percentile components (fixed values).
BLENDS = {
    "rank-only": {"rank": 1.0}, "rank-direction": {"rank": 0.55, "direction": 0.45}, "rank-direction-path": {"rank": 0.45, "direction": 0.35, "target": 0.10, "path_safety": 0.10},
    "risk-adjusted": {"rank": 0.40, "direction": 0.30, "target": 0.10, "stop_safety": 0.15, "liquidity": 0.05}, "return-aware": {"rank": 0.35, "direction": 0.30, "path_safety": 0.10, "median": 0.15, "return": 0.10},
}


#: Rows of a task that ranks the rows of dates.
DATE_ROWS = 100_000


def by_dates(df: DataFrame, date: str) -> DataFrame:
    """The rows dealt by ranges of dates, about DATE_ROWS a task (a date is never parted).

    A task that ranks several columns holds a sort for each; left to shuffle partitions or their size in
    bytes, its rows and so its memory grow with the table.
    """
    return df.repartitionByRange(max(1, math.ceil(df.count() / DATE_ROWS)), date)


def percentiles(df: DataFrame, date: str, components: list[str]) -> DataFrame:
    """pct_<component>: its place in [0, 1] among the rows of the date, ties at their mean; 0.5 for a single row."""
    n = F.count("*").over(W.partitionBy(date))

    def place(c: str) -> Column:
        ties = F.count("*").over(W.partitionBy(date, c))
        return F.when(n > 1, (F.rank().over(W.partitionBy(date).orderBy(c)) - 1 + (ties - 1) / 2.0) / (n - 1)).otherwise(F.lit(0.5))

    return by_dates(df, date).withColumns({f"pct_{c}": place(c) for c in components})


def _placed(df: DataFrame, date: str, columns: list[str], tie: list[str], blends: dict[str, dict[str, float]]) -> DataFrame:
    """columns and blend for every row and blend of percentiles, with its place at_ among the n_ rows of the date."""
    rows = list(dict.fromkeys([date, *columns, *tie]))
    scored = df.select(*rows, F.explode(F.array(*(F.struct(F.lit(name).alias("blend"), sum((F.col(f"pct_{c}") * (v / sum(parts.values())) for c, v in parts.items()), F.lit(0.0)).alias("score")) for name, parts in blends.items()))).alias("x")).select(*rows, "x.*")
    by = W.partitionBy("blend", date)
    return scored.withColumns({"at_": F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), *tie)), "n_": F.count("*").over(by)})


def _measures(y: str, direction: str, top: int, counts: Column) -> dict[str, Column]:
    """Aggregates over the placed rows that count."""
    tenth = counts & (F.col("at_") <= F.ceil(F.col("n_") * 0.1))
    first = counts & (F.col("at_") <= top)
    top_return = F.avg(F.when(tenth, F.col(y)))
    return {"top_direction_pct": 100 * F.avg(F.when(first, F.col(direction).cast("double"))), "top_return": top_return, "lift": top_return - F.avg(F.when(counts, F.col(y)))}


def _judged(g: DataFrame) -> DataFrame:
    """One row a blend with objective, admissible and selected."""
    base = lambda c: F.max(F.when(F.col("blend") == "rank-only", F.col(c))).over(W.partitionBy())  # noqa: E731, one row a blend
    d_gain, r_gain, l_gain = (F.col(c) - base(c) for c in ("top_direction_pct", "top_return", "lift"))
    admissible = (F.col("blend") == "rank-only") | ((d_gain >= 0.5) & (r_gain >= -0.02) & (l_gain >= -0.02)) | ((r_gain >= 0.05) & (d_gain >= 0) & (l_gain >= 0.03))
    g = g.withColumn("objective", (F.col("top_direction_pct") - 50) * 0.2 + F.col("lift") * 1.5 + F.col("top_return") * 0.5).withColumn("admissible", admissible)
    best = F.row_number().over(W.partitionBy().orderBy(F.desc("admissible"), F.desc(F.round("objective", 9)), "blend")) == 1
    return g.withColumn("selected", best)


def blend_metrics(df: DataFrame, date: str, y: str, direction: str, tie: list[str], blends: dict[str, dict[str, float]] = BLENDS, top: int = 10) -> DataFrame:
    """One row for each blend of percentiles: how its daily top rows do.

    top_direction_pct over the `top` rows of each date, top_decile return and its lift over all rows; admissible blends gain on rank-only in
    direction or in return without losing much of the other; the selected one has the best objective among them.
    """
    found = _measures(y, direction, top, F.lit(True))
    return _judged(_placed(df, date, [y, direction], tie, blends).groupBy("blend").agg(*(v.alias(c) for c, v in found.items())))


def inner_block(df: DataFrame, date: str, first_test: float = 0.8, first_inner: float = 0.6, purge: int = 5) -> DataFrame:
    """part: inner for the dates on which a choice is made, test for those on which it is judged; `purge` dates between them are left out.

    A date's rows stay together, so what is ranked by date may be ranked after this, over fewer rows.
    """
    dates = df.select(date).distinct().withColumn("i_", F.row_number().over(W.orderBy(date)) - 1)  # one row a date
    n = F.count("*").over(W.partitionBy())
    a, b = F.floor(n * first_inner), F.floor(n * first_test)
    part = F.when(F.col("i_") >= b, "test").when((F.col("i_") >= a) & (F.col("i_") < b - purge), "inner")
    return df.join(dates.withColumn("part", part).filter("part is not null").select(date, "part"), date)


def chosen_blend(df: DataFrame, date: str, y: str, direction: str, tie: list[str], blends: dict[str, dict[str, float]] = BLENDS, top: int = 10, purge: int = 5) -> DataFrame:
    """blend_metrics() of the inner block with what the blends do on the test dates (test_<metric>), whose outcomes no choice has seen."""
    return blends_of_parts(inner_block(df, date, purge=purge), date, y, direction, tie, blends, top)


def blends_of_parts(parts: DataFrame, date: str, y: str, direction: str, tie: list[str], blends: dict[str, dict[str, float]] = BLENDS, top: int = 10) -> DataFrame:
    """As chosen_blend(), of rows that have their part; both parts are ranked in one pass."""
    inner, test = (_measures(y, direction, top, F.col("part") == p) for p in ("inner", "test"))
    both = _placed(parts, date, [y, direction, "part"], tie, blends).groupBy("blend").agg(F.count(F.when(F.col("part") == "inner", 1)).alias("rows_"), *(v.alias(c) for c, v in inner.items()), *(v.alias(f"test_{c}") for c, v in test.items()))
    return _judged(both.filter("rows_ > 0").drop("rows_"))


def lower_by_risk(score: Column | str, risk: Column | str, base: float, strength: float = 0.5) -> Column:
    """A score less what a false positive's probability beyond its base rate takes off; it is never raised."""
    score, risk = (F.col(x) if isinstance(x, str) else x for x in (score, risk))
    return score * (1 - strength * clamp((risk - base) / max(1e-9, 1 - base), 0.0, 1.0))


def risk_head(train: DataFrame, rows: DataFrame, features: list[str], score: str, y: str, least: float = 0.5) -> DataFrame:
    """rows with risk (probability that an accepted signal is false, by a logistic model of the accepted training rows) and adjusted, the score lowered by it."""
    accepted = train.filter(F.col(score) >= least).withColumn("false_", (F.col(y) == 0).cast("double"))
    base = accepted.agg(F.avg("false_")).first()[0]
    if base is None or base in (0.0, 1.0):
        return rows.withColumns({"risk": F.lit(base).cast("double"), "adjusted": F.col(score)})
    learner = Learner("logistic", "false_", {"regParam": 0.1, "elasticNetParam": 0.0})
    out = scores(fit(accepted, [*features, score], learner), rows, learner, "risk")
    return out.withColumn("adjusted", F.when(F.col(score) >= least, lower_by_risk(score, "risk", base)).otherwise(F.col(score)))


def event_expert(train: DataFrame, rows: DataFrame, features: list[str], coverage: str, y: str, least_share: float = 0.1, least_rows: int = 2000, least_hits: int = 200) -> DataFrame | None:
    """rows with event_score from a logistic model of the covered training rows, null where a row is not covered; None if too few are."""
    covered = train.filter(F.col(coverage) > 0)
    n, hits = covered.agg(F.count("*"), F.sum(y)).first()
    if n < least_rows or n < least_share * train.count() or (hits or 0) < least_hits:
        return None
    learner = Learner("logistic", y, {"regParam": 0.14, "elasticNetParam": 0.0})
    out = scores(fit(covered, features, learner), rows, learner, "event_score")
    return out.withColumn("event_score", F.when(F.col(coverage) > 0, F.col("event_score")))


def tree_importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features of a tree model by their share of its impurity gains."""
    found = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, found), strict=True), key=lambda x: (-x[1], x[0]))
