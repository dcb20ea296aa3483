"""Formulaic alphas: expressions as nested tuples, compiled to window columns, bred and judged.

("col", name) | ("zscore" | "rank" | "delta" | "mean", e, n) | ("neg" | "sign", e) |
("add" | "sub" | "mul" | "over", a, b). A generation is one plan: equal parts of all its expressions
are computed once, level by level, as windows of windows need a column between them. The driver
holds names and one row of statistics for each expression, never values.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, correlation_p_value
from tidemark.functions.series import average_rank, ordered, pearson, trailing
from tidemark.operators.indicators import BY, ORDER

Z = lambda name, n=60: ("zscore", ("col", name), n)
#: Expressions to start from (fixed values).
SEEDS = {
    "mom_quality": ("sub", Z("momentum_20"), Z("volatility_10")),
    "gap_reversal": ("neg", Z("overnight_gap")),
    "liquidity_impulse": Z("volume_price_impulse"),
    "vwap_reclaim": ("sub", Z("close_location"), Z("vwap_gap")),
    "macd_volume_gate": ("mul", Z("macd_hist_pct"), Z("volume_ratio_20")),
    "range_breakout": ("add", Z("range_position_20"), Z("atr_pct_14")),
    "body_pressure": ("add", Z("candle_body_pressure"), Z("close_location")),
    "trend_vwap_spread": ("sub", Z("trend_gap_60"), Z("vwap_gap")),
}
WINDOWED, UNARY = ("zscore", "rank", "delta", "mean"), ("neg", "sign")


def text(e: tuple) -> str:
    if e[0] == "col":
        return e[1]
    return f"{e[0]}({', '.join(text(x) if isinstance(x, tuple) else str(x) for x in e[1:])})"


def name_of(e: tuple) -> str:
    return e[1] if e[0] == "col" else "x_" + hashlib.sha256(text(e).encode()).hexdigest()[:16]


def parts(e: tuple) -> list[tuple]:
    return [x for x in e[1:] if isinstance(x, tuple)]


def depth(e: tuple) -> int:
    return 0 if e[0] == "col" else 1 + max(map(depth, parts(e)))


def size(e: tuple) -> int:
    return 1 + sum(map(size, parts(e)))


def with_expressions(df: DataFrame, expressions: list[tuple], by: list[str] = BY, order: list[str] = ORDER) -> DataFrame:
    """df with a column name_of(e) for each expression and its parts."""
    nodes: dict[str, tuple] = {}
    stack = list(expressions)
    while stack:
        e = stack.pop()
        if e[0] != "col" and name_of(e) not in nodes:
            nodes[name_of(e)] = e
            stack += parts(e)
    w = ordered(by, order)
    for level in range(1, max(map(depth, nodes.values()), default=0) + 1):
        here = {n: e for n, e in nodes.items() if depth(e) == level}
        ranks = {f"w_{n}": F.collect_list(name_of(e[1])).over(trailing(w, e[2])) for n, e in here.items() if e[0] == "rank"}
        df = df.withColumns(ranks) if ranks else df
        df = df.withColumns({n: _column(n, e, w) for n, e in here.items()}).drop(*ranks)
    return df


def _column(name: str, e: tuple, w: Window) -> Column:
    kind, x = e[0], F.col(name_of(e[1]))
    if kind in WINDOWED:
        t = trailing(w, e[2])
        if kind == "zscore":
            sd = F.stddev_pop(x).over(t)
            return clamp((x - F.avg(x).over(t)) / F.when(sd > 1e-12, sd).otherwise(F.lit(1.0)), -6.0, 6.0)
        if kind == "rank":
            seen = F.col(f"w_{name}")
            return F.when(F.size(seen) <= 1, F.lit(0.0)).otherwise(F.size(F.filter(seen, lambda v: v <= x)) * 2.0 / F.size(seen) - 1)
        return F.coalesce(x - F.lag(x, e[2]).over(w), F.lit(0.0)) if kind == "delta" else F.avg(x).over(t)
    if kind in UNARY:
        return -x if kind == "neg" else F.signum(x)
    y = F.col(name_of(e[2]))
    return {"add": x + y, "sub": x - y, "mul": x * y, "blend": (x + y) / 2, "gated": F.when(y >= 0, x).otherwise(-x), "over": x / F.greatest(F.lit(0.25), F.abs(y))}[kind]


#: What an expression's text must name to be free of units, and must not name (fixed values).
UNIT_FREE = ("rank", "zscore", "pct", "ratio", "gap", "pressure", "return", "vol")
OF_THE_FUTURE = ("future", "label", "target", "shift(-", "lead(")
#: Accepted expressions that a new one is compared with.
ACCEPTED = 12


def gates(e: tuple, missing_pct: float, unique_ratio: float, sigma: float, outlier_pct: float) -> int:
    """How many of six quality checks an expression passes."""
    words = text(e).lower()
    return sum((
        any(t in words for t in UNIT_FREE), unique_ratio >= 0.08 and sigma > 1e-9, not any(t in words for t in OF_THE_FUTURE),
        missing_pct <= 2.0, outlier_pct <= 3.0, "zscore" in words or "rank" in words or size(e) <= 5,
    ))


def statistics(values: DataFrame) -> DataFrame:
    """One row for each expression of (expression, symbol, day, value, label, part): what its fitness needs.

    Correlations by part and the missing, distinct and outlying shares are over all rows; the rank correlation is
    the mean over symbols; rolling correlations are over strided windows of each symbol's series, of a
    quarter of its length (18 to 60 rows).
    """
    only = lambda p: pearson(F.when(F.col("part") == p, F.col("value")), F.col("label"))
    whole = values.groupBy("expression").agg(
        F.count("*").alias("n"), F.count_if(F.col("part") == "test").alias("test_n"), pearson(F.col("value"), F.col("label")).alias("ic"), *(only(p).alias(f"{p}_ic") for p in ("train", "validation", "test")),
        (F.count_if(F.col("value").isNull()) * 100 / F.count("*")).alias("missing_pct"), F.count_distinct(F.round("value", 8)).alias("kinds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma"),
    )
    by = ["expression", "symbol"]
    placed = values.withColumns({"a_": average_rank("value", by), "b_": average_rank("label", by), "at_": F.row_number().over(ordered(by, ["day"])) - 1, "n_": F.count("*").over(Window.partitionBy(*by))})
    ranks = placed.groupBy(*by).agg(pearson(F.col("a_"), F.col("b_")).alias("r")).groupBy("expression").agg(F.avg("r").alias("rank_ic"))
    width = F.least(F.lit(60), F.greatest(F.lit(18), F.floor(F.col("n_") / 4)))
    step = F.greatest(F.lit(6), F.floor(width / 3))
    low, high = F.greatest(F.lit(0), F.ceil((F.col("at_") - width + 1) / step)), F.least(F.floor(F.col("at_") / step), F.floor((F.col("n_") - width) / step))
    windows = placed.filter((F.col("n_") >= 24) & (low <= high)).withColumn("window", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    rolling = windows.groupBy(*by, "window").agg(pearson(F.col("value"), F.col("label")).alias("r"))
    own = whole.select("expression", "ic", "mean", "sigma")
    rolling = rolling.join(own, "expression").groupBy("expression").agg(
        F.count("*").alias("windows"), (F.abs(F.avg("r")) / (F.stddev_pop("r") + 0.05)).alias("stability"), F.avg((F.col("r") * F.col("ic") >= 0).cast("double")).alias("positive_share"), F.avg((F.col("r") * F.col("ic") <= 0).cast("double")).alias("losing_share"))
    far = values.join(own, "expression").groupBy("expression").agg(F.avg((F.abs(F.col("value") - F.col("mean")) / F.greatest(F.col("sigma"), F.lit(1e-9)) > 8).cast("double")).alias("far"))
    out = whole.join(ranks, "expression").join(rolling, "expression", "left").join(far, "expression")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("expression", "n", "test_n", "ic", "rank_ic", "train_ic", "validation_ic", "test_ic", *(zero(F.col(c)).alias(c) for c in ("stability", "positive_share", "losing_share")),
                      "missing_pct", (F.col("kinds") / F.greatest(F.lit(1), F.col("n"))).alias("unique_ratio"), zero(F.col("sigma")).alias("sigma"), (zero(F.col("far")) * 100).alias("outlier_pct"), correlation_p_value("test_ic", "test_n").alias("test_ic_p"))


def long_values(d: DataFrame, expressions: dict[str, tuple], label: str, part: str) -> DataFrame:
    values = F.array(*(F.struct(F.lit(n).alias("expression"), clamp(name_of(e), -8.0, 8.0).alias("value")) for n, e in expressions.items()))
    return d.select("symbol", "day", F.col(label).alias("label"), F.col(part).alias("part"), F.explode(values).alias("x")).select("symbol", "day", "label", "part", "x.*")


def overlaps(d: DataFrame, new: dict[str, tuple], accepted: dict[str, tuple]) -> dict[str, float]:
    """Largest |correlation| of each new expression with the accepted ones.

    One aggregate gives the moments of each expression over the rows that it has, one the means of products of standard scores.
    """
    pairs = [(n, a) for n in new for a in accepted if a != n]
    if not pairs:
        return dict.fromkeys(new, 0.0)
    every = {name_of(e): clamp(name_of(e), -8.0, 8.0) for e in (*new.values(), *accepted.values())}
    moments = d.agg(*(F.avg(v).alias(f"m_{n}") for n, v in every.items()), *(F.stddev_pop(v).alias(f"s_{n}") for n, v in every.items())).first()
    score = {n: (v - moments[f"m_{n}"]) / moments[f"s_{n}"] if (moments[f"s_{n}"] or 0) > 1e-12 else F.lit(0.0) for n, v in every.items()}
    z = d.select(*(v.alias(n) for n, v in score.items()))
    row = z.agg(*(F.abs(F.avg(F.col(name_of(new[n])) * F.col(name_of(accepted[a])))).alias(f"c{i}") for i, (n, a) in enumerate(pairs))).first()
    return {n: max((row[f"c{i}"] or 0.0 for i, (m, _) in enumerate(pairs) if m == n), default=0.0) for n in new}


def evaluate(df: DataFrame, expressions: dict[str, tuple], label: str = "label", part: str = "part", accepted: dict[str, tuple] | None = None) -> list[dict]:
    """One row of statistics for each expression, best first; df has the base columns, label and part (train, validation, test).

    Expressions pay for an overlap with accepted ones, for a gap between training and holdout, for changes of sign and for their size.
    """
    accepted = dict(list((accepted or {}).items())[:ACCEPTED])
    names = {name_of(e) for e in (*expressions.values(), *accepted.values())}
    # five aggregates read the values; without this each would compute all windows again
    d = with_expressions(df, [*expressions.values(), *accepted.values()]).select("symbol", "day", label, part, *sorted(names)).persist()
    try:
        overlap = overlaps(d, expressions, accepted)
        found = statistics(long_values(d, expressions, label, part)).collect()  # one row an expression
    finally:
        d.unpersist()
    rows = []
    for r in found:
        e, most = expressions[r.expression], overlap[r.expression]
        train, valid, test = r.train_ic, r.validation_ic, r.test_ic
        gap = max(0.0, abs(train) - (abs(valid) + abs(test)) / 2)
        flips = 8.0 * (train * valid < 0) + 10.0 * (train * test < 0) + 6.0 * (valid * test < 0)
        penalty = min(24.0, gap * 55 + flips + max(0.0, 0.55 - r.positive_share) * 10)
        passed = gates(e, r.missing_pct, r.unique_ratio, r.sigma, r.outlier_pct)
        general = max(0.0, min(100.0, 100.0 - penalty - most * 10 - size(e) * 0.9))
        fitness = abs(valid) * 42 + abs(test) * 34 + abs(r.rank_ic) * 20 + min(12.0, r.stability * 4.5) + r.positive_share * 8 + passed * 1.4 - most * 12 - size(e) * 0.85 - penalty
        rows.append({
            "name": r.expression, "expression": text(e), "ic": r.ic, "rank_ic": r.rank_ic, "train_ic": train, "validation_ic": valid, "test_ic": test, "test_ic_p": r.test_ic_p, "stability": r.stability, "positive_share": r.positive_share,
            "losing_share": r.losing_share, "max_overlap": most, "incremental": abs(test) * max(0.0, 1.0 - most), "gates": passed, "overfit_penalty": penalty, "generalization": general, "overfit": penalty >= 10 or general < 70, "fitness": fitness,
        })
    return sorted(rows, key=lambda r: (-r["fitness"], r["name"]))


def breed(parents: list[tuple], rng: random.Random) -> list[tuple]:
    """Children by mutation of each parent and crossover of shuffled pairs."""
    out = []
    for e in parents:
        kind = rng.choice(["zscore", "rank", "delta", "mean", "over", "neg"])
        spans = {"zscore": (20, 40, 60), "rank": (30, 60, 90), "delta": (1, 3, 5), "mean": (3, 5, 8)}
        out.append((kind, e, rng.choice(spans[kind])) if kind in spans else ("over", e, ("col", "atr_pct_14")) if kind == "over" else ("neg", e))
    pairs = parents[:]
    rng.shuffle(pairs)
    for a, b in zip(pairs[::2], pairs[1::2], strict=False):
        za, zb = ("zscore", a, 60), ("zscore", b, 60)
        out.append((rng.choice(["blend", "sub", "gated"]), za, zb))
    return out


def evolve(df: DataFrame, generations: int = 2, population: int = 12, seed: int = 1, seeds: dict[str, tuple] | None = None) -> list[dict]:
    """Statistics of the fittest expressions after some generations; equal formulas count once."""
    rng = random.Random(seed)
    known = dict(seeds or SEEDS)
    df = df.persist()  # spills to disk; every generation reads the base columns
    try:
        rows = evaluate(df, known)
        for generation in range(1, generations + 1):
            best = [known[r["name"]] for r in rows[: max(4, population // 2)]]
            formulas = {text(e) for e in known.values()}
            fresh = {f"g{generation}_{i}": e for i, e in enumerate(breed(best, rng)) if text(e) not in formulas and depth(e) <= 6}
            known |= fresh
            accepted = {r["name"]: known[r["name"]] for r in rows[:ACCEPTED]}
            rows = sorted([*rows, *(evaluate(df, fresh, accepted=accepted) if fresh else [])], key=lambda r: (-r["fitness"], r["name"]))[:population]
        return rows
    finally:
        df.unpersist()
