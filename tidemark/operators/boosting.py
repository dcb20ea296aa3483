"""Boosted histogram trees for quantiles, rankings and means, with histograms as Spark aggregates.

Rows are stored once as bin numbers. Growing one level of a tree is one aggregate: sums of gradients, curvatures and rows by node, feature and
bin. The driver sees histograms, never rows. Rankings use the listwise loss (a softmax over the rows of each date), which needs one sum a date
and no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import totals, with_places
from tidemark.sources.stored import stored

KINDS = ("mean", "quantile", "rank")


@dataclass
class Tree:
    """A full binary tree: feature and last bin that goes left of each inner node (feature -1: all go left), and the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    leaves: np.ndarray

    def at(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Number of the node, within its level, that each row of bins reaches."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(levels):
            inner = 2**level - 1 + node
            f = self.feature[inner]
            node = 2 * node + ((f >= 0) & (x[rows, np.maximum(f, 0)] > self.cut[inner]))
        return node


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.leaves[t.at(x, self.depth)]
        return out

    def score(self) -> Column:
        """The prediction as a column of the features."""
        model = self

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), "left") for e, c in zip(model.edges, (c.to_numpy(float) for c in columns), strict=True)])
            return pd.Series(model.raw(x))

        return predicted(*(F.col(f).cast("double") for f in self.features))


def binned(column: str, edges: np.ndarray) -> Column:
    """How many edges lie below a value; null and nan count as below all."""
    v = F.col(column).cast("double")
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, edges.tolist())), lambda e: e < v)) if len(edges) else F.lit(0)).cast("int")


def gradients(kind: str, p: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float, scale: float, share: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss; for rankings y is the target's share of its date, share the prediction's, w the date's rows."""
    if kind == "rank":
        return w * (share - y), w * np.maximum(share * (1 - share), 1e-6)
    if kind == "quantile":
        return w * scale * np.where(y > p, -alpha, 1 - alpha), w
    return w * (p - y), w


def best_splits(hist: np.ndarray, ridge: float, least: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each node of a histogram [node, feature, bin, (g, h, n)]: feature, bin, and sums left and right; feature -1 where nothing is gained."""
    out = []
    for node in hist:
        whole = node[0].sum(0)
        left = node.cumsum(1)[:, :-1]
        right = whole - left
        gain = left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
        gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
        out.append((int(f), int(b), left[f, b], right[f, b]) if gain.size and gain[f, b] > 1e-9 else (-1, 0, whole, np.zeros(3)))
    return out


def boost(df: DataFrame, features: list[str], y: str, kind: str = "mean", date: str | None = None, weight: str | None = None, alpha: float = 0.5, trees: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, ridge: float = 1.0, least: float = 20) -> Boosted:
    """Boosted trees on the rows with a label. kind: mean, quantile (of alpha) or rank (y is a relevance, ranked within each date).

    Bin edges are quantiles of each feature (approximate beyond ten thousand rows); rows of null date are left out of rankings.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    rows = df.filter(F.col(y).isNotNull())
    goal, w = F.col(y).cast("double"), F.greatest(F.lit(0.05), F.coalesce(F.col(weight).cast("double"), F.lit(1.0))) if weight else F.lit(1.0)
    cuts = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    one = rows.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), cuts, 10_000).alias(f"q{i}") for i, f in enumerate(features)), F.avg(goal).alias("mean"), F.stddev_pop(goal).alias("sd"), F.percentile_approx(goal, alpha, 10_000).alias("middle")).first()
    edges = [np.unique(np.array(one[f"q{i}"] or [], float)) for i in range(len(features))]
    base = {"mean": one["mean"], "quantile": one["middle"], "rank": 0.0}[kind] or 0.0
    model, scale, k, wide = Boosted(features, edges, float(base), depth), float(one["sd"] or 1.0), len(features), bins
    n_dates = 0
    if kind == "rank":
        rows, n_dates = with_places(rows, date)
        total = rows.groupBy("place").agg(F.sum(F.exp(goal)).alias("total_"), F.count("*").alias("n_"))
        rows = rows.join(total, "place")
        goal, w = F.exp(goal) / F.col("total_"), F.col("n_").cast("double")
    place = F.col("place").cast("int") if kind == "rank" else F.lit(0)
    with stored(rows.select(place.alias("place"), goal.alias("y"), w.alias("w"), F.array(*(binned(f, e) for f, e in zip(features, edges, strict=True))).alias("x"))) as kept:
        for _ in range(trees):
            mass = None
            if kind == "rank":
                mass = totals(kept, lambda place, x: np.bincount(place, weights=np.exp(np.clip(model.raw(x), -30, 30)), minlength=n_dates), n_dates, ("place", "x"))
            tree = Tree(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, int), np.zeros(2**depth))
            for level in range(depth):

                def sums(place, y, w, x):
                    p = model.raw(x)
                    share = np.exp(np.clip(p, -30, 30)) / mass[place] if mass is not None else None
                    g, h = gradients(kind, p, y, w, alpha, scale, share)
                    cell = ((tree.at(x, level)[:, None] * k + np.arange(k)) * wide + x).ravel()
                    size = 2**level * k * wide
                    return np.stack([np.bincount(cell, weights=np.repeat(v, k), minlength=size) for v in (g, h, np.ones(len(y)))], axis=-1).ravel()

                hist = totals(kept, sums, 2**level * k * wide * 3, ("place", "y", "w", "x")).reshape(2**level, k, wide, 3)
                for node, (f, b, left, right) in enumerate(best_splits(hist, ridge, least)):
                    tree.feature[2**level - 1 + node], tree.cut[2**level - 1 + node] = f, b
                    if level == depth - 1:
                        tree.leaves[2 * node : 2 * node + 2] = [-rate * s[0] / (s[1] + ridge) for s in (left, right)]
            model.trees.append(tree)
    return model
