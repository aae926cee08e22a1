"""Models on cross-sectional ranks: ridge and ridge on components from Gram aggregates.

A fit needs one aggregation pass a training set: medians, then weighted sums of
products. The driver solves a system of as many unknowns as there are inputs;
scores are column expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_double, dealt, pct_rank
from ..shared import written
from .trees import added, grow


def rank_features(panel: DataFrame, features: list[str], date: str = "as_of_date") -> DataFrame:
    """Replace features by their percentile rank over the whole cross-section, labelled or not."""
    out = dealt(panel.select("*", *[clean_double(f).alias(f"_c_{f}") for f in features]), date)
    out = out.select("*", *[pct_rank(f"_c_{f}", date).alias(f"_p_{f}") for f in features])
    keep = [c for c in panel.columns if c not in features]
    return out.select(*keep, *[F.col(f"_p_{f}").alias(f) for f in features])


@dataclass
class Linear:
    """Median imputation with indicators, standardising, and a linear rule on the result."""

    features: list[str]
    medians: dict[str, float | None]
    indicators: list[str]
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    intercept: float
    details: dict = field(default_factory=dict)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the score; a row without any observed feature has none."""
        inputs = design(self.features, self.medians, self.indicators)
        value = F.lit(float(self.intercept))
        for x, m, s, c in zip(inputs, self.means, self.scales, self.coefficients, strict=True):
            value = value + (x - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(c))
        observed = sum((F.col(f).isNotNull().cast("int") for f in self.features), F.lit(0))
        return df.withColumn("feature_count", observed).withColumn(name, F.when(observed > 0, value))


def design(features: list[str], medians: dict, indicators: list[str]) -> list[F.Column]:
    """Imputed features, then indicators of missing ones; a feature without a median is 0."""
    filled = [F.coalesce(F.col(f), F.lit(float(medians[f] or 0.0))) for f in features]
    return filled + [F.col(f).isNull().cast("double") for f in indicators]


def imputation(train: DataFrame, features: list[str]) -> tuple[dict, list[str]]:
    """Exact medians, and the features with a missing value."""
    row = train.agg(*[F.median(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.count_if(F.col(f).isNull()).alias(f"n{i}") for i, f in enumerate(features)]).first()
    return {f: row[f"m{i}"] for i, f in enumerate(features)}, [f for i, f in enumerate(features) if row[f"n{i}"]]


def gram(train: DataFrame, inputs: list[F.Column], target: str, weight: str) -> dict:
    """Weighted and plain sums of products of inputs and target, in one pass."""
    k = len(inputs)
    rows = train.select(*[x.alias(f"x{i}") for i, x in enumerate(inputs)], F.col(target).alias("y"), F.col(weight).alias("w"))
    sums = [F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.expr("w * y")).alias("wy")]
    for i in range(k):
        sums += [F.sum(f"x{i}").alias(f"s{i}"), F.sum(F.expr(f"w * x{i}")).alias(f"wx{i}"), F.sum(F.expr(f"w * x{i} * y")).alias(f"wxy{i}")]
        sums += [F.sum(F.expr(f"x{i} * x{j}")).alias(f"p{i}_{j}") for j in range(i, k)]
        sums += [F.sum(F.expr(f"w * x{i} * x{j}")).alias(f"wp{i}_{j}") for j in range(i, k)]
    r = rows.agg(*sums).first()
    full = lambda p: np.array([[r[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float).reshape(k, k)
    vector = lambda p: np.array([r[f"{p}{i}"] for i in range(k)], float)
    return {"n": r["n"], "w": r["w"], "wy": r["wy"], "s": vector("s"), "wx": vector("wx"), "wxy": vector("wxy"), "p": full("p"), "wp": full("wp")}


def _standardised(g: dict) -> tuple[np.ndarray, ...]:
    """Means and population deviations (unweighted), and weighted moments of the standardised inputs."""
    mean = g["s"] / g["n"]
    scale = np.sqrt(np.maximum(np.diag(g["p"]) / g["n"] - mean**2, 0.0))
    scale[scale <= 1e-12] = 1.0
    wz = (g["wx"] - g["w"] * mean) / scale
    wzz = (g["wp"] - np.outer(g["wx"], mean) - np.outer(mean, g["wx"]) + g["w"] * np.outer(mean, mean)) / np.outer(scale, scale)
    wzy = (g["wxy"] - mean * g["wy"]) / scale
    return mean, scale, wz, wzz, wzy


def _solve(w: float, wy: float, wz: np.ndarray, wzz: np.ndarray, wzy: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    centre = wz / w
    a = wzz - w * np.outer(centre, centre) + alpha * np.eye(len(wz))
    c = np.linalg.solve(a, wzy - centre * wy)
    return c, wy / w - float(centre @ c)


def fit_ridge(train: DataFrame, features: list[str], target: str, alphas: list[float], *, components: float | None = None, weight: str = "weight") -> list[Linear]:
    """Ridge for each alpha from one Gram pass; on the leading components that hold ``components`` of the variance if given."""
    medians, indicators = imputation(train, features)
    g = gram(train, design(features, medians, indicators), target, weight)
    mean, scale, wz, wzz, wzy = _standardised(g)
    turn, details = np.eye(len(mean)), {}
    if components is not None:
        cov = (g["p"] / g["n"] - np.outer(mean, mean)) / np.outer(scale, scale)
        turn, details = principal(cov, components)
    out = []
    for alpha in alphas:
        c, intercept = _solve(g["w"], g["wy"], turn.T @ wz, turn.T @ wzz @ turn, turn.T @ wzy, alpha)
        out.append(Linear(features, medians, indicators, mean, scale, turn @ c, intercept, {"alpha": alpha, **details}))
    return out


def principal(cov: np.ndarray, share: float) -> tuple[np.ndarray, dict]:
    """Leading eigenvectors whose share of the variance exceeds ``share``, the largest loading of each positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    ratio = values / values.sum() if values.sum() > 0 else values
    k = min(len(ratio), int(np.searchsorted(np.cumsum(ratio), share, side="right")) + 1)
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)])
    return vectors, {"components": k, "variance_ratio": ratio[:k].tolist()}


def pca_baseline(panel: DataFrame, features: list[str], train_end, share: float = 0.95, date: str = "as_of_date") -> tuple[DataFrame, dict]:
    """pc_1.. of every row from medians, scales and components of rows up to ``train_end``."""
    train = panel.where(F.col(date) <= F.lit(train_end)).select(*[clean_double(f).alias(f) for f in features])
    medians, _ = imputation(train, features)
    g = gram(train.withColumn("_one", F.lit(1.0)), design(features, medians, []), "_one", "_one")
    mean, scale, *_ = _standardised(g)
    turn, details = principal((g["p"] / g["n"] - np.outer(mean, mean)) / np.outer(scale, scale), share)
    inputs = [F.coalesce(clean_double(f), F.lit(float(medians[f] or 0.0))) for f in features]
    zs = [(x - F.lit(float(m))) / F.lit(float(s)) for x, m, s in zip(inputs, mean, scale, strict=True)]
    columns = [sum((z * F.lit(float(v)) for z, v in zip(zs, turn[:, k], strict=True)), F.lit(0.0)).alias(f"pc_{k + 1}") for k in range(turn.shape[1])]
    return panel.select(date, "symbol", *columns), details | {"weights": {f: turn[i].tolist() for i, f in enumerate(features)}}


def fit_trees(train: DataFrame, features: list[str], target: str, *, rounds: int = 200, depth: int = 3, step: float = 0.05, leaf: int = 20, weight: str = "weight"):
    """Boosted trees by Spark's rules after median imputation, to set beside ``boosting``.

    They grow by depth, without an L2 term and without routing missing values, so
    they are another model.
    """
    rows = written(train.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w")), "trees")
    medians, indicators = imputation(rows, features)
    names = [f"_x{i}" for i in range(len(features) + len(indicators))]
    prepare = lambda df: df.select("*", *[x.alias(n) for n, x in zip(names, design(features, medians, indicators), strict=True)])
    trees = grow(prepare(rows), names, "_y", "_w", rounds=rounds, depth=depth, step=step, leaf=leaf)

    def score(df: DataFrame, name: str = "score") -> DataFrame:
        observed = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
        scored = added(prepare(df.withColumn("feature_count", observed)), names, trees, depth, name)
        return scored.withColumn(name, F.when(F.col("feature_count") > 0, F.col(name)))

    return score


def candidate_grid(family: str, grid: dict[str, list]) -> list[tuple[str, dict]]:
    """All combinations in order, each under ``family:{sorted json}``."""
    names = list(grid)
    made = [dict(zip(names, values, strict=True)) for values in product(*grid.values())]
    return [(f"{family}:{json.dumps(p, sort_keys=True, separators=(',', ':'))}", p) for p in made]
