"""Nested folds as two columns, and all candidates of all folds fitted and scored in one job.

Each outer fold's training rows are split again by date; a row that takes part in
several folds stands once a fold. Moments, solutions, scores and daily
correlations are grouped by (outer, inner), so nothing loops over folds on the
driver, and only the table of trials is asked for.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import look_up, on_each
from ..shared import written
from .boosting import Boosting, fit_boosted
from .models import _solve, _standardised, principal
from .signals import rank_ic, spread_masses
from .splits import MOST_FOLDS, training_weights

KEYS = ["outer", "inner"]


def nested_blocks(cross: DataFrame, *, folds: int, test_dates: int, least_train: int, date: str = "as_of_date") -> DataFrame:
    """outer, inner, test_start, test_end: consecutive blocks at the end of each outer fold's dates.

    ``cross`` holds the training cross-sections of each ``fold``. A block with
    fewer than ``least_train`` dates before it is left out.
    """
    each = Window.partitionBy("fold")
    dates = cross.select("fold", date).distinct().withColumn("i", F.row_number().over(each.orderBy(date)) - 1).withColumn("total", F.count("*").over(each))
    first = F.col("total") - folds * test_dates
    tests = dates.where((F.col("i") >= first) & (F.col("i") >= least_train)).withColumn("inner", (F.floor((F.col("i") - first) / test_dates) + 1).cast("int"))
    blocks = tests.groupBy(F.col("fold").alias("outer"), "inner").agg(F.min(date).alias("test_start"), F.max(date).alias("test_end"), F.count("*").alias("dates"))
    return blocks.where(F.col("dates") == test_dates).drop("dates")


def nested_rows(cross: DataFrame, blocks: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rows of each outer and inner fold with a role: training, purged or test."""
    rows = on_each(cross, blocks, MOST_FOLDS).where((F.col("fold") == F.col("outer")) & (F.col(date) <= F.col("test_end"))).drop("fold")
    training = (F.col(date) < F.col("test_start")) & (F.col("label_end_date") < F.col("test_start"))
    return rows.withColumn("role", F.when(F.col(date) >= F.col("test_start"), "test").when(training, "training").otherwise("purged"))


def window_counts(rows: DataFrame, target: str, features: list[str], date: str = "as_of_date") -> DataFrame:
    """Per outer and inner fold: dates and rows by role, labelled and unlabelled rows, rows with no feature, and the mean coverage of features."""
    some = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    is_ = lambda role: F.col("role") == role
    return rows.groupBy(*KEYS).agg(
        F.countDistinct(F.when(is_("training"), F.col(date))).alias("train_dates"), F.countDistinct(F.when(is_("test"), F.col(date))).alias("test_dates"),
        F.count_if(is_("training")).alias("train_rows"), F.count_if(is_("training") & F.col(target).isNotNull()).alias("supervised_rows"),
        F.count_if(is_("purged") & (F.col("label_end_date") >= F.col("test_start"))).alias("purged_rows"), F.count_if(is_("purged") & F.col("label_end_date").isNull()).alias("unlabelled_rows"),
        F.count_if(is_("test")).alias("test_rows"), F.count_if(is_("test") & F.col(target).isNotNull()).alias("test_labelled_rows"),
        F.count_if(is_("test") & F.col(target).isNull()).alias("feature_only_rows"), F.count_if(is_("test") & (some == 0)).alias("empty_test_rows"),
        F.avg(F.when(is_("training"), some / F.lit(float(len(features))))).alias("train_coverage"), F.avg(F.when(is_("test"), some / F.lit(float(len(features))))).alias("test_coverage"),
    )


def grouped_moments(train: DataFrame, keys: list[str], features: list[str], target: str, weight: str = "weight") -> DataFrame:
    """One row a key: medians, and plain and weighted sums of products of [1, features, indicators, target] as (i, j, p, w).

    A sum stands for each pair of terms, so a row is met once, not once a pair,
    and Spark combines before it shuffles; a key's row holds as many sums as
    there are pairs of inputs.
    """
    medians = train.groupBy(*keys).agg(F.array(*[F.median(f) for f in features]).alias("medians"))
    rows = look_up(train, medians, keys, MOST_FOLDS)
    inputs = [F.coalesce(F.col(f), F.col("medians")[i], F.lit(0.0)) for i, f in enumerate(features)] + [F.col(f).isNull().cast("double") for f in features]
    terms = [F.lit(1.0), *inputs, F.col(target)]
    rows = rows.select(*keys, *[t.alias(f"v{i}") for i, t in enumerate(terms)], F.col(weight).alias("_w"))
    n = len(terms)
    places = [(i, j) for i in range(n) for j in range(i, n)]
    product = lambda i, j: F.col(f"v{i}") * F.col(f"v{j}")
    sums = rows.groupBy(*keys).agg(*[f for i, j in places for f in (F.sum(product(i, j)).alias(f"p{i}_{j}"), F.sum(product(i, j) * F.col("_w")).alias(f"w{i}_{j}"))])
    told = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("p"), F.col(f"w{i}_{j}").alias("w")) for i, j in places])
    return sums.select(*keys, told.alias("sums")).join(medians, keys)


def grouped_ridge(train: DataFrame, keys: list[str], features: list[str], target: str, candidates: list[dict]) -> DataFrame:
    """A linear rule for each key and candidate (``alpha``, and ``variance_to_keep`` for components): keys, medians, rules.

    An indicator that is constant in a key's rows has no part in its rule.
    """
    n = 2 * len(features) + 2
    kinds = {f.name: f.dataType.simpleString() for f in train.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "medians array<double>", "rules array<struct<candidate:int,intercept:double,means:array<double>,scales:array<double>,coefficients:array<double>>>"])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                p, w = np.zeros((n, n)), np.zeros((n, n))
                for t in row["sums"]:
                    p[t["i"], t["j"]] = p[t["j"], t["i"]] = t["p"]
                    w[t["i"], t["j"]] = w[t["j"], t["i"]] = t["w"]
                x = slice(1, n - 1)
                g = {"n": p[0, 0], "w": w[0, 0], "wy": w[0, -1], "s": p[0, x], "wx": w[0, x], "wxy": w[x, -1], "p": p[x, x], "wp": w[x, x]}
                mean, scale, wz, wzz, wzy = _standardised(g)
                cov = (g["p"] / g["n"] - np.outer(mean, mean)) / np.outer(scale, scale)
                rules = []
                for c, settings in enumerate(candidates):
                    turn = principal(cov, settings["variance_to_keep"])[0] if "variance_to_keep" in settings else np.eye(n - 2)
                    coefficients, intercept = _solve(g["w"], g["wy"], turn.T @ wz, turn.T @ wzz @ turn, turn.T @ wzy, settings["alpha"])
                    rules.append({"candidate": c, "intercept": intercept, "means": mean.tolist(), "scales": scale.tolist(), "coefficients": (turn @ coefficients).tolist()})
                out.append({**{k: row[k] for k in keys}, "medians": list(row["medians"]), "rules": rules})
            yield pd.DataFrame(out, columns=[*keys, "medians", "rules"])

    return grouped_moments(train, keys, features, target).mapInPandas(solve, schema)


def scored(rows: DataFrame, rules: DataFrame, keys: list[str], features: list[str], most: int = MOST_FOLDS) -> DataFrame:
    """``rows`` once a candidate of their key, with ``candidate`` and ``score``; a row without any observed feature has no score."""
    met = look_up(rows, rules, keys, most)
    some = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    inputs = F.array(*[F.coalesce(F.col(f), F.col("medians")[i], F.lit(0.0)) for i, f in enumerate(features)], *[F.col(f).isNull().cast("double") for f in features])
    long = met.withColumn("_x", inputs).withColumn("_some", some).select(*rows.columns, "_x", "_some", F.explode("rules").alias("_r"))
    value = F.expr("aggregate(sequence(0, size(_x) - 1), _r.intercept, (s, i) -> s + (_x[i] - _r.means[i]) / _r.scales[i] * _r.coefficients[i])")
    return long.select(*rows.columns, F.col("_r.candidate").alias("candidate"), F.when(F.col("_some") > 0, value).alias("score"))


def trial_scores(tests: DataFrame, target: str, realised: str, *, least: int, quantiles: int, date: str = "as_of_date") -> DataFrame:
    """outer, candidate, mean_rank_ic, mean_spread, dates: daily figures of all inner folds pooled, for scored test rows."""
    keys = ["outer", "inner", "candidate", date]
    ic = rank_ic(tests, keys, "score", target, least).groupBy("outer", "candidate").agg(F.avg("rank_ic").alias("mean_rank_ic"), F.count("*").alias("dates"))
    spreads = spread_masses(tests, keys, "score", realised, quantiles).where(F.col("pairs") >= max(quantiles, least)).groupBy("outer", "candidate").agg(F.avg("spread").alias("mean_spread"))
    every = tests.select("outer", "candidate").distinct()
    return every.join(ic, ["outer", "candidate"], "left").join(spreads, ["outer", "candidate"], "left").withColumn("dates", F.coalesce("dates", F.lit(0)))


def selected_trials(trials: DataFrame) -> DataFrame:
    """The trials with ``selected``: the largest mean IC of an outer fold, those equal to 12 decimals by the grid's order; none where no candidate has one."""
    order = Window.partitionBy("outer").orderBy(F.desc_nulls_last(F.round("mean_rank_ic", 12)), "candidate")
    return trials.withColumn("selected", (F.row_number().over(order) == 1) & F.col("mean_rank_ic").isNotNull())


def _told(tests: DataFrame, names: list[str], family: str, target: str, realised: str, least: int, quantiles: int, date: str) -> DataFrame:
    trials = selected_trials(trial_scores(written(tests, "scores"), target, realised, least=least, quantiles=quantiles, date=date))
    return trials.select("outer", F.lit(family).alias("family"), F.get(F.array(*[F.lit(n) for n in names]), F.col("candidate")).alias("candidate_id"), F.col("candidate").alias("candidate_order"), "mean_rank_ic", "mean_spread", "dates", "selected")


def _halves(rows: DataFrame, features: list[str], target: str, realised: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Weighted training rows and test rows of all folds; plans start from what is written."""
    rows = written(rows, "nested")
    train = training_weights(rows.where((F.col("role") == "training") & F.col(target).isNotNull()), KEYS, date)
    return written(train, "training"), rows.where("role = 'test'").select(*KEYS, date, *dict.fromkeys((target, realised)), *features)


def tune_linear(rows: DataFrame, features: list[str], target: str, realised: str, candidates: list[dict], *, least: int, quantiles: int, family: str = "ridge", date: str = "as_of_date") -> DataFrame:
    """All trials of all outer folds from ``nested_rows`` whose features are ranked: outer, family, candidate_id, figures, selected."""
    train, tests = _halves(rows, features, target, realised, date)
    rules = written(grouped_ridge(train, KEYS, features, target, candidates), "rules")
    return _told(scored(tests, rules, KEYS, features), [n for n, _ in named(family, candidates)], family, target, realised, least, quantiles, date)


def tune_boosted(rows: DataFrame, features: list[str], target: str, realised: str, candidates: list[dict], *, least: int, quantiles: int, rounds: int = 200, leaf: int = 20, family: str = "hist_gradient_boosting", date: str = "as_of_date") -> DataFrame:
    """As ``tune_linear``, for boosted trees: the trees of all folds and candidates grow in the same passes."""
    train, tests = _halves(rows, features, target, realised, date)
    model = fit_boosted(train, KEYS, features, target, [Boosting(**c) for c in candidates], rounds=rounds, least=leaf)
    return _told(model.score(tests), [n for n, _ in named(family, candidates)], family, target, realised, least, quantiles, date)


def named(family: str, candidates: list[dict]) -> list[tuple[str, dict]]:
    """Each candidate under ``family:{sorted json}``."""
    return [(f"{family}:{json.dumps(c, sort_keys=True, separators=(',', ':'))}", c) for c in candidates]
