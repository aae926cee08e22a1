"""Trees by Spark's rules: equal to Spark's own regressor, in few jobs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from signalloom.operators import models as M

FEATURES = ["a", "b", "c"]


def table(spark, n: int, values: int):
    """Rows with missing inputs, unequal weights and, in the input b, few values of which one is half of all."""
    rng = np.random.default_rng(n)
    x = np.stack([rng.integers(1, values, n) / values, np.where(rng.random(n) < 0.5, 0.5, rng.integers(0, 400, n) / 400), np.round(rng.random(n), 1)])
    y = np.sin(5 * x[0]) + x[1] * (x[2] > 0.4) + 0.1 * rng.standard_normal(n)
    lost = rng.random((3, n)) < np.array([[0.1], [0.05], [0.0]])
    rows = [(i, *(None if lost[f, i] else float(x[f, i]) for f in range(3)), float(y[i]), 0.5 + i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, weight double")


def sparks(train, rows, rounds: int, depth: int, leaf: int) -> dict:
    medians, indicators = M.imputation(train, FEATURES)
    inputs = [f"i{k}" for k in range(len(FEATURES) + len(indicators))]
    ready = lambda df: VectorAssembler(inputCols=inputs, outputCol="v").transform(df.select("*", *[x.alias(k) for k, x in zip(inputs, M.design(FEATURES, medians, indicators), strict=True)]))
    model = GBTRegressor(featuresCol="v", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.05, minInstancesPerNode=leaf, maxBins=255, seed=42).fit(ready(train))
    return {r["id"]: r["prediction"] for r in model.transform(ready(rows)).collect()}


@pytest.mark.parametrize("n, values, depth, leaf", [(3000, 2500, 3, 20), (3000, 100, 2, 1), (200, 150, 3, 5)])
def test_scores_equal_sparks_own_trees(spark, n, values, depth, leaf):
    rows = table(spark, n, values).cache()
    train = rows.where("id % 5 <> 0")
    got = {r["id"]: r["score"] for r in M.fit_trees(train, FEATURES, "y", rounds=20, depth=depth, leaf=leaf)(rows).collect()}
    want = sparks(train, rows, 20, depth, leaf)
    assert len(got) == n and max(abs(v - got[i]) for i, v in want.items()) < 1e-9


def test_rounds_take_no_jobs_of_their_own(spark):
    train = table(spark, 400, 300).cache()
    jobs = {}
    for rounds in (2, 12):
        spark.sparkContext.setJobGroup(f"trees of {rounds} rounds", "")
        M.fit_trees(train, FEATURES, "y", rounds=rounds)
        jobs[rounds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees of {rounds} rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[12] == jobs[2] > 0


def test_a_row_without_inputs_has_no_score_and_without_rows_there_is_no_model(spark):
    train = table(spark, 100, 50)
    out = M.fit_trees(train, FEATURES, "y", rounds=3)(train.limit(1).withColumns({f: F.lit(None).cast("double") for f in FEATURES}))
    assert out.select("feature_count", "score").first() == (0, None)
    with pytest.raises(ValueError, match="no rows"):
        M.fit_trees(train.limit(0), FEATURES, "y")
