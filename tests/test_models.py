"""Boosted trees, nested folds and grouped ridge against plain NumPy."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import boosting as B
from signalloom.operators import models as M
from signalloom.operators import tuning as TU

FEATURES = ["a", "b", "c"]


def table(seed, n, missing=0.15):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 3)), 2)
    x[rng.random((n, 3)) < missing] = np.nan
    x[: n // 2, 2] = np.nan  # no value in one group
    y = np.where(np.isnan(x[:, 0]), 1.5, 2 * x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + 0.1 * rng.standard_normal(n)
    return x, y, rng.random(n) + 0.5


def frame(spark, x, y, w, k):
    rows = [(i, int(k[i]), float(y[i]), float(w[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, k int, y double, weight double, a double, b double, c double").repartition(3)


def grown(x, g, h, edges, s, least):
    """Leaves as (row mask, value), the largest gain first, by trying every split."""

    def best(rows):
        found = None
        total = g[rows].sum() ** 2 / (h[rows].sum() + s.l2_regularization)
        for f in range(x.shape[1]):
            lost = np.isnan(x[:, f])
            for with_left in (False, True):
                for e in [*edges[f], math.inf]:
                    left = rows & np.where(lost, with_left, x[:, f] <= e)
                    right = rows & ~left
                    if min(left.sum(), right.sum()) < least or min(h[left].sum(), h[right].sum()) < B.LEAST_WEIGHT:
                        continue
                    gain = g[left].sum() ** 2 / (h[left].sum() + s.l2_regularization) + g[right].sum() ** 2 / (h[right].sum() + s.l2_regularization) - total
                    if gain > 0 and (found is None or gain > found[0] * (1 + 1e-9)):
                        to_left = with_left if (rows & lost).any() else left.sum() > right.sum()
                        found = (gain, f, e, to_left, left, right)
        return found

    leaves, splits = [(np.ones(len(x), bool), best(np.ones(len(x), bool)), ())], []
    while len(leaves) < s.max_leaf_nodes and any(leaf[1] for leaf in leaves):
        at = max((i for i in range(len(leaves)) if leaves[i][1]), key=lambda i: leaves[i][1][0])
        _, (_, f, e, to_left, left, right), path = leaves.pop(at)
        leaves += [(rows, best(rows), (*path, (f, e, to_left, side))) for rows, side in ((left, True), (right, False))]
    return [(-s.learning_rate * g[rows].sum() / (h[rows].sum() + s.l2_regularization), path) for rows, _, path in leaves]


def fitted(x, y, w, edges, s, rounds, least, new):
    """Scores of ``new`` rows."""

    def applied(leaves, rows):
        out = np.zeros(len(rows))
        for value, path in leaves:
            inside = np.ones(len(rows), bool)
            for f, e, to_left, side in path:
                inside &= np.where(np.isnan(rows[:, f]), to_left, rows[:, f] <= e) == side
            out[inside] += value
        return out

    base = (w * y).sum() / w.sum()
    at, scores = np.full(len(y), base), np.full(len(new), base)
    for _ in range(rounds):
        leaves = grown(x, w * (at - y), w, edges, s, least)
        at, scores = at + applied(leaves, x), scores + applied(leaves, new)
    return scores


def test_trees_equal_trying_every_split(spark):
    x, y, w = table(1, 300)
    k = np.arange(300) // 150
    later, y2, w2 = table(2, 80, 0.4)
    later[0] = np.nan
    settings = [B.Boosting(0.3, 5, 0.5), B.Boosting(0.1, 3, 0.0)]
    model = B.fit_boosted(frame(spark, x, y, w, k), ["k"], FEATURES, "y", settings, rounds=4, least=10)
    out = model.score(frame(spark, later, y2, w2, np.arange(80) % 2)).collect()
    assert len(out) == 160 and model.passes <= 4 * 4
    by = {(r["id"], r["candidate"]): r for r in out}
    for g in (0, 1):
        rows = k == g
        for c, s in enumerate(settings):
            want = fitted(x[rows], y[rows], w[rows], model.edges[g], s, 4, 10, later)
            for i in range(g, 80, 2):
                r = by[i, c]
                assert r["score"] is None and np.isnan(later[i]).all() if r["feature_count"] == 0 else abs(r["score"] - want[i]) < 1e-9
    assert by[0, 0]["score"] is None


def test_sums_are_renewed_and_rows_without_target_are_left_out(spark, monkeypatch):
    x, y, w = table(3, 120)
    rows = frame(spark, x, y, w, np.zeros(120)).withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")))
    once = B.fit_boosted(rows, [], FEATURES, "y", [B.Boosting()], rounds=5, least=5).score(rows).collect()
    monkeypatch.setattr(B, "REFRESH", 2)
    again = B.fit_boosted(rows, [], FEATURES, "y", [B.Boosting()], rounds=5, least=5).score(rows).collect()
    first, second = ({r["id"]: r["score"] for r in x} for x in (once, again))
    assert first.keys() == second.keys() and all(a is second[i] is None or abs(a - second[i]) < 1e-12 for i, a in first.items())
    empty = B.fit_boosted(rows.limit(0), [], FEATURES, "y", [B.Boosting()])
    assert not empty.trees and B.fit_boosted(rows.limit(8), [], FEATURES, "y", [B.Boosting()], rounds=1).trees[0, 0][0].depth == 0


def day(i):
    return date(2024, 1, 1) + timedelta(days=i)


@pytest.fixture
def cross(spark):
    rng = np.random.default_rng(9)
    rows = []
    for fold, last in ((1, 20), (2, 26)):
        for i in range(last):
            for s in range(12):
                a, b = rng.random(2)
                rows.append((fold, day(i), s, float(0.5 * a - b + 0.1 * rng.standard_normal()) if s or i % 3 else None, day(i + 2) if i % 5 else None, None if s % 4 == 0 else float(a), float(b)))
    return spark.createDataFrame(rows, "fold int, as_of_date date, symbol int, y double, label_end_date date, a double, b double")


def test_nested_folds_are_purged(cross):
    blocks = TU.nested_blocks(cross, folds=3, test_dates=5, least_train=8)
    assert [tuple(r) for r in blocks.select("outer", "inner", "test_start", "test_end").orderBy("outer", "inner").collect()] == [
        (1, 2, day(10), day(14)), (1, 3, day(15), day(19)), (2, 1, day(11), day(15)), (2, 2, day(16), day(20)), (2, 3, day(21), day(25)),
    ]
    rows = TU.nested_rows(cross, blocks)
    assert rows.where("role = 'training' AND (label_end_date IS NULL OR label_end_date >= test_start)").count() == 0
    assert rows.where("as_of_date > test_end").count() == 0 and rows.where("role = 'purged' AND as_of_date >= test_start").count() == 0
    counts = TU.window_counts(rows, "y", ["a", "b"]).where("outer = 1 AND inner = 2").first()
    assert (counts["train_dates"], counts["test_dates"], counts["test_rows"], counts["purged_rows"], counts["unlabelled_rows"]) == (6, 5, 60, 24, 24)


@pytest.mark.parametrize("settings", [[{"alpha": 0.5}, {"alpha": 20.0}], [{"alpha": 1.0, "variance_to_keep": 0.7}]])
def test_rules_of_all_folds_equal_fits_one_by_one(cross, settings):
    rows = TU.nested_rows(cross, TU.nested_blocks(cross, folds=2, test_dates=5, least_train=5))
    train = TU.training_weights(rows.where("role = 'training' AND y IS NOT NULL"), TU.KEYS)
    found = TU.scored(rows.where("role = 'test'"), TU.grouped_ridge(train, TU.KEYS, ["a", "b"], "y", settings), TU.KEYS, ["a", "b"]).where("outer = 2 AND inner = 1").collect()
    one = train.where("outer = 2 AND inner = 1")
    for c, s in enumerate(settings):
        model = M.fit_ridge(one, ["a", "b"], "y", [s["alpha"]], components=s.get("variance_to_keep"))[0]
        want = {(r["as_of_date"], r["symbol"]): r["score"] for r in model.score(rows.where("role = 'test' AND outer = 2 AND inner = 1")).collect()}
        got = {(r["as_of_date"], r["symbol"]): r["score"] for r in found if r["candidate"] == c}
        assert got.keys() == want.keys() and all(abs(got[i] - v) < 1e-9 for i, v in want.items())


def test_trials_pick_the_best_and_the_first_of_equals(cross):
    rows = TU.nested_rows(cross, TU.nested_blocks(cross, folds=2, test_dates=5, least_train=5))
    trials = TU.tune_linear(rows, ["a", "b"], "y", "y", [{"alpha": 1.0}, {"alpha": 1.0}], least=5, quantiles=3).orderBy("outer", "candidate_order").collect()
    assert [(r["outer"], r["selected"]) for r in trials if r["candidate_order"] == 0] == [(1, True), (2, True)]
    assert all(r["dates"] == 10 and r["mean_rank_ic"] > 0.5 and r["mean_spread"] > 0 for r in trials)
