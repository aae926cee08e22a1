"""Clusters, classifier, interval join, scope checks and the event stream against plain Python."""

from __future__ import annotations

import math
import re
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from signalloom.operators import companion as CO
from signalloom.operators import evaluation as E
from signalloom.operators.intervals import points_in_intervals
from signalloom.streaming import events


def day(i):
    return date(2020, 1, 1) + timedelta(days=i)


def test_linkage_averages_over_all_pairs():
    rng = np.random.default_rng(1)
    half = np.triu(np.round(rng.random((9, 9)), 2), 1)
    distance = half + half.T
    members, mean = {i: [i] for i in range(9)}, lambda a, b: np.mean([distance[i, j] for i in a for j in b])
    for new, (i, j, height, size) in enumerate(CO.average_linkage(distance), 9):
        least = min(mean(members[a], members[b]) for a in members for b in members if a < b)
        assert abs(height - least) < 1e-9 and abs(mean(members[i], members[j]) - least) < 1e-9
        members[new] = members.pop(i) + members.pop(j)
        assert size == len(members[new])
    assert CO.average_linkage(np.zeros((3, 3))) == [(0, 1, 0.0, 2), (2, 3, 0.0, 3)] and CO.average_linkage(np.zeros((1, 1))) == []


def rows(spark, n=500):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (n // 4, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 0), (4, 4, 4))])
    y = (x[:, 0] + 0.5 * rng.standard_normal(n) > 1).astype(int)
    made = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "id long, y int, a double, b double, c double").repartition(3)
    return CO.standardised(made, ["id", "y"], ["a", "b", "c"])


def test_all_k_at_once_and_the_silhouette_of_all_pairs(spark):
    made = rows(spark).cache()
    out = {r["k"]: r for r in CO.k_means(made, 3, F.col("id"), range(2, 6)).collect()}
    assert set(out) == {2, 3, 4, 5} and max(out, key=lambda k: out[k]["silhouette"]) == 4
    again = {r["k"]: r for r in CO.k_means(made.repartition(2), 3, F.col("id"), range(2, 6)).collect()}
    assert all(abs(again[k]["inertia"] - r["inertia"]) < 1e-9 and again[k]["rounds"] == r["rounds"] for k, r in out.items())
    x = np.array([r[2:] for r in made.orderBy("id").collect()])
    order = [made.orderBy(F.xxhash64("id")).first()["id"]]
    for _ in range(3):
        order.append(int(((x[:, None] - x[order][None]) ** 2).sum(2).min(1).argmax()))
    centres = x[order]
    for _ in range(out[4]["rounds"]):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == i].mean(0) for i in range(4)])
    at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    far, widths = ((x[:, None] - x[None]) ** 2).sum(2), []
    for i in range(len(x)):
        own = far[i, (at == at[i]) & (np.arange(len(x)) != i)].mean()
        other = min(far[i, at == k].mean() for k in range(4) if k != at[i])
        widths.append((other - own) / max(own, other))
    assert abs(out[4]["silhouette"] - np.mean(widths)) < 1e-9
    assert CO.k_means(made.limit(3), 3, F.col("id")).count() == 2 and CO.k_means(made.limit(0), 3, F.col("id")).count() == 0


def test_logistic_equals_plain_newton(spark):
    made = rows(spark).cache()
    w, steps = CO.logistic(made, 3, "y")
    data = np.array([tuple(r) for r in made.collect()], float)
    x, y, v = np.column_stack([np.ones(len(data)), data[:, 2:]]), data[:, 1], np.zeros(4)
    ridge = np.diag([0.0, 1, 1, 1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ v)
    assert np.abs(w - v).max() < 1e-8 and steps < 30
    parted = made.withColumn("y", (F.col("x0") > 0).cast("int"))  # separable
    far, _ = CO.logistic(parted, 3, "y", l2=1e-4)
    assert np.isfinite(far).all() and far[1] > 5
    out = {r["held_out"]: r for r in CO.held_out_report(CO.dealt(made, F.col("id")), 3, "y").collect()}
    assert out[False]["n"] + out[True]["n"] == 500 and 70 < out[True]["n"] < 130 and out[True]["correct"] > 0.8 * out[True]["n"]


def test_points_in_half_open_intervals(spark):
    rng = np.random.default_rng(3)
    spans = [(i, day(int(a)), None if i % 7 == 0 else day(int(a + n))) for i, (a, n) in enumerate(zip(rng.integers(0, 900, 200), rng.integers(0, 300, 200), strict=True))]
    dates = [day(int(i)) for i in rng.integers(0, 1000, 150)]
    found = points_in_intervals(spark.createDataFrame([(d,) for d in dates], "d date"), spark.createDataFrame(spans, "i int, a date, b date"), "d", "a", "b", days=16)
    want = sorted((d, i) for d in set(dates) for i, a, b in spans if a <= d and (b is None or d < b))
    assert sorted((r["d"], r["i"]) for r in found.collect()) == want
    assert re.search(r"(BroadcastHash|SortMerge)Join \[_bin", found._jdf.queryExecution().executedPlan().toString())


def test_a_large_interval_join_is_counted(spark):
    spans = spark.range(100_000).select("id", F.date_add(F.lit(day(0)), (F.col("id") % 9_000).cast("int")).alias("a")).withColumn("b", F.date_add("a", 5))
    dates = spark.range(10_000).select(F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("d"))
    assert points_in_intervals(dates, spans, "d", "a", "b").count() == 500_000


def test_models_that_differ_in_scope_are_counted(spark):
    made = [("p", 1, day(d), s, m, 0.1 * s, float(s), float(d)) for d in range(3) for s in range(4) for m in ("a", "b")]
    table = lambda rows: spark.createDataFrame(rows, "phase string, fold int, as_of_date date, symbol int, model string, score double, target double, realized_return double")
    count = lambda rows: {r["check"]: r["violations"] for r in E.common_scope_violations(table(rows), ["a", "b"]).collect()}
    assert set(count(made).values()) == {0}
    odd = [r for r in made if (r[2], r[4]) != (day(2), "b")] + made[:1]
    odd[3] = (*odd[3][:6], None, odd[3][7])
    odd[4] = (*odd[4][:7], 9.0)
    assert count(odd) == {"differing_targets": 1, "differing_returns": 1, "repeated_rows": 1, "absent_models": 1}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300).cache()
    folder, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    keys, values = ["window_start", "event_type"], ["n", "total"]
    parts = [source.where(F.col("event_id") % 3 == i) for i in range(3)]
    for i, done in ((0, 1), (1, 2), (2, 3)):
        parts[i].coalesce(1).write.mode("append").parquet(folder)
        events.drain(events.event_windows(events.read_events(spark, folder, 1), late="4000 days"), out, state)
        told = {(r["window_start"], r["event_type"]): (r["n"], r["total"]) for r in events.latest(spark, out, keys, values).collect()}
        want = {(r["window_start"], r["event_type"]): (r["n"], r["total"]) for r in events.event_windows(source.where(F.col("event_id") % 3 < done)).collect()}
        assert told.keys() == want.keys() and all(told[k][0] == n and math.isclose(told[k][1], t, abs_tol=1e-9) for k, (n, t) in want.items())
