"""Collision counting against all pairs, on odd vectors, with split buckets, and its calibration."""

from __future__ import annotations

import math
import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalloom.llm import collisions  # noqa: E402

KINDS = "vec_id long, embedding array<float>, label int, n_links string, class_id int, keys string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, "y") for i, v, label in rows], KINDS)


def brute(rows, cosine):
    """(vec_id, n_links, component_id, kept) of each row, from all pairs."""
    sound = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if s else None for (_, v, _), s in zip(rows, sound, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vec_id, len(near[i]), least, vec_id is not None and vec_id == least))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def crowded(seed, n, dims=16, noise=0.08):
    """Vectors of one label around a few centres, with chains of neighbours and one large group."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dims))
    rows = [(i, centres[0 if i % 3 == 0 else rng.integers(len(centres))] + noise * rng.standard_normal(dims) * rng.integers(0, 4), int(i % 2)) for i in range(n)]
    return [(i, v.tolist(), label) for i, v, label in rows]


def test_all_pairs_are_found(spark):
    rows = crowded(1, 400)
    want = brute(rows, 0.93)
    assert sum(r[1] for r in want) > 1000
    assert found(collisions.near_vectors(vectors(spark, rows), cosine=0.93, recall=0.99999)) == want
    links = [{r[0]: r[1] for r in x} for x in (found(collisions.near_vectors(vectors(spark, rows), cosine=0.93)), want)]
    assert all(links[0][i] <= n for i, n in links[1].items()) and sum(links[0].values()) >= 0.99 * sum(links[1].values())


def test_buckets_that_are_split_give_the_same(spark):
    rows = crowded(2, 150)
    assert found(collisions.near_vectors(vectors(spark, rows), cosine=0.9, recall=0.99999, bucket_rows=7)) == brute(rows, 0.9)


def test_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.5], [1.0, 0.01, 0.0, 0.5]
    rows = [
        (1, a, 0), (2, a, 0), (2, a, 0), (None, a, 0), (3, b, 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [], 0), (8, [0.0] * 4, 0), (9, [1.0, None, 0.0, 0.5], 0),
        (10, [math.nan, 0.0, 0.0, 0.5], 0), (11, [math.inf, 0.0, 0.0, 0.5], 0), (12, a[:3], 0), (13, [2e30, 0.0, 0.0, 1e30], 0), (14, [-1.0, 0.0, 0.0, -0.5], 0), (None, [0.0, 1.0, 0.0, 0.0], 0), (15, [1e-30, 0.0, -0.0, 5e-31], 0),
    ]
    assert found(collisions.near_vectors(vectors(spark, rows))) == brute(rows, 0.93)
    assert collisions.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_a_chosen_recall_holds_at_the_threshold_at_any_size():
    rng = np.random.default_rng(5)
    for rows in (100, 5_000, 10**6):
        plan = collisions.calibrated(rows, 0.93, 0.95)
        a = collisions.unit(rng.standard_normal((3000, 48)))
        side = rng.standard_normal((3000, 48))
        side -= (side * a).sum(axis=1, keepdims=True) * a
        b = collisions.unit(0.93 * a + math.sqrt(1 - 0.93**2) * collisions.unit(side))
        met = (collisions.cell_keys(a, plan) == collisions.cell_keys(b, plan)).any(axis=1)
        counted = (np.abs(collisions.projections(a, collisions.COUNTED) - collisions.projections(b, collisions.COUNTED)) <= plan.window).sum(axis=1) >= plan.least
        assert (met & counted).mean() >= 0.93
    assert collisions.calibrated(10**6, 0.93, 0.95).depth > plan.depth - 1 >= collisions.calibrated(100, 0.93, 0.95).depth


def test_windows_are_counted_by_definition():
    rng = np.random.default_rng(6)
    q, o = rng.standard_normal((7, 5)), rng.standard_normal((20, 5))
    o[3] = q[2]
    assert (collisions.collisions(q, o, 0.7) == (np.abs(q[:, None] - o[None]) <= 0.7).sum(axis=2)).all()


def test_spans():
    i, j = np.array([5, 2, 8, 7, 5]), np.array([1, 6, 7, 6, 9])
    assert collisions.spans(10, i, j).tolist() == [0, 1, 2, 3, 4, 1, 2, 2, 2, 1]
