"""Companion analysis of a panel's features: description, clusters of features, clusters of rows, and a classifier.

Rows are read by Spark in every step; what comes back is bounded by the number of
features and clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_double, pearson, unpivoted
from ..shared import written


def describe(panel: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: count, mean, sample deviation, least, quartiles and greatest of what isn't missing."""
    some = unpivoted(panel, [], features).where("value IS NOT NULL")
    quantile = lambda q: F.percentile("value", F.lit(q))
    return some.groupBy("feature").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"), F.max("value").alias("max"),
    )


def correlations(panel: DataFrame, features: list[str]) -> DataFrame:
    """left, right, n, r: Pearson's correlation of each pair of features on their complete rows, null where one is constant."""
    clean = panel.select(*[clean_double(f).alias(f) for f in features])
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(features) for b in features[i + 1 :]]
    long = clean.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("left", "right").agg(F.count("*").alias("n"), pearson("x", "y").alias("r"))


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of the nearest clusters by their mean distance.

    A merged cluster gets the next number from n on; its distances are the
    sizes' weighted means of its parts'. Ties go to the lowest pair of numbers.
    """
    n = len(distance)
    far = {(i, j): float(distance[i, j]) for i in range(n) for j in range(i + 1, n)}
    size, out = dict.fromkeys(range(n), 1), []
    for new in range(n, 2 * n - 1):
        least = min(far.values())
        i, j = min(pair for pair, d in far.items() if d <= least + 1e-12)
        out.append((i, j, far.pop((i, j)), size[i] + size[j]))
        for k in size:
            if k not in (i, j):
                a, b = far.pop((min(i, k), max(i, k))), far.pop((min(j, k), max(j, k)))
                far[k, new] = (size[i] * a + size[j] * b) / (size[i] + size[j])
        size[new] = size.pop(i) + size.pop(j)
    return out


def feature_linkage(panel: DataFrame, features: list[str]) -> DataFrame:
    """Average linkage of features on 1 - abs(correlation): step, left, right, height, size; a pair without a correlation is at 1."""
    at = {f: i for i, f in enumerate(features)}
    distance = np.ones((len(features), len(features)))
    for r in correlations(panel, features).collect():  # one row a pair of features
        distance[at[r["left"]], at[r["right"]]] = 1.0 - abs(r["r"]) if r["r"] is not None else 1.0
    merges = [(step, *m) for step, m in enumerate(average_linkage(distance), 1)]
    return panel.sparkSession.createDataFrame(merges, "step int, left int, right int, height double, size int")


def standardised(panel: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Complete rows with features to mean 0 and population deviation 1, a constant one to 0: keys and x0, x1, ..."""
    clean = panel.select(*keys, *[clean_double(f).alias(f"x{i}") for i, f in enumerate(features)]).dropna(subset=[f"x{i}" for i in range(len(features))])
    clean = written(clean, "complete")
    s = clean.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(features)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [((F.col(f"x{i}") - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"]) if s[f"s{i}"] else F.lit(0.0)).alias(f"x{i}") for i in range(len(features))]
    return clean.select(*keys, *scaled)


def _matrix(batch: pa.RecordBatch, inputs: int) -> np.ndarray:
    return np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(inputs)], axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far


def _over_tasks(rows: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    kinds = pa.schema([(name, pa.int32() if kind == "int" else pa.float64()) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for key, value in work(batch).items():
                total[key] = total[key] + value if key in total else value
        if total:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*key, *value.tolist()), strict=True)) for key, value in total.items()], schema=kinds)

    return rows.mapInArrow(run, schema)


def _moments(rows: DataFrame, inputs: int, centres: dict[int, np.ndarray]) -> dict:
    """By (k, cluster): rows, sums of inputs, and the sum of squares, of rows next to each centre, for all k in one scan."""
    names = ["n", *[f"s{i}" for i in range(inputs)], "q"]
    schema = ", ".join(["k int", "cluster int", *[f"{c} double" for c in names]])

    def work(batch: pa.RecordBatch) -> dict:
        x, out = _matrix(batch, inputs), {}
        for k, c in centres.items():
            at, _ = _nearest(x, c)
            sums = np.stack([np.bincount(at, v, k) for v in (np.ones(len(x)), *x.T, (x * x).sum(axis=1))], axis=1)
            out |= {(k, i): sums[i] for i in range(k) if sums[i, 0]}
        return out

    told = _over_tasks(rows, work, schema).groupBy("k", "cluster").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {(r["k"], r["cluster"]): np.array([r[c] for c in names]) for r in told}


def _spread_out(rows: DataFrame, inputs: int, key: Column, most: int) -> np.ndarray:
    """Up to ``most`` different rows, each farthest from those before it; ties go to the lesser values."""
    xs = [F.col(f"x{i}") for i in range(inputs)]
    first = rows.orderBy(F.xxhash64(key), *xs).first()
    chosen = [[first[f"x{i}"] for i in range(inputs)]] if first else []
    while chosen and len(chosen) < most:
        far = F.least(*[sum((F.pow(x - F.lit(v), F.lit(2)) for x, v in zip(xs, c, strict=True)), F.lit(0.0)) for c in chosen], F.lit(float("inf")))
        next_ = rows.select(*xs, far.alias("far")).orderBy(F.desc("far"), *xs).first()
        if next_["far"] <= 0:
            break
        chosen.append([next_[f"x{i}"] for i in range(inputs)])
    return np.array(chosen)


def k_means(rows: DataFrame, inputs: int, key: Column, ks: range = range(2, 11), *, most: int = 50, close: float = 1e-9) -> DataFrame:
    """For each k: rounds, inertia and mean silhouette of squared distances, of ``rows`` (x0, x1, ...).

    The first centre is the row with the least hash of ``key``, each further one
    the row farthest from those before; all k move their centres in the same scans until none
    moves by more than ``close``. A centre without rows stays. The silhouette takes a row's
    mean distance to a cluster from the cluster's count, sums and squares.
    """
    starts = _spread_out(rows, inputs, key, max(ks))
    centres = {k: starts[:k].copy() for k in ks if k <= len(starts)}
    rounds, moving = dict.fromkeys(centres, 0), dict(centres)
    for _ in range(most):
        found = _moments(rows, inputs, moving)
        for k in list(moving):
            new = np.array([found[k, i][1:-1] / found[k, i][0] if (k, i) in found else centres[k][i] for i in range(k)])
            rounds[k] += 1
            still = np.abs(new - centres[k]).max() <= close
            centres[k] = new
            if still:
                del moving[k]
            else:
                moving[k] = new
        if not moving:
            break
    moments = _moments(rows, inputs, centres)

    def work(batch: pa.RecordBatch) -> dict:
        x, out = _matrix(batch, inputs), {}
        for k, c in centres.items():
            at, far = _nearest(x, c)
            m = np.array([moments.get((k, i), np.zeros(inputs + 2)) for i in range(k)])
            n = np.maximum(m[:, 0], 1)
            mean = (x * x).sum(axis=1)[:, None] - 2 * x @ (m[:, 1:-1] / n[:, None]).T + m[:, -1] / n
            mean[:, m[:, 0] == 0] = np.inf
            own, row = m[at, 0], np.arange(len(x))
            a = mean[row, at] * own / np.maximum(own - 1, 1)
            mean[row, at] = np.inf
            b = mean.min(axis=1)
            width = np.where((own > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            out[k,] = np.array([len(x), far[row, at].sum(), width.sum()])
        return out

    told = _over_tasks(rows, work, "k int, n double, inertia double, width double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("width").alias("width"))
    count = F.create_map(*[F.lit(v) for k, r in rounds.items() for v in (k, r)]) if rounds else F.lit(None).cast("map<int,int>")
    return told.select("k", F.get(F.map_values(F.map_filter(count, lambda key, _: key == F.col("k"))), F.lit(0)).cast("int").alias("rounds"), F.col("n").cast("long").alias("n"), "inertia", (F.col("width") / F.col("n")).alias("silhouette"))


def dealt(rows: DataFrame, key: Column, parts: int = 5) -> DataFrame:
    """``rows`` with ``held_out``: one in ``parts`` by the first 32 bits of the key's MD5, so each class loses the same share about, whatever Spark's partitions."""
    return rows.withColumn("held_out", F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % parts == 0)


def logistic(rows: DataFrame, inputs: int, label: str, *, l2: float = 1.0, most: int = 50, close: float = 1e-10) -> tuple[np.ndarray, int]:
    """Intercept and coefficients of the logistic regression with ``l2 / 2 * |w|^2`` (not on the intercept), and its steps.

    Newton steps from sums of products by task; a step that doesn't lower the loss
    is halved, so that separable rows come to rest too.
    """
    n = inputs + 1
    places = [(i, j) for i in range(n) for j in range(i, n)]
    names = ["loss", *[f"g{i}" for i in range(n)], *[f"h{i}_{j}" for i, j in places]]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(batch: pa.RecordBatch) -> dict:
            x, y = np.column_stack([np.ones(batch.num_rows), _matrix(batch, inputs)]), batch.column(label).to_numpy(zero_copy_only=False).astype(float)
            z = x @ w
            p = 0.5 * (1 + np.tanh(z / 2))
            h = (x * (p * (1 - p))[:, None]).T @ x
            return {(): np.array([(np.logaddexp(0, z) - y * z).sum(), *(x.T @ (p - y)), *[h[i, j] for i, j in places]])}

        r = _over_tasks(rows, work, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
        if r["loss"] is None:
            raise ValueError("no rows")
        h = np.zeros((n, n))
        for i, j in places:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        ridge = l2 * np.array([0.0] + [1.0] * inputs)
        return r["loss"] + 0.5 * (ridge * w * w).sum(), np.array([r[f"g{i}"] for i in range(n)]) + ridge * w, h + np.diag(ridge)

    w = np.zeros(n)
    loss, gradient, hessian = sums(w)
    for step in range(1, most + 1):
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.abs(move).max() <= close:
            return w, step
        share = 1.0
        while True:
            next_loss, next_gradient, next_hessian = sums(w - share * move)
            if next_loss <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        w, loss, gradient, hessian = w - share * move, next_loss, next_gradient, next_hessian
    return w, most


def probability(inputs: int, w: np.ndarray) -> Column:
    z = F.lit(float(w[0]))
    for i in range(inputs):
        z = z + F.col(f"x{i}") * F.lit(float(w[i + 1]))
    return 1 / (1 + F.exp(-z))


def held_out_report(rows: DataFrame, inputs: int, label: str, **settings) -> DataFrame:
    """held_out, n, positives, correct and mean loss by half, of a classifier fitted on the rows that aren't held out."""
    rows = written(rows, "dealt")
    w, _ = logistic(rows.where("NOT held_out"), inputs, label, **settings)
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), probability(inputs, w)))
    told = rows.withColumn("p", p).withColumn("y", F.col(label).cast("double"))
    return told.groupBy("held_out").agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.sum(((F.col("p") >= 0.5) == F.col(label).cast("boolean")).cast("long")).alias("correct"),
        F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("loss"),
    )
