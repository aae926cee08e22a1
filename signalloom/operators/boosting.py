"""Boosted trees on histograms of gradients, for all folds and candidates at once.

Rows are binned once and kept as blobs of bytes. Each pass over them sums
gradients, weights and counts by (model, node, input, bin) within tasks, adds the
tasks' histograms up, finds each node's best split beside them, and sends one row
a node to the driver, which holds the trees. Trees grow by the largest gain first
up to a number of leaves: a pass asks for all nodes that could be next, so a tree
takes about as many passes as it is deep, whatever the number of models.

Rules: squared loss with row weights; a split needs a least count and weight on
either side; missing values go to the side that gains more, or with the larger
side where none was missing; leaves hold ``-rate * G / (H + l2)``. Bins end at
quantiles that are values of the rows, up to 254. Gains that are equal to ten
digits count as ties, for the first input and bin, and for the older node, so that the order of
sums doesn't show. A row without any observed input has no score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.numeric import clean_double, look_up
from ..shared import written
from .splits import MOST_FOLDS

#: Bins of values, and the one of missing values.
BINS, MISSING = 255, 255
#: Least weight of a side, trees after which rows get their sums anew, and histograms that one task adds.
LEAST_WEIGHT, REFRESH, FAN = 1e-3, 25, 32
TIE = 1e-10


@dataclass(frozen=True)
class Boosting:
    """A candidate's settings."""

    learning_rate: float = 0.05
    max_leaf_nodes: int = 7
    l2_regularization: float = 1.0


@dataclass
class Tree:
    """Nodes by number; a leaf has no input (-1). ``edge`` is the bin that goes left as the last one."""

    feature: np.ndarray
    edge: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            b = bins[rows, np.maximum(f, 0)]
            goes = np.where(b == MISSING, self.missing_left[at], b <= self.edge[at])
            at = np.where(f < 0, at, np.where(goes, self.left[at], self.right[at]))
        return at


def best_split(hist: np.ndarray, l2: float, least: int) -> tuple | None:
    """The split with the largest gain of a node's histogram (inputs, bins, [G, H, n]): input, bin, missing left, gain, and both sides."""
    total = hist[0].sum(axis=0)
    known = np.cumsum(hist[:, :BINS], axis=1)
    lost = hist[:, MISSING][:, None, :]
    left = np.stack([known, known + lost], axis=1)  # missing right, missing left
    right = total - left
    valid = (np.minimum(left[..., 2], right[..., 2]) >= least) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_WEIGHT)
    if not valid.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[0] ** 2 / (total[1] + l2)
    gain = np.where(valid, gain, -np.inf)
    most = gain.max()
    if most <= 0:
        return None
    f, side, b = np.unravel_index(np.argmax(gain >= most * (1 - TIE)), gain.shape)
    x, y = left[f, side, b], right[f, side, b]
    missing_left = bool(side) if hist[f, MISSING, 2] else bool(x[2] > y[2])
    return int(f), int(b), missing_left, float(gain[f, side, b]), x.tolist(), y.tolist()


class _Growing:
    """A tree that grows by the largest gain; nodes are numbered as they are made."""

    def __init__(self, settings: Boosting, least: int):
        self.settings, self.least = settings, least
        self.sums: list[list[float] | None] = [None]
        self.best: dict[int, tuple | None] = {}
        self.children: dict[int, tuple[int, int]] = {}

    def told(self, node: int, sums: list[float], best: tuple | None) -> None:
        self.sums[node] = sums
        self.best[node] = best

    def _open(self, node: int) -> bool:
        """Whether a node's best split isn't known and may exist."""
        return node not in self.best and (self.sums[node] is None or self.sums[node][2] >= 2 * self.least)

    def grow(self) -> tuple[list[int], set[int]]:
        """The nodes to split, in order, and those that must be looked at before the order is sure."""
        leaves, order, asked = [0], [], set()
        while len(leaves) < self.settings.max_leaf_nodes:
            asked |= {n for n in leaves if self._open(n)}
            able = [n for n in leaves if self.best.get(n)]
            if not able:
                break
            most = max(self.best[n][3] for n in able)
            node = min(n for n in able if self.best[n][3] >= most * (1 - TIE))
            if node not in self.children:
                self.children[node] = (len(self.sums), len(self.sums) + 1)
                self.sums += [self.best[node][4], self.best[node][5]]
            leaves.remove(node)
            leaves += self.children[node]
            order.append(node)
        return order, asked

    def tree(self, order: list[int], values: bool) -> Tree:
        """The tree of the splits in ``order`` with its nodes' own numbers."""
        n, split = len(self.sums), set(order)
        feature, edge, lost, left, right, value, depth = np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n, int), np.zeros(n, int), np.zeros(n), np.zeros(n, int)
        for node in order:
            feature[node], edge[node], lost[node] = self.best[node][:3]
            left[node], right[node] = self.children[node]
            depth[list(self.children[node])] = depth[node] + 1
        if values:
            for node, sums in enumerate(self.sums):
                if sums is not None and node not in split:
                    value[node] = -self.settings.learning_rate * sums[0] / (sums[1] + self.settings.l2_regularization)
        return Tree(feature, edge, lost, left, right, value, int(depth.max()))


@dataclass
class Boosted:
    """Fitted trees by (group, candidate), with the bins of each group."""

    keys: list[str]
    features: list[str]
    settings: list[Boosting]
    groups: DataFrame
    edges: dict[int, list[np.ndarray]]
    baseline: dict[int, float]
    trees: dict[tuple[int, int], list[Tree]] = field(default_factory=lambda: defaultdict(list))
    passes: int = 0

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` of known keys once a candidate, with feature_count, candidate and score."""
        some = sum((clean_double(f).isNotNull().cast("int") for f in self.features), F.lit(0))
        n = len(rows.columns)
        hidden = look_up(rows, self.groups, self.keys, MOST_FOLDS) if self.keys else rows.withColumn("_g", F.lit(0))
        hidden = hidden.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)], F.col("_g").alias("g"), some.alias("n"), *[clean_double(f).alias(f"x{i}") for i, f in enumerate(self.features)])
        sent = rows.sparkSession.sparkContext.broadcast((self.edges, self.baseline, dict(self.trees), len(self.settings), len(self.features)))
        schema = StructType([*hidden.schema.fields[: n + 2], StructField("s", ArrayType(DoubleType()))])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, baseline, trees, candidates, inputs = sent.value
            for batch in batches:
                g, out = batch.column("g").to_numpy(), np.zeros((batch.num_rows, candidates))
                x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(inputs)], axis=1)
                for one in np.unique(g):
                    at = np.flatnonzero(g == one)
                    bins = binned(x[at], edges[one])
                    for c in range(candidates):
                        out[at, c] = baseline[one] + sum((t.value[t.leaves(bins)] for t in trees.get((one, c), [])), np.zeros(len(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(list(out), pa.list_(pa.float64()))], names=[*batch.schema.names[: n + 2], "s"])

        made = hidden.mapInArrow(work, schema).select(*[F.col(f"c{i}") for i in range(n)], F.col("n"), F.posexplode("s").alias("candidate", "s"))
        return made.toDF(*rows.columns, "feature_count", "candidate", "score").withColumn("score", F.when(F.col("feature_count") > 0, F.col("score")))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many edges are below it; missing values have one of their own."""
    out = np.full(x.shape, MISSING, np.uint8)
    for f, e in enumerate(edges):
        known = ~np.isnan(x[:, f])
        out[known, f] = np.searchsorted(e, x[known, f], "left")
    return out


_BLOB = "g int, bins binary, y binary, w binary, sums binary"


def _pack(edges: dict, baseline: dict, inputs: int, candidates: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("g").to_numpy()
            column = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            x, y, w = np.stack([column(f"x{i}") for i in range(inputs)], axis=1), column("y"), column("w")
            out = []
            for one in np.unique(g):
                at = g == one
                out.append({"g": int(one), "bins": binned(x[at], edges[one]).tobytes(), "y": y[at].tobytes(), "w": w[at].tobytes(), "sums": np.full((candidates, at.sum()), baseline[one]).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("g", pa.int32()), *[(c, pa.binary()) for c in ("bins", "y", "w", "sums")]]))

    return work


def _blobs(batches: Iterator[pa.RecordBatch], inputs: int, candidates: int, trees: dict) -> Iterator[tuple]:
    """Each blob's group, bins, targets, weights and sums with the trees added."""
    for batch in batches:
        for r in batch.to_pylist():
            y = np.frombuffer(r["y"])
            bins, sums = np.frombuffer(r["bins"], np.uint8).reshape(len(y), inputs), np.frombuffer(r["sums"]).reshape(candidates, len(y)).copy()
            for c in range(candidates):
                for t in trees.get((r["g"], c), ()):
                    sums[c] += t.value[t.leaves(bins)]
            yield r["g"], bins, y, np.frombuffer(r["w"]), sums


def _histograms(inputs: int, candidates: int, trees: dict, partial: dict):
    """Histograms of a task for the nodes that are asked for: (g, candidate) -> tree, {node: place}."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[tuple[int, int], np.ndarray] = {}
        for g, bins, y, w, sums in _blobs(batches, inputs, candidates, trees):
            for c in range(candidates):
                if (g, c) not in partial:
                    continue
                tree, asked = partial[g, c]
                place = np.full(len(tree.feature), -1)
                place[list(asked)] = range(len(asked))
                at = place[tree.leaves(bins)]
                rows = np.flatnonzero(at >= 0)
                hist = found.setdefault((g, c), np.zeros((len(asked), inputs, BINS + 1, 3)))
                slot = (at[rows, None] * inputs + np.arange(inputs)) * (BINS + 1) + bins[rows]
                size = hist.size // 3
                for k, v in enumerate((w[rows] * (sums[c, rows] - y[rows]), w[rows], None)):
                    hist[..., k] += np.bincount(slot.ravel(), None if v is None else np.repeat(v, inputs), size).reshape(hist.shape[:3])
        here = TaskContext.get().partitionId()
        rows = [{"g": g, "c": c, "node": node, "task": here, "hist": h[k].tobytes()} for (g, c), h in found.items() for k, node in enumerate(partial[g, c][1])]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("g", pa.int32()), ("c", pa.int32()), ("node", pa.int32()), ("task", pa.int32()), ("hist", pa.binary())]))

    return work


def _refresh(inputs: int, candidates: int, trees: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [s.tobytes() for *_, s in _blobs(iter([batch]), inputs, candidates, trees)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.binary())], names=batch.schema.names)

    return work


def fit_boosted(train: DataFrame, keys: list[str], features: list[str], target: str, settings: list[Boosting], *, rounds: int = 200, least: int = 20, weight: str = "weight") -> Boosted:
    """Trees for each key of ``train`` and each candidate; rows without a target are left out."""
    spark, inputs, candidates = train.sparkSession, len(features), len(settings)
    rows = train.where(F.col(target).isNotNull()).select(*keys, F.col(target).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), *[clean_double(f).alias(f"x{i}") for i, f in enumerate(features)])
    rows = written(rows, "boosting")
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    figures = [(F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("base"), *[F.percentile_approx(f"x{i}", shares, 10_000).alias(f"e{i}") for i in range(inputs)], *[F.max(f"x{i}").alias(f"m{i}") for i in range(inputs)]]
    each = rows.groupBy(*keys).agg(*figures).orderBy(*keys or ["base"]).limit(MOST_FOLDS + 1).collect()
    if len(each) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} groups")
    each = [r for r in each if r["base"] is not None]
    edges = {g: [np.unique([v for v in r[f"e{i}"] or [] if v < r[f"m{i}"]]) for i in range(inputs)] for g, r in enumerate(each)}
    groups = spark.createDataFrame([(*[r[k] for k in keys], g) for g, r in enumerate(each)], StructType([*[rows.schema[k] for k in keys], StructField("_g", spark.range(0).selectExpr("int(id) AS g").schema["g"].dataType)]))
    out = Boosted(keys, features, settings, groups, edges, {g: r["base"] for g, r in enumerate(each)})
    if not each:
        return out
    keyed = (look_up(rows, groups, keys, MOST_FOLDS) if keys else rows.withColumn("_g", F.lit(0))).withColumnRenamed("_g", "g")
    blobs = written(keyed.select("g", "y", "w", *[f"x{i}" for i in range(inputs)]).mapInArrow(_pack(edges, out.baseline, inputs, candidates), _BLOB), "blobs").persist(StorageLevel.MEMORY_AND_DISK)
    models = [(g, c) for g in range(len(each)) for c in range(candidates)]
    since: dict[tuple[int, int], list[Tree]] = {m: [] for m in models}
    for turn in range(rounds):
        if turn and turn % REFRESH == 0:
            before, blobs = blobs, written(blobs.mapInArrow(_refresh(inputs, candidates, since), _BLOB), "blobs").persist(StorageLevel.MEMORY_AND_DISK)
            before.unpersist()
            since = {m: [] for m in models}
        growing = {m: _Growing(settings[m[1]], least) for m in models}
        orders: dict[tuple[int, int], list[int]] = {}
        while True:
            partial = {}
            for m, tree in growing.items():
                orders[m], asked = tree.grow()
                if asked:
                    partial[m] = (tree.tree(orders[m], False), sorted(asked))
            if not partial:
                break
            for r in _splits(blobs, inputs, candidates, since, partial, settings, least):
                best = None if r["feature"] is None else (r["feature"], r["edge"], r["missing_left"], r["gain"], r["left"], r["right"])
                growing[r["g"], r["c"]].told(r["node"], r["total"], best)
            out.passes += 1
        for m, tree in growing.items():
            done = tree.tree(orders[m], True)
            since[m].append(done)
            out.trees[m].append(done)
    blobs.unpersist()
    return out


_FOUND = "g int, c int, node int, total array<double>, feature int, edge int, missing_left boolean, gain double, left array<double>, right array<double>"


def _splits(blobs: DataFrame, inputs: int, candidates: int, trees: dict, partial: dict, settings: list[Boosting], least: int) -> list:
    """One row a node that is asked for: its sums and its best split."""
    asked = {m: (t, nodes) for m, (t, nodes) in partial.items()}
    parts, tasks = blobs.mapInArrow(_histograms(inputs, candidates, trees, asked), "g int, c int, node int, task int, hist binary"), blobs.rdd.getNumPartitions()
    names = ("g", "c", "node")

    def total(table: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(b.as_py()) for b in table["hist"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table[c][:1] for c in (*names, "task")}, "hist": pa.array([total(table).tobytes()], pa.binary())})

    while tasks > FAN:
        parts = parts.withColumn("task", F.expr(f"task div {FAN}")).groupBy(*names, "task").applyInArrow(add, "g int, c int, node int, task int, hist binary")
        tasks = -(-tasks // FAN)
    kinds = pa.schema([("g", pa.int32()), ("c", pa.int32()), ("node", pa.int32()), ("total", pa.list_(pa.float64())), ("feature", pa.int32()), ("edge", pa.int32()), ("missing_left", pa.bool_()), ("gain", pa.float64()), ("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))])

    def split(table: pa.Table) -> pa.Table:
        hist = total(table).reshape(inputs, BINS + 1, 3)
        row = {c: table[c][0].as_py() for c in names}
        best = best_split(hist, settings[row["c"]].l2_regularization, least) or (None,) * 6
        row |= dict(zip(("feature", "edge", "missing_left", "gain", "left", "right"), best, strict=True)) | {"total": hist[0].sum(axis=0).tolist()}
        return pa.Table.from_pylist([row], schema=kinds)

    return parts.groupBy(*names).applyInArrow(split, _FOUND).collect()
