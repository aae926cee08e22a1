"""Boosted trees by depth, as Spark's ``GBTRegressor`` grows them, in one job for all rounds.

Spark takes a job a level: 600 for 200 rounds of depth 3, each mostly its own
start. Here the tasks of one barrier stage keep their rows' bins and go through
all rounds together. At each level they add up the sums of a node's bins, never
rows, and find the same splits. They do so by connections to the first task,
since each ``allGather`` sleeps for a second; if one breaks, Spark runs the stage
again. The stage needs as many free cores as the cluster has, and so a fixed
number of executors.

Rules are Spark's: variance as impurity, a least count of rows on either side, the
first tree on the target and further ones, times ``step``, on twice the residuals,
thresholds midway between values at equal shares of the weight. These come from
all rows, where Spark draws from more than 65,025. Gains that are equal to ten
digits count as ties, for the first input and threshold.
"""

from __future__ import annotations

import os
import socket
from collections import defaultdict
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of an input, and the ranges that its values are put in order by.
BINS, RANGES = 255, 256
TIE = 1e-10


def thresholds(rows: DataFrame, inputs: list[str], weight: str) -> list[np.ndarray]:
    """Spark's thresholds of each input: all midpoints, or where sums of weights come closest to equal shares, each value ends one at most."""
    from pyspark.ml.feature import Bucketizer

    spark = rows.sparkSession
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    n, total, *cuts = rows.agg(F.count("*"), F.sum(weight), *[F.percentile_approx(x, shares, 1000) for x in inputs]).first()
    if not n:
        raise ValueError("no rows to grow trees on")
    most, stride = min(BINS, n) - 1, total / min(BINS, n)
    ranges = [[-np.inf, *np.unique(c).tolist(), np.inf] for c in cuts]
    placed = Bucketizer(splitsArray=ranges, inputCols=inputs, outputCols=[f"_r_{x}" for x in inputs]).transform(rows)
    cells = [F.struct(F.lit(i).alias("f"), F.col(f"_r_{x}").cast("int").alias("r"), F.col(x).alias("v"), F.col(weight).alias("w")) for i, x in enumerate(inputs)]
    order = Window.partitionBy("f", "r").orderBy("v")
    values = placed.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("f", "r", "v").agg(F.sum("w").alias("w"))
    values = values.select("f", "r", "v", "w", F.sum("w").over(order).alias("upto"), F.row_number().over(order).alias("place"), F.lead("v").over(order).alias("next")).persist()
    spans, before, ends = values.groupBy("f", "r").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("v").alias("v")).orderBy("f", "r").collect(), [], defaultdict(lambda: (0.0, 0))
    for s in spans:
        w, k = ends[s["f"]]
        before.append((s["f"], s["r"], w, k))
        ends[s["f"]] = w + s["w"], k + s["n"]
    values = values.join(F.broadcast(spark.createDataFrame(before, "f int, r int, w0 double, n0 long")), ["f", "r"])
    values = values.select("f", "v", "next", (F.col("n0") + F.col("place")).alias("place"), (F.col("w0") + F.col("upto") - F.col("w")).alias("low"), (F.col("w0") + F.col("upto")).alias("high"))
    share = lambda c: F.floor(F.col(c) / stride)
    crossing, wanted = values.where(share("low") < share("high")).select("f", "place", "low", "high", share("low").alias("a"), share("high").alias("b")).orderBy("f", "place").collect(), []
    for f in range(len(inputs)):
        last = ends[f][1] - 1
        at = 0
        for r in (r for r in crossing if r["f"] == f and last > most):
            for k in range(r["a"] + 1, r["b"] + 1):
                at = max(at + 1, r["place"] - (k * stride - r["low"] < r["high"] - k * stride))
                wanted += [(f, at)] * (at <= last)
        wanted += [(f, i) for i in range(1, last + 1) if last <= most]
    found = values.join(F.broadcast(spark.createDataFrame(wanted, "f int, place long")), ["f", "place"]).orderBy("f", "place").collect()
    values.unpersist()
    begins = [(s["f"], s["v"]) for s in spans]
    after = lambda f, v: min(b for g, b in begins if g == f and b > v)
    return [np.array([(r["v"] + (after(f, r["v"]) if r["next"] is None else r["next"])) / 2 for r in found if r["f"] == f]) for f in range(len(inputs))]


def split(hist: np.ndarray, starts: np.ndarray, leaf: int) -> tuple | None:
    """The split with the largest gain of a node's bins ([weight, weighted target, rows] each): input, bin, and the left side's sums."""
    best = None
    with np.errstate(divide="ignore", invalid="ignore"):
        for f, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            left = np.cumsum(hist[a:b], axis=0)
            left, total = left[:-1], left[-1]
            right = total - left
            gain = left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0] - total[1] ** 2 / total[0]
            gain = np.where((np.minimum(left[:, 2], right[:, 2]) >= leaf) & (gain > 0), gain, 0.0)
            most = gain.max(initial=0.0)
            if most > 0 and (best is None or best[0] < most * (1 - TIE)):
                k = int(np.argmax(gain >= most * (1 - TIE)))
                best = (most, f, k, left[k])
    return best and best[1:]


def _adding(context: BarrierTaskContext, key: bytes) -> tuple[Callable[[np.ndarray], np.ndarray], list[Connection]]:
    """A function that gives each task of the stage the sum of all tasks' arrays, in the tasks' order, and the connections it uses."""
    here, infos = context.partitionId(), context.getTaskInfos()
    listener = None if here else Listener(("", 0), backlog=len(infos), authkey=key)
    port = context.allGather("" if here else str(listener.address[1]))[0]
    if here:
        links = [Client((infos[0].address.rpartition(":")[0].strip("[]"), int(port)), authkey=key)]
        links[0].send(here)
    else:
        links = [listener.accept() for _ in infos[1:]]
        links = [c for _, c in sorted(((c.recv(), c) for c in links), key=lambda x: x[0])]
        listener.close()
    for c in links:
        with socket.socket(fileno=os.dup(c.fileno())) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def total(own: np.ndarray) -> np.ndarray:
        if here:
            links[0].send_bytes(own.tobytes())
            return np.frombuffer(links[0].recv_bytes()).reshape(own.shape)
        out = own + sum(np.frombuffer(c.recv_bytes()).reshape(own.shape) for c in links)
        for c in links:
            c.send_bytes(out.tobytes())
        return out

    return total, links


def _grow(edges: list[np.ndarray], rounds: int, depth: int, step: float, leaf: int):
    key = os.urandom(32)
    starts = np.cumsum([0, *(len(e) + 1 for e in edges)])
    size, inputs = int(starts[-1]), len(edges)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        parts = [(np.stack([np.searchsorted(e, b.column(f).to_numpy(), "left").astype(np.uint8) for f, e in enumerate(edges)]), b.column(inputs).to_numpy(), b.column(inputs + 1).to_numpy()) for b in batches if b.num_rows]
        bins, y, w = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True)) if parts else (np.zeros((inputs, 0), np.uint8), np.zeros(0), np.zeros(0))
        guess, made = np.zeros(len(y)), []
        total, links = _adding(context, key)

        def sums(place: np.ndarray, nodes: int, r: np.ndarray) -> np.ndarray:
            """Of all tasks, the sums of the nodes' bins; a row's place is its node's, or -1."""
            own, rows = np.zeros((3, nodes * size)), np.flatnonzero(place >= 0)
            at, kinds = place[rows] * size, (w[rows], (w * r)[rows], None)
            for f in range(inputs):
                slot = at + (bins[f, rows] + starts[f])
                for k, v in enumerate(kinds):
                    own[k] += np.bincount(slot, v, nodes * size)
            return total(own).reshape(3, nodes, size).transpose(1, 2, 0)

        for turn in range(rounds):
            r, at = 2 * (y - guess) if turn else y, np.zeros(len(y), np.int64)
            feature, edge, value = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)
            hists = {0: sums(at, 1, r)[0]}
            root = hists[0][: starts[1]].sum(axis=0)
            value[0] = root[1] / root[0]
            for level in range(depth):
                halved = []
                for node, hist in hists.items():
                    if found := split(hist, starts, leaf):
                        f, k, left = found
                        right = hist[starts[f] : starts[f + 1]].sum(axis=0) - left
                        feature[node], edge[node] = f, edges[f][k]
                        value[2 * node + 1], value[2 * node + 2] = left[1] / left[0], right[1] / right[0]
                        rows = np.flatnonzero(at == node)
                        at[rows] = 2 * node + 1 + (bins[f, rows] > k)
                        halved.append(node)
                if not halved or level == depth - 1:
                    break
                place = np.full(len(feature), -1)
                place[[2 * n + 1 for n in halved]] = range(len(halved))
                lefts = sums(place[at], len(halved), r)
                hists = {c: h for n, x in zip(halved, lefts, strict=True) for c, h in ((2 * n + 1, x), (2 * n + 2, hists[n] - x))}
            value *= step if turn else 1.0
            guess += value[at]
            made.append({"turn": turn, "feature": feature.tolist(), "edge": edge.tolist(), "value": value.tolist()})
        for c in links:
            c.close()
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("turn", pa.int32()), ("feature", pa.list_(pa.int32())), ("edge", pa.list_(pa.float64())), ("value", pa.list_(pa.float64()))]))

    return work


def grow(rows: DataFrame, inputs: list[str], target: str, weight: str, *, rounds: int, depth: int, step: float, leaf: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each tree's inputs, thresholds and values by node; node k has the children 2k + 1 and 2k + 2, and a leaf the input -1."""
    edges = thresholds(rows, inputs, weight)
    dealt = rows.select(*inputs, target, weight).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    made = dealt.mapInArrow(_grow(edges, rounds, depth, step, leaf), "turn int, feature array<int>, edge array<double>, value array<double>", barrier=True).collect()
    return [tuple(np.array(r[c]) for c in ("feature", "edge", "value")) for r in sorted(made, key=lambda r: r["turn"])]


def added(df: DataFrame, inputs: list[str], trees: list[tuple], depth: int, name: str) -> DataFrame:
    """``df`` with the sum of the trees' values as ``name``; it has the inputs as columns, which go."""
    kept = [c for c in df.columns if c not in inputs]
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows, out = np.stack([batch.column(c).to_numpy() for c in inputs]), np.arange(batch.num_rows), np.zeros(batch.num_rows)
            for feature, edge, value in sent.value:
                at = np.zeros(len(rows), np.int64)
                for _ in range(depth):
                    f = feature[at]
                    at = np.where(f < 0, at, 2 * at + 1 + (x[f, rows] > edge[at]))
                out += value[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], names=[*kept, name])

    return df.select(*kept, *inputs).mapInArrow(work, df.select(*kept).withColumn(name, F.lit(0.0)).schema)
