"""Near-duplicate vectors of one label, by counting collisions of one-dimensional projections.

The difference of two unit vectors at the least cosine is a chord of known
length, so their projections on a random direction differ by a normal variable
of known deviation. From that all parameters follow (``calibrated``): directions
come in groups, and vectors that fall into one cell of a group meet in a bucket;
there each direction is sorted, each vector is the centre of a window in it,
collisions in the windows are counted for each pair, and pairs whose count isn't
under the calibrated one are verified by their exact cosine. The cells grow finer
with the rows, so that a bucket holds about as many unrelated vectors at every
size; the recall asked for stays. A pair that meets in several buckets is counted
in the first one only. Buckets give counts a vector and links that span what is
connected in them, never all pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, and vectors whose label is null, link with nothing; vectors of
different lengths don't link; equal vectors of a label are one class that is
compared once, and each of its rows counts the others; rows without an id count
as vectors, and a component's id is the smallest id in it, null where there is
none; rows that share an id are vectors each; a cosine of exactly the threshold
links; an empty table has no rows; further columns, whatever their names, are
left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, stored
from .simhash import connected

#: Directions in which collisions are counted, and unrelated vectors of a bucket, about.
COUNTED, UNRELATED = 32, 256
#: Vectors of a bucket before it is split and joined group by group; queries at a time.
BUCKET_ROWS, QUERIES = 2048, 128
#: Widths of a cell and of half a window, in deviations of a pair at the least cosine.
CELL, WINDOW = 4.3, 2.0
#: Steps of a component and of a direction: sums of their products are exact whatever their order, so a lost task deals as before.
FINE, COARSE = 1 << 20, 1 << 12


@dataclass(frozen=True)
class Plan:
    depth: int  # directions a group
    groups: int
    cell: float
    window: float
    least: int  # collisions of a candidate
    cosine: float

    @property
    def directions(self) -> int:
        return max(self.depth * self.groups, COUNTED)


def _together(deviation: float, cell: float) -> float:
    """The chance that a normal difference leaves two values in one cell of a randomly shifted grid."""
    x = cell / deviation
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def calibrated(rows: int, cosine: float, recall: float) -> Plan:
    """Cells, windows and counts under which a pair at the least cosine is found with a chance of ``recall`` at least.

    Half of the misses allowed go to the buckets and half to the count. Vectors at
    right angles stand for unrelated ones.
    """
    deviation, miss = math.sqrt(2 - 2 * cosine), (1 - recall) / 2
    cell, window = CELL * deviation, WINDOW * deviation
    near, far = _together(deviation, cell), _together(math.sqrt(2), cell)
    depth = max(1, math.ceil(math.log(max(rows, 1) / UNRELATED) / -math.log(far))) if rows > UNRELATED else 1
    groups = math.ceil(math.log(miss) / math.log1p(-(near**depth)))
    inside, lost, least = math.erf(WINDOW / math.sqrt(2)), 0.0, 0
    while least < COUNTED:
        lost += math.comb(COUNTED, least) * inside**least * (1 - inside) ** (COUNTED - least)
        if lost > miss:
            break
        least += 1
    return Plan(depth, groups, cell, window, least, cosine)


@cache
def _directions(dims: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of whole numbers, and a shift for each."""
    rng = np.random.default_rng([11, dims])
    shifts = np.random.default_rng([12, dims]).random(count)
    return np.rint(rng.standard_normal((count, dims)) * COARSE).T.copy(), shifts


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, with sums that are rounded once."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.array([math.sqrt(math.fsum(r)) for r in (scaled * scaled).tolist()])[:, None]


def projections(units: np.ndarray, count: int) -> np.ndarray:
    directions, _ = _directions(units.shape[1], count)
    return np.rint(units * FINE) @ directions / (FINE * COARSE)


def cell_keys(units: np.ndarray, plan: Plan) -> np.ndarray:
    """A key a group: a hash of the cells that the group's projections fall into."""
    _, shifts = _directions(units.shape[1], plan.directions)
    used = plan.depth * plan.groups
    cells = np.floor(projections(units, plan.directions)[:, :used] / plan.cell + shifts[:used]).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(units), plan.groups, plan.depth)
    keys = np.full(cells.shape[:2], units.shape[1], np.uint64)
    for i in range(plan.depth):
        keys = (keys ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]


def _with_keys(plan: Plan):
    def handle(batch: pa.RecordBatch) -> dict:
        vectors = _vectors(batch.column("embedding"))
        keys: list = [None] * len(vectors)
        for dims in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == dims]
            for i, k in zip(at, cell_keys(unit(np.stack([vectors[i] for i in at])), plan), strict=True):
                keys[i] = k
        return {c: batch.column(c) for c in batch.schema.names} | {"keys": keys}

    return handle


def collisions(queries: np.ndarray, others: np.ndarray, window: float) -> np.ndarray:
    """How many directions have each of the others in the window around each query."""
    counts = np.zeros((len(queries), len(others)), np.uint8)
    at = np.arange(len(queries))
    for q, o in zip(queries.T, others.T, strict=True):
        order = np.argsort(o)
        sorted_ = o[order]
        edges = np.zeros((len(q), len(o) + 1), np.int8)
        edges[at, np.searchsorted(sorted_, q - window, "left")] += 1
        edges[at, np.searchsorted(sorted_, q + window, "right")] -= 1
        counts[:, order] += np.cumsum(edges[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    return counts


def spans(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` is connected to by the pairs (i, j)."""
    least = np.arange(n)
    while True:
        a, b = least[i], least[j]
        lower, before = np.minimum(a, b), least.copy()
        np.minimum.at(least, a, lower)
        np.minimum.at(least, b, lower)
        least = least[least]
        if (least == before).all():
            return least


class _Buckets:
    """Counts the links of the rows of one bucket at a time; rows come sorted by bucket."""

    KEY = ("label", "t", "key", "low", "high")

    def __init__(self, plan: Plan):
        self.plan, self.held, self.of = plan, [], None

    def __call__(self, batch: pa.RecordBatch):
        out: list[dict] = []
        keys = list(zip(*[batch.column(c).to_pylist() for c in self.KEY], strict=True))
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                if self.of != keys[start]:
                    out += self._join()
                    self.of = keys[start]
                self.held.append(batch.slice(start, end - start))
                start = end
        return self._merged(out)

    def finish(self):
        out = self._merged(self._join())
        if out is not None:
            yield out

    @staticmethod
    def _merged(parts: list[dict]) -> dict | None:
        return {c: pa.array(np.concatenate([p[c] for p in parts])) for c in ("a", "b", "n")} if parts else None

    def _join(self) -> list[dict]:
        held, self.held = self.held, []
        if sum(b.num_rows for b in held) < 2:
            return []
        column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
        vectors = [v for b in held for v in _vectors(b.column("embedding"))]
        dims = np.array([len(v) for v in vectors])
        keys, sides = np.stack([k for b in held for k in b.column("keys").to_numpy(zero_copy_only=False)]), column("side")
        ids, copies, out = column("class_id"), column("copies"), []
        for d in np.unique(dims):  # keys of different lengths hardly meet
            at = np.flatnonzero(dims == d)
            out += self._links(np.stack([vectors[i] for i in at]), keys[at], sides[at], ids[at], copies[at])
        return out

    def _links(self, vectors, keys, sides, ids, copies) -> list[dict]:
        plan, t, whole = self.plan, self.of[1], self.of[3] == self.of[4]
        order = np.lexsort((ids, sides))
        vectors, keys, sides, ids, copies = vectors[order], keys[order], sides[order], ids[order], copies[order]
        units = unit(vectors)
        places = projections(units, plan.directions)[:, :COUNTED]
        first = len(ids) if whole else int((sides == 0).sum())
        pairs: list[np.ndarray] = []
        for start in range(0, first, QUERIES):
            stop = min(start + QUERIES, first)
            base = start if whole else first
            near = collisions(places[start:stop], places[base:], plan.window) >= plan.least
            if whole:
                near &= np.arange(base, len(ids))[None, :] > np.arange(start, stop)[:, None]
            i, j = np.nonzero(near)
            i, j = i + start, j + base
            for u in range(t):  # met in an earlier group
                new = keys[i, u] != keys[j, u]
                i, j = i[new], j[new]
            for part in range(0, len(i), 1 << 16):
                x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                alike = np.einsum("ij,ij->i", units[x], units[y]) >= plan.cosine
                pairs.append(np.stack([x[alike], y[alike]]).astype(np.int32))
        i, j = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int32)
        if not len(i):
            return []
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        linked = np.flatnonzero(n)
        return [{"a": ids[linked], "b": ids[spans(len(ids), i, j)[linked]], "n": n[linked].astype(np.int64)}]


def near_vectors(rows: DataFrame, *, cosine: float = 0.93, recall: float = 0.998, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    chosen = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    sound = F.expr(
        "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    )
    sound = F.coalesce(sound, F.lit(False))
    valid = chosen.where(sound)
    largest = valid.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = calibrated(largest, cosine, recall)
    classes = valid.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("class_id", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    keyed = map_batches(classes.select("label", "class_id", "copies", "embedding"), lambda: _with_keys(plan), classes.select("label", "class_id", "copies", "embedding", F.array(F.lit(0).cast("long")).alias("keys")).schema)
    keyed = stored(keyed, "keyed")
    dealt = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    large = dealt.groupBy("label", "t", "key").count().where(F.col("count") > bucket_rows)
    # Written, so that Spark sees its size when it chooses the join.
    large = stored(large.select("label", "t", "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts")), "large")
    met = dealt.join(large, ["label", "t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("label", "t", "key", low.alias("low"), high.alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "class_id", "copies", "keys", "embedding")
    met = met.repartition(*_Buckets.KEY).sortWithinPartitions(*_Buckets.KEY)
    found = stored(map_batches(met, lambda: _Buckets(plan), "a long, b long, n long"), "links")
    roots = connected(found.select("a", "b")).select(F.col("node").alias("class_id"), "root")
    rooted = classes.join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    counts = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("linked"))
    known = rooted.join(least, "root").join(counts, "class_id", "left")
    known = known.select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = chosen.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Every pair of a label.
SQL = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), valid AS (
  SELECT * FROM sound WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS x, b.r AS y FROM valid a JOIN valid b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached(r, y) AS (
  SELECT r, r FROM sound UNION SELECT t.r, l.y FROM reached t JOIN links l ON l.x = t.y
), counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x
), components AS (SELECT t.r, min(s.vec_id) AS component_id FROM reached t JOIN sound s ON s.r = t.y GROUP BY t.r
)
SELECT s.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(s.vec_id = component_id, false) AS kept FROM sound s LEFT JOIN counts USING (r) JOIN components USING (r)
"""


def op11_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.93)
