"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers floor(scale * x). Rows are packed into blocks where
they are read (one row a block, vectors as bytes), queries and candidates
alike; each pair of a query block and a candidate block is one task's unit.
There, term by term, the queries' weights are multiplied with the term's
postings and scattered into a dense score array; partition selection keeps
the k best of each query, and a merge over the blocks keeps the k best of all.

No vector meets the driver; a block has at most ``block_rows`` rows, so a task
holds two blocks and one tile of scores.

Blocks are dealt to a stated number of partitions, one for each pair of blocks,
as their number of bytes says nothing about the work that a pair is.

Defined cases: a row whose vector is null or has a null or non-finite
component takes no part, nor does a row with a null id; an empty vector has
score 0 with every other; vectors of different lengths meet on their common
terms; a repeated row is a candidate like any other, and of several rows with
a query's id only the query's own is left out; ties go to the smaller id;
fewer than k candidates are all returned; other columns aren't read, whatever
their names; very long vectors are taken whole; an empty table gives no rows.
Scores beyond the range of a long stop at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, read, stored

BLOCK_ROWS, QUERY_ROWS, MOST_PARTS = 8192, 4096, 20_000
_TILE = (128, 2048)
_PACKED = "n long, dims long, ids binary, uids binary, weights binary, exact boolean"
_LONG = np.iinfo(np.int64)


def _pack(ids: list, uids: list, vectors: list[np.ndarray]) -> dict:
    """One block as a row of bytes; int32 weights where they suffice."""
    dims = max((len(v) for v in vectors), default=0)
    exact = all((np.abs(v) < 2**31).all() for v in vectors)
    matrix = np.zeros((len(vectors), dims), np.int32 if exact else np.float64)
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    return {"n": [len(ids)], "dims": [dims], "ids": [np.array(ids, np.int64).tobytes()], "uids": [np.array(uids, np.int64).tobytes()], "weights": [matrix.tobytes()], "exact": [exact]}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, uids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64)
    kind = np.int32 if row["exact"] else np.float64
    return ids, uids, np.frombuffer(row["weights"], kind).reshape(row["n"], row["dims"])


class _Packer:
    """Gathers rows of a task into blocks of at most ``rows``."""

    def __init__(self, rows: int):
        self.rows, self.ids, self.uids, self.vectors = rows, [], [], []

    def add(self, i: int, u: int, v: np.ndarray) -> dict | None:
        self.ids.append(i)
        self.uids.append(u)
        self.vectors.append(v)
        return self.take() if len(self.ids) >= self.rows else None

    def take(self) -> dict | None:
        if not self.ids:
            return None
        out = _pack(self.ids, self.uids, self.vectors)
        self.ids, self.uids, self.vectors = [], [], []
        return out


def _joined(rows: list[dict]) -> dict | None:
    return {k: [x for r in rows for x in r[k]] for k in rows[0]} if rows else None


def _packing(scale: float, rows: int):
    def make():
        packer = _Packer(rows)

        def handle(batch: pa.RecordBatch):
            out = []
            for i, u, v in zip(batch.column("id").to_pylist(), batch.column("uid").to_pylist(), batch.column("vector"), strict=True):
                values = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else None
                # A null component reads as NaN.
                if i is not None and values is not None and np.isfinite(values).all():
                    with np.errstate(over="ignore"):
                        block = packer.add(i, u, np.floor(np.clip(scale * values, -1e300, 1e300)))
                    out += [block] if block else []
            return _joined(out)

        def finish():
            if block := packer.take():
                yield block

        handle.finish = finish
        return handle

    return make


def _querying(every: int):
    """The query rows of candidate blocks."""

    def make():
        def handle(batch: pa.RecordBatch):
            out: dict[str, list] = {"id": [], "uid": [], "vector": []}
            for row in batch.to_pylist():
                ids, uids, weights = _unpack(row)
                at = np.flatnonzero(ids % every == 0)
                out["id"] += ids[at].tolist()
                out["uid"] += uids[at].tolist()
                out["vector"] += list(weights[at].astype(np.float64))
            return out

        return handle

    return make


def accumulate(queries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of a tile, one term after the other."""
    terms = min(queries.shape[1], weights.shape[1])
    acc = np.zeros((len(queries), len(weights)), queries.dtype)
    work = np.empty_like(acc)
    for t in range(terms):
        q, w = queries[:, t], weights[:, t]
        who, posted = np.flatnonzero(q), np.flatnonzero(w)
        if 2 * len(who) > len(q) and 2 * len(posted) > len(w):  # long lists: the whole array at once
            np.multiply(q[:, None], w[None, :], out=work)
            acc += work
        elif len(who) and len(posted):
            acc[np.ix_(who, posted)] += np.multiply.outer(q[who], w[posted])
    return acc


def _kind(queries: np.ndarray, weights: np.ndarray):
    most = lambda m: float(np.abs(m).max()) if m.size else 0.0
    bound = min(queries.shape[1], weights.shape[1]) * most(queries) * most(weights)
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_blocks(queries: tuple, candidates: tuple, k: int) -> dict[str, list]:
    """The k best candidates of each query within a block, without the query's own row."""
    q_ids, q_uids, q_all = queries
    order = np.argsort(candidates[0], kind="stable")
    ids, uids, weights = (x[order] for x in candidates)
    kind = _kind(q_all, weights)
    to_kind = (lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)) if kind is object else (lambda m: m.astype(kind))
    weights = to_kind(weights)
    rows = max(8, _TILE[0])
    out: dict[str, list] = {"query_uid": [], "query_id": [], "vec_id": [], "score": []}
    for a in range(0, len(q_ids), rows):
        part = to_kind(q_all[a : a + rows])
        kept: list[list] = [[] for _ in part]
        for b in range(0, len(ids), _TILE[1]):
            acc = accumulate(part, weights[b : b + _TILE[1]])
            # One more than k, as the query's own row may be among them.
            for i, scores in enumerate(acc):
                if kind is object:
                    scores = np.array([min(max(s, _LONG.min + 1), _LONG.max) for s in scores], np.int64)
                at = _best(scores, ids[b : b + _TILE[1]], k + 1)
                kept[i].append((scores[at].astype(np.int64), ids[b + at], uids[b + at]))
        for i, found in enumerate(kept):
            scores, who, uid = (np.concatenate(x) for x in zip(*found, strict=True))
            own = uid != q_uids[a + i]
            scores, who = scores[own], who[own]
            at = np.lexsort((who, -scores))[:k]
            n = len(at)
            out["query_uid"].append(np.full(n, q_uids[a + i]))
            out["query_id"].append(np.full(n, q_ids[a + i]))
            out["vec_id"].append(who[at])
            out["score"].append(scores[at])
    return {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()}


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocks as one struct column beside their number from 1 on; and how many there are."""
    held = stored(blocks.withColumn("at", F.monotonically_increasing_id()), "numbered")
    numbers = held.select("at", F.row_number().over(Window.orderBy("at")).cast("int").alias(f"{name}_no"))
    columns = [c.split()[0] for c in _PACKED.split(", ")]
    return held.join(numbers, "at").select(f"{name}_no", F.struct(*columns).alias(name)), held.count()


def top_k(
    df: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id",
    vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k best other rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.repartition(-(-df.count() // block_rows) or 1)
    blocks = stored(map_batches(rows, _packing(scale, block_rows), _PACKED), "blocks")
    chosen = stored(map_batches(blocks, _querying(every), "id long, uid long, vector array<double>"), "queries")
    asked = map_batches(chosen.repartition(-(-chosen.count() // query_rows) or 1), _packing(1.0, query_rows), _PACKED)
    blocks, n_blocks = _numbered(blocks, "candidate")
    asked, n_asked = _numbered(asked, "query")
    # Each pair of blocks has a key of its own, so pairs spread over all tasks.
    every_of = lambda n: F.explode(F.sequence(F.lit(1), F.lit(max(n, 1))))
    key, parts = ["candidate_no", "query_no"], min(2 * max(1, n_blocks * n_asked), MOST_PARTS)
    pairs = blocks.withColumn("query_no", every_of(n_asked)).repartition(parts, *key).join(asked.withColumn("candidate_no", every_of(n_blocks)).repartition(parts, *key), key)

    def make():
        def handle(batch: pa.RecordBatch):
            found = [search_blocks(_unpack(r["query"]), _unpack(r["candidate"]), k) for r in batch.to_pylist()]
            return {c: np.concatenate([f[c] for f in found]) for c in found[0]}

        return handle

    found = map_batches(pairs, make, "query_uid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
