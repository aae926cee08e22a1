"""A Merkle manifest of a dataset: a digest a row, an authentication path a row, and one root.

Rows are leaves of their source's tree and the sources' roots are leaves of the
top tree; up to three consecutive nodes become their parent, level by level. A
tree of any size is cut into aligned blocks of 3^levels nodes, whose roots are the
nodes of the next table, until one node is left. Then the tables are gone
through downwards: within a block, treehash stacks hash the nodes that the next
paths need while the traversal goes from leaf to leaf, so that its state is a
few nodes a level; the block's own path above it, which its rows share, is
appended.

Defined cases: null values count as ``-`` in a leaf and a null source is a
source, the first one; rows without an id come first and are never tampered
with; rows that share an id stand in the order of their leaves, and equal rows
are leaves each; an empty text is a text of 0 bytes; texts of any length are
hashed whole; an empty table has no rows and no root; further columns, whatever
their names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, read, stored

#: Levels of a block (2,187 nodes), and nodes a run.
LEVELS, ARITY = 7, 3
#: Rows a partition of the ordered leaves.
RANGE_ROWS = 20_000
PATH = "array<struct<left:string,right:string>>"


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """The node ``level`` levels above leaves that come one by one, from a stack of a few nodes a level."""

    def __init__(self, level: int):
        self.level, self.stack, self.node = level, [[] for _ in range(level + 1)], None

    def push(self, leaf: str) -> None:
        self.stack[0].append(leaf)
        t = 0
        while t < self.level and len(self.stack[t]) == ARITY:
            self.stack[t + 1].append(digest_of(*self.stack[t]))
            self.stack[t] = []
            t += 1

    def close(self) -> str:
        """The node, with whatever runs are short."""
        for t in range(self.level):
            if self.stack[t]:
                self.stack[t + 1].append(digest_of(*self.stack[t]))
                self.stack[t] = []
        self.node = self.stack[self.level][0]
        self.stack = []
        return self.node

    def tail(self) -> int:
        return next((t for t, nodes in enumerate(self.stack) if nodes), self.level)

    def held(self) -> int:
        return sum(map(len, self.stack)) + (self.node is not None)


class _Ahead:
    """Hashes the second and the third node of the run that a level comes to next, a leaf at a time."""

    def __init__(self, leaves: list[str], level: int, run: int):
        self.leaves, self.width, self.level = leaves, ARITY**level, level
        self.at = run * self.width * ARITY + self.width
        self.last = min(self.at + (ARITY - 1) * self.width, len(leaves))
        self.nodes: list[str] = []
        self.hash = Treehash(level)

    def step(self) -> None:
        self.hash.push(self.leaves[self.at])
        self.at += 1
        if self.at % self.width == 0 or self.at == self.last:
            self.nodes.append(self.hash.close())
            self.hash = Treehash(self.level)

    def waiting(self) -> bool:
        return self.at < self.last

    def finish(self) -> list[str]:
        while self.waiting():
            self.step()
        return self.nodes


class Traversal:
    """The authentication paths of the leaves of one block, from first to last.

    ``run[h]`` holds what is known of the run of nodes around the current leaf on
    level h: those left of it were finished on the way, those right of it were
    hashed ahead. A step gives its few leaf updates to the stack that has the
    lowest tail, so that all are done when their level needs them.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels, self.leaf = leaves, levels, 0
        self.run = [["", *_Ahead(leaves, h, 0).finish()] for h in range(levels)]
        self.ahead = [_Ahead(leaves, h, 1) for h in range(levels)]
        self.budget = -(-levels * (ARITY - 1) // ARITY) + 1
        self.late = 0  # levels that weren't ready in time

    def path(self) -> list[tuple[str, str]]:
        """Siblings left and right of the current leaf's ancestors, bottom up."""
        out, at = [], self.leaf
        for run in self.run:
            at, d = divmod(at, ARITY)
            out.append(("".join(run[:d]), "".join(run[d + 1 :])))
        return out

    def advance(self) -> None:
        node, at, h = self.leaves[self.leaf], self.leaf, 0
        self.leaf += 1
        while at % ARITY == ARITY - 1:
            node = digest_of(*self.run[h][: ARITY - 1], node)
            at, h = at // ARITY, h + 1
        self.run[h][at % ARITY] = node
        for low in range(h):
            self.late += self.ahead[low].waiting()
            self.run[low] = ["", *self.ahead[low].finish()]
            self.ahead[low] = _Ahead(self.leaves, low, self.leaf // ARITY ** (low + 1) + 1)
        for _ in range(self.budget):
            waiting = [x for x in self.ahead if x.waiting()]
            if not waiting:
                break
            min(waiting, key=lambda x: x.hash.tail()).step()

    def held(self) -> int:
        """Nodes in memory besides the leaves."""
        return sum(map(len, self.run)) + sum(x.hash.held() + len(x.nodes) for x in self.ahead)

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        for i in range(len(self.leaves)):
            if i:
                self.advance()
            yield self.path()


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root over a node by its path."""
    for left, right in path:
        node = digest_of(left, node, right)
    return node


def _blocks(handle: Callable[[list[dict]], dict], out: tuple[str, ...], key: tuple[str, ...]) -> Callable:
    """A batch handler that gives ``handle`` the rows of one key at a time; rows come sorted by key."""

    def make():
        held: list[dict] = []

        def flush(rows: list[dict], into: dict) -> None:
            for name, values in handle(rows).items():
                into[name] += values

        def work(batch: pa.RecordBatch) -> dict | None:
            nonlocal held
            into: dict[str, list] = {name: [] for name in out}
            for row in batch.to_pylist():
                if held and any(held[-1][k] != row[k] for k in key):
                    flush(held, into)
                    held = []
                held.append(row)
            return into if any(into.values()) else None

        def finish():
            if held:
                into: dict[str, list] = {name: [] for name in out}
                flush(held, into)
                yield into

        work.finish = finish
        return work

    return make


def numbered(rows: DataFrame, group: list[str], order: list[str], row: str) -> DataFrame:
    """``rows`` with the place ``i`` of each within its group and the group's size ``n``, groups numbered by ``tree``.

    Rows are dealt by ranges of group and order and counted within each range, so
    no group goes through one task; only counts of ranges are summed in order.
    ``row`` tells rows apart that are equal otherwise. Places and groups start at 0.
    """
    count = rows.count()
    keys = [*group, *order, row]
    parts = max(1, -(-count // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, *keys) if parts > 1 else rows.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ordered")
    firsts = dealt.groupBy(*group, "pid").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    each, ranges = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("pid")
    firsts = firsts.withColumn("n", F.sum("here").over(each)).withColumn("before", F.sum("here").over(ranges) - F.col("here"))
    firsts = stored(firsts, "ranges").select(*[F.col(g).alias(f"_{g}") for g in group], F.col("pid").alias("_pid"), "first", "before", "n")
    same = F.col("pid") == F.col("_pid")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return dealt.join(firsts, same).withColumn("i", F.col("before") + F.col("at") - F.col("first")).select(*rows.columns, "i", "n")


def _lift(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks of ``nodes`` (tree, i, n, digest), as nodes of their own."""
    width = ARITY**levels

    def handle(rows: list[dict]) -> dict:
        stack = Treehash(levels if rows[0]["n"] > width else height(rows[0]["n"]))
        for r in rows:
            stack.push(r["digest"])
        r = rows[0]
        return {"tree": [r["tree"]], "i": [r["block"]], "n": [-(-r["n"] // width)], "digest": [stack.close()]}

    dealt = nodes.select("tree", F.expr(f"i div {width}").alias("block"), "i", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return stored(map_batches(dealt, _blocks(handle, ("tree", "i", "n", "digest"), ("tree", "block")), "tree long, i long, n long, digest string"), "nodes")


def _tables(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """``leaves`` and the tables above, the last of which holds one node a tree."""
    tables = [leaves]
    while True:
        tables.append(_lift(tables[-1], levels))
        if (tables[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tables


def _with_upper(nodes: DataFrame, upper: DataFrame, levels: int, more: list[str]) -> DataFrame:
    """Rows of each block behind a row (i = -1) with the path from the block's root on, the subroot and the root."""
    width = ARITY**levels
    kept = nodes.select("tree", F.expr(f"i div {width}").alias("block"), "i", "n", "digest", *more)
    for name, kind in (("path", PATH), ("subroot", "string"), ("root", "string")):
        kept = kept.withColumn(name, F.lit(None).cast(kind))
    heads = upper.select("tree", F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in more], "path", "subroot", "root")
    return kept.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")


def _walk(rows: list[dict], levels: int) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """The nodes of a block and their whole paths."""
    head, nodes = rows[0], rows[1:]
    n = nodes[0]["n"]
    upper = [(p["left"], p["right"]) for p in head["path"]]
    walk = Traversal([r["digest"] for r in nodes], levels if n > ARITY**levels else height(n))
    for row, path in zip(nodes, walk.paths(), strict=True):
        yield row, path + upper


def _paths(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """tree, i, path, subroot, root of inner nodes; the subroot is a top node's own digest."""

    def handle(rows: list[dict]) -> dict:
        out: dict[str, list] = {c: [] for c in ("tree", "i", "path", "subroot", "root")}
        for row, path in _walk(rows, levels):
            for c, v in (("tree", row["tree"]), ("i", row["i"]), ("path", [{"left": x, "right": y} for x, y in path]), ("subroot", rows[0]["subroot"]), ("root", rows[0]["root"])):
                out[c].append(v)
        return out

    made = _blocks(handle, ("tree", "i", "path", "subroot", "root"), ("tree", "block"))
    return stored(map_batches(_with_upper(nodes, upper, levels, []), made, f"tree long, i long, path {PATH}, subroot string, root string"), "paths")


def _proofs(leaves: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    def handle(rows: list[dict]) -> dict:
        out: dict[str, list] = {c: [] for c in PROOF}
        head = rows[0]
        for row, path in _walk(rows, levels):
            folded = fold(row["seen"], path)
            proof = digest_of(*[s for pair in path for s in pair])
            for c, v in zip(PROOF, (row["doc_id"], row["digest"], head["subroot"], head["root"], proof, folded, folded == head["root"]), strict=True):
                out[c].append(v)
        return out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_batches(_with_upper(leaves, upper, levels, ["doc_id", "seen"]), _blocks(handle, PROOF, ("tree", "block")), schema)


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def leaf(*columns: F.Column) -> F.Column:
    """Digest of values, each ``-`` if null and else its UTF-8 byte count, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def manifest(docs: DataFrame, seen: F.Column | None = None, *, levels: int = LEVELS) -> DataFrame:
    """The proof of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``seen`` is the text as it is when a proof is checked, the original by
    default: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    now = leaf(*fields[:4], F.col("text") if seen is None else seen)
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*fields).alias("digest"), now.alias("seen"), F.monotonically_increasing_id().alias("row"))
    placed = stored(numbered(stored(leaves, "leaves"), ["source"], ["doc_id", "digest"], "row"), "placed")
    sources = placed.where("i = 0").select("source", F.monotonically_increasing_id().alias("row"))
    trees = stored(numbered(stored(sources, "sources"), [], ["source"], "row").select(F.col("source").alias("_source"), F.col("i").alias("tree"), F.col("n").alias("trees")), "trees")
    rows = stored(placed.join(trees, placed["source"].eqNullSafe(trees["_source"])).select("tree", "i", "n", "digest", "seen", "doc_id"), "rows")
    below = _tables(rows, levels)
    subroots = below[-1].join(trees.select("tree", "trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("trees").alias("n"), "digest")
    above = _tables(stored(subroots, "subroots"), levels)
    upper = above[-1].select("tree", "i", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        upper = _paths(nodes, upper, levels)
    upper = below[-1].select("tree", "digest").join(upper.select(F.col("i").alias("tree"), "path", "root"), "tree")
    upper = upper.select("tree", F.lit(0).cast("long").alias("i"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(below[1:-1]):
        upper = _paths(nodes, upper, levels)
    return _proofs(rows, upper, levels)


#: CRC-32 bit by bit; the proof's fold keeps a level as left|right.
SQL = """
WITH RECURSIVE coded AS (
  SELECT *, list_transform(range(0, 8 * strlen(doc_id::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) AS bits FROM documents
), known AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(xor(c, b) // 2, 3988292384 * (xor(c, b) % 2))), 4294967295) AS crc FROM coded
), told AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM known
), hashed AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(now) || ':' || now, '-')) AS seen FROM told
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), nodes(tree, h, i, digest) AS (
  SELECT tree, 0::BIGINT, i, leaf FROM leaves
  UNION ALL
  SELECT tree, h + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS left_over FROM nodes) WHERE left_over > 1 GROUP BY tree, h + 1, i // 3
), subroots AS (
  SELECT tree, h AS top, digest AS subroot FROM nodes QUALIFY row_number() OVER (PARTITION BY tree ORDER BY h DESC) = 1
), crown(h, i, digest) AS (
  SELECT 0::BIGINT, tree, subroot FROM subroots
  UNION ALL
  SELECT h + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS left_over FROM crown) WHERE left_over > 1 GROUP BY h + 1, i // 3
), peak AS (SELECT h AS top, digest AS root FROM crown ORDER BY h DESC LIMIT 1
), levels AS (
  SELECT l.tree, l.i, g.h, l.i // (3 ** g.h)::BIGINT AS me FROM leaves l JOIN subroots s USING (tree), LATERAL (SELECT unnest(range(0, s.top)) AS h) g
), lower_path AS (
  SELECT v.tree, v.i, v.h, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < v.me), '') AS l, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > v.me), '') AS r
  FROM levels v JOIN nodes n ON n.tree = v.tree AND n.h = v.h AND n.i // 3 = v.me // 3 GROUP BY v.tree, v.i, v.h
), upper_path AS (
  SELECT s.tree, g.h, coalesce(string_agg(c.digest, '' ORDER BY c.i) FILTER (c.i < s.tree // (3 ** g.h)::BIGINT), '') AS l, coalesce(string_agg(c.digest, '' ORDER BY c.i) FILTER (c.i > s.tree // (3 ** g.h)::BIGINT), '') AS r
  FROM subroots s, peak p, LATERAL (SELECT unnest(range(0, p.top)) AS h) g JOIN crown c ON c.h = g.h AND c.i // 3 = (s.tree // (3 ** g.h)::BIGINT) // 3 GROUP BY s.tree, g.h
), lowers AS (SELECT tree, i, list(l || '|' || r ORDER BY h) AS path FROM lower_path GROUP BY tree, i
), uppers AS (SELECT tree, list(l || '|' || r ORDER BY h) AS path FROM upper_path GROUP BY tree
), whole AS (
  SELECT l.*, s.subroot, p.root, list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
  FROM leaves l JOIN subroots s USING (tree) CROSS JOIN peak p LEFT JOIN lowers a ON a.tree = l.tree AND a.i = l.i LEFT JOIN uppers b ON b.tree = l.tree
), folded AS (
  SELECT *, list_reduce(list_prepend(seen, path), lambda x, p: sha256(split_part(p, '|', 1) || x || split_part(p, '|', 2))) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")))
