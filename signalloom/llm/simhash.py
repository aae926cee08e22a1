"""SimHash near-dedup with a binary trie self-join.

Fingerprints that differ in at most ``budget`` bits agree on two or more of
``budget + 2`` equal bands of bits, so equal fingerprints are first counted
once and then dealt by each two bands and their values (25 bits or more for the
usual budget of 3: buckets stay small up to billions of fingerprints). Each
bucket is a binary trie over the sorted fingerprints: pairs of nodes are
traversed together from the root, differing bits add up, and a pair is dropped
once it exceeds the budget. The traversal is vectorised over many buckets and
works through its frontier in bounded slices. Buckets give spanning links only
(a node to the least of its local component), never all pairs; alternating
large-star and small-star steps, with a checkpoint each, join them into
components.

A bucket above ``bucket_rows`` is split into groups by a hash, and each pair of
groups is a bucket of its own, so that no task holds a large bucket.

``keep_unlike`` is for stages that remove near copies: texts are alike when the
sets of their word shingles have a Jaccard similarity of ``least`` or more.
Texts of equal sets are one class. Candidates are the links of the trie
self-join over the classes' fingerprints; as fingerprints of texts at a
similarity of 0.8 differ in ten bits on average, those are joined by classes
that share one of ``GROUPS`` groups of ``HASHES`` minimum hashes with the least
or the greatest class of that value. Each pair of either kind is held against
the sets themselves.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other; a very long text is hashed whole; repeated rows have equal
fingerprints and each keeps its row, but stages keep one of rows equal in id
and shingles; a null id takes part but never names a component that has an id;
other columns go along unseen, whatever their names and types, but simhash is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FOLD_CASE, append, checkpoint, map_batches, read, stored

BUCKET_ROWS = 4096
#: Minimum hashes a group, and groups: of pairs at a similarity of 0.8 all but 1 in 1,500 share a group.
HASHES, GROUPS = 6, 24
#: Pairs of nodes that are expanded at a time, and the product of sizes below which they are compared directly.
_FRONTIER, _DIRECT = 1 << 19, 64
_ROOT = np.uint64(63)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included."""
    import xxhash

    words = text.translate(FOLD_CASE).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, size: int = 3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a column ``simhash`` (64 bits as a long)."""

    def make():
        def work(rows: list[bytes]) -> dict:
            prints = np.array([fingerprint(shingle_hashes(t, size)) for t in rows], np.uint64)
            return {"simhash": pa.array(prints.view(np.int64))}

        return work

    return append(docs, text_col, make, "simhash long")


class _Links:
    """Least position linked to each, over one slice of buckets."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.least[a], self.least[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            np.minimum.at(self.least, high, low)
            while True:
                further = self.least[self.least]
                if (further == self.least).all():
                    break
                self.least = further


def _close(prints: np.ndarray, links: _Links, a: np.ndarray, b: np.ndarray, budget: int) -> None:
    near = np.bitwise_count(prints[a] ^ prints[b]) <= budget
    links.add(a[near], b[near])


def _expand(prints, links, pairs, budget) -> np.ndarray:
    """Compare all members of small pairs of nodes."""
    a0, a1, b0, b1 = pairs[:4]
    n = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(n)
    cut = 0
    while cut < len(n):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 4 * _FRONTIER)))
        part = slice(cut, stop)
        m = n[part]
        which = np.repeat(np.arange(cut, stop), m)
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        width = (b1 - b0)[which]
        a, b = a0[which] + inner // width, b0[which] + inner % width
        once = a < b
        _close(prints, links, a[once], b[once], budget)
        cut = stop


def trie_links(prints: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int) -> np.ndarray:
    """Join tries with themselves or each other.

    ``prints`` holds nodes' fingerprints, sorted within each range; ``left`` and
    ``right`` are arrays of ranges (rows: first, end), the roots to traverse
    together. Returns for each position the least position linked to it.
    """
    links = _Links(len(prints))
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((prints >> (_ROOT - np.uint64(depth))) & np.uint64(1), dtype=np.int64)])
        return ones[depth]

    stack = [(0, np.stack([left[:, 0], left[:, 1], right[:, 0], right[:, 1], np.zeros(len(left), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        a0, a1, b0, b1, differing = pairs
        small = (a1 - a0) * (b1 - b0) <= _DIRECT
        if depth >= 64:
            small[:] = True
        if small.any():
            _expand(prints, links, pairs[:, small], budget)
            pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > _FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        a0, a1, b0, b1, differing = pairs
        count = ones_before(depth)
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = (a0 == b0) & (a1 == b1)
        children = [
            np.stack([a0, am, b0, bm, differing]),
            np.stack([am, a1, bm, b1, differing]),
            np.stack([a0, am, bm, b1, differing + 1]),
            np.stack([am, a1, b0, bm, differing + 1])[:, ~same],
        ]
        after = np.concatenate(children, axis=1)
        fits = (after[0] < after[1]) & (after[2] < after[3]) & (after[4] <= budget)
        # Nodes of one member each that are linked already need no visit.
        stack.append((depth + 1, after[:, fits]))
    return links.least


class _Buckets:
    """Reads rows sorted by bucket and joins the tries of many buckets at once."""

    def __init__(self, budget: int, rows: int = 1 << 16):
        self.budget, self.rows, self.held = budget, rows, []

    def __call__(self, batch: pa.RecordBatch):
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "value", "low", "high", "side")])
        self.held.append((keys, batch.column("simhash").to_numpy().view(np.uint64)))
        if sum(len(p) for _, p in self.held) < self.rows:
            return None
        keys, prints = self._all()
        last = np.flatnonzero((keys[:4] != keys[:4, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        self.held = [(keys[:, cut:], prints[cut:])]
        return self._join(keys[:, :cut], prints[:cut]) if cut else None

    def _all(self):
        return np.concatenate([k for k, _ in self.held], axis=1), np.concatenate([p for _, p in self.held])

    def finish(self):
        if self.held:
            yield self._join(*self._all())

    def _join(self, keys: np.ndarray, prints: np.ndarray) -> dict:
        order = np.lexsort((prints, keys[4], keys[3], keys[2], keys[1], keys[0]))
        keys, prints = keys[:, order], prints[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        ends = np.append(new[1:], len(prints))
        ranges = np.stack([new, ends], axis=1)
        inner = keys[2, new] == keys[3, new]
        # A bucket of two groups is two ranges that follow each other, sides 0 and 1.
        first = np.flatnonzero(~inner[:-1] & (keys[:4, new[:-1]] == keys[:4, new[1:]]).all(axis=0) & (keys[4, new[:-1]] == 0)) if len(new) > 1 else np.empty(0, np.int64)
        left = np.concatenate([ranges[inner], ranges[first]])
        right = np.concatenate([ranges[inner], ranges[first + 1]])
        least = trie_links(prints, left, right, self.budget)
        at = np.flatnonzero(least != np.arange(len(prints)))
        return {"a": pa.array(prints[at].view(np.int64)), "b": pa.array(prints[least[at]].view(np.int64))}


def near_links(prints: DataFrame, *, budget: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in column ``simhash``."""
    bands = budget + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    value = lambda i: F.shiftrightunsigned("simhash", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    keys = [F.struct(F.lit(k).alias("band"), F.shiftleft(value(i), edges[j + 1] - edges[j]).bitwiseOR(value(j)).alias("value")) for k, (i, j) in enumerate(combinations(range(bands), 2))]
    dealt = prints.select("simhash", F.explode(F.array(*keys)).alias("x")).select("simhash", "x.*")
    large = dealt.groupBy("band", "value").count().where(F.col("count") > bucket_rows)
    # Written, so that Spark sees its size when it chooses the join.
    large = stored(large.select("band", "value", F.ceil(F.col("count") / bucket_rows).cast("int").alias("groups")), "large")
    near = dealt.join(large, ["band", "value"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.pmod(F.xxhash64("simhash"), F.col("groups")).cast("int")
    near = near.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    near = near.select(
        "band", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "simhash",
    )
    key = ["band", "value", "low", "high"]
    near = near.repartition(*key).sortWithinPartitions(*key)
    return map_batches(near, lambda: _Buckets(budget), "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b) that isn't its own root, by stars.

    Large-star hangs each larger neighbour of a node on the node's least
    neighbour; small-star does so with the smaller neighbours and the node.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.hash("v", "u")), F.lit(0))).first())


def _rooted(docs: DataFrame, size: int, budget: int, id_col: str, text_col: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, simhash) of each row, and (simhash, least, root) of each fingerprint."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(with_fingerprint(chosen, size=size).select("doc_id", "simhash"), "prints")
    classes = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected(near_links(classes, budget=budget, bucket_rows=bucket_rows)).withColumnRenamed("node", "simhash")
    return prints, classes.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))


def near_duplicates(docs: DataFrame, *, size: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document: doc_id, simhash, component_id (the least id reachable over links)."""
    prints, rooted = _rooted(docs, size, budget, id_col, text_col, bucket_rows)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("simhash", "component_id")
    return prints.join(named, "simhash").select("doc_id", "simhash", "component_id")


def _least(doc_id: str, kind: str) -> F.Column:
    """The class with the least id, no id coming last, as kept_id and kept_class."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("kept_id"), F.col(kind).alias("kept_class")))


def _keep(docs: DataFrame, kept: DataFrame, make, kind: str) -> DataFrame:
    """The rows of ``docs`` whose id and class are in ``kept`` (kept_id, kept_class); of those equal in both one.

    ``make`` makes the handler that gives the class of each text as ``class_``.
    """
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    keyed = append(docs.toDF(*at.values()), at["text"], make, f"class_ {kind}")
    # The id's value and whether it is null, so that join and window are dealt alike.
    ids = lambda c: (F.coalesce(c, F.lit(0)), c.isNull())
    value, null = ids(F.col(at["doc_id"]).cast("long"))
    keyed = keyed.withColumn("id_", value).withColumn("null_", null)
    value, null = ids(F.col("kept_id"))
    chosen = kept.select(value.alias("id_"), null.alias("null_"), F.col("kept_class").alias("class_"))
    key = ["id_", "null_", "class_"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(at["text"]), at["text"]))
    left = keyed.join(chosen, key, "left_semi").withColumn("first_", first).where("first_ = 1")
    return left.select(*at.values()).toDF(*names)


def keep_one(docs: DataFrame, *, size: int = 3, budget: int = 3) -> DataFrame:
    """One document of each component, the one with the least id; of rows equal in id and fingerprint one."""
    _, rooted = _rooted(docs, size, budget, "doc_id", "text", BUCKET_ROWS)
    kept = rooted.groupBy("root").agg(_least("least", "simhash").alias("kept")).select("kept.kept_id", "kept.kept_class")
    return _keep(docs, kept, lambda: lambda rows: {"class_": pa.array(np.array([fingerprint(shingle_hashes(t, size)) for t in rows], np.uint64).view(np.int64))}, "long")


def _least_hashes():
    """Factors and terms of the hash functions."""
    rng = np.random.default_rng(8)
    odd = rng.integers(0, 2**63, HASHES * GROUPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    more = rng.integers(0, 2**63, HASHES * GROUPS, dtype=np.uint64)
    return odd, more


def _sets(size: int):
    def make():
        import xxhash

        odd, more = _least_hashes()

        def work(rows: list[bytes]) -> dict:
            out: dict[str, list] = {"_class": [], "_print": [], "_groups": []}
            for text in rows:
                found = np.unique(shingle_hashes(text, size))
                out["_print"].append(int(np.uint64(fingerprint(found)).view(np.int64)))
                out["_class"].append(int.from_bytes(xxhash.xxh64_digest(found.tobytes(), 8), "big", signed=True))
                groups = []
                if len(found):
                    least = np.array([(found * a + b).min() for a, b in zip(odd, more, strict=True)], np.uint64).reshape(GROUPS, HASHES)
                    groups = [int.from_bytes(xxhash.xxh64_digest(g.tobytes(), k), "big", signed=True) for k, g in enumerate(least)]
                out["_groups"].append(groups)
            return out

        return work

    return make


def _class_of(hashes: np.ndarray) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(np.unique(hashes).tobytes(), 8), "big", signed=True)


def _classes(size: int):
    """The class of a text: a hash of its set of shingles."""
    return lambda: lambda rows: {"class_": [_class_of(shingle_hashes(t, size)) for t in rows]}


def _shingle_set(size: int):
    def make():
        import xxhash

        def work(rows: list[bytes]) -> dict:
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in rows]
            return {"_set": sets, "_class": [int.from_bytes(xxhash.xxh64_digest(x, 8), "big", signed=True) for x in sets]}

        return work

    return make


def _alike(least: float):
    def handle(batch: pa.RecordBatch) -> dict:
        near = []
        for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                near.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= least * (len(x) + len(y) - both))
        keep = pa.array(near, pa.bool_())
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return handle


def _pairs(of: DataFrame) -> DataFrame:
    return of.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def trie_pairs(classes: DataFrame, *, budget: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of ``classes`` (class, simhash) by the trie self-join.

    The least class of a fingerprint stands for it; the fingerprint's other
    classes pair with that one.
    """
    heads = stored(classes.groupBy("simhash").agg(F.min("class").alias("head"), F.max("class").alias("last")), "heads")
    links = near_links(heads.select("simhash"), budget=budget, bucket_rows=bucket_rows).distinct()
    left, right = heads.select(F.col("simhash").alias("a"), F.col("head").alias("left")), heads.select(F.col("simhash").alias("b"), F.col("head").alias("right"))
    near = links.join(left, "a").join(right, "b").select(F.col("left").alias("a"), F.col("right").alias("b"))
    equal = classes.join(heads.where("head <> last"), "simhash").select(F.col("class").alias("a"), F.col("head").alias("b"))
    return _pairs(near.unionByName(equal))


def group_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``classes`` (class, groups) that share a group of minimum hashes."""
    dealt = classes.select(F.col("class").alias("a"), F.explode("groups").alias("value"))
    hubs = dealt.groupBy("value").agg(F.array(F.min("a"), F.max("a")).alias("ends"), F.count("*").alias("n")).where("n > 1").select("value", F.explode("ends").alias("b"))
    return _pairs(dealt.join(hubs, "value"))


def like_links(docs: DataFrame, *, size: int = 5, least: float = 0.8, budget: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class) of each row of ``docs`` (doc_id, text), and links (a, b) of alike classes."""
    made = append(docs, "text", _sets(size), "_class long, _print long, _groups array<long>")
    classed = stored(made.select("doc_id", F.col("_class").alias("class"), F.col("_print").alias("simhash"), F.col("_groups").alias("groups")), "classes")
    first = classed.groupBy("class").agg(F.first("groups").alias("groups"), F.first("simhash").alias("simhash"), F.min("doc_id").alias("doc_id"))
    pairs = stored(trie_pairs(first, budget=budget).unionByName(group_pairs(first)).distinct(), "pairs")
    # One row of a class stands for it; only those of a pair are read.
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    ids = first.select("class", "doc_id").join(asked, "class", "left_semi")
    stands = docs.join(ids, "doc_id").select("class", "text")
    # Documents of one id may differ. Those without an id are found by their class, so that no two of them meet.
    sets = append(stands, "text", _shingle_set(size), "_set binary, _class long").where("class = _class").select("class", "_set")
    alone = ids.where("doc_id IS NULL").select("class")
    unnamed = append(docs.where("doc_id IS NULL").select("text"), "text", _shingle_set(size), "_set binary, _class long")
    sets = sets.unionByName(unnamed.select(F.col("_class").alias("class"), "_set").join(alone, "class", "left_semi")).groupBy("class").agg(F.first("_set").alias("set"))
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("left")), sets.select(F.col("class").alias("b"), F.col("set").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return classed.select("doc_id", "class"), map_batches(met, lambda: _alike(least), "a long, b long")


def keep_unlike(docs: DataFrame, *, size: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each component of alike texts, the one with the least id; of rows equal in id and shingles one."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    classed, links = like_links(chosen, size=size, least=least)
    roots = connected(links).withColumnRenamed("node", "class")
    rooted = classed.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    kept = rooted.groupBy("root").agg(_least("doc_id", "class").alias("kept")).select("kept.kept_id", "kept.kept_class")
    return _keep(docs, kept, _classes(size), "long")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), size=3, budget=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
