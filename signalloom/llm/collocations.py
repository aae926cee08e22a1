"""Phrases whose words stand together more often than chance, mined through minimal perfect hashes.

Words of a language that occur often enough get numbers, all others end a run of
numbers. A phrase of k words is then a pair of neighbouring numbers of phrases
of k - 1 words, its first part's and its rest's (one word less at either end):
unless both are frequent it can't be, so frequent phrases are found level by
level, each from the numbers of the one below:

1. candidates: pairs of neighbouring numbers that could reach the least count.
   Tasks count hashes of pairs in arrays of buckets, which are summed in a tree:
   a pair whose bucket is below the least count is so itself. And a pair below
   its share of the least count in every task is below it in sum;
2. a minimal perfect hash over the candidates, made on the executors, a shard of
   bounded size at a time; the pair itself is stored in its slot, so nothing
   else is counted there;
3. exact counts: tasks count slots in numpy arrays, which are summed in a tree,
   some tasks at a time; slots that reach the least count are numbered;
4. the next level's numbers: each position looks up the number of its pair.

Scores read the counts of a phrase's cuts by number: the part before a cut is
the first part of the first part, and so on, the part after it the rest of the
rest. Scores are whole numbers of up to 38 digits.

Defined cases: a null text is empty and a null language ``und``; empty texts have
no words; texts of any length are read whole; equal rows count as often as they
stand; ids take no part, null or not; phrases of equal score and count are in the
byte order of their words; an empty table has no phrases; further columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_batches, read, stored, texts
from .merkle import numbered

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Keys of a shard, the group of keys that a task makes a hash of, and shards that are broadcast at a time (25 MB).
SHARD_KEYS, SHARDS = 1 << 17, 16
#: Buckets at most and their number a pair, which a task keeps as bytes, and buckets of a piece.
MOST_BUCKETS, BUCKETS_A_PAIR, PIECE = 1 << 24, 0.25, 1 << 20
#: Pairs that occur, for each part of those that are proposed.
PART_PAIRS = 1 << 22
#: Words that are broadcast at a time, and the length from which a digest stands for a word.
SHARD_WORDS, LONG_WORD = 1 << 18, 64
#: Arrays that one task sums.
FAN = 16
#: Words that a task keeps before it passes on their counts, pairs that it keeps before it counts them, and counts it keeps.
KEPT_WORDS, KEPT_PAIRS, KEPT_COUNTS = 1 << 18, 1 << 21, 1 << 22

#: Breaks of pieces become newlines, tabs spaces, and ASCII capitals small.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for a break; no byte of UTF-8.
BREAK = b"\xff"


def words(text: bytes) -> list[bytes]:
    """The words of a text in order, with breaks between pieces."""
    return text.translate(FOLD).replace(b"\n", b" \xff ").split()


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, each of which is stored in its slot.

    Levels of bits: a key that has its position of a level to itself sets the bit,
    all others go on to the next level; a key's slot is the rank of its bit.
    """

    ROOM = 2

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        rank, left, level = 0, np.ascontiguousarray(keys, np.uint64), 0
        while len(left):
            size = max(64, -(-len(left) * self.ROOM // 64) * 64)
            at = self._at(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            blocks = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
            ones = np.bitwise_count(blocks).astype(np.int64)
            self.bits.append(blocks)
            self.before.append(rank + np.cumsum(ones) - ones)
            rank += int(ones.sum())
            left, level = left[~alone[at]], level + 1
        self.keys = np.zeros(rank, np.uint64)
        self.keys[self._ranks(np.ascontiguousarray(keys, np.uint64))] = keys

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has a bit for it."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            at = self._at(keys[todo], level, 64 * len(bits))
            block, bit = at >> 6, (at & 63).astype(np.uint64)
            word = bits[block]
            here = (word >> bit) & np.uint64(1) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[todo[here]] = before[block[here]] + np.bitwise_count(below)
            todo = todo[~here]
            if not len(todo):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key isn't the one stored there."""
        out = self._ranks(keys)
        if len(self.keys):
            out[self.keys[np.maximum(out, 0)] != keys] = -1
        return out

    def parts(self) -> tuple[bytes, list[int], bytes]:
        return b"".join(x.tobytes() for x in self.bits), [len(x) for x in self.bits], self.keys.tobytes()

    @classmethod
    def of(cls, row: dict) -> PerfectHash:
        self = cls.__new__(cls)
        bits, cuts = np.frombuffer(bytes(row["bits"]), np.uint64), np.cumsum(row["sizes"])
        self.bits = np.split(bits, cuts[:-1]) if len(cuts) else []
        ones = np.bitwise_count(bits).astype(np.int64)
        before = np.cumsum(ones) - ones
        self.before = np.split(before, cuts[:-1]) if len(cuts) else []
        self.keys = np.frombuffer(bytes(row["keys"]), np.uint64)
        return self


def _word_counts():
    """Counts of words by language, passed on before they grow large."""
    from collections import Counter

    held: dict[str, Counter] = {}

    def flush() -> dict:
        out: dict[str, list] = {"lang": [], "word": [], "n": []}
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            out["lang"] += [lang] * len(counts)
            out["word"] += counts.keys()
            out["n"] += counts.values()
        held.clear()
        return {"lang": out["lang"], "word": pa.array(out["word"], pa.binary()).cast(pa.string()), "n": out["n"]}

    def handle(batch: pa.RecordBatch) -> dict | None:
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            held.setdefault(lang, Counter()).update(words(text))
        return flush() if sum(map(len, held.values())) > KEPT_WORDS else None

    handle.finish = lambda: [flush()]
    return handle


def _word_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\xfe" + sha256(word).digest()


class _Numbers(dict):
    """Numbers of words, 0 for others; long words by their digest."""

    def __missing__(self, word: bytes) -> int:
        return self.get(_word_key(word), 0) if len(word) > LONG_WORD else 0


def runs(numbers: np.ndarray) -> np.ndarray:
    """Runs of two numbers or more, a 0 behind each."""
    some = np.concatenate([numbers > 0, [False]])
    paired = some[:-1] & some[1:]
    kept = some.copy()
    kept[:-1] = paired
    kept[1:] |= paired
    ends = kept.copy()
    ends[1:] |= kept[:-1]
    return np.where(kept, np.concatenate([numbers, [0]]), 0)[ends]


def _pairs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a number and its neighbour stand, and both as one key."""
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    return at, numbers[at].astype(np.uint64) << np.uint64(32) | numbers[at + 1].astype(np.uint64)


def _blob(numbers: np.ndarray) -> dict:
    left = runs(numbers)
    return {"numbers": [left.astype(np.int32).tobytes()], "pairs": [len(_pairs(left)[1])]} if len(left) else {"numbers": [], "pairs": []}


BLOB = "numbers binary, pairs long"


def _encoder(table, last: bool):
    """Fills in the numbers of some words; -1 is a break, 0 a word not known so far. The last one puts out runs."""

    def make():
        known: dict[str, _Numbers] = {}
        lang, word, number = table.value
        for a, b, c in zip(lang, word, number, strict=True):
            known.setdefault(a, _Numbers({BREAK: -1}))[_word_key(b)] = c
        none = _Numbers({BREAK: -1})

        def handle(batch: pa.RecordBatch) -> dict:
            found = []
            for lang, text, old in zip(batch.column("lang").to_pylist(), texts(batch), batch.column("numbers").to_pylist(), strict=True):
                has = words(text)
                new = np.fromiter(map(known.get(lang, none).__getitem__, has), np.int64, len(has))
                found.append(new if old is None else np.where(new == 0, np.frombuffer(old, np.int64), new))
            if last:
                return _blob(np.concatenate([x for one in found for x in (one, [-1])]))
            return {"lang": batch.column("lang"), "text": batch.column("text"), "numbers": [x.tobytes() for x in found]}

        return handle

    return make


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` and their number from 1 on, in order."""
    return numbered(rows, [], list(order[:-1]), order[-1]).withColumn("number", F.col("i") + 1).select(*rows.columns, "number")


def encode(docs: DataFrame, frequent: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The runs of numbers of frequent words (lang, word, number) in ``docs`` (lang, text)."""
    spark = docs.sparkSession
    state = docs.withColumn("numbers", F.lit(None).cast("binary"))
    total = frequent.count()
    starts = range(0, max(total, 1), shard_words)
    for start in starts:
        part = frequent.where(F.col("number").between(start + 1, start + shard_words)).select("lang", "word", "number").toArrow()
        table = spark.sparkContext.broadcast((part["lang"].to_pylist(), [w.encode() for w in part["word"].to_pylist()], part["number"].to_pylist()))
        last = start == starts[-1]
        state = stored(map_batches(state, _encoder(table, last), BLOB if last else "lang string, text string, numbers binary"), "numbers")
        table.destroy()
    return state


def _blobs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for b in batch.column("numbers").to_pylist():
        yield np.frombuffer(b, np.int32)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair; their number is a power of two."""
    x = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _bucket_counter(buckets: int, least: int):
    """Counts of a task by bucket, up to ``least``, in pieces."""
    kind = np.uint8 if least < 256 else np.uint32

    def make():
        from pyspark import TaskContext

        sums, held = np.zeros(buckets, np.uint32), []

        def count() -> None:
            if held:
                at, n = np.unique(_bucket_of(np.concatenate(held), buckets), return_counts=True)
                sums[at] += n.astype(np.uint32)
                held.clear()

        def handle(batch: pa.RecordBatch) -> None:
            for numbers in _blobs(batch):
                held.append(_pairs(numbers)[1])
                if sum(map(len, held)) > KEPT_PAIRS:
                    count()

        def finish():
            count()
            here = TaskContext.get().partitionId()
            for at in range(0, buckets, PIECE):
                if sums[at : at + PIECE].any():
                    yield {"shard": [at // PIECE], "task": [here], "counts": [np.minimum(sums[at : at + PIECE], least).astype(kind).tobytes()]}

        handle.finish = finish
        return handle

    def add(arrays: list[bytes]) -> bytes:
        total = np.frombuffer(arrays[0], kind)
        for more in arrays[1:]:
            total = np.minimum(total.astype(np.uint64) + np.frombuffer(more, kind), least).astype(kind)
        return total.tobytes()

    return make, add


def _full(least: int):
    """A bit a bucket: whether it reaches the least count."""
    kind = np.uint8 if least < 256 else np.uint32
    return lambda: lambda batch: {"shard": batch.column("shard"), "bits": [np.packbits(np.frombuffer(b, kind) >= least).tobytes() for b in batch.column("counts").to_pylist()]}


def _proposer(least: int, pairs: int, full, buckets: int, parts: int):
    """Pairs of full buckets that a task sees at least as often as its share of the least count, an array a part."""

    def make():
        held: list[np.ndarray] = []
        keys, counts, seen = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def count() -> None:
            nonlocal keys, counts
            new, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)

        def passed() -> dict:
            nonlocal keys, counts, seen
            # count / seen >= least / pairs, in whole numbers.
            likely = keys[counts >= -(-least * seen // pairs)]
            keys, counts, seen = keys[:0], counts[:0], 0
            of = _shard_of(likely, parts)
            order = np.argsort(of, kind="stable")
            here, first = np.unique(of[order], return_index=True)
            return {"part": here, "keys": [k.tobytes() for k in np.split(likely[order], first[1:])] if len(here) else []}

        def handle(batch: pa.RecordBatch) -> dict | None:
            nonlocal seen
            for numbers in _blobs(batch):
                found = _pairs(numbers)[1]
                at = _bucket_of(found, buckets)
                seen += len(found)
                held.append(found[full.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1])
                if sum(map(len, held)) > KEPT_PAIRS:
                    count()
            return passed() if len(keys) > KEPT_COUNTS else None

        def finish():
            if held:
                count()
            if len(keys):
                yield passed()

        handle.finish = finish
        return handle

    return make


def candidates(below: DataFrame, least: int) -> DataFrame:
    """Pairs (key) of neighbouring numbers of ``below`` that could occur ``least`` times; the others can't."""
    pairs = max(1, below.agg(F.sum("pairs")).first()[0] or 0)
    buckets = max(1 << 10, min(MOST_BUCKETS, 1 << int(pairs * BUCKETS_A_PAIR).bit_length()))
    make, add = _bucket_counter(buckets, least)
    numbers = below.select("numbers")
    counts = _summed(map_batches(numbers, make, "shard long, task long, counts binary"), numbers.rdd.getNumPartitions(), add)
    size = min(PIECE, buckets) // 8
    bits = np.zeros(-(-buckets // 8), np.uint8)
    for piece in map_batches(counts, _full(least), "shard long, bits binary").toLocalIterator():
        bits[piece["shard"] * size : (piece["shard"] + 1) * size] = np.frombuffer(bytes(piece["bits"]), np.uint8)
    full = below.sparkSession.sparkContext.broadcast(bits)
    # Most tasks propose what is frequent, so arrays travel and not rows.
    parts = -(-pairs // PART_PAIRS)
    proposed = map_batches(numbers, _proposer(least, pairs, full, buckets, parts), "part long, keys binary")

    def once(table: pa.Table) -> pa.Table:
        return pa.table({"key": np.unique(np.concatenate([np.frombuffer(k, np.int64) for k in table["keys"].to_pylist()]))})

    found = stored(proposed.groupBy("part").applyInArrow(once, "key long"), "candidates")
    full.destroy()
    return found


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


HASH = "shard long, bits binary, sizes array<long>, keys binary, numbers binary"


def hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """A minimal perfect hash a shard of ``pairs`` (key, number); its numbers are by slot."""

    def dealt():
        return lambda batch: {"key": batch.column("key"), "number": batch.column("number"), "shard": _shard_of(batch.column("key").to_numpy().view(np.uint64), shards)}

    schema = to_arrow_schema(StructType.fromDDL(HASH))

    def build(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy().view(np.uint64)
        made = PerfectHash(keys)
        numbers = np.zeros(len(keys), np.int64)
        numbers[made.slots(keys)] = table["number"].to_numpy()
        bits, sizes, stored_keys = made.parts()
        return pa.table({"shard": [table["shard"][0].as_py()], "bits": [bits], "sizes": [sizes], "keys": [stored_keys], "numbers": [numbers.tobytes()]}, schema=schema)

    return stored(map_batches(pairs, dealt, "key long, number long, shard long").groupBy("shard").applyInArrow(build, HASH), "hashes")


class _Shards:
    """Some shards of a level's hashes, as a task holds them."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.hashes = {r["shard"]: (PerfectHash.of(r), np.frombuffer(bytes(r["numbers"]), np.int64)) for r in rows}

    def slots(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per shard: which keys are in it, their slots, and numbers by slot."""
        of = _shard_of(keys, self.shards)
        for shard, (made, numbers) in self.hashes.items():
            at = np.flatnonzero(of == shard)
            slots = made.slots(keys[at])
            yield shard, at[slots >= 0], slots[slots >= 0], numbers


def _passes(table: DataFrame, shards: int, at_once: int) -> Iterator:
    """Broadcasts of a few shards of hashes each; a shard's size is bounded."""
    sc = table.sparkSession.sparkContext
    for start in range(0, shards, at_once):
        rows = [r.asDict() for r in table.where(F.col("shard").between(start, start + at_once - 1)).collect()]
        sent = sc.broadcast(rows)
        yield sent, start + at_once >= shards
        sent.destroy()


def _counter(sent, shards: int):
    """Counts of a task by slot, an array a shard."""

    def make():
        from pyspark import TaskContext

        at, here = _Shards(sent.value, shards), TaskContext.get().partitionId()
        sums = {shard: np.zeros(len(made.keys), np.int64) for shard, (made, _) in at.hashes.items()}

        def handle(batch: pa.RecordBatch) -> None:
            for numbers in _blobs(batch):
                for shard, _, slots, _ in at.slots(_pairs(numbers)[1]):
                    sums[shard] += np.bincount(slots, minlength=len(sums[shard]))

        def finish():
            for shard, n in sums.items():
                if n.any():
                    yield {"shard": [shard], "task": [here], "counts": [n.tobytes()]}

        handle.finish = finish
        return handle

    return make


def _sum(arrays: list[bytes]) -> bytes:
    return sum(np.frombuffer(b, np.int64) for b in arrays).tobytes()


def _summed(parts: DataFrame, tasks: int, add=_sum) -> DataFrame:
    """One array a shard from those of all tasks, ``FAN`` at a time."""

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"][:1], "task": table["task"][:1], "counts": pa.array([add(table["counts"].to_pylist())], pa.binary())})

    while tasks > 1:
        parts = parts.withColumn("task", F.expr(f"task div {FAN}")).groupBy("shard", "task").applyInArrow(one, "shard long, task long, counts binary")
        tasks = -(-tasks // FAN)
    return parts


def _frequent(least: int):
    """Pairs whose slots hold the least count or more."""

    def handle(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"key": [], "a": []}
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            n = np.frombuffer(counts, np.int64)
            out["key"] += np.frombuffer(keys, np.int64)[n >= least].tolist()
            out["a"] += n[n >= least].tolist()
        return out

    return lambda: handle


def _next_numbers(sent, shards: int, last: bool):
    """The numbers of pairs where they begin; of ``numbers`` (of the level below) and what earlier passes know."""

    def make():
        at = _Shards(sent.value, shards)

        def handle(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"numbers": [], "pairs": [], "above": []}
            for numbers, known in zip(_blobs(batch), batch.column("above").to_pylist(), strict=True):
                above = np.zeros(len(numbers), np.int32) if known is None else np.frombuffer(known, np.int32).copy()
                where, keys = _pairs(numbers)
                for _, of, slots, found in at.slots(keys):
                    above[where[of]] = found[slots]
                if last:
                    for c, v in _blob(above).items():
                        out[c] += v
                else:
                    for c, v in (("numbers", numbers.tobytes()), ("pairs", len(keys)), ("above", above.tobytes())):
                        out[c].append(v)
            return out if not last else {c: out[c] for c in ("numbers", "pairs")}

        return handle

    return make


def level(below: DataFrame, least: int, shard_keys: int = SHARD_KEYS, at_once: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The frequent pairs of neighbouring numbers of ``below`` (key, a, number), and the runs of their numbers."""
    proposed = candidates(below, least).withColumn("number", F.lit(0).cast("long"))
    shards = max(1, -(-proposed.count() // shard_keys))
    table = hashes(proposed, shards)
    tasks = below.select("numbers").rdd.getNumPartitions()
    sums = None
    for sent, _ in _passes(table, shards, at_once):
        part = stored(_summed(map_batches(below.select("numbers"), _counter(sent, shards), "shard long, task long, counts binary"), tasks), "counts")
        sums = part if sums is None else sums.unionByName(part)
    counted = table.select("shard", "keys").join(sums.select("shard", "counts"), "shard").select("keys", "counts")
    frequent = stored(_numbered(stored(map_batches(counted, _frequent(least), "key long, a long"), "frequent"), "key"), "numbered")
    shards = max(1, -(-frequent.count() // shard_keys))
    state = below.withColumn("above", F.lit(None).cast("binary"))
    for sent, last in _passes(hashes(frequent.select("key", "number"), shards), shards, at_once):
        state = stored(map_batches(state, _next_numbers(sent, shards, last), BLOB if last else f"{BLOB}, above binary"), "numbers")
    return frequent, state


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, shard_words: int = SHARD_WORDS, shard_keys: int = SHARD_KEYS, at_once: int = SHARDS) -> DataFrame:
    """The best ``first`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = stored(map_batches(docs, _word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    known = stored(_numbered(stored(counted.where(F.col("a") >= least), "frequent"), "lang", "word"), "numbered")
    none = F.array().cast("array<long>")
    levels = [known.select("number", "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("lefts"), none.alias("rights"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("rest"))]
    numbers = encode(docs, known, shard_words)
    for _ in range(2, longest + 1):
        pairs, numbers = level(numbers, least, shard_keys, at_once)
        pairs = pairs.select("number", "a", F.shiftrightunsigned("key", 32).alias("first"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest"))
        p, q = (levels[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in levels[-1].columns]) for side in "pq")
        both = pairs.join(p, F.col("first") == F.col("p_number")).join(q, F.col("rest") == F.col("q_number"))
        levels.append(stored(both.select(
            "number", "a", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "q_last").alias("phrase"), F.col("q_last").alias("last"),
            F.concat("p_lefts", F.array("p_a")).alias("lefts"), F.concat(F.array("q_a"), "q_rights").alias("rights"), "first", "rest",
        ), "phrases"))
    kept = None
    for these, above in zip(levels[1:], [*levels[2:], None], strict=True):
        if above is not None:
            inside = above.select("a", F.explode(F.array("first", "rest")).alias("number")).groupBy("number").agg(F.max("a").alias("most"))
            these = these.join(inside, "number", "left").where("most IS NULL OR most < a").drop("most")
        kept = these if kept is None else kept.unionByName(these)
    value = "CAST(1000 * a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0)) DIV (CAST(x.lefts AS DECIMAL(19,0)) * CAST(x.rights AS DECIMAL(18,0)))"
    cuts = F.expr(f"array_min(transform(arrays_zip(lefts, rights), (x, i) -> struct({value} AS score, i, x.lefts AS l, x.rights AS r)))")
    scored = kept.join(totals, "lang").withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Every phrase counted.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), parts AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces
), spans AS (
  SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM parts, (SELECT unnest(range(1, 6)) AS k)
), counts AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM spans GROUP BY ALL
), totals AS (SELECT lang, sum(a) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (SELECT lang, k, phrase, a FROM counts WHERE k > 1 AND a >= 100
), cuts AS (
  SELECT c.*, string_split(phrase, ' ') AS ws, unnest(range(1, c.k)) AS j FROM candidates c
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, t.n, ((1000 * c.a::HUGEINT) * t.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cuts c JOIN totals t USING (lang) JOIN counts x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.ws[1:c.j], ' ')
    JOIN counts y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.ws[c.j + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.k, c.phrase ORDER BY score, c.j) = 1
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.lang = s.lang AND b.k > s.k AND b.a >= s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
