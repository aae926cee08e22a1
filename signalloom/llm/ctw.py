"""Language-model scoring by context-tree weighting.

A text is its UTF-8 bytes, ASCII capitals lowered, and a final zero byte. Each
byte is eight binary decisions along a path of a byte tree, each made in the
contexts of the last 0 to ``DEPTH`` bytes (zeros before the text). A node is a
context and a place on the path; it counts zeros and ones of all training
texts and has a Krichevsky-Trofimov estimate. Going from the longest contexts
to the empty one, a node's weighted probability is half its own estimate and
half the product of its children's, which gives the weight of its own estimate
against longer contexts once training is over. A text's code length sums, over
bytes and decisions, the mixture over all depths; where a longer context was
never seen, the estimate of the longest seen one stands for it.

Counts are of all training text: each task counts the strings of DEPTH + 1
bytes in its rows, sums and the weighting bottom-up are grouped aggregates.
Every node is kept. Nodes of contexts up to ``SHORT`` bytes, of which there are
at most 256 ** SHORT * 255 whatever the corpus, are broadcast; those of longer
contexts stay in a table that is dealt to buckets by the last SHORT + 1 bytes of
the context. Documents are dealt to chunks of text; the distinct strings of a
chunk meet the nodes in the buckets and bring their log probabilities back to
the chunk, whose texts are then scored.

The base score is a unigram model of words with one added to counts. Its table
isn't bounded: at most ``HOT`` of the most frequent words are broadcast, and
each document's other words are joined by word.

Defined cases: a null or empty text has the end alone; null ids train nothing
and are not held out; repeated rows train and are scored each; with no
training rows N and V are 0 and both models are uniform; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import FOLD_CASE, map_batches, read, stored, texts, to_batch

DEPTH, SHORT, HOT = 5, 2, 1 << 17
#: Bytes of text for each chunk of documents, and for each bucket of nodes.
CHUNK, BUCKET = 1 << 24, 1 << 19
#: Bytes of text whose strings are looked up at a time, and words or strings a task holds before it hands them on.
_SLICE, _HELD = 1 << 19, 1 << 19
#: Slots of a chunk's strings; those that another took are searched for.
_MEMO = 1 << 21
_U = np.uint64
_SCORED = "n_bytes long, n_tokens long, hot_known long, hot_score double, rest array<binary>, rest_n array<long>"


def strings(rows: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each byte of the texts and their ends: the byte and the ``depth`` before it, newest lowest."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in rows), np.uint8).astype(np.uint64)
    n = len(data)
    key = np.zeros(n, np.uint64)
    for d in range(depth + 1):
        key[d:] |= data[: n - d] << _U(8 * d)
    real = np.ones(n, bool)
    at = np.cumsum([0] + [len(t) + 1 + depth for t in rows[:-1]])
    for d in range(depth):
        real[at + d] = False
    return key[real]


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


#: lgamma of halves below 16; beyond, Stirling's series is good to 1e-12.
_HALVES = np.array([math.inf] + [math.lgamma(i / 2) for i in range(1, 32)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of whole and half numbers."""
    far = np.maximum(x, 16.0)
    r = 1.0 / (far * far)
    series = (far - 0.5) * np.log(far) - far + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / far
    return np.where(x < 16.0, _HALVES[np.minimum(2 * x, 31).astype(np.int64)], series)


class Nodes:
    """Nodes by number: the probability of the rarer bit (less than 0 if that is a zero), and the weight.

    A probability near one isn't kept as such: in single precision it is one
    from some 17 million counts on, and the other bit would be impossible.
    """

    def __init__(self, node: np.ndarray, rare: np.ndarray, weight: np.ndarray):
        order = np.argsort(node)
        self.node, self.rare, self.weight = node[order], rare[order], weight[order]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the nodes are there, with the probabilities of a one and the weights."""
        if not len(self.node):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted)), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(self.node, wanted), len(self.node) - 1)
        rare = self.rare[at].astype(np.float64)
        return self.node[at] == wanted, np.where(rare > 0, rare, 1.0 + rare), self.weight[at].astype(np.float64)


def log10(keys: np.ndarray, short: Nodes, long: Nodes) -> np.ndarray:
    """log10 probabilities of bytes after contexts (distinct ``strings``)."""
    byte, context = keys & _U(255), keys >> _U(8)
    out = np.zeros(len(keys))
    for i in range(8):
        path = (_U(1) << _U(i)) | (byte >> _U(8 - i))
        bit = ((byte >> _U(7 - i)) & _U(1)).astype(bool)
        mixed, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for d in range(DEPTH, -1, -1):
            wanted = (_U(d) << _U(48)) | ((context & _U((1 << 8 * d) - 1)) << _U(8)) | path
            seen, one, weight = (long if d > SHORT else short).find(wanted.view(np.int64))
            own = np.where(bit, one, 1.0 - one)
            weight = np.where(known, weight, 1.0)
            mixed = np.where(seen, weight * own + (1.0 - weight) * mixed, mixed)
            known |= seen
        out += np.log10(mixed)
    return out


class Values:
    """The log probabilities of all strings of a chunk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.known, self.value = np.full(_MEMO, np.iinfo(np.uint64).max), np.zeros(_MEMO)
        slot = self._slot(self.keys)
        self.known[slot], self.value[slot] = self.keys, self.values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - _MEMO.bit_length() + 1)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        missed = np.flatnonzero(self.known[slot] != keys)
        out[missed] = self.values[np.searchsorted(self.keys, keys[missed])]
        return out

    def scores(self, rows: list[bytes]) -> list[float]:
        """log10 probability of each text, many looked up at once."""
        out = []
        for some in sliced(rows):
            if len(some) == 1:
                out.append(float(sum(self.of(keys).sum() for keys in pieces(some[0]))))
            else:
                starts = np.cumsum([0] + [len(t) + 1 for t in some[:-1]])
                out += np.add.reduceat(self.of(strings(some)), starts).tolist()
        return out


def sliced(rows: list[bytes]) -> Iterator[list[bytes]]:
    """Texts of a slice together, and a longer one by itself."""
    at = 0
    while at < len(rows):
        stop, size = at, 0
        while stop < len(rows) and (stop == at or size + len(rows[stop]) < _SLICE):
            size += len(rows[stop])
            stop += 1
        yield rows[at:stop]
        at = stop


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The strings of one text by pieces that overlap by a context."""
    for a in range(0, len(text) + 1, _SLICE):
        last = a + _SLICE > len(text)
        yield strings([text[max(0, a - DEPTH) : a + _SLICE]])[min(a, DEPTH) : None if last else -1]


def distinct_strings(rows: list[bytes]) -> np.ndarray:
    found = [_distinct(keys) for some in sliced(rows) for keys in (pieces(some[0]) if len(some) == 1 else [strings(some)])]
    return _distinct(np.concatenate(found))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """By sorting, which is many times faster here than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Model:
    """All nodes: those of short contexts, and a table of the others."""

    def __init__(self, short: Nodes, long: DataFrame):
        self.short, self.long = short, long

    def score(self, docs: DataFrame, make, added: str) -> DataFrame:
        """The columns of ``docs`` but ``text``, those that ``make``'s handler adds, and model_score."""
        spark = docs.sparkSession
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        chunks, buckets = 1 + size // CHUNK, 1 + size // BUCKET
        dealt = docs.withColumn("chunk", F.pmod(F.xxhash64(*docs.columns), F.lit(chunks)))
        bucket = lambda context: F.pmod(F.xxhash64(context.bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))), F.lit(buckets))
        asked = dealt.groupBy("chunk").applyInArrow(_asked, "chunk long, key long").withColumn("bucket", bucket(F.shiftrightunsigned("key", 8)))
        nodes = self.long.withColumn("bucket", bucket(F.shiftrightunsigned("node", 8)))
        short = spark.sparkContext.broadcast(self.short)

        def valued(key, strings: pa.Table, nodes: pa.Table) -> pa.Table:
            distinct, which = np.unique(strings.column("key").to_numpy().view(np.uint64), return_inverse=True)
            long = Nodes(*(nodes.column(c).to_numpy() for c in ("node", "rare", "weight")))
            values = log10(distinct, short.value, long)[which]
            return pa.table({"chunk": strings.column("chunk"), "key": strings.column("key"), "value": values})

        values = asked.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(valued, "chunk long, key long, value double")
        kept = [c for c in docs.columns if c != "text"]
        schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL(added).fields, StructField("model_score", DoubleType())])
        arrow = to_arrow_schema(schema)

        def scored(key, rows: pa.Table, table: pa.Table) -> pa.Table:
            low = _folded(rows)
            look = Values(table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy())
            out = {c: rows.column(c) for c in kept} | make()(low) | {"model_score": look.scores(low)}
            return pa.Table.from_batches([to_batch(out, arrow)])

        return dealt.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(scored, schema)

    def scores(self, rows: list[bytes]) -> list[float]:
        """log10 probability of each of a few texts."""
        spark = self.long.sparkSession
        docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(rows)], "at long, text string")
        found = self.score(docs, lambda: lambda low: {"n": [len(t) for t in low]}, "n long").select("at", "model_score").collect()
        return [r["model_score"] for r in sorted(found, key=lambda r: r["at"])]


def _folded(rows: pa.Table) -> list[bytes]:
    return [t.translate(FOLD_CASE) for t in texts(rows)]


def _asked(rows: pa.Table) -> pa.Table:
    """The distinct strings of a chunk."""
    keys = distinct_strings(_folded(rows))
    return pa.table({"chunk": np.full(len(keys), rows.column("chunk")[0].as_py()), "key": keys.view(np.int64)})


# Training


def _counted(spare: int = _HELD):
    """The strings in a task's texts and how often they occur."""

    def make():
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            distinct, which = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(which, weights=counts).astype(np.int64)

        def handle(batch: pa.RecordBatch):
            rows = [t.translate(FOLD_CASE) for t in texts(batch)]
            held.append(np.unique(strings(rows), return_counts=True))
            if sum(len(k) for k, _ in held) > 4 * spare:
                held[:] = [summed()]
                if len(held[0][0]) > spare:
                    keys, counts = held.pop()
                    return {"key": keys.view(np.int64), "n": counts}
            return None

        def finish():
            if held:
                keys, counts = summed()
                yield {"key": keys.view(np.int64), "n": counts}

        handle.finish = finish
        return handle

    return make


def _words(spare: int = _HELD):
    """The words in a task's texts and how often they occur; the end is null."""

    def make():
        held: Counter = Counter()
        ends = [0]

        def taken() -> dict:
            out = {"word": [*held], "n": [*held.values()]}
            held.clear()
            return out

        def handle(batch: pa.RecordBatch):
            for t in texts(batch):
                held.update(t.translate(FOLD_CASE).split())
                ends[0] += 1
            return taken() if len(held) > spare else None

        def finish():
            rest = taken()
            yield {"word": [*rest["word"], None], "n": [*rest["n"], ends[0]]}

        handle.finish = finish
        return handle

    return make


def _weighted():
    """Add a node's estimate and weighted probability (logs) to counts and the children's product."""

    def handle(batch: pa.RecordBatch) -> dict:
        zeros, ones = (batch.column(c).to_numpy().astype(np.float64) for c in ("zeros", "ones"))
        own, below = log_kt(zeros, ones), batch.column("below").to_numpy(zero_copy_only=False).astype(np.float64)
        both = np.where(np.isnan(below), own, math.log(0.5) + np.logaddexp(own, np.nan_to_num(below)))
        weight = np.where(np.isnan(below), 1.0, np.exp(math.log(0.5) + own - both))
        return {"context": batch.column("context"), "path": batch.column("path"), "zeros": batch.column("zeros"), "ones": batch.column("ones"), "weighted": both, "weight": weight}

    return handle


def train(texts_only: DataFrame) -> Model:
    """Fit on the column ``text``, all rows whole."""
    counted = map_batches(texts_only, _counted(), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    byte = F.col("key").bitwiseAND(F.lit(255))
    shift = lambda c, by: F.shiftrightunsigned(c, by)
    path = [(F.lit(1 << i) + shift(byte, 8 - i), shift(byte, 7 - i).bitwiseAND(F.lit(1))) for i in range(8)]
    steps = F.explode(F.array(*[F.struct(p.alias("path"), b.alias("bit")) for p, b in path])).alias("s")
    nodes = counted.select(shift(F.col("key"), 8).alias("context"), "n", steps).groupBy("context", F.col("s.path").alias("path"))
    nodes = nodes.agg(F.sum(F.when(F.col("s.bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("s.bit") == 1, F.col("n")).otherwise(0)).alias("ones"), F.lit(None).cast("double").alias("below"))
    kept = {}
    share = lambda c: (F.col(c) + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    rare = F.when(F.col("ones") <= F.col("zeros"), share("ones")).otherwise(-share("zeros"))
    for depth in range(DEPTH, -1, -1):
        done = stored(map_batches(nodes, lambda: _weighted(), "context long, path int, zeros long, ones long, weighted double, weight double"), f"nodes-{depth}")
        number = F.shiftleft("context", 8).bitwiseOR(F.col("path").cast("long")).bitwiseOR(F.lit(depth << 48))
        kept[depth] = done.select(number.alias("node"), rare.cast("float").alias("rare"), F.col("weight").cast("float").alias("weight"))
        if depth:
            parent = F.col("context").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1))
            nodes = done.groupBy(parent.alias("context"), "path").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    # At most 256 ** SHORT * 255 rows of the deepest, whatever the input.
    short = reduce(DataFrame.unionByName, [kept[d] for d in range(SHORT + 1)]).toArrow()
    return Model(Nodes(*(short.column(c).to_numpy() for c in ("node", "rare", "weight"))), reduce(DataFrame.unionByName, [kept[d] for d in range(SHORT + 1, DEPTH + 1)]))


def _scored(hot, total: float):
    """The part of the base score that hot words give, and the other words."""

    def make():
        known = {w: math.log10((n + 1) / total) for w, n in hot.value.items()}.get

        def work(low: list[bytes]) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "hot_known", "hot_score", "rest", "rest_n")}
            for t in low:
                words = t.split()
                logs = list(map(known, words))
                rest = Counter(w for w, x in zip(words, logs, strict=True) if x is None) if None in logs else {}
                out["n_bytes"].append(len(t) + 1)
                out["n_tokens"].append(len(words) + 1)
                out["hot_known"].append(len(words) - sum(rest.values()))
                out["hot_score"].append(sum(filter(None, logs)))
                out["rest"].append([*rest])
                out["rest_n"].append([*rest.values()])
            return out

        return work

    return make


def frequent(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the most frequent words: all whose count reaches a level, eight levels for each doubling."""
    level = F.floor(8 * F.log2("n"))
    counts = words.groupBy(level.alias("level")).count().collect()  # at most 8 * 63 rows
    least, taken = math.inf, 0
    for row in sorted(counts, reverse=True):
        taken += row["count"]
        if taken > most:
            break
        least = row["level"]
    return words.where(level >= F.lit(float(least)))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, hot_words: int = HOT) -> DataFrame:
    """Of every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (code length, its end counted as a byte)."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out)
    learned = chosen.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text")
    model = train(learned)

    # A task without rows gives the end a count of 0.
    words = stored(map_batches(learned, _words(), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = float(n_all + n_kinds + 1)
    few = frequent(words.where(F.octet_length("word") <= 64), hot_words).toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(few.column("word").to_pylist(), few.column("n").to_pylist(), strict=True)))

    made = model.score(chosen, _scored(hot, total), _SCORED)
    made = stored(made.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rest = made.select("_row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("_row", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("k"))
    count = F.coalesce("n", F.lit(0))
    sums = rest.join(words.where("word is not null"), "word", "left").groupBy("_row").agg(
        F.sum(F.col("k") * F.log10((count + 1) / F.lit(total))).alias("rest_score"), F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("rest_known")
    )
    end = math.log10((ends + 1) / total)
    return made.join(sums, "_row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("rest_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rest_score", F.lit(0.0)) + end).alias("base_score"),
        F.col("model_score").alias("score"), (F.col("model_score") * -math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
