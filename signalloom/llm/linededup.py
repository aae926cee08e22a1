"""Line dedup by winnowing over line hashes.

A repeated passage may begin and end anywhere in the text's own lines, so the
text is taken re-wrapped: from each word on stands a line of ``LINE_WORDS``
words, wherever line breaks are. Of the lines in each window of ``min_words``
words the least hash is the window's fingerprint. Equal windows have equal
fingerprints wherever they stand, so a fingerprint that was selected only once
is in no repeat.

Consecutive windows of one fingerprint are a stretch, whose outermost windows
are the furthest that a match reaches from the fingerprint to the left and to
the right while it decides. Positions of repeated fingerprints are joined:
equal whole stretches match as one, by a hash of all their words; of stretches
that differ and share a fingerprint, or in which it stands more than once, one
of each kind is extended window by window. Each is compared with the earliest place of equal content. Matches
unite over the stretches of a document to maximal runs, and the words of a run
that stands earlier are deleted: exactly those words go that are in
``min_words`` consecutive words with an earlier occurrence. Only sums and least
places are aggregated, so the work is linear however often a passage repeats.

A first scan counts fingerprints. Those that repeat set bits of a bitmap of
``FILTER_BITS`` (16 MB whatever the input), with which the second scan leaves
out most others; what it lets through by chance matches nothing.

Documents are ordered by id, then by a hash of the text, then by word. Hashes
of words and runs are 64 bits, compared within equal fingerprints of 64 bits.

Defined cases: a null text stays null and an empty one empty; a line of which
some words go keeps the others with a blank between them, one of which all go
is left out, other lines stay as they are; a very long text is hashed piece by
piece and cut as a whole; rows equal in id and text are one document and are
treated alike; null ids come first; other columns go along unseen, whatever
their names, but n_words and n_deleted are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, dismiss, held, map_batches, read, stored, texts

MIN_WORDS, LINE_WORDS, FILTER_BITS = 50, 8, 27
#: Most windows of a stretch, bytes hashed at a time, words looked at a time, and words that are hashed one by one.
_STRETCH, _SLICE, _CHUNK, _LONG_WORD = 64, 1 << 18, 1 << 18, 4096
_U = np.uint64
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLANK = np.isin(np.arange(256, dtype=np.uint8), list(_BLANKS))
_BLANK_AT = re.compile(rb"[\x20\x09-\x0d]")


# Hashes of words and of runs of words: sums of values times powers, so that a run's is a difference of two sums.

_BYTE = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_held = {True: np.ones(1, _U), False: np.ones(1, _U)}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    if len(_held[inverse]) < n:
        out = np.full(1 << (n - 1).bit_length(), pow(_BASE, -1, 1 << 64) if inverse else _BASE, _U)
        out[0] = 1
        _held[inverse] = np.multiply.accumulate(out)
    return _held[inverse][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(len(values)), out=out[1:])
    return out


def _runs(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [first, end)."""
    return _mixed((sums[end] - sums[first]) * _powers(len(sums), True)[first])


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte of each word of a slice."""
    import xxhash

    raw = np.frombuffer(data, np.uint8)
    ink = np.zeros(len(raw) + 2, bool)
    ink[1:-1] = ~_BLANK[raw]
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, _U), first
    out = _runs(_sums(_BYTE[raw]), first, end)
    for i in np.flatnonzero(end - first > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[first[i] : end[i]])
    return out, first


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word of a text of any length."""
    import xxhash

    out, at = [], 0
    while at < len(text):
        stop = at + _SLICE
        if stop < len(text):
            following = _BLANK_AT.search(text, stop, stop + _LONG_WORD + 1)
            if following:
                stop = following.start()
            else:  # within a word that is hashed by itself
                stop = max(at, *(text.rfind(bytes([c]), at, stop) for c in _BLANKS))
                if stop == at and text[at] not in _BLANKS:
                    following = _BLANK_AT.search(text, at)
                    stop = following.start() if following else len(text)
                    out.append(np.array([xxhash.xxh64_intdigest(text[at:stop])], _U))
                    at = stop
                    continue
                stop += 1
        out.append(_hashed(text[at:stop])[0])
        at = stop
    return np.concatenate(out) if out else np.empty(0, _U)


def pieces(rows: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words, the row of each and its number in the row; several short rows or overlapping parts of a long one."""
    at = 0
    while at < len(rows):
        if len(rows[at]) > _SLICE:
            found = word_hashes(rows[at])
            for a in range(0, max(1, len(found) - least + 1), _CHUNK):
                part = found[a : a + _CHUNK + least - 1]
                yield part, np.full(len(part), at), np.arange(a, a + len(part))
            at += 1
            continue
        stop, size = at, 0
        while stop < len(rows) and size + len(rows[stop]) <= _SLICE:
            size += len(rows[stop])
            stop += 1
        found, first = _hashed(b"\n".join(rows[at:stop]))
        begins = np.cumsum([0] + [len(t) + 1 for t in rows[at:stop]])
        row = np.searchsorted(begins, first, "right") - 1
        counts = np.bincount(row, minlength=stop - at)
        yield found, row + at, np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = stop


def _sliding_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` values, and where the last one of it stands."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = values[step:] <= values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return values, at


class Stretches:
    """Stretches of windows with one fingerprint, of the words of ``pieces``.

    ``tied`` are those in which the fingerprint stands more than once: only there
    may windows of one stretch be equal.
    """

    def __init__(self, words: np.ndarray, row: np.ndarray, least: int):
        line = min(LINE_WORDS, least)
        n = max(0, len(words) - least + 1)
        self.sums, self.least = _sums(words), least
        self.at = np.flatnonzero(row[:n] == row[least - 1 :]) if n else np.empty(0, np.int64)
        if not len(self.at):
            self.first = self.size = self.at
            self.mark, self.tied = np.empty(0, _U), np.empty(0, bool)
            return
        starts = np.arange(len(words) - line + 1)
        mark, stands = (x[self.at] for x in _sliding_least(_runs(self.sums, starts, starts + line), least - line + 1))
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (np.diff(self.at) != 1) | (row[self.at[1:]] != row[self.at[:-1]])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(mark)))
        tied = np.repeat(stands[begin] != stands[begin + sizes - 1], sizes)
        inner = np.arange(len(mark)) - np.repeat(begin, sizes)
        self.first = np.flatnonzero(inner % _STRETCH == 0)
        self.size = np.diff(np.append(self.first, len(mark)))
        self.mark, self.tied = mark[self.first], tied[self.first]

    def whole(self, some: np.ndarray) -> np.ndarray:
        """Hashes of all words of the chosen stretches, and of how many windows they are."""
        first = self.at[self.first[some]]
        return _runs(self.sums, first, first + self.size[some] - 1 + self.least) ^ _mixed(self.size[some].astype(_U))

    def windows(self, some: np.ndarray) -> pa.ListArray:
        """Hashes of the windows of the chosen stretches."""
        size = self.size[some]
        ends = np.cumsum(size)
        which = np.repeat(self.first[some] - (ends - size), size) + np.arange(size.sum())
        at = self.at[which]
        values = _runs(self.sums, at, at + self.least)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view(np.int64)))


def _selected(least: int):
    """Fingerprints of a batch and how many stretches have them, tied ones twice."""

    def make():
        def handle(batch: pa.RecordBatch) -> dict:
            found = [Stretches(words, row, least) for words, row, _ in pieces(texts(batch), least)]
            marks, n = np.unique(np.concatenate([x for f in found for x in (f.mark, f.mark[f.tied])]), return_counts=True)
            return {"mark": marks.view(np.int64), "n": n}

        return handle

    return make


def _positions(least: int, bits):
    """Stretches whose fingerprint has its bit set."""

    def make():
        lit = bits.value

        def handle(batch: pa.RecordBatch) -> dict:
            rows, body = texts(batch), batch.column("body").to_numpy()
            out: dict[str, list] = {k: [] for k in ("doc_id", "body", "first", "n", "mark", "tied", "whole", "windows")}
            for words, row, number in pieces(rows, least):
                found = Stretches(words, row, least)
                slot = found.mark & _U((1 << FILTER_BITS) - 1)
                some = np.flatnonzero((lit[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1))
                at = found.at[found.first[some]]
                out["doc_id"].append(batch.column("doc_id").take(pa.array(row[at])))
                out["body"].append(pa.array(body[row[at]]))
                out["first"].append(pa.array(number[at]))
                out["n"].append(pa.array(found.size[some]))
                out["mark"].append(pa.array(found.mark[some].view(np.int64)))
                out["tied"].append(pa.array(found.tied[some]))
                out["whole"].append(pa.array(found.whole(some).view(np.int64)))
                out["windows"].append(found.windows(some))
            return {k: pa.chunked_array(v) for k, v in out.items()}

        return handle

    return make


def _bitmap(marks: DataFrame) -> np.ndarray:
    """A bit for each slot that a fingerprint falls on; 16 MB at most."""
    slot = F.col("mark").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    found = marks.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(_U)


def repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body (a hash of the text), spans: intervals [first, end) of words that stand earlier; they may overlap."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    marks = map_batches(chosen.select("text"), _selected(min_words), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1")
    lit = docs.sparkSession.sparkContext.broadcast(_bitmap(marks))
    near = held(map_batches(chosen, _positions(min_words, lit), "doc_id long, body long, first long, n long, mark long, tied boolean, whole long, windows array<long>"))
    place = F.struct("doc_id", "body", "first")
    # Held, as the joins below then stand alone and skewed ones are split.
    kinds = held(near.groupBy("mark", "whole").agg(F.min(place).alias("origin"), F.max(place).alias("final"), F.bool_or("tied").alias("tied"), F.first("windows").alias("windows")), "mark", "whole")
    copied = kinds.where("origin <> final").select("mark", "whole", "origin")
    later = near.select("mark", "whole", "doc_id", "body", "first", "n").join(copied, ["mark", "whole"]).where(~place.eqNullSafe(F.col("origin")))
    later = held(later.select("doc_id", "body", "first", (F.col("first") + F.col("n") - 1 + min_words).alias("end")))
    dismiss(near)

    shared = held(kinds.groupBy("mark").agg(F.count("*").alias("n"), F.bool_or("tied").alias("tied")).where("n > 1 OR tied").select("mark"), "mark")
    differing = kinds.join(shared, "mark", "left_semi").select("mark", "origin.*", "windows").orderBy("doc_id", "body", "first")
    # Sorted by place, so that a number stands for the place of a window; a stretch has fewer windows than 2^10.
    # Written, as the numbers must be the same whenever they are read.
    differing = stored(differing.withColumn("number", F.monotonically_increasing_id()), "differing")
    dismiss(kinds, shared)
    each = differing.select("mark", "number", "doc_id", "body", "first", F.posexplode("windows").alias("i", "window"))
    each = each.withColumn("number", F.expr("number * 1024 + i"))
    found = each.groupBy("mark", "window").agg(F.min("number").alias("origin"), F.max("number").alias("final")).where("origin <> final").select("mark", "window", "origin")
    found = held(found, "mark", "window")
    partly = each.join(found, ["mark", "window"]).where("number <> origin").select("doc_id", "body", (F.col("first") + F.col("i")).alias("first"), (F.col("first") + F.col("i") + min_words).alias("end"))
    spans = stored(later.unionByName(partly).groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "spans")
    dismiss(later, found)
    discard(differing)
    return spans


def drop_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text that is left, and n_words and n_deleted (words before, and gone)."""
    found = repeats(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    names = docs.columns
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    hidden = docs.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = hidden.withColumn("body", F.xxhash64(text))
    spans = found.select(F.col("doc_id").alias("of"), F.col("body").alias("hash"), "spans")
    joined = keyed.join(spans, F.col(key).cast("long").eqNullSafe(F.col("of")) & (F.col("body") == F.col("hash")), "left").drop("of", "hash", "body")
    kept = [f for f in hidden.schema if f.name != text]
    schema = StructType([*kept, StructField("left", StringType()), StructField("n_words", LongType()), StructField("n_deleted", LongType())])

    def make():
        def handle(batch: pa.RecordBatch) -> dict:
            left, spans = batch.column(text), batch.column("spans")
            changed = spans.is_valid()
            rows = texts(batch.filter(changed), text)
            spans = spans.drop_null()
            first, end = (spans.flatten().field(k).to_numpy() for k in ("first", "end"))
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(spans).to_numpy())])
            each = [cut(t, zip(first[a:b].tolist(), end[a:b].tolist(), strict=True)) for t, a, b in zip(rows, at[:-1], at[1:], strict=True)]
            if each:
                left = pc.replace_with_mask(left, changed, pa.array([x[0].decode() for x in each], left.type))
            gone = np.zeros(batch.num_rows, np.int64)
            gone[changed.to_numpy(zero_copy_only=False)] = [x[1] for x in each]
            return {f.name: batch.column(f.name) for f in kept} | {"left": left, "n_words": count_words(batch.column(text)), "n_deleted": gone}

        return handle

    done = map_batches(joined, make, schema)
    order = ["left" if f"c{i}" == text else f"c{i}" for i, c in enumerate(names) if c not in ("n_words", "n_deleted")]
    return done.select(*order, "n_words", "n_deleted").toDF(*[c for c in names if c not in ("n_words", "n_deleted")], "n_words", "n_deleted")


def count_words(column: pa.StringArray) -> np.ndarray:
    """The number of words of each text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    ink = ~_BLANK[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    first[begins] = ink[begins]
    sums = np.concatenate([[0], np.cumsum(first)])
    return sums[at[1:]] - sums[at[:-1]]


def cut(text: bytes, spans: Iterable[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the words of the spans, and how many went."""
    lines = text.split(b"\n")
    parts = [line.split() for line in lines]
    gone = np.zeros(sum(map(len, parts)), bool)
    for first, end in spans:
        gone[first:end] = True
    out, at = [], 0
    sums = np.concatenate([[0], np.cumsum(gone)]).tolist()
    for line, words in zip(lines, parts, strict=True):
        before, at = at, at + len(words)
        lost = sums[at] - sums[before]
        if not lost:
            out.append(line)
        elif lost < len(words):
            out.append(b" ".join(w for w, g in zip(words, gone[before:at].tolist(), strict=True) if not g))
    return b"\n".join(out), sums[-1]


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = drop_repeats(docs, min_words=MIN_WORDS)
    return found.select("doc_id", "n_words", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: DuckDB, on the definition: every window of 50 words, compared by content.
SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS ln FROM documents),
x AS (SELECT doc_id, ln, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS w FROM l),
p AS (
  SELECT doc_id, ln, word, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) AS pos
  FROM (SELECT doc_id, ln, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM x WHERE len(w) > 0)),
a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS r FROM (
      SELECT doc_id, pos, array_to_string(w[pos : pos + 49], ' ') AS content
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS pos FROM a WHERE len(w) >= 50)))
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS pos FROM later),
lines AS (
  SELECT p.doc_id, ln, count(*) AS n, count(gone.pos) AS g, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL) AS kept
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos GROUP BY p.doc_id, ln)
SELECT x.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(g), 0) AS BIGINT) AS n_deleted,
       sha256(coalesce(string_agg(CASE WHEN coalesce(g, 0) = 0 THEN raw ELSE kept END, chr(10) ORDER BY x.ln) FILTER (WHERE g IS NULL OR g < n), '')) AS text_sha256
FROM x LEFT JOIN lines ON x.doc_id = lines.doc_id AND x.ln = lines.ln GROUP BY x.doc_id
"""
