"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items become sequences of word numbers; every run of ``window``
consecutive item words is a pattern of one automaton, which reads the word
numbers of a document once. Word positions map back to character offsets of
the original text.

The patterns reach the driver and the executors in chunks of at most
``chunk_windows`` windows, each with its own pass over the documents. What a
pass finds is written to the shared folder before the next one begins, so that
what is broadcast and held at a time is bounded whatever the size of the
benchmark; a benchmark up to the bound takes one automaton and one pass.

Defined cases: a null or empty text has no words; a very long text is scanned
whole; an item without words
occurs nowhere; an item with a null id marks words but is not counted or
listed; items with the same id count once; a repeated document row is scanned
again and kept; other columns go along unseen, whatever their names, but those
that this adds are replaced; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD_WORDS, append, discard, read, sheltered, stored

#: Bounds of one chunk of the benchmark: windows in an automaton, and bytes of text at the driver.
CHUNK_WINDOWS, CHUNK_BYTES = 200_000, 32 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_ADDED = "n_words long, spans array<array<long>>, item_keys array<string>"


def item_windows(text: bytes, window: int) -> list[tuple[bytes, ...]]:
    words = text.translate(FOLD_WORDS).split()
    n = max(1, len(words) - window + 1) if words else 0
    return [tuple(words[i : i + window]) for i in range(n)]


def _chunks(items: DataFrame, window: int, chunk_windows: int, chunk_bytes: int):
    """Lists of (words, item keys), each of bounded size."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // chunk_bytes) or 1
    for part in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        found: dict[tuple[bytes, ...], set] = {}
        for row in some.toLocalIterator():
            for w in item_windows((row["text"] or "").encode(), window):
                found.setdefault(w, set()).add(row["item_key"])
                if len(found) >= chunk_windows:
                    yield found
                    found = {}
        if found:
            yield found


class _Scanner:
    """Scans documents for the windows of one chunk."""

    def __init__(self, windows: dict[tuple[bytes, ...], set]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, keys in windows.items():
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            self.auto.add_word(ids, (len(ids), tuple(k for k in keys if k is not None)))
        self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged word intervals [first, last + 1) that are hit, and the item keys."""
        get = self.number.get
        ids = tuple([get(w, 0) for w in words])
        spans, keys = [], set()
        if any(ids):
            for end, (n, found) in self.auto.iter(ids):
                keys.update(found)
                spans.append([end - n + 1, end + 1])
        return merge(spans), keys


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    chunk_windows: int = CHUNK_WINDOWS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` with n_words, spans (hit word intervals) and item_keys."""
    sc = docs.sparkSession.sparkContext
    bench = items.select(
        F.col(item_id_col).cast("string").alias("item_key"), F.col(item_text_col).cast("string").alias("text")
    )
    names = docs.columns
    text, added = f"c{names.index(text_col)}", [c.split()[0] for c in _ADDED.split(", ")]
    hidden, found, last = docs.toDF(*[f"c{i}" for i in range(len(names))]), None, None
    for chunk in _chunks(bench, window, chunk_windows, chunk_bytes):
        if found is not None:  # there is a further chunk
            before, last = last, stored(found, "scanned")
            found = _united(append(last, text, _scan_with(sc.broadcast(chunk)), _MORE))
            if before is not None:
                discard(before)
        else:
            found = append(hidden, text, _scan_with(sc.broadcast(chunk)), _ADDED)
    if found is None:
        found = append(hidden, text, _scan_with(None), _ADDED)
    kept = [(f"c{i}", c) for i, c in enumerate(names) if c not in added]
    return found.select(*[c for c, _ in kept], *added).toDF(*[c for _, c in kept], *added)


#: What a further chunk adds, before it is united with what the chunks before it found.
_MORE = "n_words_ long, spans_ array<array<long>>, item_keys_ array<string>"


def _united(df: DataFrame) -> DataFrame:
    """Unite hits of a further chunk. Spans may overlap until ``merge`` puts them together."""
    return (
        df.withColumn("spans", F.concat("spans", "spans_"))
        .withColumn("item_keys", F.array_union("item_keys", "item_keys_"))
        .drop("n_words_", "spans_", "item_keys_")
    )


def _scan_with(shared):
    def make():
        scanner = _Scanner(shared.value) if shared is not None else None

        def work(rows: list[bytes]) -> dict:
            n_words, spans, keys = [], [], []
            for text in rows:
                words = text.translate(FOLD_WORDS).split()
                hit, found = scanner.scan(words) if scanner else ([], set())
                n_words.append(len(words))
                spans.append(hit)
                keys.append(sorted(found))
            by = {"n_words": n_words, "spans": spans, "item_keys": keys}
            return by | {f"{k}_": v for k, v in by.items()}

        return work

    return make


def n_hit(spans: F.Column) -> F.Column:
    """Words in the union of the intervals, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s[1]).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def char_spans(text: str, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Code-point intervals of word intervals in the original text."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, chars, before = [], 0, 0
    for a, b in merge(spans):
        ends = []
        for i in (at[a][0], at[b - 1][1]):
            chars += len(raw[before:i].decode())
            before = i
            ends.append(chars)
        out.append(tuple(ends))
    return out


def with_offsets(found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Add char_spans to the rows of ``contamination``: the hit code points [first, end) of the original text."""
    packed = found.withColumn("spans", F.to_json("spans"))
    names = found.columns
    text, spans = f"c{names.index(text_col)}", f"c{names.index('spans')}"
    joined = packed.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("packed", F.concat(F.col(spans), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))

    def make():
        def work(rows: list[bytes]) -> dict:
            both = [r.partition(b"\n") for r in rows]
            return {"char_spans": [[list(x) for x in char_spans(t.decode(), json.loads(s))] for s, _, t in both]}

        return work

    kept = [c for c in names if c != "char_spans"]
    done = append(joined, "packed", make, "char_spans array<array<long>>")
    done = done.withColumn(spans, F.from_json(spans, "array<array<long>>"))
    return done.select(*[f"c{i}" for i, c in enumerate(names) if c in kept], "char_spans").toDF(*kept, "char_spans")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in."""
    used = [options.get("text_col", "text")]
    return sheltered(docs, used, lambda rows: contamination(rows, items, **options).where(F.size("spans") == 0))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("item_keys").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_keys"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: DuckDB. Short items give windows of their own length.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n,
               unnest(generate_series(1, greatest(1, len(w) - 9))) AS i
        FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS k
          FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS k, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.k, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.k, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(words.k, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
