"""Language ID with a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's emission scores
come from hashed byte n-grams of the word between boundary marks (those that
hold a mark are its affixes) and from lexicons of the frequent words of each
language; learned transitions couple neighbours, so that code-switched texts
are labelled piece by piece. Forward-backward over runs of ``SEGMENT`` words
gives each word's posterior; a text's language has the largest mean posterior,
which is its score.

The model is fitted by gradient ascent on a bounded sample of each language: of
its labelled texts, a row repeated counting once, at most ``per_lang`` with the
least hashes, and no further ones once these hold ``lang_bytes``. No language
goes without. A share of the sample is cut to pieces of a few words that are
spliced over languages, from which the transitions between languages are
learned. Everything else reads every row whole. Only text and lang are learned
from, and only text is read to predict.

Defined cases: a null text or one without a letter is ``und`` with score 0,
and so is every text if nothing was labelled; a very long text is labelled
whole; repeated rows are predicted alike; null ids are never learned from and
are not held out; null langs are not learned from; equal posteriors go to the
first language by code point; other columns go along unseen, whatever their
names, but lang_pred and lang_score (or lang_runs) are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import append, checkpoint, read, sheltered, stored

PER_LANG, LANG_BYTES = 150, 1 << 19
#: One in so many sampled texts is spliced, in pieces of so many words.
SPLICED, PIECE = 4, (4, 24)
SEGMENT, BUCKETS, NGRAMS, LEXICON, ROUNDS = 64, 1 << 16, 4, 1000, 40
#: Words whose emissions a worker remembers.
_REMEMBERED = 200_000
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_LETTERS).split()


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def ngram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and where each word's begin."""
    joined = b"".join(b"\x01" + w + b"\x02" for w in words)
    data = np.frombuffer(joined, np.uint8).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(data))
    hashed, fits = np.empty((len(data), NGRAMS), np.uint64), np.empty((len(data), NGRAMS), bool)
    key = np.zeros(len(data), np.uint64)
    for n in range(NGRAMS):
        key[: len(data) - n] = (key[: len(data) - n] << np.uint64(8)) | data[n:]
        hashed[:, n] = ((key + np.uint64(n + 1)) * _MIX) >> np.uint64(48)
        fits[:, n] = at + n < ends
    counts = np.add.reduceat(fits.sum(axis=1), np.cumsum(lens) - lens)
    return (hashed[fits] % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(counts) - counts


class Crf:
    """Parameters, emissions and inference."""

    def __init__(self, labels: list[str], lexicon: dict[bytes, list[int]]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.grams, self.known = np.zeros((BUCKETS, k), np.float32), np.zeros((k + 1, k), np.float32)
        self.steps, self.start = np.zeros((k, k), np.float32), np.zeros(k, np.float32)

    def lexical(self, words: list[bytes]) -> np.ndarray:
        """Indicators of the lexicons that hold each word; the last column says none."""
        out = np.zeros((len(words), len(self.labels) + 1), np.float32)
        for i, w in enumerate(words):
            for k in self.lexicon.get(w, (-1,)):
                out[i, k] = 1
        return out

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        buckets, starts = ngram_buckets(words)
        return np.add.reduceat(self.grams[buckets], starts, axis=0) + self.lexical(words) @ self.known

    def posteriors(self, scores: np.ndarray, lens: np.ndarray, pairs: bool = False):
        """Forward-backward over consecutive runs of the given lengths, all runs at once.

        Returns the labels' posteriors a word and, on demand, summed posteriors of
        neighbouring labels and of first labels.
        """
        runs, k = len(lens), scores.shape[1]
        longest = int(lens.max())
        row = np.repeat(np.arange(runs), lens)
        col = np.arange(len(scores)) - np.repeat(np.cumsum(lens) - lens, lens)
        there = np.arange(longest)[None, :] < lens[:, None]
        local = np.ones((longest, runs, k), np.float32)
        local[col, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
        step, first = np.exp(self.steps), np.exp(self.start)
        ahead = np.empty_like(local)
        ahead[0] = local[0] * first
        ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            a = (ahead[t - 1] @ step) * local[t]
            a /= a.sum(axis=1, keepdims=True)
            ahead[t] = np.where(there[:, t, None], a, ahead[t - 1])
        back = np.ones_like(local)
        for t in range(longest - 2, -1, -1):
            b = (local[t + 1] * back[t + 1]) @ step.T
            b /= b.sum(axis=1, keepdims=True)
            back[t] = np.where(there[:, t + 1, None], b, 1.0)
        both = ahead * back
        both /= both.sum(axis=2, keepdims=True)
        out = both[col, row]
        if not pairs:
            return out
        moves = np.zeros((k, k))
        for t in range(longest - 1):
            on = there[:, t + 1]
            x = ahead[t][on][:, :, None] * step[None] * (local[t + 1] * back[t + 1])[on][:, None, :]
            moves += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return out, moves, both[0].sum(axis=0)


def runs_of(sizes: list[int]) -> np.ndarray:
    """Lengths of the runs that documents of the given sizes are cut into."""
    out = []
    for n in sizes:
        out += [SEGMENT] * (n // SEGMENT) + ([n % SEGMENT] if n % SEGMENT else [])
    return np.array(out, np.int64)


def spliced(docs: list[tuple[list[bytes], str]]) -> list[list[tuple[list[bytes], str]]]:
    """Texts made of pieces of some documents, in an order by chance, about as long as those."""
    rng = np.random.default_rng(3)
    cut = []
    for words, lang in docs[::SPLICED]:
        at = 0
        while at < len(words):
            n = int(rng.integers(*PIECE))
            cut.append((words[at : at + n], lang))
            at += n
    cut = [cut[i] for i in rng.permutation(len(cut))]
    each = max(1, len(cut) * SPLICED // max(1, len(docs)))
    return [cut[i : i + each] for i in range(0, len(cut), each)]


def fit(sample: list[tuple[bytes, str]]) -> Crf | None:
    """Fit on labelled texts by Adam on the mean log-likelihood of a word."""
    docs = [(w, lang) for text, lang in sample if (w := words_of(text))]
    if not docs:
        return None
    labels = sorted({lang for _, lang in docs}, key=lambda x: [ord(c) for c in x])
    number = {lang: i for i, lang in enumerate(labels)}
    counts = [Counter() for _ in labels]
    for w, lang in docs:
        counts[number[lang]].update(w)
    lexicon: dict[bytes, list[int]] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    model = Crf(labels, lexicon)
    made = [[x] for x in docs] + (spliced(docs) if len(labels) > 1 else [])
    flat = [w for pieces in made for ws, _ in pieces for w in ws]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.array([vocab[w] for w in flat])
    truth = np.repeat([number[lang] for pieces in made for _, lang in pieces], [len(ws) for pieces in made for ws, _ in pieces])
    lens = runs_of([sum(len(ws) for ws, _ in pieces) for pieces in made])
    words = list(vocab)
    buckets, starts = ngram_buckets(words)
    per_word = np.diff(np.append(starts, len(buckets)))
    owner = np.repeat(np.arange(len(words)), per_word)
    lexical = model.lexical(words)
    k, n = len(labels), len(flat)
    seen = np.zeros((len(words), k))
    np.add.at(seen, (ids, truth), 1)
    first = np.cumsum(lens) - lens
    inner = np.ones(n, bool)
    inner[first] = False
    seen_steps = np.zeros((k, k))
    np.add.at(seen_steps, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
    seen_first = np.bincount(truth[first], minlength=k)
    params = [model.grams, model.known, model.steps, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, ROUNDS + 1):
        scores = np.add.reduceat(model.grams[buckets], starts, axis=0) + lexical @ model.known
        marginal, moves, begins = model.posteriors(scores[ids], lens, pairs=True)
        expected = np.stack([np.bincount(ids, weights=marginal[:, j], minlength=len(words)) for j in range(k)], axis=1)
        wrong = ((seen - expected) / n).astype(np.float32)
        by_gram = np.stack([np.bincount(buckets, weights=wrong[owner, j], minlength=BUCKETS) for j in range(k)], axis=1)
        grads = [by_gram, lexical.T @ wrong, (seen_steps - moves) / n, (seen_first - begins) / n]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g.astype(np.float32) - 1e-5 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def fold(id_col: F.Column, parts: int) -> F.Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, per_lang: int = PER_LANG, lang_bytes: int = LANG_BYTES) -> DataFrame:
    """lang, h and text of a bounded number of labelled texts of each language that aren't held out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("i"), folds) != held)).withColumn("h", F.xxhash64("i", "text"))
    kinds = checkpoint(rows.select("lang", "h", F.octet_length("text").cast("long").alias("size")).distinct())
    # Hashes are even, so that about four times as many as are asked for lie below this share of their range.
    below = stored(kinds.groupBy("lang").agg((4.0 * per_lang / F.count("*")).alias("share")), "shares")
    kinds = kinds.join(below, "lang").where(F.col("h").cast("double") / 2.0**64 + 0.5 < F.col("share"))
    order = Window.partitionBy("lang").orderBy("h")
    best = kinds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = stored(best.withColumn("before", before).where(F.col("before") < lang_bytes).select("lang", "h"), "sample")
    # per_lang rows of a language; text isn't moved to find them if they are few enough for Spark to broadcast.
    return rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))


def train(docs: DataFrame, **options) -> Crf | None:
    """Fit on the ``sample`` of the documents."""
    found = sorted((r["lang"], r["h"], r["text"]) for r in sample(docs, **options).collect())
    return fit([(text.encode(), lang) for lang, _, text in found])


def _labeller(crf: Crf | None):
    """A function from texts to (text numbers, word counts, posteriors of their words), those without a word left out."""
    number: dict[bytes, int] = {}
    table = np.empty((0, len(crf.labels) if crf else 0), np.float32)

    def label(rows: list[bytes]):
        nonlocal number, table
        held = [words_of(t) if crf and has_letter(t) else [] for t in rows]
        some = [i for i, w in enumerate(held) if w]
        if not some:
            return some, [], table[:0]
        flat = [w for i in some for w in held[i]]
        if len(number) > _REMEMBERED:
            number, table = {}, table[:0]
        new = list({w for w in flat if w not in number})
        for w in new:
            number[w] = len(number)
        if new:
            table = np.concatenate([table, crf.emissions(new)])
        ids = np.array([number[w] for w in flat])
        sizes = [len(held[i]) for i in some]
        return some, sizes, crf.posteriors(table[ids], runs_of(sizes))

    return label


def predict(docs: DataFrame, model: Crf | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and lang_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        crf = shared.value
        label = _labeller(crf)

        def work(rows: list[bytes]) -> dict:
            langs, scores = ["und"] * len(rows), [0.0] * len(rows)
            some, sizes, marginal = label(rows)
            if some:
                sums = np.add.reduceat(marginal.astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
                means = sums / np.array(sizes)[:, None]
                for i, mean in zip(some, means, strict=True):
                    k = int(mean.argmax())
                    langs[i], scores[i] = crf.labels[k], min(1.0, float(mean[k]))
            return {"lang_pred": langs, "lang_score": scores}

        return work

    return append(docs, text_col, make, "lang_pred string, lang_score double")


def label_words(docs: DataFrame, model: Crf | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_runs: the languages of runs of words [first, end), words as ``words_of`` finds them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        crf = shared.value
        label = _labeller(crf)

        def work(rows: list[bytes]) -> dict:
            out: list[list] = [[] for _ in rows]
            some, sizes, marginal = label(rows)
            best = marginal.argmax(axis=1) if some else ()
            at = 0
            for i, n in zip(some, sizes, strict=True):
                mine = best[at : at + n]
                first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                out[i] = [{"lang": crf.labels[mine[a]], "first": int(a), "end": int(b)} for a, b in zip(first, np.append(first[1:], n), strict=True)]
                at += n
            return {"lang_runs": out}

        return work

    return append(docs, text_col, make, "lang_runs array<struct<lang:string,first:long,`end`:long>>")


def accepted(docs: DataFrame, *, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` in a learned language with a mean posterior of ``least`` or more."""

    def chosen(rows: DataFrame) -> DataFrame:
        return predict(rows, train(rows)).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= least))

    return sheltered(docs, ("doc_id", "text", "lang"), chosen)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
