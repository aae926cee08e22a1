"""Phrase mining against plain counting, on odd texts and in many passes, and its perfect hash."""

from __future__ import annotations

import collections
import os
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalloom.llm import collocations  # noqa: E402


def documents(spark, rows):
    kinds = "doc_id long, lang string, text string, a string, n int, key string, number string, numbers string, phrase long, score string"
    return spark.createDataFrame([(i, lang, text, "x", 1, "k", "y", "z", 5, "s") for i, (lang, text) in enumerate(rows)], kinds)


def brute(rows, least, first=2000):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, n, -score))
    return sorted(out)


def prose(seed, n, vocabulary=30):
    rng = np.random.default_rng(seed)
    phrases = [" ".join(f"w{x}" for x in rng.zipf(1.6, 4) % vocabulary) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [phrases[x % 12] if x % 3 else f"w{x % vocabulary}" for x in rng.zipf(1.3, 20).clip(0, 10**6)]
        rows.append(((None, "en", "de")[i % 3], "".join(p + (" ", "\t", ". ", "\n", "  ")[(x * i) % 5] for x, p in enumerate(parts))))
    return rows


LONG = "y" * 5000
ODD = [
    ("en", None), (None, ""), ("en", " \t\n.,;"), ("en", "A a A a\ta a. a a"), ("en", "ı É é\x0bé é"), (None, "a a"), ("und", "a a"), ("en", f"{LONG} {LONG} z {LONG} {LONG}"), ("en", f"{LONG} {LONG}"),
    ("en", "a b c d e f g " * 400), ("en", "a b c d e f g " * 400), ("xx", "one"), ("en", "\x00 \x00 \x00"), ("en", "ÿ þ ÿ þ"),
]


@pytest.mark.parametrize(("rows", "least"), [(prose(1, 150), 12), (ODD, 2), (prose(3, 30), 1)])
def test_plain_counting(spark, rows, least):
    want = brute(rows, least)
    assert len(want) > 10
    assert sorted(map(tuple, collocations.collocations(documents(spark, rows).repartition(5), least=least).collect())) == want


def test_many_passes_and_a_short_list_give_the_same(spark):
    rows = prose(2, 120)
    found = collocations.collocations(documents(spark, rows).repartition(7), least=6, first=9, shard_words=5, shard_keys=8, at_once=3)
    assert sorted(map(tuple, found.collect())) == brute(rows, 6, 9)


def test_no_documents_and_no_phrases(spark):
    assert collocations.collocations(documents(spark, ODD).limit(0)).count() == 0
    assert collocations.collocations(documents(spark, ODD[:4])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 100_000])
def test_the_hash_is_perfect_and_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    made = collocations.PerfectHash(keys)
    bits, sizes, stored = made.parts()
    for h in (made, collocations.PerfectHash.of({"bits": bits, "sizes": sizes, "keys": stored})):
        assert sorted(h.slots(keys)) == list(range(len(keys)))
        assert (h.slots(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_runs():
    found = collocations.runs(np.array([0, 3, 4, -1, 5, 0, 6, 7, 8, 0, 0, 9]))
    assert found.tolist() == [3, 4, 0, 6, 7, 8, 0]
    assert collocations.runs(np.array([5])).tolist() == collocations.runs(np.array([], int)).tolist() == []
