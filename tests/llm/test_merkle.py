"""The Merkle manifest against trees built whole, on odd inputs, and the memory of the traversal."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from signalloom.llm import merkle  # noqa: E402


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(level, at):
    """The siblings of node ``at`` by level, and the root, with every level built whole."""
    path = []
    while len(level) > 1:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        path.append((run[: at % 3], run[at % 3 + 1 :]))
        level, at = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)], at // 3
    return path, level[0]


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute(rows):
    trees = {}
    for r in rows:
        seen = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        trees.setdefault(r[1], []).append((r[0], leaf(*r), leaf(*r[:4], seen)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [climb([x[1] for x in trees[name]], 0)[1] for name in names]
    out = []
    for t, name in enumerate(names):
        above, root = climb(subroots, t)
        for i, (doc_id, mine, seen) in enumerate(trees[name]):
            path, subroot = climb([x[1] for x in trees[name]], i)
            node = seen
            for left, right in path + above:
                node = digest(*left, node, *right)
            out.append((doc_id, mine, subroot, root, digest(*[d for left, right in path + above for d in left + right]), node, node == root))
    return sorted(out, key=str)


ROWS = (
    [(i, "hot", "en", i % 7, f"line {i}\nline {i % 5}") for i in range(100)]
    + [(i, f"s{i % 12}", "de", None, "one\ntwo") for i in range(100, 140)]
    + [(None, "hot", "en", 3, "no id\n"), (None, None, None, None, None), (7, "hot", "en", 0, "line 7\nagain"), (7, "hot", "en", 0, "line 7\nagain"), (200, None, "fr", 0, ""), (201, "ü", "fr", 9, "é\n" * 50_000)]
)


def documents(spark, rows):
    kinds = "doc_id long, source string, lang string, n_chars long, text string, leaf string, i long, tree string, root int"
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], kinds)


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_trees_built_whole(spark, levels):
    docs = documents(spark, ROWS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(docs, F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")), levels=levels)
    assert found.columns == list(merkle.PROOF)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(ROWS)


def test_untampered_rows_verify_and_an_empty_table_has_none(spark):
    assert merkle.manifest(documents(spark, ROWS[:30]), levels=1).where("not verified").count() == 0
    assert merkle.manifest(documents(spark, ROWS).limit(0)).count() == 0
    alone = merkle.manifest(documents(spark, ROWS[:1])).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["proof_sha256"] == digest()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 243, 500, 729, 730, 2187])
def test_the_traversal_holds_a_few_nodes_a_level(n):
    leaves = [digest(str(i)) for i in range(n)]
    levels = merkle.height(n)
    walk = merkle.Traversal(leaves, levels)
    for i in range(n):
        if i:
            walk.advance()
        path, root = climb(leaves, i)
        if n <= 730 or i % 97 == 0:
            assert walk.path() == [("".join(x), "".join(y)) for x, y in path]
            assert merkle.fold(leaves[i], walk.path()) == root
        assert walk.held() <= 8 * levels
    assert walk.late == 0
