"""The pipeline's stages against plain Python on a small corpus."""

from __future__ import annotations

import collections
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_corpus_operators import brute_repeats, components_of, without  # noqa: E402

import corpus_pipeline  # noqa: E402
from signalloom.llm import decontaminate, langid  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60 AND length(text) < 6000")
    odd = spark.createDataFrame([(1000, None, "en", "src1", 0), (1001, "12 34", "en", "src1", 5), (1002, "", None, None, 0)], docs.schema)
    again = docs.where("doc_id = 3")
    docs = docs.unionByName(odd).unionByName(again)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    outs, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(now)
        assert name == "mixing" or now.columns == columns
    rows = [[(r["doc_id"], r["text"]) for r in sorted(o.collect(), key=lambda r: r["doc_id"])] for o in outs[:4]]

    model = langid.train(docs)
    known = langid.predict(docs, model).collect()
    assert sorted(i for i, _ in rows[0]) == sorted(r["doc_id"] for r in known if r["lang_pred"] != "und" and r["lang_score"] >= 0.4)
    assert not {1000, 1001, 1002} & {i for i, _ in rows[0]}

    distinct = list(dict.fromkeys(rows[0]))
    gone = brute_repeats(distinct, 50)
    want = {i: without(t, g) for (i, t), g in zip(distinct, gone, strict=True) if len(g) < len(t.split())}
    assert dict(rows[1]) == want and sum(map(len, gone)) > 100

    def alike(a, b):
        x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
        return len(x & y) >= 0.8 * len(x | y)

    texts = dict(rows[1])
    groups = components_of(texts, lambda a, b: alike(texts[a], texts[b]))
    assert [i for i, _ in rows[2]] == sorted({i for i in texts if groups[i] == i}) and len(rows[2]) < len(texts)

    windows = {w for r in bench.collect() for w in decontaminate.item_windows((r["text"] or "").encode(), 10)}

    def hit(text):
        words = text.encode().translate(decontaminate.FOLD_WORDS).split()
        return any(tuple(words[k : k + len(w)]) == w for w in windows for k in range(len(words) - len(w) + 1) if words[k] == w[0])

    assert [i for i, _ in rows[3]] == [i for i, t in rows[2] if not hit(t)]
    mixed = outs[4].collect()
    kept = {r["doc_id"]: r for r in outs[3].collect()}
    taken, words = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in kept.values():
        words[r["source"]].update(r["text"].split())
    for r in mixed:
        assert {kept[i]["source"] for i in r["doc_ids"]} == {r["source"]} and len(r["text"].split(" ")) == r["n_words"]
        taken.update(dict.fromkeys([r["source"]], r["n_words"]))
    planned = {r["source"]: r for r in corpus_pipeline.mixing.mix(outs[3]).collect()}
    for source, n in taken.items():
        assert abs(n - planned[source]["target"]) <= 1
        once = collections.Counter(w for r in mixed if r["source"] == source and r["pass_no"] == 0 for w in r["text"].split(" "))
        assert once == words[source] or n < planned[source]["source_size"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, mixed))
