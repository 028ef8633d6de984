"""The pipeline against plain Python on a small table."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, mixing, simhash
from tessera.llm.common import write_table
from tessera.sources.tables import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, SF), "t")
        at[name] = [r.asDict() for r in docs.collect()]
    assert all(set(at[n][0]) == set(rows[0]) for n, _ in corpus_pipeline.STAGES[:-1])
    letters = [r for r in rows if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    key = lambda rs: sorted(r["doc_id"] for r in rs)
    assert key(at["language_id"]) == key(letters)
    best = {}
    for r in letters:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert key(at["exact_dedup"]) == sorted(best.values())
    prints = sorted((i, simhash.simhash(t)) for t, i in best.items())
    left = []
    root = {i: i for i, _ in prints}

    def find(x):
        return x if root[x] == x else find(root[x])
    for i, f in prints:
        for j, g in prints:
            if i < j and bin(f ^ g).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = sorted({find(i) for i, _ in prints})
    assert key(at["simhash_near_dedup"]) == left
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(
        read(spark, SF, "documents").where(F.col("doc_id").isin(left))).collect()}
    assert key(at["mix_sources"]) == sorted(i for i, n in plan.items() for _ in range(n))
    assert key([r for r in at["pack"] if r["piece"] == 0]) == key(at["mix_sources"])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert langid.LEARN_DOCS > 0
