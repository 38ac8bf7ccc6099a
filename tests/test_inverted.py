"""The pruned inverted index against plain sums over all postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import inverted as iv
from quarry.operators import lexical as lx


def corpus(spark, seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, rows[5][1]), (n + 3, rows[5][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def asked(spark, seed):
    rng = random.Random(-seed)
    rows = [(q, " ".join(f"w{int(rng.paretovariate(0.6)) % 320}" for _ in range(rng.randint(1, 15)))) for q in range(25)]
    rows += [(100, "unknown words only"), (101, None), (102, ""), (103, "w299 unknown"), (104, "w0 w0 w1")]
    return spark.createDataFrame(rows, "qid long, question string")


def plain_top(docs, questions, k):
    """All scores from all postings; documents without a hit score 0."""
    index = lx.build_bm25_index(docs)
    scores = {(r["qid"], r["doc_id"]): r["score"] for r in lx.bm25_scores(index, questions).collect()}
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    out = []
    for (q,) in questions.select("qid").collect():
        best = sorted((-round(scores.get((q, d), 0.0), 6) + 0.0, d) for d in ids)[:k]
        out += [(q, i, d, -s + 0.0) for i, (s, d) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,block,literals", [(1, 128, 2000), (2, 8, 2000), (3, 1, 3)])
def test_bm25_top_k(spark, monkeypatch, seed, block, literals):
    monkeypatch.setattr(iv, "BLOCK_DOCS", block)
    monkeypatch.setattr(iv, "BUCKET_POSTINGS", 500)
    monkeypatch.setattr(iv, "LITERALS", literals)
    monkeypatch.setattr(iv, "SEED_POSTINGS", 20)
    docs, questions = corpus(spark, seed), asked(spark, seed)
    got = sorted(tuple(r) for r in iv.bm25_top_k(docs, questions, 5).collect())
    want = plain_top(docs, questions, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1.1e-6)


def test_negative_weights(spark):
    """Few documents, terms in most of them: the floor of the idf is below 0."""
    docs = spark.createDataFrame([(i, "a b" if i % 4 else "a") for i in range(1, 9)] + [(20, "z"), (21, "")],
                                 "doc_id long, text string")
    questions = spark.createDataFrame([(1, "a"), (2, "a b z"), (3, "b"), (4, "q")], "qid long, question string")
    got = sorted(tuple(r) for r in iv.bm25_top_k(docs, questions, 4).collect())
    assert [x[:3] for x in got] == [x[:3] for x in plain_top(docs, questions, 4)]


def test_sparse_top_k(spark, tmp_path):
    rng = random.Random(4)
    doc_w = [(d, f"t{t}", rng.random() * (1 + t % 3)) for d in range(300) for t in rng.sample(range(80), 6)]
    q_w = [(q, f"t{t}", rng.random()) for q in range(12) for t in rng.sample(range(90), 4)] + [(50, "nowhere", 1.0)]
    questions = spark.createDataFrame([(q,) for q in [*range(12), 50, 51]], "qid long")
    rows = spark.createDataFrame(doc_w, "doc_id long, term string, a double").withColumn("b", F.lit(0.0))
    index = iv.build_inverted(rows, 300, str(tmp_path / "sparse"))
    got = iv.sparse_top_k(index, spark.createDataFrame(q_w, "qid long, term string, weight double"), questions, 5).collect()
    want = {}
    for q, t, w in q_w:
        for d, u, x in doc_w:
            if t == u:
                want[q, d] = want.get((q, d), 0) + w * x
    for q in range(12):
        best = sorted((-round(s, 6), d) for (p, d), s in want.items() if p == q)[:5]
        mine = sorted((r["rk"], r["doc_id"], r["score"]) for r in got if r["qid"] == q)
        assert [(d, s) for _, d, s in mine] == [(d, pytest.approx(-s, abs=1e-6)) for s, d in best]
    assert {r["qid"] for r in got if r["no_match"]} == {50, 51}


def rows_scanned(df):
    """Rows that the plan's file scans gave out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_reads_the_asked_terms_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(iv, "BUCKET_POSTINGS", 200)
    rows = spark.range(20000).select((F.col("id") % 4000).cast("string").alias("term"), F.col("id").alias("doc_id"),
                                     F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    index = iv.build_inverted(rows, 20000, str(tmp_path / "many"))
    assert index.buckets == 100
    scanned = [rows_scanned(index.of_terms(spark.range(n).select(F.col("id").cast("string").alias("term")), "term", "docs"))
               for n in (1, 10, 100)]
    assert 0 < scanned[0] < scanned[1] < scanned[2] <= 20000 and scanned[0] <= 600
    plan = index.of_terms(spark.createDataFrame([("7",)], "term string"), "term", "top")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "docs" not in plan.split("ReadSchema:")[1]


def test_blocks_below_the_threshold_are_skipped(spark, monkeypatch, tmp_path):
    """One rare pair of words decides; the blocks of the frequent word are not scored."""
    rows = [(d, "common", 1.0) for d in range(5000)] + [(d, "rare", 9.0) for d in range(10)]
    post = spark.createDataFrame(rows, "doc_id long, term string, a double").withColumn("b", F.lit(0.0))
    index = iv.build_inverted(post, 5000, str(tmp_path / "skip"))
    q = spark.createDataFrame([(1, "common", 1.0), (1, "rare", 1.0)], "qid long, term string, w double")
    scored = iv.top_scores(index, q, iv.weight_impact, 5).count()
    assert scored < 2000
    assert [(r["doc_id"], r["score"]) for r in iv.ranked(iv.top_scores(index, q, iv.weight_impact, 5), 5)
            .orderBy("rk").collect()] == [(d, 10.0) for d in range(5)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "a")], "qid long, question string")
    assert iv.bm25_top_k(docs, questions).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert iv.bm25_top_k(some, questions.limit(0)).count() == 0
