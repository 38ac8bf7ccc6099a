"""Dense k-NN vs brute force, normalisation edge cases, hybrid properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import SF_SMALL, rows

from quarry.operators import dense as dn
from quarry.operators import hybrid as hy
from quarry.operators import scoring as sc
from quarry.plans import bindings as bd


@pytest.fixture(scope="module")
def data(spark):
    vec = bd.vectors(spark, SF_SMALL).toPandas()
    qv = bd.question_vectors(spark, SF_SMALL).toPandas()
    return vec, qv


def test_knn_matches_brute_force(spark, data):
    vec, qv = data
    X = np.stack(vec.embedding.to_numpy()).astype(np.float64)
    Q = np.stack(qv.embedding.to_numpy()).astype(np.float64)
    d = ((Q[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    corpus = bd.vectors(spark, SF_SMALL).withColumnRenamed("vec_id", "doc_id")
    got = {}
    for q, rk, doc, dist in rows(dn.knn(corpus, bd.question_vectors(spark, SF_SMALL), 5),
                                 "qid", "rk", "doc_id", "distance"):
        got.setdefault(q, {})[rk] = (doc, dist)
    ids = vec.vec_id.to_numpy()
    for i, q in enumerate(qv.qid.to_numpy()):
        key = sorted(range(len(ids)), key=lambda j: (round(d[i, j], 6), ids[j]))[:5]
        assert [got[q][r][0] for r in range(1, 6)] == [int(ids[j]) for j in key]


def test_identical_distances_give_zero_similarity(spark):
    coll = spark.createDataFrame([(i, f"doc {i}", [1.0, 0.0]) for i in range(3)],
                                 "doc_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(9, "zzz", [0.0, 1.0])], "qid long, question string, embedding array<float>")
    store = sc.open_store(coll)
    block = next(sc.blocks(q, store))
    c = sc.candidates(store, block, sc.bounds(store, block), 0.0, None, 5)
    assert {r["sn"] for r in c.collect()} == {0.0}
    # nothing passes the hybrid threshold: no lexical hit, no semantic spread
    assert hy.hybrid_search(coll, q).count() == 0


@pytest.fixture(scope="module")
def hybrid_runs(spark):
    coll = bd.comment_collection(spark, SF_SMALL)
    qs = bd.question_vectors(spark, SF_SMALL)
    top15 = rows(hy.hybrid_search(coll, qs, k=15), "qid", "rk", "doc_id", "score")
    top20 = rows(hy.hybrid_search(coll, qs, k=20), "qid", "rk", "doc_id", "score")
    return coll, qs, top15, top20


def test_top_k_is_prefix_of_top_k_plus(hybrid_runs):
    _, _, top15, top20 = hybrid_runs
    assert set(top15) == {r for r in top20 if r[1] <= 15}


def test_fusion_bounds(hybrid_runs):
    _, _, top15, _ = hybrid_runs
    assert all(0.1 < s <= 1.0 + 1e-9 for *_, s in top15)


def test_prefilter_contains_postfilter(spark, hybrid_runs):
    coll, qs, _, _ = hybrid_runs
    routes = [(1, ("the",), "match", "src1")]
    post = set(rows(hy.hybrid_filtered(coll, qs, routes, "post"), "qid", "doc_id", "score"))
    pre = set(rows(hy.hybrid_filtered(coll, qs, routes, "pre"), "qid", "doc_id", "score"))
    assert post <= pre
    assert len(pre) >= len(post)


def test_unknown_route_column_is_ignored(spark, hybrid_runs):
    coll, qs, top15, _ = hybrid_runs
    routes = [(1, ("the", "a", "e"), "stage", "Semi-Finals")]
    post = set(rows(hy.hybrid_filtered(coll, qs, routes, "post"), "qid", "rk", "doc_id", "score"))
    assert post == set(top15)


def test_lsh_recall(spark):
    corpus = bd.vectors(spark, SF_SMALL).withColumnRenamed("vec_id", "doc_id")
    qs = bd.question_vectors(spark, SF_SMALL)
    exact = set(rows(dn.knn(corpus, qs, 5), "qid", "doc_id"))
    approx = set(rows(dn.knn_lsh(corpus, qs, 5), "qid", "doc_id"))
    recall = len(exact & approx) / len(exact)
    assert recall >= 0.5


def test_stream_equals_batch(spark, hybrid_runs):
    from quarry.plans.streams import q_stream_questions
    _, _, top15, _ = hybrid_runs
    streamed = set(rows(q_stream_questions(spark, SF_SMALL), "qid", "rk", "doc_id", "score"))
    assert streamed == set(top15)


def test_question_blocks_split_beyond_bound(spark):
    qs = bd.question_vectors(spark, SF_SMALL)
    blocks = list(dn.question_blocks(qs, max_rows=7))
    assert all(len(b[0]) <= 7 for b in blocks)
    assert sorted(int(x) for b in blocks for x in b[0]) == sorted(
        r[0] for r in rows(qs.where("embedding is not null"), "qid"))


def test_block_split_gives_same_results(spark, hybrid_runs, monkeypatch):
    coll, qs, top15, _ = hybrid_runs
    orig, blocks = dn.question_blocks, sc.blocks
    monkeypatch.setattr(dn, "question_blocks", lambda q, **kw: orig(q, max_rows=7))
    monkeypatch.setattr(sc, "blocks", lambda q, store: blocks(q, store, 7))
    monkeypatch.setattr(sc, "CELLS", 100)
    monkeypatch.setattr(dn, "CELLS", 100)
    assert set(rows(hy.hybrid_search(coll, qs, k=15), "qid", "rk", "doc_id", "score")) == set(top15)
    lab = bd.label_collections(spark, SF_SMALL)
    split = set(rows(dn.knn(lab, qs, 5, group_col="collection"), "qid", "collection", "rk", "doc_id"))
    monkeypatch.setattr(dn, "question_blocks", orig)
    whole = set(rows(dn.knn(lab, qs, 5, group_col="collection"), "qid", "collection", "rk", "doc_id"))
    assert split == whole


def test_documents_and_questions_without_a_vector_compete_by_words(spark):
    coll = spark.createDataFrame([(0, "red fox", [1.0, 0.0]), (1, "red owl owl", None), (2, "blue", [0.0, 1.0]),
                                  (3, None, None), (4, "sea", [0.7, 0.7])], "doc_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(1, "owl", [0.0, 1.0]), (2, "owl", None)], "qid long, question string, embedding array<float>")
    got = {(r["qid"], r["doc_id"]): r for r in hy.hybrid_search(coll, q).collect()}
    assert got[1, 1]["bm25_norm"] == 1 and got[1, 1]["sem_norm"] == 0 and got[1, 1]["score"] == 0.5
    assert got[1, 2]["sem_norm"] == 1 and got[1, 2]["bm25_norm"] == 0
    assert [k for k in got if k[0] == 2] == [(2, 1)]


def test_routes_on_any_column_of_the_collection(spark):
    coll = spark.createDataFrame([(i, f"red fox {i}", "m1" if i % 2 else "m2", "semi" if i < 3 else None, [1.0, float(i)]) for i in range(8)],
                                 "doc_id long, text string, match string, stage string, embedding array<float>")
    qs = spark.createDataFrame([(1, "red semi", [1.0, 2.0]), (2, "red m1", [1.0, 3.0]), (3, "red", [1.0, 4.0]), (4, "fox nowhere", [1.0, 4.0])],
                               "qid long, question string, embedding array<float>")
    routes = [(1, ("semi",), "stage", "semi"), (2, ("m1",), "match", "m1"), (3, ("nowhere",), "place", "x")]
    free = rows(hy.hybrid_search(coll, qs), "qid", "doc_id", "score")
    allowed = {1: {0, 1, 2}, 2: {1, 3, 5, 7}, 3: set(range(8)), 4: set(range(8))}
    want = {r for r in free if r[1] in allowed[r[0]]}
    assert want != set(free)
    for mode in ("post", "pre"):
        assert set(rows(hy.hybrid_filtered(coll, qs, routes, mode), "qid", "doc_id", "score")) == want


def test_two_scans_for_any_number_of_blocks(spark, monkeypatch):
    """Many blocks of questions share a scan, and what a task holds for them is bounded."""
    coll = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} x", [float(i % 7), 1.0]) for i in range(200)],
                                 "doc_id long, text string, embedding array<float>").repartition(3)
    qs = spark.createDataFrame([(q, f"w{q % 6} x", [float(q % 9), 0.5]) for q in range(90)], "qid long, question string, embedding array<float>")
    want = set(rows(hy.hybrid_search(coll, qs, k=4), "qid", "rk", "doc_id", "score"))
    orig = sc.blocks
    monkeypatch.setattr(sc, "blocks", lambda q, store: orig(q, store, 8))
    monkeypatch.setattr(sc, "HELD_ROWS", 50)
    many = hy.hybrid_search(coll, qs, k=4)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert set(rows(many, "qid", "rk", "doc_id", "score")) == want
    near = set(rows(dn.knn(coll, qs, 3), "qid", "rk", "doc_id"))
    monkeypatch.setattr(dn, "HELD_ROWS", 50)
    split = dn.knn(coll, qs, 3, max_questions=8)
    assert split._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert set(rows(split, "qid", "rk", "doc_id")) == near
