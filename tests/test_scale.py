"""What keeps memory, disk and time in proportion: terms counted in rows, bounded slices, hashes in joins."""

import contextlib
import io
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import SF_SMALL, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import dense as dn
from quarry.operators import lexical as lx
from quarry.operators import scoring as sc
from quarry.plans import bindings as bd


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_lsh_writes_no_pairs_and_finds_what_a_join_finds(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    corpus = bd.vectors(spark, SF_SMALL).withColumnRenamed("vec_id", "doc_id")
    asked = bd.question_vectors(spark, SF_SMALL).where("embedding is not null")

    def vec(df, key):
        return df.select(key, array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))

    c, q = vec(corpus, "doc_id"), vec(asked, "qid")
    for length, within in ((0.5, 2.0), (0.05, 1.3)):
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length, numHashTables=4, seed=7).fit(c)
        pairs = model.approxSimilarityJoin(q, c, within, distCol="dist").select(
            F.col("datasetA.qid").alias("qid"), F.col("datasetB.doc_id").alias("doc_id"), F.round(F.col("dist") * F.col("dist"), 6).alias("distance"))
        w = Window.partitionBy("qid").orderBy("distance", "doc_id")
        want = rows(pairs.withColumn("rk", F.row_number().over(w)).where("rk <= 5"), "qid", "rk", "doc_id", "distance")
        found = dn.knn_lsh(corpus, asked, 5, bucket_length=length, threshold=within)
        assert sorted(rows(found, "qid", "rk", "doc_id", "distance")) == sorted(want)
        assert "Join" not in plan_of(found)


def test_postings_are_counted_in_their_rows(spark):
    docs = [(1, "b a b  B c"), (2, None), (3, " "), (4, "x"), (5, " ".join(f"w{i % 7}" for i in range(500)))]
    post = lx.term_postings(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(i, t, n, len((x or "").split())) for i, x in docs for t, n in Counter((x or "").lower().split()).items()}
    got = rows(post, "doc_id", "term", "tf", "dl")
    assert len(got) == len(want) and set(got) == want
    plan = plan_of(lx.term_postings(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_texts_are_hashed_before_collections_are_joined(spark, monkeypatch):
    from quarry.functions import ordering
    from quarry.plans import indexing
    kept = []
    monkeypatch.setattr(ordering, "materialize", lambda df, name: kept.append(dict(df.dtypes)) or df)
    indexing.q_stale_by_hash(spark, SF_SMALL)
    assert kept and all(t["text"] == "bigint" for t in kept)


def test_a_store_is_told_by_its_texts_hashes(spark, monkeypatch):
    from quarry import session
    seen = []
    monkeypatch.setattr(session, "memo_fingerprint", lambda df, compute: seen.append(plan_of(df)) or compute())
    coll = bd.comment_collection(spark, SF_SMALL)
    store = sc.open_store(coll)
    side = [x for x in re.findall(r"Exchange (?:hash|Single|range)[^\n]*\n[^\n]*Project \[([^\n]*)\]", seen[0])]
    assert all(" text#" not in f" {x.split('xxhash64')[0]}" for x in side)
    assert lx.corpus_fingerprint(bd.comments(spark, SF_SMALL))[0] == store.rows.count()
    want = rows(lx.stored_bm25_index(bd.comments(spark, SF_SMALL)).idf, "term", "df", "idf")
    assert sorted(rows(store.index.idf, "term", "df", "idf")) == sorted(want)


def _block(m):
    return sc.Block(np.arange(m), np.full((m, 1), np.nan), ["a", "b"], np.array([0, m, m + 1]), np.concatenate([np.arange(m), [0]]),
                    np.linspace(1, 2, m + 1), 1.5, 0.75, 10.0)


def test_a_slice_of_documents_is_bounded(monkeypatch):
    texts = [["a", "b", "a"] * (i % 5) + ["c"] * (i % 3) for i in range(200)] + [["a"] * 900, None, []]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "tokens": pa.array(texts, type=pa.list_(pa.string())),
                                        "v": pa.array([None] * len(texts), type=pa.list_(pa.float64())), "rv": [None] * len(texts)})
    whole = list(sc._scored([batch], _block(9), False))
    monkeypatch.setattr(sc, "CELLS", 45)
    monkeypatch.setattr(sc, "TOKENS", 30)
    parts = list(sc._scored([batch], _block(9), False))
    for ids, lexical, *_ in parts:
        assert len(ids) == 1 or (lexical.size <= 45 and sum(len(texts[i] or ()) for i in ids) <= 30)
    for i in range(3):
        np.testing.assert_allclose(np.concatenate([p[i] for p in parts]), np.concatenate([p[i] for p in whole]), rtol=1e-12)


def test_equal_scores_are_held_k_at_a_time():
    """Copies score the same; what is held for them doesn't grow with their number."""
    k, m, rng = 4, 3, np.random.default_rng(5)
    values = np.array([0.0, 0.25, 0.5, 0.5 + 1e-7, 0.5 + 6e-7])
    for top in range(1, len(values) + 1):
        ids = rng.permutation(4000)
        score = values[rng.integers(0, top, (len(ids), m))]
        live = rng.random(score.shape) < 0.9
        best = sc._Best(m, k)
        for lo in range(0, len(ids), 500):
            part = slice(lo, lo + 500)
            best.add(ids[part], score[part], live[part], score[part] / 2, score[part] / 4)
            assert len(best.rows[0]) <= m * k * top
        q, d, s, b, sn = best.rows
        np.testing.assert_array_equal(np.stack([b, sn]), np.stack([s / 2, s / 4]))
        for j in range(m):
            want = sorted((-round(x, 6), i) for x, i, on in zip(score[:, j].tolist(), ids.tolist(), live[:, j]) if on)[:k]
            got = sorted((-round(x, 6), i) for x, i in zip(s[q == j].tolist(), d[q == j].tolist()))[:k]
            assert got == want
    best = sc._Best(m, k)
    none = np.zeros((2, m))
    best.add(np.arange(2), none, none.astype(bool), none, none)
    assert not len(best.rows[0])


def test_terms_join_in_two_tiers(spark):
    from quarry.functions.sizing import join_by_term
    terms = [(f"t{i}", 1 + (i % 20) ** 2, float(i)) for i in range(300)]
    given = [(d, f"t{(d * 7 + j) % 320}") for d in range(100) for j in range(9)]
    occ, table = spark.createDataFrame(given, "doc_id long, term string"), spark.createDataFrame(terms, "term string, df long, x double")
    own = {t: x for t, _, x in terms}
    want = sorted((d, t, own[t]) for d, t in given if t in own)
    for most in (0, 10, 100, 1000):
        found = join_by_term(occ, table, most)
        assert sorted(rows(found, "doc_id", "term", "x")) == want
    assert "LeftAnti" in plan_of(join_by_term(occ, table, 100)) and "LeftAnti" not in plan_of(join_by_term(occ, table, 1000))


def test_a_part_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from quarry.operators import maintained as mt
    monkeypatch.setattr(mt, "TASK_DOCS", 50)
    docs = [("comments", i, f"w{i % 9} w{i % 4} all") for i in range(900)] + [("players", 1, None), ("players", 2, " ")]
    index = mt.MaintainedIndex(spark, str(tmp_path / "store"), parts=2)
    index.refresh(spark.createDataFrame(docs, "collection string, doc_id long, text string"))
    for name in ("chunks", "postings"):
        files = list((tmp_path / "store" / name / "version=0" / "collection=comments" / "part=0").glob("*.parquet"))
        assert len(files) >= 4
    assert len(rows(index.chunks())) == len(docs)
    tokens = {r["collection"]: r["t"] for r in index.manifest().groupBy("collection").agg(F.sum("tokens").alias("t")).collect()}
    assert tokens == {"comments": 2700, "players": 0}


def test_hits_are_summed_where_their_block_is(spark, tmp_path, monkeypatch):
    """No exchange between the postings' blocks and the documents' scores."""
    from quarry.operators import inverted as iv
    monkeypatch.setattr(iv, "BLOCK_DOCS", 8)
    post = spark.createDataFrame([(d, f"t{t}", 1.0 + (d * t) % 5) for d in range(200) for t in range(1 + d % 6)],
                                 "doc_id long, term string, a double").withColumn("b", F.lit(0.0))
    index = iv.build_inverted(post, 200, str(tmp_path / "idx"))
    asked = spark.createDataFrame([(q, f"t{t}", 1.0 + q) for q in range(4) for t in range(q, 6)], "qid long, term string, w double")
    found = iv.top_scores(index, asked, iv.weight_impact, 3)
    plan = plan_of(found)
    assert "Exchange" not in plan.split("SortMergeJoin")[0] and "SortMergeJoin" in plan
    want = {}
    for d in range(200):
        for t in range(1 + d % 6):
            for q in range(4):
                if t >= q:
                    want[q, d] = want.get((q, d), 0) + (1 + q) * (1.0 + (d * t) % 5)
    got = {(q, d): s for q, d, s in rows(found, "qid", "doc_id", "score")}
    assert all(want[x] == s for x, s in got.items())
    for q in range(4):
        best = sorted((-s, d) for (p, d), s in want.items() if p == q)[:3]
        assert all(got[q, d] == -s for s, d in best)
