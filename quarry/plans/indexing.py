"""Collection build / staleness, sparse retrieval and approximate k-NN queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import collections as co
from quarry.operators import dense as dn
from quarry.operators import inverted as iv
from quarry.operators import lexical as lx
from quarry.functions.sizing import join_by_term
from quarry.operators import sparse as sp
from quarry.plans import bindings as bd
from quarry.plans.sqlfrag import COMMENTS, QUESTIONS, bm25_ctes, tok
from quarry.session import index_dir
from quarry.sources.tables import load


def all_collections(spark, sf, docs=None):
    """comments = documents with a vector; c<label> = every vector of that label with
    the text of the document of the same id.  ``docs``: (doc_id, text), the comments by default."""
    docs = bd.comments(spark, sf) if docs is None else docs
    vecs = bd.vectors(spark, sf)
    comments = co.build_collection(docs.select("doc_id", "text"),
                                   vecs.select(F.col("vec_id").alias("doc_id"), "embedding"), "comments")
    labelled = co.build_collection(
        docs.select("doc_id", "text").join(
            vecs.select(F.col("vec_id").alias("doc_id"),
                        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection")), "doc_id"),
        vecs.select(F.col("vec_id").alias("doc_id"), "embedding"))
    return comments.unionByName(labelled)


def q_collection_build(spark, sf):
    return all_collections(spark, sf).select("collection", "chunk_id", "doc_id",
                                             F.size("embedding").cast("bigint").alias("n_dims"))


def _counts(spark, sf):
    docs = load(spark, sf, "documents", "doc_id", "text")
    vecs = load(spark, sf, "embeddings", "vec_id", "label")
    by_label = vecs.groupBy(F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"))
    stored = by_label.agg(F.count(F.lit(1)).alias("stored")).unionByName(
        docs.join(vecs.withColumnRenamed("vec_id", "doc_id"), "doc_id")
            .agg(F.count(F.lit(1)).alias("stored")).select(F.lit("comments").alias("collection"), "stored"))
    expected = by_label.agg(F.count(F.lit(1)).alias("expected")).unionByName(
        docs.agg(F.count(F.lit(1)).alias("expected")).select(F.lit("comments").alias("collection"), "expected"))
    return stored, expected


def q_stale_collections(spark, sf):
    stored, expected = _counts(spark, sf)
    return co.stale_collections(stored, expected)


def q_stale_by_hash(spark, sf):
    """Stored collections against their chunk sources: every document for
    ``comments``, each label's documents for ``c<label>``.  Only hashes are compared, so each text
    is hashed where it is read and its hash takes its place in joins and numbering."""
    docs = bd.comments(spark, sf).select("doc_id", F.xxhash64("text").alias("text"))
    stored = co.fingerprint(all_collections(spark, sf, docs))
    vecs = bd.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"),
                                        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"))
    sources = docs.withColumn("collection", F.lit("comments")).unionByName(docs.join(vecs, "doc_id"))
    return co.stale_by_hash(stored, co.fingerprint(sources))


def token_logits(idx, occurrences, id_col):
    """Token logits standing in for a sparse encoder's output: idf(term) - 1 under
    the document corpus's BM25 statistics.  ``occurrences`` (id, term) holds one
    row per distinct (text, term): every occurrence of a term in a text carries
    the same logit, so the max over occurrences needs only one of them."""
    logit = idx.idf.select("term", "df", (F.col("idf") - 1).alias("logit"))
    return join_by_term(occurrences.select(id_col, "term"), logit)


def _weights(spark, sf):
    idx = lx.stored_bm25_index(bd.comments(spark, sf))
    dw = sp.sparse_weights(token_logits(idx, idx.postings, "doc_id"), distinct_terms=True)
    return idx, dw


def q_sparse_weights(spark, sf):
    _, dw = _weights(spark, sf)
    return dw.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def q_sparse_top5(spark, sf):
    qs, docs = bd.questions(spark, sf), bd.comments(spark, sf).select("doc_id", "text")
    idx, dw = _weights(spark, sf)
    n, fp = lx.corpus_fingerprint(docs)
    # the weights are stored once, as postings with block bounds
    stored = iv.build_inverted(dw.select("term", "doc_id", F.col("weight").alias("a"), F.lit(0.0).alias("b")), n,
                               f"{index_dir(spark)}/sparse/{n}-{fp & (2**64 - 1):016x}-{iv.BLOCK_DOCS}")
    qw = sp.sparse_weights(token_logits(idx, lx.question_terms(qs), "qid"), "qid", distinct_terms=True)
    return iv.sparse_top_k(stored, qw, qs, 5)


def q_knn_lsh(spark, sf):
    corpus = bd.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = bd.question_vectors(spark, sf).where("embedding is not null")
    return dn.knn_lsh(corpus, asked, 5).select("qid", "rk", "doc_id", "distance")


QUERIES = {
    "collection_build": q_collection_build,
    "stale_collections": q_stale_collections,
    "stale_by_hash": q_stale_by_hash,
    "sparse_weights": q_sparse_weights,
    "sparse_top5": q_sparse_top5,
    "knn_lsh": q_knn_lsh,
}

_BM = bm25_ctes(COMMENTS, QUESTIONS)
_SPARSE = f"""{_BM},
dw AS (SELECT doc_id, term, max(ln(1 + greatest(idf - 1, 0.0))) AS weight
       FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) JOIN idf USING (term)
       GROUP BY doc_id, term HAVING max(ln(1 + greatest(idf - 1, 0.0))) > 0),
qw AS (SELECT qid, term, max(ln(1 + greatest(idf - 1, 0.0))) AS weight
       FROM (SELECT item_id AS qid, unnest({tok('text')}) AS term FROM benchmark) JOIN idf USING (term)
       GROUP BY qid, term HAVING max(ln(1 + greatest(idf - 1, 0.0))) > 0)"""

ORACLE = {
    "collection_build": """
WITH c AS (SELECT 'comments' AS collection, d.doc_id, len(e.embedding) AS n
           FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
           UNION ALL
           SELECT 'c' || e.label::VARCHAR AS collection, d.doc_id, len(e.embedding) AS n
           FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)
SELECT collection, collection || '_' || (row_number() OVER (PARTITION BY collection ORDER BY doc_id) - 1)::VARCHAR
       AS chunk_id, doc_id, n::BIGINT AS n_dims FROM c""",
    "stale_collections": """
WITH s AS (SELECT 'c' || label::VARCHAR AS collection, count(*) AS stored FROM embeddings GROUP BY 1
           UNION ALL
           SELECT 'comments', count(*) FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
x AS (SELECT 'c' || label::VARCHAR AS collection, count(*) AS expected FROM embeddings GROUP BY 1
      UNION ALL SELECT 'comments', count(*) FROM documents)
SELECT coalesce(s.collection, x.collection) AS collection, coalesce(stored, 0) AS stored,
       coalesce(expected, 0) AS expected,
       CASE WHEN coalesce(stored, 0) > 0 AND coalesce(stored, 0) = coalesce(expected, 0)
            THEN 'reuse' ELSE 'rebuild' END AS action
FROM s FULL OUTER JOIN x ON s.collection = x.collection""",
    "stale_by_hash": """
WITH lab AS (SELECT 'c' || e.label::VARCHAR AS collection, d.doc_id, d.text
             FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
st AS (SELECT 'comments' AS collection, d.doc_id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
       UNION ALL SELECT * FROM lab),
src AS (SELECT 'comments' AS collection, doc_id, text FROM documents UNION ALL SELECT * FROM lab),
a AS (SELECT collection, count(*) AS n, bit_xor(hash(doc_id, text)) AS fp FROM st GROUP BY 1),
b AS (SELECT collection, count(*) AS n, bit_xor(hash(doc_id, text)) AS fp FROM src GROUP BY 1)
SELECT coalesce(a.collection, b.collection) AS collection, a.n AS stored, b.n AS expected,
       CASE WHEN coalesce(a.n, 0) > 0 AND a.n = b.n AND a.fp = b.fp THEN 'reuse' ELSE 'rebuild' END AS action
FROM a FULL OUTER JOIN b ON a.collection = b.collection""",
    "sparse_weights": f"WITH {_SPARSE} SELECT doc_id, term, round(weight, 6) AS weight FROM dw",
    "sparse_top5": f"""WITH {_SPARSE},
sc AS (SELECT qw.qid, dw.doc_id, round(sum(qw.weight * dw.weight), 6) AS score
       FROM qw JOIN dw USING (term) GROUP BY qw.qid, dw.doc_id HAVING sum(qw.weight * dw.weight) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM sc)
SELECT qid, rk::BIGINT AS rk, doc_id, score, false AS no_match FROM r WHERE rk <= 5
UNION ALL
SELECT item_id AS qid, NULL::BIGINT AS rk, NULL::BIGINT AS doc_id, NULL::DOUBLE AS score, true AS no_match
FROM benchmark WHERE item_id NOT IN (SELECT qid FROM sc)""",
}
