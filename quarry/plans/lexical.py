"""Lexical queries over the driver tables: tokens, postings, idf, BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.sizing import fits
from quarry.functions.text import preview
from quarry.operators import inverted as iv
from quarry.operators import lexical as lx
from quarry.plans import bindings as bd
from quarry.plans.sqlfrag import COMMENTS, QUESTIONS, bm25_ctes, tok


def q_tokenize(spark, sf):
    return lx.tokenize(bd.comments(spark, sf)).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def q_term_postings(spark, sf):
    return lx.term_postings(bd.comments(spark, sf))


def q_bm25_idf(spark, sf):
    idx = lx.stored_bm25_index(bd.comments(spark, sf))
    return idx.idf.select("term", "df", F.round("idf", 6).alias("idf"))


def q_bm25_scores(spark, sf):
    idx = lx.stored_bm25_index(bd.comments(spark, sf))
    s = lx.bm25_scores(idx, bd.questions(spark, sf))
    return s.select("qid", "doc_id", F.round("score", 6).alias("score"))


def q_bm25_top5(spark, sf):
    docs = bd.comments(spark, sf)
    top = iv.bm25_top_k(docs, bd.questions(spark, sf), k=5)
    # fetch text only after the limit
    return top.join(docs.select("doc_id", "match", "text"), "doc_id").select(
        "qid", "rk", "doc_id", "score", "match", preview("text", 200).alias("body"))


def q_score_max_norm(spark, sf):
    idx = lx.stored_bm25_index(bd.comments(spark, sf))
    qs = bd.questions(spark, sf)
    s = lx.max_normalise(lx.bm25_scores(idx, qs), broadcast_groups=fits(qs, 2_000_000))
    return s.select("qid", "doc_id", F.round("score", 6).alias("score"),
                    F.round("score_norm", 6).alias("score_norm"))


QUERIES = {
    "tokenize": q_tokenize,
    "term_postings": q_term_postings,
    "bm25_idf": q_bm25_idf,
    "bm25_scores": q_bm25_scores,
    "bm25_top5": q_bm25_top5,
    "score_max_norm": q_score_max_norm,
}

_BM25 = bm25_ctes(COMMENTS, QUESTIONS)

ORACLE = {
    "tokenize": f"""
SELECT doc_id, (generate_subscripts(toks, 1) - 1)::BIGINT AS pos, unnest(toks) AS token
FROM (SELECT doc_id, {tok('text')} AS toks FROM documents)""",
    "term_postings": f"""
WITH {_BM25}
SELECT doc_id, term, dl::BIGINT AS dl, tf::BIGINT AS tf FROM p""",
    "bm25_idf": f"""
WITH {_BM25}
SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf""",
    "bm25_scores": f"""
WITH {_BM25}
SELECT qid, doc_id, round(score, 6) AS score FROM s""",
    "bm25_top5": f"""
WITH {_BM25},
full_s AS (SELECT q.qid, c.doc_id, round(coalesce(s.score, 0), 6) AS score
           FROM {QUESTIONS} q CROSS JOIN {COMMENTS} c
           LEFT JOIN s ON s.qid = q.qid AND s.doc_id = c.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC) AS rk FROM full_s)
SELECT r.qid, r.rk::BIGINT AS rk, r.doc_id, r.score, c.match, substring(c.text, 1, 200) AS body
FROM r JOIN {COMMENTS} c USING (doc_id) WHERE r.rk <= 5""",
    "score_max_norm": f"""
WITH {_BM25},
m AS (SELECT qid, max(score) AS mx FROM s GROUP BY qid)
SELECT s.qid, s.doc_id, round(s.score, 6) AS score,
       round(CASE WHEN m.mx > 0 THEN s.score / m.mx ELSE s.score END, 6) AS score_norm
FROM s JOIN m USING (qid)""",
}
