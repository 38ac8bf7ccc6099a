"""Dense, hybrid, routed and multi-collection retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import dense as dn
from quarry.operators import hybrid as hy
from quarry.operators import lexical as lx
from quarry.operators import scoring as sc
from quarry.plans import bindings as bd
from quarry.plans.sqlfrag import COLLECTION, QVEC, bm25_ctes, sqdist

# Routes bound to the driver tables: keywords that occur in benchmark questions,
# a value that exists in documents.source, and a rule on a column the comment
# collection does not carry (ignored, as in the reference).
BOUND_ROUTES = [
    (1, ("que", "with"), "match", "src3"),
    (2, ("the",), "stage", "Semi-Finals"),
]


def q_knn_top5(spark, sf):
    corpus = bd.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    return dn.knn(corpus, bd.question_vectors(spark, sf), 5).select("qid", "rk", "doc_id", "distance")


def q_knn_where(spark, sf):
    corpus = (bd.vectors(spark, sf).filter(F.col("label") == 3)  # metadata pre-filter, pushed to the scan
              .select(F.col("vec_id").alias("doc_id"), "embedding"))
    return dn.knn(corpus, bd.question_vectors(spark, sf), 5).select("qid", "rk", "doc_id", "distance")


def q_l2_normalise(spark, sf):
    v = dn.l2_normalise(bd.vectors(spark, sf))
    return v.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def q_mean_pool(spark, sf):
    return dn.mean_pool(bd.vectors(spark, sf), "label").select(
        "label", "dim", F.round("value", 6).alias("value"))


def q_score_minmax(spark, sf):
    store = sc.open_store(bd.comment_collection(spark, sf))
    held = sc.HeldBlocks(spark, sc.blocks(bd.question_vectors(spark, sf), store))
    c = sc.all_candidates(store, held, sc.all_bounds(store, held), 0.0, None, 15, dense_only=True).select("qid", "doc_id", F.round("sn", 6).alias("sem_norm"))
    return lx.rank_within(c, "qid", [F.desc("sem_norm"), F.asc("doc_id")], 15).select(
        "qid", "rk", "doc_id", "sem_norm")


def _hybrid(k):
    def run(spark, sf):
        coll = bd.comment_collection(spark, sf)
        top = hy.hybrid_search(coll, bd.question_vectors(spark, sf), k=k)
        # metadata fetched from the comment table after the limit
        return top.join(bd.comments(spark, sf).select("doc_id", "match", "upvotes"), "doc_id").select(
            "qid", "rk", "doc_id", "score", "bm25_norm", "sem_norm", "match", "upvotes")
    return run


def q_keyword_route(spark, sf):
    return hy.keyword_route(bd.questions(spark, sf), BOUND_ROUTES).select(
        "qid", "route_column", "route_value")


def _filtered(mode):
    def run(spark, sf):
        return hy.hybrid_filtered(bd.comment_collection(spark, sf), bd.question_vectors(spark, sf),
                                  BOUND_ROUTES, mode=mode)
    return run


def q_multi_collection(spark, sf):
    return hy.multi_collection(bd.comment_collection(spark, sf), bd.label_collections(spark, sf),
                               bd.question_vectors(spark, sf), routes=BOUND_ROUTES)


QUERIES = {
    "knn_top5": q_knn_top5,
    "knn_where": q_knn_where,
    "l2_normalise": q_l2_normalise,
    "mean_pool": q_mean_pool,
    "score_minmax": q_score_minmax,
    "hybrid_top15": _hybrid(15),
    "hybrid_top20": _hybrid(20),
    "keyword_route": q_keyword_route,
    "hybrid_postfilter": _filtered("post"),
    "hybrid_prefilter": _filtered("pre"),
    "multi_collection": q_multi_collection,
}

# ------------------------------------------------------------------ oracle

_QTEXT = "(SELECT qid, question FROM " + QVEC + ")"
_CTEXT = "(SELECT doc_id, text FROM " + COLLECTION + ")"

HYBRID_CTES = bm25_ctes(_CTEXT, _QTEXT) + f""",
mx AS (SELECT qid, max(score) AS mx FROM s GROUP BY qid),
bn AS (SELECT s.qid, s.doc_id, CASE WHEN mx.mx > 0 THEN s.score / mx.mx ELSE s.score END AS b
       FROM s JOIN mx USING (qid)),
dist AS (SELECT q.qid, c.doc_id, {sqdist('q.embedding', 'c.embedding')} AS d
         FROM {QVEC} q CROSS JOIN {COLLECTION} c
         WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
bounds AS (SELECT qid, max(d) AS max_d, min(d) AS min_d FROM dist GROUP BY qid),
sem AS (SELECT dist.qid, dist.doc_id,
               CASE WHEN bounds.max_d - bounds.min_d > 0
                    THEN (bounds.max_d - dist.d) / (bounds.max_d - bounds.min_d)
                    ELSE bounds.max_d - dist.d END AS sn
        FROM dist JOIN bounds USING (qid)),
h AS (SELECT q.qid, c.doc_id, coalesce(bn.b, 0) AS b, coalesce(sem.sn, 0) AS sn,
             0.5 * coalesce(bn.b, 0) + 0.5 * coalesce(sem.sn, 0) AS score
      FROM (SELECT qid FROM {QVEC}) q CROSS JOIN (SELECT doc_id FROM {COLLECTION}) c
      LEFT JOIN sem ON sem.qid = q.qid AND sem.doc_id = c.doc_id
      LEFT JOIN bn ON bn.qid = q.qid AND bn.doc_id = c.doc_id),
hr AS (SELECT qid, doc_id, round(b, 6) AS bm25_norm, round(sn, 6) AS sem_norm,
              round(score, 6) AS score,
              row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rk
       FROM h WHERE score > 0.1)"""

ROUTE_CASE_COL = ("CASE WHEN contains(lower(question), 'que') OR contains(lower(question), 'with') "
                  "THEN 'match' WHEN contains(lower(question), 'the') THEN 'stage' END")
ROUTE_CASE_VAL = ("CASE WHEN contains(lower(question), 'que') OR contains(lower(question), 'with') "
                  "THEN 'src3' WHEN contains(lower(question), 'the') THEN 'Semi-Finals' END")

_KNN = """
WITH d AS (SELECT q.qid, e.vec_id AS doc_id, round({dist}, 6) AS distance
           FROM {qvec} q CROSS JOIN embeddings e WHERE q.embedding IS NOT NULL {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rk FROM d)
SELECT qid, rk::BIGINT AS rk, doc_id, distance FROM r WHERE rk <= 5"""


def _hyb_sql(k):
    return f"""
WITH {HYBRID_CTES}
SELECT hr.qid, hr.rk::BIGINT AS rk, hr.doc_id, hr.score, hr.bm25_norm, hr.sem_norm, c.match, c.upvotes
FROM hr JOIN {COLLECTION} c USING (doc_id) WHERE hr.rk <= {k}"""


ORACLE = {
    "knn_top5": _KNN.format(dist=sqdist("q.embedding", "e.embedding"), qvec=QVEC, where=""),
    "knn_where": _KNN.format(dist=sqdist("q.embedding", "e.embedding"), qvec=QVEC,
                             where="AND e.label = 3"),
    "l2_normalise": """
WITH n AS (SELECT vec_id, embedding,
                  sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm
           FROM embeddings),
u AS (SELECT vec_id, CASE WHEN nrm > 0 THEN list_transform(embedding, lambda x: x::DOUBLE / nrm) END AS v
      FROM n)
SELECT vec_id, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(unnest(v), 6) AS value FROM u""",
    "mean_pool": """
SELECT label, (pos - 1)::BIGINT AS dim,
       round(sum(x::DOUBLE * 1.0) / greatest(sum(1.0), 1e-9), 6) AS value
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
GROUP BY label, pos""",
    "score_minmax": f"""
WITH dist AS (SELECT q.qid, c.doc_id, {sqdist('q.embedding', 'c.embedding')} AS d
              FROM {QVEC} q CROSS JOIN {COLLECTION} c
              WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
b AS (SELECT qid, max(d) AS mx, min(d) AS mn FROM dist GROUP BY qid),
s AS (SELECT dist.qid, dist.doc_id,
             round(CASE WHEN b.mx - b.mn > 0 THEN (b.mx - dist.d) / (b.mx - b.mn)
                        ELSE b.mx - dist.d END, 6) AS sem_norm
      FROM dist JOIN b USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sem_norm DESC, doc_id) AS rk FROM s)
SELECT qid, rk::BIGINT AS rk, doc_id, sem_norm FROM r WHERE rk <= 15""",
    "hybrid_top15": _hyb_sql(15),
    "hybrid_top20": _hyb_sql(20),
    "keyword_route": f"""
SELECT item_id AS qid, {ROUTE_CASE_COL.replace('question', 'text')} AS route_column,
       {ROUTE_CASE_VAL.replace('question', 'text')} AS route_value FROM benchmark""",
    "hybrid_postfilter": f"""
WITH {HYBRID_CTES},
rt AS (SELECT qid, CASE WHEN {ROUTE_CASE_COL} = 'match' THEN {ROUTE_CASE_VAL} END AS rv FROM {QVEC})
SELECT hr.qid, hr.rk::BIGINT AS rk, hr.doc_id, hr.score, hr.bm25_norm, hr.sem_norm
FROM hr JOIN rt USING (qid) JOIN {COLLECTION} c USING (doc_id)
WHERE hr.rk <= 15 AND (rt.rv IS NULL OR c.match = rt.rv)""",
    "hybrid_prefilter": f"""
WITH {HYBRID_CTES},
rt AS (SELECT qid, CASE WHEN {ROUTE_CASE_COL} = 'match' THEN {ROUTE_CASE_VAL} END AS rv FROM {QVEC}),
kept AS (SELECT h.qid, h.doc_id, round(h.b, 6) AS bm25_norm, round(h.sn, 6) AS sem_norm,
                round(h.score, 6) AS score
         FROM h JOIN rt USING (qid) JOIN {COLLECTION} c USING (doc_id)
         WHERE h.score > 0.1 AND (rt.rv IS NULL OR c.match = rt.rv)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM kept)
SELECT qid, rk::BIGINT AS rk, doc_id, score, bm25_norm, sem_norm FROM r WHERE rk <= 15""",
    "multi_collection": f"""
WITH {HYBRID_CTES},
nn AS (SELECT q.qid, 'c' || e.label::VARCHAR AS collection, e.vec_id AS doc_id,
              round({sqdist('q.embedding', 'e.embedding')}, 6) AS score
       FROM {QVEC} q CROSS JOIN embeddings e WHERE q.embedding IS NOT NULL),
rt AS (SELECT qid, CASE WHEN {ROUTE_CASE_COL} = 'match' THEN {ROUTE_CASE_VAL} END AS rv FROM {QVEC}),
routed AS (SELECT hr.* FROM hr JOIN rt USING (qid) JOIN {COLLECTION} c USING (doc_id)
           WHERE hr.rk <= 15 AND (rt.rv IS NULL OR c.match = rt.rv)),
nr AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score, doc_id) AS rk FROM nn)
SELECT qid, 'comments' AS collection, rk::BIGINT AS rk, doc_id, score FROM routed
UNION ALL
SELECT qid, collection, rk::BIGINT AS rk, doc_id, score FROM nr WHERE rk <= 5""",
}

# multi-collection rows as CTEs (``mc``), for oracles that build on them
MULTI_CTES = HYBRID_CTES + f""",
nn AS (SELECT q.qid, 'c' || e.label::VARCHAR AS collection, e.vec_id AS doc_id,
              round({sqdist('q.embedding', 'e.embedding')}, 6) AS score
       FROM {QVEC} q CROSS JOIN embeddings e WHERE q.embedding IS NOT NULL),
rt AS (SELECT qid, CASE WHEN {ROUTE_CASE_COL} = 'match' THEN {ROUTE_CASE_VAL} END AS rv FROM {QVEC}),
routed AS (SELECT hr.* FROM hr JOIN rt USING (qid) JOIN {COLLECTION} c USING (doc_id)
           WHERE hr.rk <= 15 AND (rt.rv IS NULL OR c.match = rt.rv)),
nr AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score, doc_id) AS rk FROM nn),
mc AS (SELECT qid, 'comments' AS collection, rk::BIGINT AS rk, doc_id, score FROM routed
       UNION ALL
       SELECT qid, collection, rk::BIGINT AS rk, doc_id, score FROM nr WHERE rk <= 5)"""
