"""Hybrid lexical + dense retrieval over a whole table of questions.

The normalisers need whole-corpus statistics per question, so the documents are scanned
twice: once for the bounds, once for the fused scores (see ``operators.scoring``).  A
document without a vector competes with a semantic score of 0, a question without one by
its words alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.sizing import bounded_broadcast
from quarry.operators import dense as dn
from quarry.operators import lexical as lx
from quarry.operators import scoring as sc

# Fusion weight, score threshold and top-k of the reference.
ALPHA = 0.5
THRESHOLD = 0.1
TOP_K = 15
LEGACY_TOP_K = 20

def hybrid_candidates(collection: DataFrame, questions: DataFrame, alpha: float = ALPHA,
                      threshold: float = THRESHOLD, k: int = TOP_K, route_cols: list[str] | None = None,
                      store: sc.Store | None = None) -> DataFrame:
    """Unranked (qid, doc_id, b, sn, score) rows, a superset of every question's top-k.

    With ``route_cols`` the questions' ``route_value`` (a ``route_tag``) restricts each routed question to documents
    that have it (after whole-corpus normalisation)."""
    store = store or sc.open_store(collection, route_cols)
    held = sc.HeldBlocks(questions.sparkSession, sc.blocks(questions, store))
    return sc.all_candidates(store, held, sc.all_bounds(store, held), alpha, threshold, k)


def rank_fused(cands: DataFrame, threshold: float = THRESHOLD, k: int | None = TOP_K) -> DataFrame:
    """Strict ``score > threshold``, then rank by (score rounded to 6 digits desc, doc_id)."""
    c = (cands.filter(F.col("score") > threshold)
              .select("qid", "doc_id", F.round("b", 6).alias("bm25_norm"),
                      F.round("sn", 6).alias("sem_norm"), F.round("score", 6).alias("score")))
    return lx.rank_within(c, "qid", [F.desc("score"), F.asc("doc_id")], k)


def hybrid_search(collection: DataFrame, questions: DataFrame, alpha: float = ALPHA,
                  threshold: float = THRESHOLD, k: int = TOP_K,
                  store: sc.Store | None = None) -> DataFrame:
    """(qid, rk, doc_id, score, bm25_norm, sem_norm) -- top-k per question.

    ``collection``: (doc_id, text, embedding or null, ...); ``questions``: (qid, question,
    embedding or null)."""
    cands = hybrid_candidates(collection, questions, alpha, threshold, k, store=store)
    return rank_fused(cands, threshold, k)


# --------------------------------------------------------------- routing

def keyword_route(questions: DataFrame, routes=(), text_col: str = "question") -> DataFrame:
    """Adds (route_column, route_value): the lowest-priority rule whose keyword occurs
    in the lower-cased question; null when none does.  The rule list is a small
    configuration, compiled into one CASE expression."""
    q = F.lower(F.col(text_col))
    col_expr: Column | None = None
    val_expr: Column | None = None
    for _, kws, column, value in sorted(routes, key=lambda r: r[0]):
        cond = None
        for kw in kws:
            c = F.contains(q, F.lit(kw))
            cond = c if cond is None else (cond | c)
        col_expr = (F.when(cond, F.lit(column)) if col_expr is None
                    else col_expr.when(cond, F.lit(column)))
        val_expr = (F.when(cond, F.lit(value)) if val_expr is None
                    else val_expr.when(cond, F.lit(value)))
    none = F.lit(None).cast("string")       # without rules no question is routed
    return (questions.withColumn("route_column", none if col_expr is None else col_expr)
                     .withColumn("route_value", none if val_expr is None else val_expr))


def route_tag(column, value) -> Column:
    """What a document must have for a route: its column and value in one text."""
    return F.concat(column, F.lit("="), value)


def hybrid_filtered(collection: DataFrame, questions: DataFrame, routes=(),
                    mode: str = "post", k: int = TOP_K, alpha: float = ALPHA,
                    threshold: float = THRESHOLD, route_col: str = "match",
                    store: sc.Store | None = None) -> DataFrame:
    """Routed hybrid search.  A route applies to the column that it names, if the collection has it; one on a
    column that is not there (``stage`` in the reference's collection) leaves the question unrouted.

    ``post``: rank over the whole collection, then drop routed-out rows (can
    return fewer than k).
    ``pre``: drop routed-out documents after whole-corpus normalisation and
    before ranking, so scores equal the post-filter ones but k rows are kept
    when available.  A given ``store`` must have been opened with the same route columns."""
    columns = route_columns(collection, routes, route_col)
    value = F.when(F.col("route_column").isin(columns), route_tag(F.col("route_column"), F.col("route_value")))
    routed = keyword_route(questions, routes).withColumn("route_value", value)
    if mode == "post":
        top = hybrid_search(collection, questions, alpha, threshold, k, store)
        docs = collection.select("doc_id", sc.route_tags(columns).alias("__tags"))
        return (top.join(bounded_broadcast(routed.select("qid", "route_value")), "qid")
                   .join(docs, "doc_id")
                   .filter(F.col("route_value").isNull() | F.array_contains("__tags", F.col("route_value")))
                   .select("qid", "rk", "doc_id", "score", "bm25_norm", "sem_norm"))
    if mode != "pre":
        raise ValueError("mode must be 'pre' or 'post'")
    cands = hybrid_candidates(collection, routed, alpha, threshold, k, columns, store)
    return rank_fused(cands, threshold, k).select(
        "qid", "rk", "doc_id", "score", "bm25_norm", "sem_norm")


def route_columns(collection: DataFrame, routes, route_col: str | None = None) -> list[str]:
    """The columns of a collection that routes name, and the usual one."""
    named = {r[2] for r in routes} | ({route_col} if route_col else set())
    return sorted(c for c in named if c in collection.columns)


# ------------------------------------------------------------ fan-out

def multi_collection(comment_collection: DataFrame, other_collections: DataFrame,
                     questions: DataFrame, k_comments: int = TOP_K, k_other: int = 5,
                     alpha: float = ALPHA, threshold: float = THRESHOLD, routes=(),
                     mode: str = "post", route_col: str = "match") -> DataFrame:
    """Hybrid top-k on comments, routed where ``routes`` say so, plus k-NN top-5 in each other
    collection, one plan.

    ``other_collections``: (collection, doc_id, embedding).  Returns (qid,
    collection, rk, doc_id, score): fused score for comments, squared L2
    distance for the others."""
    found = hybrid_filtered(comment_collection, questions, routes, mode, k_comments, alpha, threshold,
                            route_col) if routes else hybrid_search(
        comment_collection, questions, alpha, threshold, k_comments)
    hyb = found.select(
        "qid", F.lit("comments").alias("collection"), "rk", "doc_id", "score")
    nn = dn.knn(other_collections, questions, k_other, group_col="collection").select(
        "qid", "collection", "rk", "doc_id", F.col("distance").alias("score"))
    return hyb.unionByName(nn)
