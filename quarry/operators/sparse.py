"""Sparse (term-weighted) retrieval.

Weights: ``log(1 + relu(logit))`` per token occurrence, max over a text's
occurrences of the term (the masked max pooling of a sparse encoder).  Token
logits arrive as a table; the encoder itself is out of scope.  Scoring is a
dot product over shared terms: question weights (small, size-checked
broadcast) probe the document weights in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.sizing import bounded_broadcast
from quarry.operators.lexical import rank_within

TOP_K = 5


def sparse_weights(token_logits: DataFrame, id_col: str = "doc_id",
                   distinct_terms: bool = False, mask_col: str | None = None) -> DataFrame:
    """(id, term, weight > 0) from (id, term, logit) rows, one per token occurrence; ``mask_col`` is 0 for
    occurrences that count nothing (padding), 1 for others.

    ``distinct_terms``: the input already has one row per (id, term) (e.g. it is
    derived from postings), so the max is the row itself -- a map-only
    projection that keeps the input's partitioning (no shuffle)."""
    w = F.log1p(F.greatest(F.col("logit").cast("double"), F.lit(0.0)))
    if mask_col:
        w = w * F.col(mask_col).cast("double")
    if distinct_terms:
        out = token_logits.select(id_col, "term", w.alias("weight"))
    else:
        out = token_logits.groupBy(id_col, "term").agg(F.max(w).alias("weight"))
    return out.filter(F.col("weight") > 0)


def sparse_scores(doc_w: DataFrame, q_w: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """(qid, doc_id, score) for pairs sharing at least one weighted term."""
    q = bounded_broadcast(q_w.select("qid", "term", F.col("weight").alias("wq")), max_broadcast_rows)
    j = doc_w.select("doc_id", "term", F.col("weight").alias("wd")).join(q, "term")
    return j.groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def sparse_top_k(doc_w: DataFrame, q_w: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, rk, doc_id, score, no_match): top-k positive scores per question (rank
    by score rounded to 6 digits, then doc_id); a question without any positive
    score gets one row with ``no_match`` true."""
    from quarry.session import materialize
    s = sparse_scores(doc_w, q_w).filter(F.col("score") > 0).withColumn("score", F.round("score", 6))
    # what is kept for both branches is the ranking, k rows per question, not the scored pairs
    top = materialize(rank_within(s, "qid", [F.desc("score"), F.asc("doc_id")], k), "sparse-top")
    none = questions.select("qid").join(top.select("qid").distinct(), "qid", "left_anti").select(
        "qid", F.lit(None).cast("bigint").alias("rk"), F.lit(None).cast("bigint").alias("doc_id"),
        F.lit(None).cast("double").alias("score"), F.lit(True).alias("no_match"))
    return top.withColumn("no_match", F.lit(False)).select(
        "qid", "rk", "doc_id", "score", "no_match").unionByName(none)
