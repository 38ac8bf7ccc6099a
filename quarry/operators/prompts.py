"""Grounded prompt assembly from ranked retrieval rows.

Input: ranked rows (qid, collection, rk, doc_id, score) joined to their chunk
text.  Per question the number of lines is bounded by the top-k values, so the
per-question ordered ``collect_list`` is bounded too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fixed_point, preview
from quarry.operators.hybrid import THRESHOLD

# Section headers and order of the prompt, and its cap on comment lines.
SECTION_HEADERS = (
    ("tournament", "Tournament info:"),
    ("players", "Player info:"),
    ("champions", "Champion stats:"),
    ("comments", "Community reactions (Reddit):"),
)
MAX_COMMENT_LINES = 15

# Texts around the context: plain defaults, to be replaced by a caller's own.
REFUSAL = "The stored material says too little to answer this."
PROMPT_HEAD = (
    "Use the sections below to answer. Sections taken from records can be restated; what a "
    "commenter wrote should be quoted as somebody's view. Where the sections are silent, say so.\n\n"
    "[sections]\n")
PROMPT_TAIL = "\n[end of sections]\n"
USER_PREFIX = "Material first, then the question.\n"


def section_table(spark, sections) -> DataFrame:
    """(collection, section_ord, header) for the configured section order."""
    return spark.createDataFrame([(c, i, h) for i, (c, h) in enumerate(sections)],
                                 "collection string, section_ord int, header string")


def line_text(comment_collection: str = "comments") -> Column:
    """``- {text}`` for knowledge rows; ``[{match}, {upvotes} upvotes]: {text}`` for comments."""
    return F.when(F.col("collection") == comment_collection,
                  F.concat(F.lit("["), F.col("match"), F.lit(", "), F.col("upvotes").cast("string"),
                           F.lit(" upvotes]: "), F.col("text"))
                  ).otherwise(F.concat(F.lit("- "), F.col("text")))


def prompt_sections(rows: DataFrame, sections: DataFrame,
                    comment_collection: str = "comments",
                    max_comment_lines: int = MAX_COMMENT_LINES) -> DataFrame:
    """(qid, collection, section_ord, section): header + lines in rank order joined by
    newline.  Collections without a configured section are not shown; comments
    are cut to ``max_comment_lines``."""
    r = rows.filter((F.col("collection") != comment_collection) | (F.col("rk") <= max_comment_lines))
    r = r.join(F.broadcast(sections), "collection")  # sections: a fixed small configuration
    lines = r.withColumn("line", line_text(comment_collection))
    agg = lines.groupBy("qid", "collection", "section_ord", "header").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "line"))),
                                 lambda x: x["line"]), "\n").alias("body"))
    return agg.select("qid", "collection", "section_ord",
                      F.concat(F.col("header"), F.lit("\n"), F.col("body")).alias("section"))


def prompt_build(sections: DataFrame, questions: DataFrame, head: str = PROMPT_HEAD,
                 tail: str = PROMPT_TAIL, prefix: str = USER_PREFIX) -> DataFrame:
    """(qid, prompt, user_message): non-empty sections in fixed order joined by a blank
    line, wrapped in the template; a question without any section gets an empty
    context."""
    ctx = sections.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "section"))),
                                 lambda x: x["section"]), "\n\n").alias("context"))
    q = questions.select("qid", "question").join(ctx, "qid", "left")
    prompt = F.concat(F.lit(head), F.coalesce(F.col("context"), F.lit("")), F.lit(tail))
    return q.select("qid", prompt.alias("prompt"),
                    F.concat(F.lit(prefix), prompt, F.lit("\n\nQuestion: "),
                             F.col("question")).alias("user_message"))


def retrieval_counts(rows: DataFrame, collections) -> DataFrame:
    """(qid, n_<collection>...) with a fixed pivot list; absent -> 0."""
    p = rows.groupBy("qid").pivot("collection", list(collections)).count()
    for c in collections:
        p = p.withColumnRenamed(c, f"n_{c}")
    return p.fillna(0, [f"n_{c}" for c in collections]).select(
        "qid", *[F.col(f"n_{c}").cast("bigint").alias(f"n_{c}") for c in collections])


def fallback_flag(rows: DataFrame, questions: DataFrame, comment_collection: str = "comments",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(qid, max_score, fallback): max fused comment score (0 when none) and whether
    the canned refusal applies (max < threshold and every other collection empty)."""
    per = rows.groupBy("qid").agg(
        F.max(F.when(F.col("collection") == comment_collection, F.col("score"))).alias("mx"),
        F.sum(F.when(F.col("collection") != comment_collection, 1).otherwise(0)).alias("n_other"))
    q = questions.select("qid").join(per, "qid", "left")
    mx = F.coalesce(F.col("mx"), F.lit(0.0))
    return q.select("qid", mx.alias("max_score"),
                    ((mx < threshold) & (F.coalesce(F.col("n_other"), F.lit(0)) == 0)).alias("fallback"))


def debug_lines(rows: DataFrame, comment_collection: str = "comments", n_comments: int = 5,
                named: DataFrame | None = None) -> DataFrame:
    """(qid, collection, rk, line): scores to 3 decimals.  Comments (the first ``n_comments``) show their
    match and 80 characters; rows of the collections that ``named`` (collection, doc_id, name, detail)
    covers show the name and its detail, a question mark for what is missing; others 100 characters.

    ``named`` has one row at most for a (collection, doc_id); a collection is covered if it has any."""
    r = rows.filter((F.col("collection") != comment_collection) | (F.col("rk") <= n_comments))
    score = F.concat(F.lit("["), fixed_point("score"), F.lit("] "))
    by_name = F.lit(False)
    if named is not None:
        # few collections, whatever the number of names
        covered = [x[0] for x in named.select("collection").distinct().limit(1000).collect()]
        by_name = F.col("collection").isin(covered)
        r = r.join(named.select("collection", "doc_id", "name", "detail"), ["collection", "doc_id"], "left")
        label = F.concat(F.coalesce("name", F.lit("?")), F.lit(" ("), F.coalesce("detail", F.lit("?")), F.lit(")"))
    else:
        label = F.lit("")
    line = F.when(F.col("collection") == comment_collection,
                  F.concat(score, F.lit("["), F.col("match"), F.lit("] "), preview("text", 80), F.lit("..."))
                  ).when(by_name, F.concat(score, label)
                  ).otherwise(F.concat(score, preview("text", 100), F.lit("...")))
    return r.select("qid", "collection", "rk", line.alias("line"))
