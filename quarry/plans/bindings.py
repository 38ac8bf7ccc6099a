"""How the driver tables stand in for the reference's data model.

* ``documents``  -> comment corpus: body = text, match = source, upvotes = n_chars
* ``benchmark``  -> question table: qid = item_id, question = text
* ``embeddings`` -> vectors: chunk vectors by ``vec_id = doc_id``, question vectors
                    by ``vec_id = item_id``; ``label`` names a collection
* ``labels``     -> author flag (toxic = 1 plays ``[deleted]``) and grades
* ``conversations`` -> session memory (session_id = conv_id, content = text)
* ``part`` / ``lineitem`` / ``orders`` -> roster, statistics, nested matches
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import load


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents", "doc_id", "text", "source", "n_chars").select(
        "doc_id", "text", F.col("source").alias("match"), F.col("n_chars").alias("upvotes"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings", "vec_id", "embedding", "label")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every question, with its vector where there is one."""
    v = vectors(spark, sf).select(F.col("vec_id").alias("qid"), "embedding")
    return questions(spark, sf).join(v, "qid", "left")


def comment_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The comment collection: every comment, with its chunk vector where there is one, and its text's hash."""
    v = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    return comments(spark, sf).withColumn("text_hash", F.xxhash64("text")).join(v, "doc_id", "left")


def label_collections(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as named collections (``label`` -> collection name)."""
    return vectors(spark, sf).select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
        F.col("vec_id").alias("doc_id"), "embedding")
