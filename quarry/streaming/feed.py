"""The console loop as a question feed: cache, retrieval, prompt, answer, cache and memory again.

Each micro-batch of (qid, session_id, question) rows

1. is split against the cache as it was before the batch (keys are trimmed and lower-cased); of equal questions in
   the batch the one with the smallest qid is asked and the others take its answer, as they would one after the other;
2. sends the rest through retrieval over all collections, the fallback test and the prompt;
3. gets answers for the prompts (``answer``, a DataFrame function; no row or a null is a failed call);
4. writes answers, new cache entries and memory turns, each under ``batch_id=<id>`` with overwrite.

A batch reads only cache entries of earlier batches, so replaying it rewrites the same rows.  Refused and failed
questions enter neither cache nor memory and are asked anew when they come again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import py_strip
from quarry.operators import memory as mem
from quarry.operators import prompts as pr
from quarry.session import materialize
from quarry.streaming.questions import finish

ANSWERS = "qid long, session_id long, status string, answer string, message string, batch_id long"
CACHE = "question_key string, answer string, batch_id long"
MEMORY = "session_id long, qid long, role string, content string, batch_id long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)        # no batch yet


@dataclass
class Feed:
    """``retrieve``: (qid, question) -> rows (qid, collection, rk, doc_id, score, text, match, upvotes);
    ``answer``: (qid, message) -> (qid, answer); ``sections``: the prompt's sections; ``path``: shared folder."""

    retrieve: Callable[[DataFrame], DataFrame]
    answer: Callable[[DataFrame], DataFrame]
    sections: DataFrame
    path: str

    def answers(self, spark: SparkSession) -> DataFrame:
        return _table(spark, f"{self.path}/answers", ANSWERS)

    def memory(self, spark: SparkSession) -> DataFrame:
        return _table(spark, f"{self.path}/memory", MEMORY)

    def cache_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(question_key, answer): the last entry of each key that earlier batches wrote."""
        log = _table(spark, f"{self.path}/cache", CACHE).where(F.col("batch_id") < batch_id)
        return mem.latest_per_key(log.withColumnRenamed("batch_id", "version")).select("question_key", "answer")

    def asked(self, questions: DataFrame) -> DataFrame:
        """(qid, status, answer, message) of questions that the cache does not answer."""
        rows = materialize(self.retrieve(questions), "feed-retrieved")
        refused = pr.fallback_flag(rows, questions).select("qid", "fallback")
        prompts = pr.prompt_build(pr.prompt_sections(rows, self.sections), questions)
        sent = materialize(prompts.join(refused, "qid").select(
            "qid", "fallback", F.when(~F.col("fallback"), F.col("user_message")).alias("message")), "feed-prompts")
        got = self.answer(sent.where("not fallback").select("qid", "message")).select("qid", "answer")
        status = (F.when(F.col("fallback"), "refused").when(F.col("answer").isNotNull(), "answered").otherwise("failed"))
        return sent.join(got, "qid", "left").select(
            "qid", status.alias("status"), F.when(F.col("fallback"), F.lit(pr.REFUSAL)).otherwise(F.col("answer")).alias("answer"),
            "message")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        question = py_strip("question")
        q = batch.select("qid", "session_id", question.alias("question")).where("question <> ''")
        q = materialize(q.withColumn("question_key", mem.cache_key("question")), "feed-batch")
        first = q.groupBy("question_key").agg(F.min("qid").alias("first_qid"))
        cache = self.cache_before(spark, batch_id).withColumnRenamed("answer", "cached")
        keys = materialize(first.join(cache, "question_key", "left"), "feed-keys")
        misses = q.join(keys.where("cached is null").select(F.col("first_qid").alias("qid")), "qid", "left_semi")
        misses = materialize(misses.select("qid", "question"), "feed-misses")
        new = spark.createDataFrame([], "qid long, status string, answer string, message string") \
            if misses.first() is None else materialize(self.asked(misses), "feed-asked")
        known = keys.join(new.withColumnRenamed("qid", "first_qid"), "first_qid", "left")
        known = known.select("question_key", "first_qid", "status", "message", F.coalesce("cached", "answer").alias("answer"))
        every = q.join(known, "question_key")
        later = F.col("status").isNull() | ((F.col("status") == "answered") & (F.col("qid") != F.col("first_qid")))
        out = materialize(every.select(
            "qid", "session_id", "question", "question_key", F.when(later, "cached").otherwise(F.col("status")).alias("status"),
            "answer", F.when(~later, F.col("message")).alias("message")), "feed-answers")

        def write(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

        write(out.where("status = 'answered'").select("question_key", "answer"), "cache")
        told = out.where("status in ('answered', 'cached')")
        # the bare question, without its context, then the answer
        write(told.select("session_id", "qid", F.lit("user").alias("role"), F.col("question").alias("content")).unionByName(
            told.select("session_id", "qid", F.lit("assistant").alias("role"), F.col("answer").alias("content"))), "memory")
        write(out.select("qid", "session_id", "status", "answer", "message"), "answers")

    def run(self, questions: DataFrame, checkpoint: str, timeout_s: int = 1800) -> None:
        """Answers all that has arrived in the stream of (qid, session_id, question)."""
        query = (questions.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        finish(query, timeout_s)
