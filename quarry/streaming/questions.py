"""Question feed answered as it arrives (the console loop, re-aimed as a stream).

Each micro-batch of questions is answered by the same batch operators against
a static collection and a lexical index built once, then written under
``batch_id=<id>`` with overwrite, so a replayed batch (after a failure between
write and commit) rewrites the same files instead of duplicating them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import hybrid as hy
from quarry.operators import scoring as sc
from quarry.session import shared_path


def finish(query: StreamingQuery, timeout_s: int) -> None:
    """Waits for a bounded stream to end; a stream that fails or is still running after
    ``timeout_s`` is an error, so a part is never taken for the whole."""
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream is still running after {timeout_s} s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def answer_stream(spark: SparkSession, questions_stream: DataFrame, question_vectors: DataFrame,
                  collection: DataFrame, out_path: str | None = None, k: int = hy.TOP_K,
                  checkpoint: str | None = None, available_now: bool = True,
                  timeout_s: int = 1800) -> DataFrame:
    """Run the feed to completion (``availableNow``) and return everything answered.

    ``questions_stream``: streaming (qid, question); ``question_vectors``: static
    (qid, embedding); ``collection``: static (doc_id, text, embedding, ...)."""
    out_path = out_path or shared_path(spark, "stream-answers")
    checkpoint = checkpoint or shared_path(spark, "stream-ckpt")
    store = sc.open_store(collection)

    def process(batch: DataFrame, batch_id: int) -> None:
        q = batch.select("qid", "question").join(question_vectors.select("qid", "embedding"), "qid", "left")
        res = hy.hybrid_search(collection, q, k=k, store=store)
        res.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = (questions_stream.writeStream.foreachBatch(process)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    query = w.start()
    finish(query, timeout_s)
    schema = "qid long, rk long, doc_id long, score double, bm25_norm double, sem_norm double, batch_id long"
    try:
        return spark.read.schema(schema).parquet(out_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)        # nothing arrived


def question_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming (qid, question) from question parquet files (benchmark layout)."""
    return (spark.readStream.schema("item_id long, text string")
                 .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
                 .select(F.col("item_id").alias("qid"), F.col("text").alias("question")))
