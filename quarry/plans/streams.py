"""Streaming queries (rows-only on the driver; equal to batch results in tests)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarry.functions.sizing import bounded_broadcast
from quarry.operators import hybrid as hy
from quarry.operators import prompts as pr
from quarry.plans import answering as an
from quarry.plans import bindings as bd
from quarry.plans.memory import MEMORY_SQL
from quarry.plans.retrieval import BOUND_ROUTES, HYBRID_CTES
from quarry.plans.sqlfrag import WS
from quarry.session import materialize, shared_path
from quarry.sources.tables import load, table_path
from quarry.streaming import feed as sf_feed
from quarry.streaming import memory as smem
from quarry.streaming import questions as sq
from quarry.streaming import turns as st


def _as_glob(path: str) -> str:
    """A file stream source needs a directory or a glob; turn one file into a glob."""
    d, f = os.path.split(path)
    return os.path.join(d, f"[{f[0]}]{f[1:]}")


def q_stream_questions(spark, sf):
    stream = sq.question_file_stream(spark, _as_glob(table_path(sf, "benchmark")))
    res = sq.answer_stream(spark, stream, bd.vectors(spark, sf).withColumnRenamed("vec_id", "qid"),
                           bd.comment_collection(spark, sf))
    return res.select("qid", "rk", "doc_id", "score", "bm25_norm", "sem_norm")


def q_stream_memory(spark, sf):
    return smem.run_memory_stream(spark, _as_glob(table_path(sf, "conversations")))


def q_stream_session_turns(spark, sf):
    """The turns each session has in memory, read from the state of the stream."""
    return st.session_memory(spark, _as_glob(table_path(sf, "conversations")))


#: Times that the feed's questions come in, each a batch of its own.
FEED_PASSES = 2


def question_feed(spark, sf) -> sf_feed.Feed:
    """The feed over the driver tables.  Question ``qid // FEED_PASSES`` is answered by the document of that
    id; a missing or toxic one plays a failed call."""
    comments, labels = bd.comment_collection(spark, sf), bd.label_collections(spark, sf)
    item = F.floor(F.col("qid") / FEED_PASSES).cast("long")
    vectors = bd.vectors(spark, sf).select(F.col("vec_id").alias("item"), "embedding")

    def retrieve(questions):
        asked = questions.withColumn("item", item).join(vectors, "item", "left").drop("item")
        rows = bounded_broadcast(materialize(hy.multi_collection(comments, labels, asked, routes=BOUND_ROUTES), "feed-rows"), 500_000)
        return rows.join(bd.comments(spark, sf).select("doc_id", "text", "match", "upvotes"), "doc_id")

    docs = load(spark, sf, "documents", "doc_id", "text")
    toxic = load(spark, sf, "labels", "doc_id", "toxic").where("toxic = 1").select("doc_id").distinct()

    def answer(prompts):
        known = docs.join(toxic, "doc_id", "left_anti").select(F.col("doc_id").alias("item"), F.col("text").alias("answer"))
        return prompts.withColumn("item", item).join(known, "item")

    return sf_feed.Feed(retrieve, answer, pr.section_table(spark, an.SECTIONS), shared_path(spark, "feed"))


def q_stream_feed(spark, sf):
    """Every benchmark question, asked twice (the second time with blanks around it) in batches of their own."""
    feed, arrived, checkpoint = question_feed(spark, sf), shared_path(spark, "feed-questions"), shared_path(spark, "feed-ckpt")
    questions = bd.questions(spark, sf)
    for i in range(FEED_PASSES):
        blank = F.lit("  " * i)
        (questions.select((F.col("qid") * FEED_PASSES + i).alias("qid"), F.col("qid").alias("session_id"),
                          F.concat(blank, "question", blank).alias("question"))
                  .write.parquet(f"{arrived}/pass={i}"))
        stream = spark.readStream.schema("qid long, session_id long, question string").parquet(f"{arrived}/pass=*")
        feed.run(stream, checkpoint)
    return feed.answers(spark).select("qid", "session_id", "status", "answer", "message")


QUERIES = {
    "stream_questions": q_stream_questions,
    "stream_memory": q_stream_memory,
    "stream_session_turns": q_stream_session_turns,
    "stream_feed": q_stream_feed,
}

# The feed must answer exactly what the batch query answers; the memory size
# after each turn has a closed form: within a segment between clears it is
# (system turn seen before the segment's clear ? 1 : 0) + the segment's
# non-clear turns so far; a clear itself leaves only the system turn.
_STRIP = f"regexp_replace(text, '^{WS}|{WS}$', '', 'g')"

_ITEM_STRIP = f"regexp_replace(b.text, '^{WS}|{WS}$', '', 'g')"

# A question is answered when it comes first with its key and its document is there; what comes
# later with that key is a hit; refused and failed ones are asked again.
FEED_SQL = f"""
it AS (SELECT b.item_id, {_ITEM_STRIP} AS question, lower({_ITEM_STRIP}) AS question_key,
              (fb.max_score < 0.1 AND fb.n_other = 0) AS fallback,
              {an._q(pr.USER_PREFIX)} || p.prompt || chr(10) || chr(10) || 'Question: ' || {_ITEM_STRIP} AS message,
              CASE WHEN b.item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN d.text END AS answer
       FROM benchmark b JOIN prompts p ON p.qid = b.item_id JOIN fb ON fb.qid = b.item_id
       LEFT JOIN documents d ON d.doc_id = b.item_id),
lead AS (SELECT question_key, min(item_id) AS first FROM it WHERE question <> '' GROUP BY question_key),
o AS (SELECT l.question_key, l.first, CASE WHEN fallback THEN 'refused' WHEN answer IS NOT NULL THEN 'answered' ELSE 'failed' END AS status,
             CASE WHEN fallback THEN {an._q(pr.REFUSAL)} ELSE answer END AS answer, CASE WHEN NOT fallback THEN message END AS message
      FROM lead l JOIN it ON it.item_id = l.first),
e AS (SELECT it.item_id * {FEED_PASSES} + i AS qid, it.item_id AS session_id, o.status, o.answer, o.message,
             o.status = 'answered' AND (i > 0 OR it.item_id <> o.first) AS hit
      FROM it JOIN o USING (question_key), range({FEED_PASSES}) AS r(i))
SELECT qid::BIGINT AS qid, session_id, CASE WHEN hit THEN 'cached' ELSE status END AS status, answer,
       CASE WHEN NOT hit THEN message END AS message FROM e"""

ORACLE = {
    "stream_session_turns": f"WITH {MEMORY_SQL} SELECT * FROM memo",
    "stream_feed": f"WITH {an.ROWS_CTES},{FEED_SQL}",
    "stream_questions": f"""WITH {HYBRID_CTES}
SELECT qid, rk::BIGINT AS rk, doc_id, score, bm25_norm, sem_norm FROM hr WHERE rk <= 15""",
    "stream_memory": f"""
WITH t AS (SELECT conv_id AS session_id, turn,
                  CASE WHEN role = 'user' AND lower({_STRIP}) = 'clear' THEN 1 ELSE 0 END AS clr,
                  CASE WHEN role = 'system' THEN 1 ELSE 0 END AS sys
           FROM conversations),
t2 AS (SELECT *, sum(clr) OVER w AS seg, max(sys) OVER w AS hs FROM t
       WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t3 AS (SELECT *, max(CASE WHEN clr = 1 THEN hs END) OVER (PARTITION BY session_id, seg) AS hs_at_clear,
              sum(1 - clr) OVER (PARTITION BY session_id, seg ORDER BY turn
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt
       FROM t2)
SELECT session_id, turn,
       (CASE WHEN clr = 1 THEN hs WHEN seg = 0 THEN cnt ELSE coalesce(hs_at_clear, 0) + cnt END)::BIGINT
         AS memory_size
FROM t3""",
}
