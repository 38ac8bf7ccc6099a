"""Cache and conversation-memory queries over ``conversations``.

Binding: session_id = conv_id, content = text; the conversation log in
(session, turn) order is the stream of cache writes (version =
session_id * 100000 + turn); new answers arrive as a table (benchmark question
``i`` answered by document ``i``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import py_strip
from quarry.operators import memory as mem
from quarry.plans.sqlfrag import WS
from quarry.sources.tables import load

NEW_VERSION_BASE = 10 ** 12


def turns(spark, sf):
    return load(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def cache_table(spark, sf):
    ex = mem.exchanges(turns(spark, sf)).withColumn(
        "version", F.col("session_id") * 100000 + F.col("turn"))
    return mem.cache_from_exchanges(ex)


def user_questions(spark, sf):
    return turns(spark, sf).filter(F.col("role") == "user").select(
        "session_id", "turn", py_strip("content").alias("question"))


def q_command_parse(spark, sf):
    return mem.command_parse(turns(spark, sf).filter(F.col("role") == "user"))


def q_memory_since_reset(spark, sf):
    return mem.memory_since_reset(turns(spark, sf))


def q_messages_build(spark, sf):
    return mem.messages_long(mem.memory_since_reset(turns(spark, sf)))


def q_messages_at(spark, sf):
    """The message list of every question as it stood when it was asked."""
    return mem.messages_at(turns(spark, sf))


def q_cache_hits(spark, sf):
    hits, _ = mem.cache_split(user_questions(spark, sf), cache_table(spark, sf), ["session_id", "turn"])
    return hits.select("session_id", "turn", "question_key", "answer")


def q_cache_misses(spark, sf):
    _, misses = mem.cache_split(user_questions(spark, sf), cache_table(spark, sf), ["session_id", "turn"])
    return misses.select("session_id", "turn", "question_key")


def new_answers(spark, sf):
    b = load(spark, sf, "benchmark", "item_id", "text")
    d = load(spark, sf, "documents", "doc_id", "text")
    return b.join(d.withColumnRenamed("doc_id", "item_id").withColumnRenamed("text", "answer"), "item_id").select(
        "item_id", F.col("text").alias("question"), "answer")


def q_cache_upsert(spark, sf):
    new = new_answers(spark, sf).select(mem.cache_key("question").alias("question_key"), "answer",
                                        (F.lit(NEW_VERSION_BASE) + F.col("item_id")).alias("version"))
    return mem.cache_upsert(cache_table(spark, sf), new)


def q_memory_append(spark, sf):
    ex = new_answers(spark, sf).select(F.col("item_id").alias("session_id"), "question", "answer",
                                       F.lit(0).alias("ex_ord"))
    memory = turns(spark, sf)
    ex = ex.join(memory.select("session_id").distinct(), "session_id")  # sessions that exist
    return mem.memory_append(memory, ex)


QUERIES = {
    "command_parse": q_command_parse,
    "memory_since_reset": q_memory_since_reset,
    "messages_build": q_messages_build,
    "messages_at": q_messages_at,
    "cache_hits": q_cache_hits,
    "cache_misses": q_cache_misses,
    "cache_upsert": q_cache_upsert,
    "memory_append": q_memory_append,
}


def _strip(x):
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


TURNS = "(SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)"
MEMORY_SQL = f"""
t AS (SELECT *, CASE WHEN role = 'user' AND lower({_strip('content')}) = 'clear' THEN 1 ELSE 0 END AS clr
      FROM {TURNS}),
t2 AS (SELECT *, sum(clr) OVER (PARTITION BY session_id ORDER BY turn
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM t),
t3 AS (SELECT *, max(seg) OVER (PARTITION BY session_id) AS last FROM t2),
memo AS (SELECT session_id, turn, role, content FROM t3
         WHERE role = 'system' OR (seg = last AND clr = 0))"""

CACHE_SQL = f"""
ex AS (SELECT u.session_id, u.turn, {_strip('u.content')} AS question, a.content AS answer,
              u.session_id * 100000 + u.turn AS version
       FROM {TURNS} u JOIN {TURNS} a ON a.session_id = u.session_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant'),
cache AS (SELECT question_key, arg_max(answer, version) AS answer, max(version) AS version
          FROM (SELECT lower(question) AS question_key, answer, version FROM ex) GROUP BY question_key),
uq AS (SELECT session_id, turn, lower({_strip('content')}) AS question_key FROM {TURNS} WHERE role = 'user')"""

NEW_SQL = """
na AS (SELECT b.item_id, b.text AS question, d.text AS answer
       FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"""

ORACLE = {
    "command_parse": f"""
WITH u AS (SELECT session_id, turn, {_strip('content')} AS q, lower({_strip('content')}) AS l
           FROM {TURNS} WHERE role = 'user'),
t AS (SELECT *, CASE WHEN l <> 'quit' AND l <> 'clear' AND starts_with(l, 'debug') THEN 1 ELSE 0 END AS tog
      FROM u),
t2 AS (SELECT *, sum(tog) OVER (PARTITION BY session_id ORDER BY turn
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ntog,
              sum(CASE WHEN l = 'quit' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS quits_before,
              CASE WHEN tog = 1 THEN {_strip('substring(q, 6)')} ELSE q END AS qq FROM t),
t3 AS (SELECT *, CASE WHEN coalesce(quits_before, 0) > 0 THEN 'ended'
                      WHEN l = 'quit' THEN 'quit' WHEN l = 'clear' THEN 'clear' WHEN l = 'debug' THEN 'debug'
                      WHEN qq = '' THEN 'skip' ELSE 'ask' END AS command FROM t2)
SELECT session_id, turn, command, (ntog % 2 = 1) AS debug_on,
       CASE WHEN command = 'ask' THEN qq END AS query FROM t3""",
    "memory_since_reset": f"WITH {MEMORY_SQL} SELECT * FROM memo",
    "messages_build": f"""WITH {MEMORY_SQL}
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1)::BIGINT AS msg_pos,
       role, content FROM memo""",
    "messages_at": f"""WITH {MEMORY_SQL},
q AS (SELECT session_id, turn, seg, content FROM t2 WHERE role = 'user' AND clr = 0),
m AS (SELECT q.session_id, q.turn, s.turn AS told, s.role, s.content
      FROM q JOIN t2 s ON s.session_id = q.session_id AND s.turn < q.turn
      WHERE s.role = 'system' OR (s.seg = q.seg AND s.clr = 0)
      UNION ALL SELECT session_id, turn, turn, 'user', content FROM q)
SELECT session_id, turn, (row_number() OVER (PARTITION BY session_id, turn ORDER BY told) - 1)::BIGINT AS msg_pos,
       role, content FROM m""",
    "cache_hits": f"""WITH {CACHE_SQL}
SELECT uq.session_id, uq.turn, uq.question_key, cache.answer FROM uq JOIN cache USING (question_key)""",
    "cache_misses": f"""WITH {CACHE_SQL}
SELECT uq.session_id, uq.turn, uq.question_key FROM uq
WHERE uq.question_key NOT IN (SELECT question_key FROM cache)""",
    "cache_upsert": f"""WITH {CACHE_SQL}, {NEW_SQL},
w AS (SELECT question_key, answer, version FROM cache
      UNION ALL
      SELECT lower({_strip('question')}) AS question_key, answer, {NEW_VERSION_BASE} + item_id AS version FROM na)
SELECT question_key, arg_max(answer, version) AS answer, max(version) AS version FROM w GROUP BY question_key""",
    "memory_append": f"""WITH {NEW_SQL},
last AS (SELECT session_id, max(turn) AS lt FROM {TURNS} GROUP BY session_id),
e AS (SELECT last.session_id, last.lt + 1 AS base, na.question, na.answer
      FROM na JOIN last ON last.session_id = na.item_id)
SELECT session_id, base AS turn, 'user' AS role, question AS content FROM e
UNION ALL
SELECT session_id, base + 1 AS turn, 'assistant' AS role, answer AS content FROM e""",
}
