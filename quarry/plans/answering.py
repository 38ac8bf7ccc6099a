"""Prompt assembly and evaluation queries on top of multi-collection retrieval.

Binding: each label collection's chunk text is the document with the same id
(``vec_id = doc_id``); sections: c0/c1/c2 take the reference's three
knowledge headers, c3..c9 a generic one, comments last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.sizing import bounded_broadcast
from quarry.operators import hybrid as hy
from quarry.operators import prompts as pr
from quarry.operators.stats import guarded_rate
from quarry.plans import bindings as bd
from quarry.plans.retrieval import BOUND_ROUTES, MULTI_CTES
from quarry.session import materialize
from quarry.sources.tables import load

COLLECTIONS = ["comments"] + [f"c{i}" for i in range(10)]
SECTIONS = ([("c0", pr.SECTION_HEADERS[0][1]), ("c1", pr.SECTION_HEADERS[1][1]),
             ("c2", pr.SECTION_HEADERS[2][1])]
            + [(f"c{i}", f"Collection c{i} info:") for i in range(3, 10)]
            + [("comments", pr.SECTION_HEADERS[3][1])])


def retrieved_rows(spark, sf):
    rows = hy.multi_collection(bd.comment_collection(spark, sf), bd.label_collections(spark, sf),
                               bd.question_vectors(spark, sf), routes=BOUND_ROUTES)
    # fetch texts after the limits: the few ids go to the documents, not the texts to the ids
    ids = bounded_broadcast(materialize(rows, "retrieved"), 500_000)
    return ids.join(bd.comments(spark, sf).select("doc_id", "text", "match", "upvotes"), "doc_id")


def names(spark, sf):
    """Who the rows of two collections are about: c1 (players) with the team, c2 (champions) with the role;
    the part of the same number gives name, brand and type."""
    parts = load(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), "p_brand", "p_type")
    return (parts.select(F.lit("c1").alias("collection"), "doc_id", "name", F.col("p_brand").alias("detail"))
            .unionByName(parts.select(F.lit("c2").alias("collection"), "doc_id", "name", F.col("p_type").alias("detail"))))


def q_prompt_sections(spark, sf):
    return pr.prompt_sections(retrieved_rows(spark, sf), pr.section_table(spark, SECTIONS))


def q_prompt_build(spark, sf):
    secs = pr.prompt_sections(retrieved_rows(spark, sf), pr.section_table(spark, SECTIONS))
    return pr.prompt_build(secs, bd.questions(spark, sf))


def q_retrieval_counts(spark, sf):
    return pr.retrieval_counts(retrieved_rows(spark, sf), COLLECTIONS)


def q_fallback_flag(spark, sf):
    return pr.fallback_flag(retrieved_rows(spark, sf), bd.questions(spark, sf))


def q_retrieval_debug(spark, sf):
    return pr.debug_lines(retrieved_rows(spark, sf), named=names(spark, sf))


def q_eval_prompts(spark, sf):
    """Every benchmark question through retrieval -> fallback -> prompt (no cache,
    no memory): the message that would be sent, or the canned refusal."""
    rows = materialize(retrieved_rows(spark, sf), "eval-rows")  # read by two branches
    qs = bd.questions(spark, sf)
    prompts = pr.prompt_build(pr.prompt_sections(rows, pr.section_table(spark, SECTIONS)), qs)
    fb = pr.fallback_flag(rows, qs)
    return prompts.join(fb, "qid").select(
        "qid", "fallback",
        F.when(F.col("fallback"), F.lit(pr.REFUSAL)).otherwise(F.col("user_message")).alias("message"))


# ------------------------------------------------------------- evaluation

def grades(spark, sf):
    """Evaluation binding: question_id = benchmark item, expected = the first reply in the conversation with
    that id, answer = the document with that id, raw grade from labels (toxic = 1 -> failed call)."""
    b = load(spark, sf, "benchmark", "item_id", "text")
    d = load(spark, sf, "documents", "doc_id", "text")
    lab = load(spark, sf, "labels", "doc_id", "quality", "toxic")
    replies = load(spark, sf, "conversations", "conv_id", "turn", "role", "text").where("role = 'assistant'")
    first = replies.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    expected = replies.join(first, ["conv_id", "turn"]).select(F.col("conv_id").alias("question_id"), F.col("text").alias("expected"))
    return (b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
             .join(d.select(F.col("doc_id").alias("question_id"), F.col("text").alias("answer")),
                   "question_id", "left")
             .join(lab.withColumnRenamed("doc_id", "question_id"), "question_id", "left")
             .join(expected, "question_id", "left")
             .withColumn("raw_grade", F.when(F.col("toxic") == 1, F.lit(None).cast("string"))
                         .when(F.col("quality") == 1, F.lit(" pass."))
                         .when(F.col("quality") == 0, F.lit("Fail"))))


def parse_grade(raw="raw_grade"):
    """PASS if the upper-cased trimmed text contains PASS, FAIL otherwise, ERROR when
    the grading call produced nothing."""
    return (F.when(F.col(raw).isNull(), F.lit("ERROR"))
             .when(F.contains(F.upper(F.trim(F.col(raw))), F.lit("PASS")), F.lit("PASS"))
             .otherwise(F.lit("FAIL")))


def q_grade_parse(spark, sf):
    return grades(spark, sf).select("question_id", "raw_grade", parse_grade().alias("grade"))


def q_pass_rate(spark, sf):
    g = grades(spark, sf).withColumn("grade", parse_grade())
    agg = g.agg(F.sum(F.when(F.col("grade") == "PASS", 1).otherwise(0)).cast("bigint").alias("passed"),
                F.count(F.lit(1)).alias("total"))
    return agg.select("passed", "total", guarded_rate("passed", "total").alias("pass_rate"))


def q_eval_failures(spark, sf):
    g = grades(spark, sf).withColumn("grade", parse_grade())
    return g.filter(F.col("grade") != "PASS").select(
        "question_id", "question", "expected", "grade",
        F.substring(F.coalesce(F.col("answer"), F.lit("")), 1, 100).alias("answer_preview"))


QUERIES = {
    "prompt_sections": q_prompt_sections,
    "prompt_build": q_prompt_build,
    "retrieval_counts": q_retrieval_counts,
    "fallback_flag": q_fallback_flag,
    "retrieval_debug": q_retrieval_debug,
    "eval_prompts": q_eval_prompts,
    "grade_parse": q_grade_parse,
    "pass_rate": q_pass_rate,
    "eval_failures": q_eval_failures,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SEC_VALUES = ", ".join(f"({_q(c)}, {i}, {_q(h)})" for i, (c, h) in enumerate(SECTIONS))

ROWS_CTES = MULTI_CTES + f""",
rows AS (SELECT mc.*, d.text, d.source AS match, d.n_chars AS upvotes
         FROM mc JOIN documents d ON d.doc_id = mc.doc_id),
sec(collection, section_ord, header) AS (VALUES {_SEC_VALUES}),
lines AS (SELECT r.qid, r.collection, s.section_ord, s.header, r.rk,
                 CASE WHEN r.collection = 'comments'
                      THEN '[' || r.match || ', ' || r.upvotes::VARCHAR || ' upvotes]: ' || r.text
                      ELSE '- ' || r.text END AS line
          FROM rows r JOIN sec s USING (collection)
          WHERE r.collection <> 'comments' OR r.rk <= 15),
sections AS (SELECT qid, collection, section_ord::INTEGER AS section_ord,
                    header || chr(10) || string_agg(line, chr(10) ORDER BY rk) AS section
             FROM lines GROUP BY qid, collection, section_ord, header),
ctx AS (SELECT qid, string_agg(section, chr(10) || chr(10) ORDER BY section_ord) AS context
        FROM sections GROUP BY qid),
prompts AS (SELECT b.item_id AS qid, b.text AS question,
                   {_q(pr.PROMPT_HEAD)} || coalesce(ctx.context, '') || {_q(pr.PROMPT_TAIL)} AS prompt
            FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id),
fb AS (SELECT b.item_id AS qid,
              coalesce(max(CASE WHEN r.collection = 'comments' THEN r.score END), 0.0) AS max_score,
              coalesce(sum(CASE WHEN r.collection <> 'comments' THEN 1 ELSE 0 END), 0) AS n_other
       FROM benchmark b LEFT JOIN rows r ON r.qid = b.item_id GROUP BY b.item_id)"""

GRADES_SQL = """
ex AS (SELECT conv_id, arg_min(text, turn) AS expected FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
g AS (SELECT b.item_id AS question_id, b.text AS question, d.text AS answer, ex.expected,
             CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 1 THEN ' pass.' WHEN l.quality = 0 THEN 'Fail' END
               AS raw_grade
      FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id
      LEFT JOIN labels l ON l.doc_id = b.item_id LEFT JOIN ex ON ex.conv_id = b.item_id),
gp AS (SELECT *, CASE WHEN raw_grade IS NULL THEN 'ERROR'
                      WHEN contains(upper(trim(raw_grade)), 'PASS') THEN 'PASS' ELSE 'FAIL' END AS grade FROM g)"""

_COUNTS = ", ".join(f"count(*) FILTER (WHERE collection = '{c}')::BIGINT AS n_{c}" for c in COLLECTIONS)

ORACLE = {
    "prompt_sections": f"WITH {ROWS_CTES} SELECT qid, collection, section_ord, section FROM sections",
    "prompt_build": f"""WITH {ROWS_CTES}
SELECT qid, prompt, {_q(pr.USER_PREFIX)} || prompt || chr(10) || chr(10) || 'Question: ' || question AS user_message
FROM prompts""",
    "retrieval_counts": f"WITH {ROWS_CTES} SELECT qid, {_COUNTS} FROM rows GROUP BY qid",
    "fallback_flag": f"WITH {ROWS_CTES} SELECT qid, max_score, (max_score < 0.1 AND n_other = 0) AS fallback FROM fb",
    "retrieval_debug": f"""WITH {ROWS_CTES}
SELECT qid, collection, rk,
       CASE WHEN collection = 'comments'
            THEN '[' || printf('%.3f', score) || '] [' || match || '] ' || substring(text, 1, 80) || '...'
            WHEN collection IN ('c1', 'c2')
            THEN '[' || printf('%.3f', score) || '] ' || coalesce(p_name, '?') || ' ('
                 || coalesce(CASE WHEN collection = 'c1' THEN p_brand ELSE p_type END, '?') || ')'
            ELSE '[' || printf('%.3f', score) || '] ' || substring(text, 1, 100) || '...' END AS line
FROM rows LEFT JOIN part ON p_partkey = doc_id WHERE collection <> 'comments' OR rk <= 5""",
    "eval_prompts": f"""WITH {ROWS_CTES}
SELECT p.qid, (fb.max_score < 0.1 AND fb.n_other = 0) AS fallback,
       CASE WHEN fb.max_score < 0.1 AND fb.n_other = 0 THEN {_q(pr.REFUSAL)}
            ELSE {_q(pr.USER_PREFIX)} || p.prompt || chr(10) || chr(10) || 'Question: ' || p.question END AS message
FROM prompts p JOIN fb USING (qid)""",
    "grade_parse": f"WITH {GRADES_SQL} SELECT question_id, raw_grade, grade FROM gp",
    "pass_rate": f"""WITH {GRADES_SQL},
a AS (SELECT sum(CASE WHEN grade = 'PASS' THEN 1 ELSE 0 END)::BIGINT AS passed, count(*) AS total FROM gp)
SELECT passed, total,
       CASE WHEN total > 0 THEN ((passed * 1000) // total + CASE WHEN 2 * ((passed * 1000) % total) > total
            OR (2 * ((passed * 1000) % total) = total AND ((passed * 1000) // total) % 2 = 1) THEN 1 ELSE 0 END)
            / 10.0 END AS pass_rate
FROM a""",
    "eval_failures": f"""WITH {GRADES_SQL}
SELECT question_id, question, expected, grade, substring(coalesce(answer, ''), 1, 100) AS answer_preview
FROM gp WHERE grade <> 'PASS'""",
}
