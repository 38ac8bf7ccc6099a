"""Legacy flat report (context block) and the legacy single-collection prompt.

Report binding, every section bounded: a header from whole-table aggregates; one result line per order
priority (status F against status O; the side with more orders wins; orders of any other status
are counted as open) and one per region (nations whose suppliers' balance is 4,000 and more in sum advance); nations
as teams, their two richest suppliers as roster, the coach an object, a text or absent; the five most
returned and the five most open parts; one storyline per order status.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.sizing import one_row_join
from quarry.operators import hybrid as hy
from quarry.operators import report as rp
from quarry.plans import bindings as bd
from quarry.plans.documents import q_group_lines
from quarry.plans.retrieval import HYBRID_CTES
from quarry.plans.sqlfrag import COLLECTION, QVEC
from quarry.sources.tables import load

# The report's section heads.
TOURNAMENT, RESULTS, ROSTERS, STATS, STORYLINES = ("TOURNAMENT: ", "RESULTS:", "TEAM ROSTERS:", "NOTABLE CHAMPION STATS:",
                                                   "KEY STORYLINES:")
# Texts around the report: plain defaults.
LEGACY_HEAD = "Summary of the results, followed by what readers wrote.\n\n"
COMMENTS_HEAD = "\n\nFrom the readers, best match first:\n"


def report(spark, sf):
    o = load(spark, sf, "orders", "o_orderdate", "o_orderstatus", "o_orderpriority")
    head = o.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("mn"), F.max("o_orderdate").alias("mx"))
    head_line = F.concat(F.lit(TOURNAMENT), F.col("n").cast("string"), F.lit(" orders ("),
                         F.col("mn").cast("date").cast("string"), F.lit(" to "),
                         F.col("mx").cast("date").cast("string"), F.lit(")"))
    pr = o.groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("nf"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("no"),
        F.count(F.lit(1)).alias("n"))
    pr = pr.select("p", "nf", "no", (F.col("n") - F.col("nf") - F.col("no")).alias("nx"), F.lit("F").alias("team1"), F.lit("O").alias("team2"),
                   F.when(F.col("no") > F.col("nf"), F.lit("O")).otherwise(F.lit("F")).alias("winner"))
    # at most one row per priority value: a small aggregate, numbered in one task
    pr = pr.withColumn("l", F.row_number().over(Window.orderBy("p")))
    res_line = F.concat(F.lit("- "), F.col("p"), F.lit(": "), F.col("winner"), F.lit(" "),
                        F.col("nf").cast("string"), F.lit("-"), F.col("no").cast("string"),
                        F.lit(" (vs "), rp.opponent(), F.lit("), open "), F.col("nx").cast("string"))
    parts = [rp.lines(0, head, F.lit(0), head_line), rp.fixed_line(spark, 0, 1, ""),
             rp.fixed_line(spark, 1, 0, RESULTS), rp.lines(1, pr, "l", res_line)]
    groups = q_group_lines(spark, sf).withColumn("l", 100 + F.row_number().over(Window.orderBy("group_name")))   # a line per region
    parts += [rp.lines(1, groups, "l", "line"), rp.fixed_line(spark, 1, 999, "")]
    t = nation_teams(spark, sf)
    parts += [rp.fixed_line(spark, 2, -1, ROSTERS), rp.lines(2, t, "ord", rp.roster_line()), rp.fixed_line(spark, 2, 1 << 30, "")]
    parts += [rp.fixed_line(spark, 3, 0, STATS), rp.lines(3, top_parts(spark, sf, "l_returnflag", "R", "Most picked: "), F.lit(1), "line"),
              rp.lines(3, top_parts(spark, sf, "l_linestatus", "O", "Most banned: "), F.lit(2), "line"), rp.fixed_line(spark, 3, 9, "")]
    told = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").cast("string").alias("last"))
    told = told.select(F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("narrative"),
                       F.concat(F.col("n").cast("string"), F.lit(" orders, the last on "), F.col("last"), F.lit(".")).alias("description"))
    told = told.withColumn("l", F.row_number().over(Window.orderBy("narrative")))       # a line per status
    parts += [rp.fixed_line(spark, 4, 0, STORYLINES), rp.lines(4, told, "l", rp.storyline())]
    return rp.assemble(parts)


def top_parts(spark, sf, flag, value, head):
    """One line: the five parts with most line items of a flag."""
    li = load(spark, sf, "lineitem", "l_partkey", flag)
    part = load(spark, sf, "part", "p_partkey", "p_name")
    had = li.filter(F.col(flag) == value).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))
    top = (had.orderBy(F.desc("c"), F.asc("l_partkey")).limit(5)      # top-5 is the feature
              .join(part, had.l_partkey == part.p_partkey))
    return top.agg(F.concat(F.lit(head), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), F.col("l_partkey"),
                                             F.concat(F.col("p_name"), F.lit(" ("), F.col("c").cast("string"),
                                                      F.lit(")")).alias("t")))),
        lambda x: x["t"]), ", ")).alias("line"))


def nation_teams(spark, sf):
    """Nations as teams of their two richest suppliers; the coach comes as JSON."""
    n = load(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region", "r_regionkey", "r_name")
    s = load(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    best = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), F.asc("s_suppkey"))
    s = s.withColumn("rk", F.row_number().over(best)).where("rk <= 2")
    roster = s.groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "s_name"))), lambda x: F.struct(
        F.when(x["rk"] == 1, "first").otherwise("second").alias("role"), x["s_name"].alias("name"))).alias("roster"))
    kind = F.col("n_nationkey") % 3
    coach = (F.when(kind == 0, F.to_json(F.struct(F.col("n_name").alias("ign"), F.col("r_name").alias("real_name"))))
             .when(kind == 1, F.concat(F.lit('"'), F.col("r_name"), F.lit('"'))))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(roster, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return both.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("abbr"),
                       F.col("n_name").alias("full_name"), F.col("r_name").alias("region"), F.lit("Played").alias("result"),
                       F.coalesce("roster", F.array().cast("array<struct<role:string,name:string>>")).alias("roster"),
                       F.parse_json(coach).alias("coach"))


def q_report_text(spark, sf):
    return report(spark, sf)


def q_prompt_legacy(spark, sf):
    coll = bd.comment_collection(spark, sf)
    qs = bd.question_vectors(spark, sf)
    top = hy.hybrid_search(coll, qs, k=hy.LEGACY_TOP_K).join(
        bd.comments(spark, sf).select("doc_id", "match", "upvotes", "text"), "doc_id")
    block = F.concat(F.lit("[Comment from "), F.col("match"), F.lit(", "), F.col("upvotes").cast("string"),
                     F.lit(" upvotes]: "), F.col("text"), F.lit("\n\n"))
    ctx = top.groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rk", block.alias("b")))), lambda x: x["b"]), "").alias("ctx"))
    q = one_row_join(qs.select("qid", "question").join(ctx, "qid", "left"), report(spark, sf))
    prompt = F.concat(F.lit(LEGACY_HEAD), F.col("report"), F.lit(COMMENTS_HEAD),
                      F.coalesce(F.col("ctx"), F.lit("")), F.lit("\nQuestion: "), F.col("question"))
    return q.select("qid", prompt.alias("prompt"))


QUERIES = {
    "report_text": q_report_text,
    "prompt_legacy": q_prompt_legacy,
}


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _top(flag, value):
    return (f"(SELECT string_agg(p_name || ' (' || c::VARCHAR || ')', ', ' ORDER BY c DESC, l_partkey) FROM (SELECT l_partkey, count(*) AS c "
            f"FROM lineitem WHERE {flag} = '{value}' GROUP BY 1 ORDER BY c DESC, l_partkey LIMIT 5) JOIN part ON p_partkey = l_partkey)")


REPORT_CTES = f"""
oh AS (SELECT count(*) AS n, min(o_orderdate)::DATE::VARCHAR AS mn, max(o_orderdate)::DATE::VARCHAR AS mx FROM orders),
pr AS (SELECT o_orderpriority AS p, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS nf,
              sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS no, count(*) AS n FROM orders GROUP BY 1),
pr2 AS (SELECT p, nf, no, (n - nf - no)::BIGINT AS nx, 'F' AS team1, 'O' AS team2, CASE WHEN no > nf THEN 'O' ELSE 'F' END AS winner FROM pr),
gb AS (SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1),
gn AS (SELECT r_name, n_name, coalesce(balance, 0.0) >= 4000.0 AS won FROM nation JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN gb ON s_nationkey = n_nationkey),
gl AS (SELECT r_name, '- ' || r_name || ': ' || coalesce(string_agg(CASE WHEN won THEN n_name END, ' and ' ORDER BY n_name), '')
       || ' advanced. ' || coalesce(string_agg(CASE WHEN NOT won THEN n_name END, ' and ' ORDER BY n_name), '') || ' eliminated.' AS line
       FROM gn GROUP BY r_name),
sr AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM supplier),
ro AS (SELECT s_nationkey, string_agg(s_name || CASE rk WHEN 1 THEN ' (first)' ELSE ' (second)' END, ', ' ORDER BY rk) AS roster
       FROM sr WHERE rk <= 2 GROUP BY 1),
tm AS (SELECT n_nationkey, n_name || '/N' || n_nationkey::VARCHAR || ' (' || r_name || ', Played): ' || coalesce(roster, '') || '.'
              || CASE n_nationkey % 3 WHEN 0 THEN ' Coach: ' || n_name || ' (' || r_name || ')' WHEN 1 THEN ' Coach: ' || r_name ELSE '' END AS line
       FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN ro ON s_nationkey = n_nationkey),
so AS (SELECT o_orderstatus AS st, count(*) AS n, max(o_orderdate)::DATE::VARCHAR AS last FROM orders GROUP BY 1),
ln AS (SELECT 0 AS s, 0 AS l, '{TOURNAMENT}' || n::VARCHAR || ' orders (' || mn || ' to ' || mx || ')' AS line FROM oh
       UNION ALL SELECT 0, 1, ''
       UNION ALL SELECT 1, 0, '{RESULTS}'
       UNION ALL SELECT 1, row_number() OVER (ORDER BY p),
              '- ' || p || ': ' || winner || ' ' || nf::VARCHAR || '-' || no::VARCHAR || ' (vs '
              || CASE WHEN winner <> team1 THEN team1 ELSE team2 END || '), open ' || nx::VARCHAR FROM pr2
       UNION ALL SELECT 1, 100 + row_number() OVER (ORDER BY r_name), line FROM gl
       UNION ALL SELECT 1, 999, ''
       UNION ALL SELECT 2, -1, '{ROSTERS}'
       UNION ALL SELECT 2, n_nationkey, line FROM tm
       UNION ALL SELECT 2, 1073741824, ''
       UNION ALL SELECT 3, 0, '{STATS}'
       UNION ALL SELECT 3, 1, 'Most picked: ' || {_top('l_returnflag', 'R')}
       UNION ALL SELECT 3, 2, 'Most banned: ' || {_top('l_linestatus', 'O')}
       UNION ALL SELECT 3, 9, ''
       UNION ALL SELECT 4, 0, '{STORYLINES}'
       UNION ALL SELECT 4, row_number() OVER (ORDER BY st), '- Status ' || st || ': ' || n::VARCHAR || ' orders, the last on ' || last || '.' FROM so),
rep AS (SELECT string_agg(line, chr(10) ORDER BY s, l) AS report FROM ln)"""

ORACLE = {
    "report_text": f"WITH {REPORT_CTES} SELECT report FROM rep",
    "prompt_legacy": f"""WITH {HYBRID_CTES}, {REPORT_CTES},
blk AS (SELECT hr.qid, string_agg('[Comment from ' || c.match || ', ' || c.upvotes::VARCHAR || ' upvotes]: '
                                  || c.text || chr(10) || chr(10), '' ORDER BY hr.rk) AS ctx
        FROM hr JOIN {COLLECTION} c USING (doc_id) WHERE hr.rk <= 20 GROUP BY hr.qid)
SELECT q.qid, {_q(LEGACY_HEAD)} || rep.report || {_q(COMMENTS_HEAD)} || coalesce(blk.ctx, '')
       || chr(10) || 'Question: ' || q.question AS prompt
FROM {QVEC} q LEFT JOIN blk USING (qid) CROSS JOIN rep""",
}
