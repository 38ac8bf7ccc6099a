"""Statistics and chunk queries over the roster/statistics/match stand-ins.

Binding: ``part`` is the roster (key p_partkey, name p_name, title p_brand,
tags = words of p_type); ``lineitem`` grouped by part gives games (lines),
wins (return flag R), bans (line status O) and roles (distinct return flags);
the number of ``orders`` is the total-games denominator of presence; parts
smaller than 10 carry a context line.  ``orders`` are matches whose games are
their line items (game = line number, notable = return note).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.sizing import one_row_join
from quarry.functions.text import is_truthy_text, preview, py_strip
from quarry.operators import chunks as ch
from quarry.operators import stats as stt
from quarry.plans import bindings as bd
from quarry.plans.sqlfrag import WS
from quarry.sources.tables import load


def champions(spark, sf):
    part = load(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    li = load(spark, sf, "lineitem", "l_partkey", "l_returnflag", "l_linestatus")
    n_orders = load(spark, sf, "orders", "o_orderkey").agg(F.count(F.lit(1)).alias("n_orders"))
    st = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("wins"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).cast("bigint").alias("bans"),
        F.sort_array(F.collect_set("l_returnflag")).alias("roles"))  # bounded by the flag domain
    roster = part.select(F.col("p_partkey").alias("ord"), "p_partkey", F.col("p_name").alias("name"),
                         F.col("p_brand").alias("title"), F.split("p_type", " ").alias("tags"),
                         F.when(F.col("p_size") < 10, F.concat(F.lit("Compact "), F.col("p_type")))
                          .alias("tournament_context"))
    c = stt.left_join_defaults(roster, st, "p_partkey", {
        "games": 0, "wins": 0, "bans": 0,
        "roles": F.array(*[F.lit(r) for r in stt.DEFAULT_ROLES])})
    c = c.withColumn("title", F.coalesce("title", F.lit(stt.DEFAULT_TITLE)))
    c = one_row_join(c, n_orders)
    c = c.withColumn("primary_role", F.element_at("roles", 1))
    c = c.withColumn("__pb", F.col("bans") + F.col("games"))
    return (c.withColumn("presence_pct", stt.guarded_rate("__pb", "n_orders"))
             .withColumn("win_rate", stt.guarded_rate("wins", "games"))
             .withColumnRenamed("games", "games_played").drop("__pb", "n_orders"))


def q_left_join_defaults(spark, sf):
    return champions(spark, sf).select("p_partkey", "name", "title", F.col("games_played").alias("games"),
                                       "wins", "bans", "primary_role", "tournament_context")


def q_guarded_rate(spark, sf):
    return champions(spark, sf).select("p_partkey", F.col("games_played").alias("games"), "wins",
                                       "win_rate")


def q_stable_sort_desc(spark, sf):
    return stt.stable_sort_desc(champions(spark, sf).select("p_partkey", "presence_pct"),
                                "presence_pct", "p_partkey")


# Role order bound to the stand-in data: primary roles are return flags; parts
# without statistics have the default role and come last.
BOUND_ROLE_ORDER = ("R", "N", "A", stt.DEFAULT_ROLES[0])


def q_ordered_string_agg(spark, sf):
    c = champions(spark, sf).select("p_partkey", "name", "primary_role", "presence_pct")
    m = stt.ordered_members(c, "primary_role", "presence_pct", "p_partkey")
    return stt.in_role_order(m, "primary_role", BOUND_ROLE_ORDER).select(
        "role_ord", "primary_role", "pos", "name", "p_partkey")


def q_count_by_label(spark, sf):
    return stt.count_by_label(bd.comments(spark, sf), "match")


def players(spark, sf):
    p = load(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("ign"),
        F.col("p_brand").alias("real_name"), F.col("p_type").alias("role"),
        F.concat(F.lit("Team "), F.col("p_size").cast("string")).alias("team"),
        F.col("p_brand").alias("nationality"), F.split("p_type", " ").alias("signature_champions"),
        F.concat(F.lit("Priced at "), F.col("p_retailprice").cast("string"), F.lit(".")).alias("playstyle"),
        F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(".")).alias("tournament_performance"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("community_sentiment"))


def q_chunk_profile(spark, sf):
    return ch.player_chunks(players(spark, sf)).select("ord", "text", "name", "team", "role")


def q_chunk_stats(spark, sf):
    return ch.champion_chunks(champions(spark, sf)).select("ord", "text", "name", "role", "presence")


def matches(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
             "o_orderdate", "o_orderpriority")
    li = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    games = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("game"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("returned "), F.col("l_quantity").cast("string")))
         .when(F.col("l_returnflag") == "A", F.lit("")).alias("notable")))).alias("games"))  # <= 7 per order
    m = o.join(games, o.o_orderkey == games.l_orderkey, "left")
    team1 = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    team2 = F.concat(F.lit("S"), F.col("o_orderstatus"))
    return m.select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("stage"),
        team1.alias("team1"), team2.alias("team2"),
        F.when(F.col("o_totalprice") >= 150000, team1).otherwise(team2).alias("winner"),
        F.concat(F.coalesce(F.size("games"), F.lit(0)).cast("string"), F.lit("-0")).alias("score"),
        F.concat(F.lit("Placed "), F.col("o_orderdate").cast("date").cast("string"), F.lit("."))
         .alias("summary"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("match_label"), "games")


def q_chunk_nested(spark, sf):
    return ch.match_chunks(matches(spark, sf), "group").select("ord", "text", "match", "stage")


def q_chunk_semi(spark, sf):
    m = matches(spark, sf).withColumn("narratives", F.when(
        F.col("winner") == F.col("team1"), F.array(F.concat(F.lit("won by "), F.col("team1")), F.lit("cheered"))))
    return ch.match_chunks(m, "semi").select("ord", "text", "match", "stage")


def q_preview(spark, sf):
    c = bd.comments(spark, sf)
    return c.select("doc_id", preview("text", 80, flatten_newlines=True, ellipsis=True).alias("preview"))


def q_question_normalise(spark, sf):
    """Questions as they are asked: trimmed, blank ones skipped."""
    q = bd.questions(spark, sf).withColumn("question", py_strip("question"))
    return q.where(is_truthy_text("question")).select("qid", "question", F.lower("question").alias("question_key"))


def q_chunk_rows(spark, sf):
    c = bd.comments(spark, sf).select("doc_id", F.col("text").alias("body"), "match",
                                      F.col("upvotes").alias("score"))
    return ch.comment_chunks(c).drop("metadata")


def page_text(html):
    """The whole page without its tags."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def q_chunk_union(spark, sf):
    c = bd.comments(spark, sf).select(F.lit("comments").alias("collection"), "doc_id", "text")
    p = load(spark, sf, "pages", "page_id", "html").select(
        F.lit("pages").alias("collection"), F.col("page_id").alias("doc_id"),
        page_text("html").alias("text"),
        F.col("page_id").alias("page_id"))
    return ch.union_chunks(c, p)


def q_chunk_ids(spark, sf):
    c = bd.comments(spark, sf).select(F.lit("comments").alias("collection"),
                                      F.col("doc_id").alias("ord"))
    ids = ch.assign_chunk_ids(c)
    return ids.select(F.col("ord").alias("doc_id"), "chunk_id",
                      ch.parse_chunk_pos("chunk_id", "comments").alias("parsed_pos"))


QUERIES = {
    "left_join_defaults": q_left_join_defaults,
    "guarded_rate": q_guarded_rate,
    "stable_sort_desc": q_stable_sort_desc,
    "ordered_string_agg": q_ordered_string_agg,
    "count_by_label": q_count_by_label,
    "chunk_profile": q_chunk_profile,
    "chunk_stats": q_chunk_stats,
    "chunk_nested": q_chunk_nested,
    "chunk_semi": q_chunk_semi,
    "preview": q_preview,
    "question_normalise": q_question_normalise,
    "chunk_rows": q_chunk_rows,
    "chunk_union": q_chunk_union,
    "chunk_ids": q_chunk_ids,
}


def _rate(num, den):
    return (f"CASE WHEN {den} > 0 THEN (({num} * 1000) // {den} + CASE WHEN "
            f"2 * (({num} * 1000) % {den}) > {den} OR (2 * (({num} * 1000) % {den}) = {den} "
            f"AND (({num} * 1000) // {den}) % 2 = 1) THEN 1 ELSE 0 END) / 10.0 END")


CHAMPS_SQL = f"""
st AS (SELECT l_partkey AS p_partkey, count(*) AS games,
              sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS wins,
              sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS bans,
              list_sort(list_distinct(list(l_returnflag))) AS roles
       FROM lineitem GROUP BY l_partkey),
c0 AS (SELECT p.p_partkey AS ord, p.p_partkey, p.p_name AS name, coalesce(p.p_brand, 'Unknown') AS title,
              string_split(p.p_type, ' ') AS tags,
              CASE WHEN p.p_size < 10 THEN 'Compact ' || p.p_type END AS tournament_context,
              coalesce(st.games, 0)::BIGINT AS games, coalesce(st.wins, 0)::BIGINT AS wins,
              coalesce(st.bans, 0)::BIGINT AS bans, coalesce(st.roles, ['Unknown']) AS roles,
              (SELECT count(*) FROM orders) AS n_orders
       FROM part p LEFT JOIN st ON st.p_partkey = p.p_partkey),
champs AS (SELECT *, roles[1] AS primary_role, {_rate('(bans + games)', 'n_orders')} AS presence_pct,
                  {_rate('wins', 'games')} AS win_rate FROM c0)"""


def _fmt(x):
    """DuckDB rendering of a double the way Spark/Python print it (70.0, 6.2)."""
    return f"CASE WHEN {x} = floor({x}) THEN printf('%.1f', {x}) ELSE {x}::VARCHAR END"


ORACLE = {
    "left_join_defaults": f"WITH {CHAMPS_SQL} SELECT p_partkey, name, title, games, wins, bans, "
                          "primary_role, tournament_context FROM champs",
    "guarded_rate": f"WITH {CHAMPS_SQL} SELECT p_partkey, games, wins, win_rate FROM champs",
    "stable_sort_desc": f"""WITH {CHAMPS_SQL}
SELECT p_partkey, presence_pct, (row_number() OVER (ORDER BY presence_pct DESC, p_partkey) - 1)::BIGINT AS pos
FROM champs""",
    "ordered_string_agg": f"""WITH {CHAMPS_SQL},
ro(role_ord, primary_role) AS (VALUES (0, 'R'), (1, 'N'), (2, 'A'), (3, 'Unknown'))
SELECT ro.role_ord::INTEGER AS role_ord, c.primary_role,
       (row_number() OVER (PARTITION BY c.primary_role ORDER BY c.presence_pct DESC, c.p_partkey) - 1)::BIGINT AS pos,
       c.name, c.p_partkey
FROM champs c JOIN ro USING (primary_role)""",
    "count_by_label": """
SELECT regexp_replace(source, '( \\(Series\\)| - Game \\d+)$', '') AS match, count(*) AS n_comments,
       (SELECT count(*) FROM documents) AS total
FROM documents GROUP BY 1""",
    "chunk_profile": """
SELECT p_partkey AS ord,
       p_name || ' (' || p_brand || ') is a ' || p_type || ' player for Team ' || p_size::VARCHAR
       || '. Nationality: ' || p_brand || '. Signature champions: ' || array_to_string(string_split(p_type, ' '), ', ')
       || '. Playstyle: Priced at ' || """ + _fmt("p_retailprice") + """ || '. Tournament performance: Size '
       || p_size::VARCHAR || '. Community sentiment: ' || coalesce(CASE WHEN p_size > 25 THEN p_brand END, 'N/A')
       AS text,
       p_name AS name, 'Team ' || p_size::VARCHAR AS team, p_type AS role
FROM part""",
    "chunk_stats": f"""WITH {CHAMPS_SQL}
SELECT ord,
       name || ' (' || title || '): ' || array_to_string(tags, ', ') || '. Played: ' || array_to_string(roles, '/')
       || '. Pick/Ban presence: ' || {_fmt('presence_pct')} || '%. Games played: ' || games::VARCHAR
       || ', Wins: ' || wins::VARCHAR || ', Win rate: '
       || CASE WHEN win_rate IS NULL THEN 'N/A' ELSE {_fmt('win_rate')} || '%' END
       || '. Banned ' || bans::VARCHAR || ' times. '
       || CASE WHEN coalesce(tournament_context, '') <> '' THEN 'Tournament context: ' || tournament_context ELSE '' END
       AS text,
       name, primary_role AS role, presence_pct AS presence
FROM champs""",
    "chunk_nested": """
WITH g AS (SELECT l_orderkey,
                  list_sort(list({'game': l_linenumber,
                                  'notable': CASE WHEN l_returnflag = 'R' THEN 'returned ' || """ + _fmt("l_quantity") + """
                                                  WHEN l_returnflag = 'A' THEN '' END})) AS games
           FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o.o_orderkey AS ord, o.o_orderpriority AS stage, 'C' || o.o_custkey::VARCHAR AS team1,
             'S' || o.o_orderstatus AS team2, o.o_totalprice, coalesce(len(g.games), 0) AS ng,
             o.o_orderdate, g.games
      FROM orders o LEFT JOIN g ON g.l_orderkey = o.o_orderkey)
SELECT ord,
       stage || ': ' || team1 || ' vs ' || team2 || '. Winner: '
       || CASE WHEN o_totalprice >= 150000 THEN team1 ELSE team2 END || ' (' || ng::VARCHAR || '-0). Placed '
       || o_orderdate::DATE::VARCHAR || '.'
       || coalesce(array_to_string(list_transform(list_filter(games, lambda x: coalesce(x.notable, '') <> ''),
                                                  lambda x: ' Game ' || x.game::VARCHAR || ': ' || x.notable || '.'), ''), '')
       AS text,
       'order_' || ord::VARCHAR AS match, stage
FROM m""",
    "chunk_rows": """
SELECT doc_id, text, 'comment' AS type, 'reddit' AS source, source AS match, n_chars AS upvotes FROM documents""",
    "chunk_union": """
SELECT 'comments' AS collection, doc_id, text, NULL::BIGINT AS page_id FROM documents
UNION ALL
SELECT 'pages' AS collection, page_id AS doc_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, page_id
FROM pages""",
    "chunk_ids": """
SELECT doc_id, 'comments_' || (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS chunk_id,
       (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS parsed_pos
FROM documents""",
}

ORACLE["chunk_semi"] = f"""
SELECT n.ord, n.text || CASE WHEN o.o_totalprice >= 150000
                             THEN ' won by C' || o.o_custkey::VARCHAR || '. cheered.' ELSE '' END AS text,
       n.match, n.stage
FROM ({ORACLE['chunk_nested']}) n JOIN orders o ON o.o_orderkey = n.ord"""
ORACLE["preview"] = """
SELECT doc_id, replace(substring(text, 1, 80), chr(10), ' ') || '...' AS preview FROM documents"""
ORACLE["question_normalise"] = f"""
SELECT qid, question, lower(question) AS question_key
FROM (SELECT item_id AS qid, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS question FROM benchmark)
WHERE question <> ''"""
