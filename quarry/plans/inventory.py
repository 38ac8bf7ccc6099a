"""Sources, sinks and chunk kinds that have no other query, over the driver tables.

Binding: a document is a thread snapshot whose comments are its lines (a line that ends in a comma plays a child of
another kind); a number of up to three digits in a line links to the document of that id.  Suppliers are
coaches and teams, orders are finals, regions are narratives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import label_or_row, require_columns
from quarry.operators import chunks as ch
from quarry.operators import collections as co
from quarry.operators import memory as mem
from quarry.plans import bindings as bd
from quarry.plans.knowledge import matches
from quarry.plans.memory import CACHE_SQL, NEW_SQL, NEW_VERSION_BASE, _strip, cache_table, new_answers
from quarry.session import shared_path
from quarry.sources import files as fl
from quarry.sources import snapshots as sn
from quarry.sources.tables import load

LINK = r"(?:^|[^0-9])([0-9]{1,3})(?:[^0-9]|$)"


def thread_snapshots(spark, sf):
    """Saved listings as JSON text, one for each document."""
    d = load(spark, sf, "documents", "doc_id", "text", "lang")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kids = F.transform(lines, lambda x: F.struct(
        F.when(x.endswith(","), "more").otherwise("t1").alias("kind"),
        F.struct(F.col("lang").alias("author"), x.alias("body"), F.length(x).cast("long").alias("score")).alias("data")))
    none = F.transform(F.filter(kids, lambda x: F.lit(False)), lambda x: x)
    listing = F.array(F.struct(F.struct(none.alias("children")).alias("data")), F.struct(F.struct(kids.alias("children")).alias("data")))
    return d.select(F.col("doc_id").cast("string").alias("thread_id"), F.to_json(listing).alias("value"))


def children(spark, sf):
    return sn.thread_children(sn.parse_snapshots(thread_snapshots(spark, sf)))


def q_thread_comments(spark, sf):
    return sn.thread_comments(children(spark, sf))


def q_harvest_order(spark, sf):
    threads = load(spark, sf, "documents", "doc_id", "source").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("label"), F.col("doc_id").cast("string").alias("thread_id"))
    return sn.harvest_children(threads, children(spark, sf), LINK).select("ord", "match", "author", "score")


def q_json_maps(spark, sf):
    """Orders as JSON documents that map line numbers to items, written, read with a MAP schema and unfolded."""
    li = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    item = F.struct(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("key"),
                    F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity")).alias("value"))
    entries = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", item.alias("e"))))    # 7 lines an order at most
    docs = li.groupBy(F.col("l_orderkey").alias("order")).agg(entries.alias("s"))
    # a key that comes twice keeps its last value, as in a Python dict
    later = F.filter("s", lambda x, i: ~F.exists(F.slice(F.col("s"), i + 2, F.lit(100)), lambda y: y["l_linenumber"] == x["l_linenumber"]))
    docs = docs.select("order", F.map_from_entries(F.transform(later, lambda x: x["e"])).alias("items"))
    path = shared_path(spark, "json-maps")
    fl.write_json_lines(docs, path)
    back = spark.read.schema("order long, items map<string, struct<part: long, quantity: double>>").json(path)
    unfolded = back.select("order", F.posexplode(F.map_entries("items")).alias("ord", "e"))
    return unfolded.select("order", F.col("ord").cast("long").alias("ord"), F.col("e.key").alias("key"), "e.value.part", "e.value.quantity")


def q_row_labels(spark, sf):
    """The match of each row, or its number where there is none."""
    c = require_columns(bd.comments(spark, sf), "doc_id", "match").withColumn("match", F.when(F.col("upvotes") % 3 > 0, F.col("match")))
    return c.select("doc_id", label_or_row(c, "match", "doc_id").alias("label"))


def q_cache_saved(spark, sf):
    """The cache as it is read from its log after two saves."""
    path = shared_path(spark, "cache-log")
    mem.save_cache_writes(cache_table(spark, sf), path)
    new = new_answers(spark, sf).select(mem.cache_key("question").alias("question_key"), "answer",
                                        (F.lit(NEW_VERSION_BASE) + F.col("item_id")).alias("version"))
    mem.save_cache_writes(new, path)
    return mem.load_cache(spark, path)


def q_collections_persisted(spark, sf):
    """Collections written by name, one of them rebuilt, and opened again."""
    path = shared_path(spark, "collections")
    rows = bd.label_collections(spark, sf).select("collection", "doc_id", F.size("embedding").cast("long").alias("n_dims"))
    co.write_collections(rows, path)
    co.write_collections(rows.where("collection = 'c3'").withColumn("n_dims", -F.col("n_dims")), path)
    return spark.read.schema("doc_id long, n_dims long, collection string").parquet(path).select("collection", "doc_id", "n_dims")


def coaches(spark, sf):
    s = load(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = load(spark, sf, "nation", "n_nationkey", "n_name")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("team"), F.col("s_name").alias("ign"),
        F.lit(None).cast("string").alias("real_name"), F.col("n_name").alias("nationality"),
        F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("background"),
        F.when(F.col("s_acctbal") > 0, F.lit("creditor")).alias("tournament_role"))


def q_chunk_coach(spark, sf):
    return ch.coach_chunks(coaches(spark, sf)).select("ord", "text", "name", "team", "role", F.col("metadata")["type"].alias("kind"))


def q_chunk_final(spark, sf):
    m = matches(spark, sf).withColumns({
        "narratives": F.when(F.col("winner") == F.col("team2"), F.array(F.concat(F.col("team2"), F.lit(" held on")))), "mvp": F.col("team1")})
    return ch.match_chunks(m, "final").select("ord", "text", "match", "stage")


def q_chunk_overview(spark, sf):
    """A region's orders as a tournament."""
    r = load(spark, sf, "region", "r_regionkey", "r_name")
    n = load(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    c = load(spark, sf, "customer", "c_custkey", "c_nationkey")
    o = load(spark, sf, "orders", "o_custkey", "o_orderdate")
    days = (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_regionkey").agg(F.min("o_orderdate").cast("date").cast("string").alias("start"),
                                        F.max("o_orderdate").cast("date").cast("string").alias("end")))
    names = n.groupBy(F.col("n_regionkey").alias("k")).agg(F.min("n_name").alias("champion"), F.max("n_name").alias("runner_up"))
    t = r.join(days, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(names, F.col("r_regionkey") == F.col("k"), "left")
    t = t.select(F.col("r_name").alias("name"), F.lit("everywhere").alias("location"), F.struct("start", "end").alias("dates"),
                 F.lit("open").alias("format"), "champion", "runner_up")
    return ch.overview_chunk(t).select("text", F.col("metadata")["subtopic"].alias("subtopic"))


def q_chunk_narrative(spark, sf):
    c = bd.comments(spark, sf).select(F.col("doc_id").alias("ord"), F.col("match").alias("narrative"), F.substring("text", 1, 60).alias("description"))
    return ch.narrative_chunks(c).select("ord", "text", F.col("metadata")["subtopic"].alias("subtopic"))


def q_chunk_team(spark, sf):
    s = coaches(spark, sf)
    player = F.struct(F.col("ign").alias("name"))
    t = s.select("ord", F.col("team").alias("abbr"), F.col("ign").alias("full_name"), F.coalesce("nationality", F.lit("-")).alias("region"),
                 F.col("ord").cast("string").alias("seed"), F.lit("Played").alias("result"),
                 F.create_map(F.lit("top"), player, F.lit("mid"), player).alias("roster"),
                 F.when(F.col("ord") % 3 == 0, F.to_json(F.struct("ign"))).when(F.col("ord") % 3 == 1, F.col("background")).alias("coach"))
    return ch.team_chunks(t).select("ord", "text", F.col("metadata")["team"].alias("team"))


QUERIES = {
    "thread_comments": q_thread_comments,
    "harvest_order": q_harvest_order,
    "json_maps": q_json_maps,
    "row_labels": q_row_labels,
    "cache_saved": q_cache_saved,
    "collections_persisted": q_collections_persisted,
    "chunk_coach": q_chunk_coach,
    "chunk_final": q_chunk_final,
    "chunk_overview": q_chunk_overview,
    "chunk_narrative": q_chunk_narrative,
    "chunk_team": q_chunk_team,
}

_KIDS = """
k AS (SELECT doc_id, lang AS author, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS body
      FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""
_GAMES = """
g AS (SELECT l_orderkey, list({'game': l_linenumber, 'notable': CASE WHEN l_returnflag = 'R' THEN 'returned '
             || CASE WHEN l_quantity = floor(l_quantity) THEN printf('%.1f', l_quantity) ELSE l_quantity::VARCHAR END
             WHEN l_returnflag = 'A' THEN '' END} ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned '
             || CASE WHEN l_quantity = floor(l_quantity) THEN printf('%.1f', l_quantity) ELSE l_quantity::VARCHAR END
             WHEN l_returnflag = 'A' THEN '' END NULLS FIRST) AS games FROM lineitem GROUP BY 1)"""

ORACLE = {
    "thread_comments": f"""WITH {_KIDS}
SELECT doc_id::VARCHAR AS thread_id, pos::BIGINT AS pos, author, body, length(body)::BIGINT AS score FROM k WHERE NOT ends_with(body, ',')""",
    "harvest_order": rf"""WITH {_KIDS},
l AS (SELECT doc_id, pos, regexp_extract_all(body, '(?:^|[^0-9])([0-9]{{1,3}})(?:[^0-9]|$)', 1) AS raw FROM k WHERE pos < 3),
f AS (SELECT doc_id, arg_min(list_filter(raw, lambda x, i: list_position(raw, x) = i), pos) AS links FROM l WHERE len(raw) > 0 GROUP BY 1),
fl AS (SELECT doc_id, generate_subscripts(links, 1) AS game_no, unnest(links) AS link FROM f),
a AS (SELECT d.doc_id AS lo, 0 AS game_no, d.source || ' (Series)' AS match, k.* FROM documents d JOIN k USING (doc_id)
      UNION ALL
      SELECT d.doc_id, fl.game_no, d.source || ' - Game ' || fl.game_no::VARCHAR, k.* FROM fl JOIN documents d USING (doc_id)
      JOIN k ON k.doc_id::VARCHAR = fl.link)
SELECT (row_number() OVER (ORDER BY lo, game_no, pos) - 1)::BIGINT AS ord, match, author, length(body)::BIGINT AS score
FROM a WHERE NOT ends_with(body, ',')""",
    "json_maps": """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_quantity DESC) AS last FROM lineitem)
SELECT l_orderkey AS "order", (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::BIGINT AS ord,
       'line ' || l_linenumber::VARCHAR AS key, l_partkey AS part, l_quantity AS quantity FROM s WHERE last = 1""",
    "row_labels": """SELECT doc_id, coalesce(CASE WHEN n_chars % 3 > 0 THEN source END, 'Row ' || doc_id::VARCHAR) AS label FROM documents""",
    "cache_saved": f"""WITH {CACHE_SQL}, {NEW_SQL},
w AS (SELECT question_key, answer, version FROM cache
      UNION ALL SELECT lower({_strip('question')}), answer, {NEW_VERSION_BASE} + item_id FROM na)
SELECT question_key, arg_max(answer, version) AS answer, max(version) AS version FROM w GROUP BY question_key""",
    "collections_persisted": """
SELECT 'c' || label::VARCHAR AS collection, vec_id AS doc_id, (CASE WHEN label = 3 THEN -1 ELSE 1 END * len(embedding))::BIGINT AS n_dims
FROM embeddings""",
    "chunk_coach": """
SELECT s_suppkey AS ord, 'Coach ' || s_name || ' (None) coaches T' || s_suppkey::VARCHAR || '. Nationality: ' || coalesce(n_name, 'None')
       || '. Background: supplier ' || s_suppkey::VARCHAR || ' Tournament role: ' || CASE WHEN s_acctbal > 0 THEN 'creditor' ELSE 'N/A' END AS text,
       s_name AS name, 'T' || s_suppkey::VARCHAR AS team, NULL::VARCHAR AS role, 'coach' AS kind
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "chunk_final": f"""WITH {_GAMES},
m AS (SELECT o_orderkey AS ord, 'C' || o_custkey::VARCHAR AS team1, 'S' || o_orderstatus AS team2, o_totalprice >= 150000 AS first,
             coalesce(len(games), 0)::VARCHAR || '-0' AS score, 'Placed ' || o_orderdate::DATE::VARCHAR || '.' AS summary,
             list_filter(coalesce(games, []), lambda x: coalesce(x.notable, '') <> '') AS noted
      FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT ord, 'Grand Finals: ' || team1 || ' vs ' || team2 || '. Winner: ' || CASE WHEN first THEN team1 ELSE team2 END || ' (' || score
       || '). MVP: ' || team1 || '. ' || summary
       || array_to_string(list_transform(noted, lambda x: ' Game ' || x.game::VARCHAR || ': ' || x.notable || '.'), '')
       || CASE WHEN NOT first OR team1 = team2 THEN ' ' || team2 || ' held on.' ELSE '' END AS text,
       'order_' || ord::VARCHAR AS match, 'Grand Finals' AS stage FROM m""",
    "chunk_overview": """
WITH d AS (SELECT n_regionkey, min(o_orderdate)::DATE::VARCHAR AS s, max(o_orderdate)::DATE::VARCHAR AS e
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
n AS (SELECT n_regionkey, min(n_name) AS a, max(n_name) AS b FROM nation GROUP BY 1)
SELECT 'Tournament: ' || r_name || ', held at everywhere from ' || coalesce(s, 'None') || ' to ' || coalesce(e, 'None')
       || '. Format: open. Champion: ' || coalesce(a, 'None') || '. Runner-up: ' || coalesce(b, 'None') || '.' AS text, 'overview' AS subtopic
FROM region LEFT JOIN d ON d.n_regionkey = r_regionkey LEFT JOIN n ON n.n_regionkey = r_regionkey""",
    "chunk_narrative": """
SELECT doc_id AS ord, 'Tournament narrative — ' || coalesce(source, 'None') || ': ' || coalesce(substring(text, 1, 60), 'None') AS text,
       'narrative' AS subtopic FROM documents""",
    "chunk_team": """
SELECT s_suppkey AS ord, 'Team ' || s_name || ' (T' || s_suppkey::VARCHAR || '), ' || coalesce(n_name, '-') || ' ' || s_suppkey::VARCHAR
       || '. Result: Played. Roster: ' || s_name || ' (top), ' || s_name || ' (mid).'
       || CASE WHEN s_suppkey % 3 = 0 THEN ' Coach: ' || s_name ELSE '' END AS text, 'T' || s_suppkey::VARCHAR AS team
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
}
