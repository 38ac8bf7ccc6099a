"""The champions document, the report's rosters, pooled tokens and a refreshed index over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.sizing import bounded_broadcast, join_by_term, one_row_join
from quarry.operators import dense as dn
from quarry.operators import lexical as lx
from quarry.operators import report as rp
from quarry.operators import sparse as sp
from quarry.operators import stats as stt
from quarry.operators.maintained import MaintainedIndex
from quarry.plans import bindings as bd
from quarry.plans.knowledge import CHAMPS_SQL, champions
from quarry.plans.sqlfrag import QUESTIONS, bm25_ctes, tok
from quarry.session import shared_path
from quarry.sources import files as fl
from quarry.sources.tables import load

# The base data holds parts of this size and more; the others are entered by hand.
LEAST_BASE_SIZE = 5
DATA_VERSION, IMAGES = "26.5", "https://images.example/cdn"
META = {"tournament": "Parts", "patch": DATA_VERSION}
ENTRY = ("name string, data_dragon_key string, title string, tags array<string>, blurb string, image string, "
         "tournament struct<roles: array<string>, primary_role: string, presence_pct: double, bans: bigint, "
         "games_played: bigint, wins: bigint, win_rate: double>, tournament_context string")


def entries(spark, sf):
    """Every champion with its base data (or the defaults) and its statistics."""
    part = load(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").where(F.col("p_size") >= LEAST_BASE_SIZE)
    key = F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("data_dragon_key")
    base = part.select(key, F.col("p_name").alias("name"), F.col("p_brand").alias("title"), F.split("p_type", " ").alias("tags"),
                       F.concat(F.col("p_type"), F.lit(" of size "), F.col("p_size").cast("string")).alias("blurb"))
    roster = champions(spark, sf).drop("name", "title", "tags").select("*", key)
    roster = roster.withColumn("display_name", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")))
    return stt.base_entry(roster, base, DATA_VERSION, IMAGES)


def q_champions_document(spark, sf):
    """The champions in presence order, written as one document with their number in front and read back."""
    path = shared_path(spark, "champions-document")
    value = F.to_json(F.struct(
        "name", "data_dragon_key", "title", "tags", "blurb", "image",
        F.struct("roles", "primary_role", "presence_pct", "bans", "games_played", "wins", "win_rate").alias("tournament"),
        "tournament_context"), {"ignoreNullFields": "false"})
    fl.write_ordered_document(entries(spark, sf), path, "display_name", value, [F.desc("presence_pct"), F.asc("p_partkey")], META,
                              "total_champions_picked_or_banned", "champions")
    found, meta = fl.read_ordered_document(spark, path, ENTRY, "tournament string, patch string, "
                                           "total_champions_picked_or_banned bigint", "champions")
    meta = meta.select("tournament", "patch", F.col("total_champions_picked_or_banned").alias("total"))
    both = one_row_join(found.withColumnRenamed("tournament", "t"), meta)
    return both.select("pos", "key", "name", "data_dragon_key", "title", F.array_join("tags", ",").alias("tags"), "blurb", "image",
                       F.array_join("t.roles", ",").alias("roles"), "t.primary_role", "t.presence_pct", "t.bans", "t.games_played",
                       "t.wins", "t.win_rate", "tournament_context", "tournament", "patch", "total")


def teams(spark, sf):
    """Suppliers as teams: roster = the supplier, its nation and its region; the coach comes as JSON that is an
    object, a text or absent."""
    nation = load(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = load(spark, sf, "region", "r_regionkey", "r_name")
    s = load(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    s = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("s_suppkey") % 4
    coach = (F.when(kind == 0, F.to_json(F.struct(F.col("s_name").alias("ign"), F.col("n_name").alias("real_name"))))
             .when(kind == 1, F.to_json(F.array("n_name")).substr(F.lit(2), F.length("n_name") + 2)).when(kind == 2, F.lit("null")))
    return s.select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("abbr"),
        F.col("s_name").alias("full_name"), F.col("r_name").alias("region"),
        F.when(F.col("s_acctbal") < 0, "Eliminated").otherwise("Advanced").alias("result"),
        F.array(F.struct(F.lit("top").alias("role"), F.col("s_name").alias("name")),
                F.struct(F.lit("mid").alias("role"), F.col("n_name").alias("name"))).alias("roster"),
        F.parse_json(coach).alias("coach"))


def q_team_rosters(spark, sf):
    return teams(spark, sf).select("ord", rp.roster_line().alias("line"))


def q_group_lines(spark, sf):
    """Who advanced and who was eliminated, by region: nations whose suppliers' balance is positive in sum."""
    nation = load(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = load(spark, sf, "region", "r_regionkey", "r_name")
    balance = load(spark, sf, "supplier", "s_nationkey", "s_acctbal").groupBy("s_nationkey").agg(
        F.round(F.sum("s_acctbal"), 2).alias("balance"))
    n = nation.join(balance, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    won = F.coalesce(F.col("balance"), F.lit(0.0)) >= 4000.0

    def names(which):
        return F.sort_array(F.collect_list(F.when(which, F.col("n_name"))))      # the nations of a region: few

    groups = n.groupBy(F.col("r_name").alias("group_name")).agg(names(won).alias("advanced"), names(~won).alias("eliminated"))
    return groups.select("group_name", rp.group_line().alias("line"))


# ------------------------------------------------------------------ pooled tokens

def tokens_with_mask(spark, sf):
    """Token occurrences of all documents; those that end in a full stop or comma count nothing, like padding."""
    t = lx.tokenize(bd.comments(spark, sf))
    return t.withColumn("mask", F.when(F.col("token").rlike("[.,]$"), 0).otherwise(1))


def q_token_pool(spark, sf):
    """Mean of the token vectors of each document, masked: a token's vector is the one whose id is its length."""
    t = tokens_with_mask(spark, sf).groupBy("doc_id", F.length("token").cast("long").alias("vec_id")).agg(F.sum("mask").alias("n"))
    vectors = bounded_broadcast(bd.vectors(spark, sf).join(t.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "embedding"))
    pooled = dn.mean_pool(t.where("n > 0").join(vectors, "vec_id"), "doc_id", mask_col="n")
    return pooled.where("dim < 4").select("doc_id", "dim", F.round("value", 6).alias("value"))


def q_sparse_token_weights(spark, sf):
    """Largest weight of each term over its unmasked occurrences; the logit falls with the place in a sentence of four."""
    idx = lx.stored_bm25_index(bd.comments(spark, sf))
    place = (1 + F.pmod("pos", F.lit(4))).alias("place")
    t = tokens_with_mask(spark, sf).withColumnRenamed("token", "term").select("doc_id", "term", "mask", place)
    t = join_by_term(t, idx.idf.select("term", "df", "idf"))
    logits = t.select("doc_id", "term", "mask", ((F.col("idf") - 1) / F.col("place")).alias("logit"))
    return sp.sparse_weights(logits, mask_col="mask").select("doc_id", "term", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------ refreshed index

def q_refresh_idf(spark, sf):
    """Term statistics of the comments after an edit: the index of the collections is built, one document in a hundred
    is changed, and a refresh brings the stored index up to date."""
    docs = bd.comments(spark, sf).select("doc_id", "text")
    vecs = bd.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"))
    source = docs.withColumn("collection", F.lit("comments")).unionByName(docs.join(vecs, "doc_id"))
    edited = source.withColumn("text", F.when(F.pmod("doc_id", F.lit(100)) == 7, F.concat(
        F.coalesce("text", F.lit("")), F.lit(" edited since"))).otherwise(F.col("text")))
    index = MaintainedIndex(spark, shared_path(spark, "maintained"), parts=16)
    index.refresh(source)
    index.refresh(edited)
    return index.bm25("comments").idf.select("term", "df", F.round("idf", 6).alias("idf"))


QUERIES = {
    "champions_document": q_champions_document,
    "team_rosters": q_team_rosters,
    "group_lines": q_group_lines,
    "token_pool": q_token_pool,
    "sparse_token_weights": q_sparse_token_weights,
    "refresh_idf": q_refresh_idf,
}

_TOKENS = f"""
tk AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
       FROM (SELECT doc_id, {tok('text')} AS toks FROM documents)),
tm AS (SELECT *, CASE WHEN regexp_matches(token, '[.,]$') THEN 0 ELSE 1 END AS mask FROM tk)"""
_EDITED = ("(SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN coalesce(text, '') || ' edited since' ELSE text END AS text "
           "FROM documents)")
_TEAMS = """
s AS (SELECT s_suppkey, s_name, s_acctbal, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)"""

ORACLE = {
    "champions_document": f"""WITH {CHAMPS_SQL},
e AS (SELECT c.*, p.p_size, p.p_type, p.p_size >= {LEAST_BASE_SIZE} AS found FROM champs c JOIN part p USING (p_partkey))
SELECT (row_number() OVER (ORDER BY presence_pct DESC, p_partkey) - 1)::BIGINT AS pos, 'Part ' || p_partkey::VARCHAR AS key,
       CASE WHEN found THEN name ELSE 'Part ' || p_partkey::VARCHAR END AS name, 'K' || p_partkey::VARCHAR AS data_dragon_key,
       CASE WHEN found THEN title ELSE 'Unknown' END AS title,
       CASE WHEN found THEN array_to_string(tags, ',') ELSE '' END AS tags,
       CASE WHEN found THEN p_type || ' of size ' || p_size::VARCHAR ELSE '' END AS blurb,
       CASE WHEN found THEN '{IMAGES}/{DATA_VERSION}/img/champion/K' || p_partkey::VARCHAR || '.png' END AS image,
       array_to_string(roles, ',') AS roles, primary_role, presence_pct, bans, games AS games_played, wins, win_rate,
       tournament_context, '{META["tournament"]}' AS tournament, '{META["patch"]}' AS patch, count(*) OVER () AS total
FROM e""",
    "team_rosters": f"""WITH {_TEAMS}
SELECT s_suppkey AS ord, s_name || '/S' || s_suppkey::VARCHAR || ' (' || r_name || ', '
       || CASE WHEN s_acctbal < 0 THEN 'Eliminated' ELSE 'Advanced' END || '): ' || s_name || ' (top), ' || n_name || ' (mid).'
       || CASE s_suppkey % 4 WHEN 0 THEN ' Coach: ' || s_name || ' (' || n_name || ')' WHEN 1 THEN ' Coach: ' || n_name ELSE '' END AS line
FROM s""",
    "group_lines": """
WITH b AS (SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1),
n AS (SELECT r_name, n_name, coalesce(balance, 0.0) >= 4000.0 AS won FROM nation JOIN region ON n_regionkey = r_regionkey
      LEFT JOIN b ON s_nationkey = n_nationkey)
SELECT r_name AS group_name, '- ' || r_name || ': ' || coalesce(string_agg(CASE WHEN won THEN n_name END, ' and ' ORDER BY n_name), '')
       || ' advanced. ' || coalesce(string_agg(CASE WHEN NOT won THEN n_name END, ' and ' ORDER BY n_name), '') || ' eliminated.' AS line
FROM n GROUP BY r_name""",
    "token_pool": f"""WITH {_TOKENS},
g AS (SELECT doc_id, len(token) AS vec_id, sum(mask) AS n FROM tm GROUP BY 1, 2 HAVING sum(mask) > 0),
v AS (SELECT doc_id, n, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM g JOIN embeddings USING (vec_id))
SELECT doc_id, dim::BIGINT AS dim, round(sum(x::DOUBLE * n) / greatest(sum(n), 1e-9), 6) AS value FROM v WHERE dim < 4 GROUP BY doc_id, dim""",
    "sparse_token_weights": f"""WITH {bm25_ctes("documents", QUESTIONS)},{_TOKENS},
sw AS (SELECT doc_id, token AS term, max(ln(1 + greatest((idf - 1) / (1 + pos % 4), 0.0)) * mask) AS weight
       FROM tm JOIN idf ON term = token GROUP BY 1, 2)
SELECT doc_id, term, round(weight, 6) AS weight FROM sw WHERE weight > 0""",
    "refresh_idf": f"""WITH {bm25_ctes(_EDITED, QUESTIONS)}
SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf""",
}
