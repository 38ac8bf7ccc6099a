"""Thread snapshots: saved listing JSON files -> comment rows and game links.

A snapshot file holds a JSON array of two listings; element 1's
``data.children`` are the comments (``kind = 't1'``).  Files are read whole
(``wholetext``) and parsed with an explicit schema; a malformed file parses to
null and yields no rows (the reference's "bad status -> empty").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ordering import positions_within

LISTING_SCHEMA = ("ARRAY<STRUCT<data: STRUCT<children: ARRAY<STRUCT<kind: STRING, "
                  "data: STRUCT<author: STRING, body: STRING, score: BIGINT>>>>>>")

# The game-thread link pattern, how many leading comments are
# searched for it, and the comment kind that is kept.
GAME_LINK_PATTERN = r"comments/([a-z0-9]+)/"
LINK_SEARCH_DEPTH = 3
COMMENT_KIND = "t1"


def read_snapshots(spark: SparkSession, paths) -> DataFrame:
    """(thread_id, listing) per file; thread_id = file name without extension."""
    raw = spark.read.text(paths, wholetext=True).withColumn("__path", F.input_file_name())
    tid = F.regexp_extract("__path", r"([^/]+?)(\.json)?$", 1)
    return parse_snapshots(raw.select(tid.alias("thread_id"), "value"))


def parse_snapshots(raw: DataFrame) -> DataFrame:
    """(thread_id, listing) of (thread_id, value): snapshots as JSON text."""
    return raw.select("thread_id", F.from_json("value", LISTING_SCHEMA).alias("listing"))


def thread_children(snapshots: DataFrame) -> DataFrame:
    """(thread_id, pos, kind, author, body, score): element 1's children in order."""
    kids = F.get(F.col("listing"), 1)["data"]["children"]
    # explode_outer: no inferred pre-filter re-parsing the JSON below the generate
    return snapshots.select("thread_id", F.posexplode_outer(kids).alias("pos", "c")).filter(
        F.col("c").isNotNull()).select(
        "thread_id", F.col("pos").cast("bigint").alias("pos"), F.col("c.kind").alias("kind"),
        F.col("c.data.author").alias("author"), F.col("c.data.body").alias("body"),
        F.col("c.data.score").alias("score"))


def thread_comments(children: DataFrame) -> DataFrame:
    """Kind filter (``t1`` only) and projection."""
    return children.filter(F.col("kind") == COMMENT_KIND).select(
        "thread_id", "pos", "author", "body", "score")


def first_links(children: DataFrame, group_col: str = "thread_id", pos_col: str = "pos",
                body_col: str = "body", pattern: str = GAME_LINK_PATTERN,
                depth: int = LINK_SEARCH_DEPTH) -> DataFrame:
    """(group, link_pos, link): among the first ``depth`` children, the first one
    whose body has any match; its matches de-duplicated in first-seen order.
    Missing bodies count as empty.  ``min(struct(pos, links))`` is a partial
    aggregate, so a huge thread costs one row per task."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(body_col), F.lit("")),
                                                  F.lit(pattern), 1))
    c = (children.filter(F.col(pos_col) < depth)
                 .select(group_col, pos_col, links.alias("links"))
                 .filter(F.size("links") > 0))
    first = c.groupBy(group_col).agg(F.min(F.struct(pos_col, "links")).alias("f"))
    return first.select(group_col, F.posexplode("f.links").alias("link_pos", "link")).withColumn(
        "link_pos", F.col("link_pos").cast("bigint"))


def fan_out_labels(links: DataFrame, group_col: str, name_col: str) -> DataFrame:
    """Series label ``"{name} (Series)"`` (game_no 0) plus one ``"{name} - Game {i}"``
    per link, 1-based, in link order."""
    series = links.select(group_col, name_col).distinct().select(
        group_col, F.lit(0).cast("bigint").alias("game_no"),
        F.concat(F.col(name_col), F.lit(" (Series)")).alias("label"),
        F.lit(None).cast("string").alias("link"))
    games = links.select(group_col, (F.col("link_pos") + 1).alias("game_no"),
                         F.concat(F.col(name_col), F.lit(" - Game "),
                                  (F.col("link_pos") + 1).cast("string")).alias("label"), "link")
    return series.unionByName(games)


def harvest(spark: SparkSession, threads: DataFrame, snapshot_dir: str) -> DataFrame:
    """Comments of every listed thread and of the game threads it links to.

    ``threads``: (ord, label, thread_id).  Returns (ord, match, author, body,
    score) where ``ord`` orders rows as harvested: label order, then series
    before games in link order, then comment position."""
    return harvest_children(threads, thread_children(read_snapshots(spark, f"{snapshot_dir.rstrip('/')}/*.json")))


def harvest_children(threads: DataFrame, kids: DataFrame, pattern: str = GAME_LINK_PATTERN) -> DataFrame:
    """The harvest of parsed snapshots; ``kids`` are all threads' children."""
    comments = thread_comments(kids)
    series = threads.join(comments, "thread_id").select(
        F.col("ord").alias("label_ord"), F.lit(0).cast("bigint").alias("game_no"),
        F.concat(F.col("label"), F.lit(" (Series)")).alias("match"), "pos", "author", "body", "score")
    links = first_links(kids, pattern=pattern).join(threads, "thread_id")
    games = (links.select(F.col("ord").alias("label_ord"), (F.col("link_pos") + 1).alias("game_no"),
                          F.concat(F.col("label"), F.lit(" - Game "),
                                   (F.col("link_pos") + 1).cast("string")).alias("match"),
                          F.col("link").alias("thread_id"))
             .join(comments, "thread_id")
             .select("label_ord", "game_no", "match", "pos", "author", "body", "score"))
    rows = series.unionByName(games)
    return positions_within(rows.withColumn("__g", F.lit(0)), ["__g"],
                            [F.asc("label_ord"), F.asc("game_no"), F.asc("pos")], out="ord").select(
        "ord", "match", "author", "body", "score")


def host_of(url) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(c, r"://([^/:?#]+)", 1)
