"""Source/sink queries: link extraction and fan-out over pages, CSV round trip,
JSON document sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.ordering import positions_within
from quarry.plans import bindings as bd
from quarry.plans.knowledge import CHAMPS_SQL, champions
from quarry.session import shared_path
from quarry.sources import files as fl
from quarry.sources import snapshots as sn
from quarry.sources.tables import load

# Binding: a thread is a site (url host); its children are the site's pages in
# page_id order; links are href targets.
PAGE_LINK_PATTERN = r'href="([^"]+)"'


def page_children(spark, sf):
    p = load(spark, sf, "pages", "page_id", "url", "html").select(
        sn.host_of("url").alias("thread_id"), "page_id", F.col("html").alias("body"))
    return positions_within(p, ["thread_id"], [F.asc("page_id")], out="pos")


def q_link_extract_first(spark, sf):
    return sn.first_links(page_children(spark, sf), pattern=PAGE_LINK_PATTERN).select(
        "thread_id", "link_pos", "link")


def q_thread_fanout(spark, sf):
    links = sn.first_links(page_children(spark, sf), pattern=PAGE_LINK_PATTERN)
    return sn.fan_out_labels(links.withColumn("name", F.col("thread_id")), "thread_id", "name")


def q_csv_roundtrip(spark, sf):
    docs = load(spark, sf, "documents", "doc_id", "text", "source", "n_chars")
    path = shared_path(spark, "csv-roundtrip")
    fl.write_csv(docs, path)
    return fl.read_csv(spark, path, "doc_id BIGINT, text STRING, source STRING, n_chars BIGINT")


def q_json_document(spark, sf):
    """One JSON object per champion (the scalable form of the champions file)."""
    c = champions(spark, sf)
    doc = F.to_json(F.struct(
        "name", "title", "tags",
        F.struct("roles", "primary_role", "presence_pct", "bans", "games_played", "wins",
                 "win_rate").alias("tournament"),
        "tournament_context"), {"ignoreNullFields": "false"})
    return c.select("p_partkey", doc.alias("json"))


QUERIES = {
    "link_extract_first": q_link_extract_first,
    "thread_fanout": q_thread_fanout,
    "csv_roundtrip": q_csv_roundtrip,
    "json_document": q_json_document,
}

_LINKS = r"""
p AS (SELECT regexp_extract(url, '://([^/:?#]+)', 1) AS thread_id, page_id, html,
             row_number() OVER (PARTITION BY regexp_extract(url, '://([^/:?#]+)', 1) ORDER BY page_id) - 1 AS pos
      FROM pages),
l AS (SELECT thread_id, pos, regexp_extract_all(coalesce(html, ''), 'href="([^"]+)"', 1) AS raw FROM p WHERE pos < 3),
l2 AS (SELECT thread_id, pos, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS links
       FROM l WHERE len(raw) > 0),
f AS (SELECT thread_id, arg_min(links, pos) AS links FROM l2 GROUP BY thread_id),
fl AS (SELECT thread_id, (generate_subscripts(links, 1) - 1)::BIGINT AS link_pos, unnest(links) AS link FROM f)"""

ORACLE = {
    "link_extract_first": f"WITH {_LINKS} SELECT thread_id, link_pos, link FROM fl",
    "thread_fanout": f"""WITH {_LINKS}
SELECT DISTINCT thread_id, 0::BIGINT AS game_no, thread_id || ' (Series)' AS label, NULL::VARCHAR AS link FROM fl
UNION ALL
SELECT thread_id, link_pos + 1 AS game_no, thread_id || ' - Game ' || (link_pos + 1)::VARCHAR AS label, link FROM fl""",
    "csv_roundtrip": "SELECT doc_id, text, source, n_chars FROM documents",
    "json_document": f"""WITH {CHAMPS_SQL}
SELECT p_partkey, to_json({{'name': name, 'title': title, 'tags': tags,
                           'tournament': {{'roles': roles, 'primary_role': primary_role,
                                           'presence_pct': presence_pct, 'bans': bans,
                                           'games_played': games, 'wins': wins, 'win_rate': win_rate}},
                           'tournament_context': tournament_context}})::VARCHAR AS json
FROM champs""",
}
