"""Cleaning queries over documents (+ labels) and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as cl
from quarry.sources.tables import load

# Bound parameters (chosen so every filter is exercised by the driver tables):
# pages carry 4-6 ``href=`` each, so the link-dump bound is 6; documents hold
# licence lines and e-mail-like text for the phrase filter; pages carry the
# ``&amp;`` / ``&quot;`` entities.
PAGE_LINK_PATTERN = "href="
PAGE_MAX_LINKS = 6
PAGE_ENTITIES = (("&amp;", "&"), ("&quot;", '"'))
BOUND_PHRASES = ("license", "@")
EXCLUDED_SOURCES = ("src0", "src1")


def raw_comments(spark, sf):
    """documents left-join labels: toxic = 1 plays a deleted author, 0 a live one,
    unlabelled rows have a null author."""
    d = load(spark, sf, "documents", "doc_id", "text", "source", "n_chars")
    lab = load(spark, sf, "labels", "doc_id", "toxic")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("match"),
        F.when(F.col("toxic") == 1, F.lit("[deleted]"))
         .when(F.col("toxic") == 0, F.lit("user")).alias("author"),
        F.col("text").alias("body"), F.col("n_chars").alias("score"))


def _docs(spark, sf):
    return load(spark, sf, "documents", "doc_id", "text", "source").select(
        "doc_id", F.col("source").alias("match"), F.col("text").alias("body"))


def q_min_length_filter(spark, sf):
    return cl.min_length_filter(_docs(spark, sf))


def q_dedup_keep_first(spark, sf):
    return cl.dedup_keep_first(_docs(spark, sf), "body", "doc_id")


def q_nullsafe_neq_filter(spark, sf):
    return cl.drop_deleted_authors(raw_comments(spark, sf)).select(
        F.col("ord").alias("doc_id"), "author")


def q_not_in_filter(spark, sf):
    return cl.drop_placeholders(_docs(spark, sf), "match", EXCLUDED_SOURCES).select("doc_id", "match")


def q_pattern_count_filter(spark, sf):
    p = load(spark, sf, "pages", "page_id", "html")
    return cl.pattern_count_filter(p, "html", PAGE_LINK_PATTERN, PAGE_MAX_LINKS).select(
        "page_id", F.regexp_count("html", F.lit(PAGE_LINK_PATTERN)).cast("bigint").alias("n_links"))


def q_literal_replace(spark, sf):
    p = load(spark, sf, "pages", "page_id", "html")
    return cl.replace_entities(p, "html", PAGE_ENTITIES)


def q_phrase_filter(spark, sf):
    return cl.phrase_filter(_docs(spark, sf), "body", BOUND_PHRASES).select("doc_id")


def q_cleaning_funnel(spark, sf):
    return cl.cleaning_funnel(raw_comments(spark, sf))


def q_clean_pipeline(spark, sf):
    out = cl.clean(cl.harvest_filter(raw_comments(spark, sf)))
    return out.select(F.col("ord").alias("doc_id"), "match", "body", "score")


QUERIES = {
    "min_length_filter": q_min_length_filter,
    "dedup_keep_first": q_dedup_keep_first,
    "nullsafe_neq_filter": q_nullsafe_neq_filter,
    "not_in_filter": q_not_in_filter,
    "pattern_count_filter": q_pattern_count_filter,
    "literal_replace": q_literal_replace,
    "phrase_filter": q_phrase_filter,
    "cleaning_funnel": q_cleaning_funnel,
    "clean_pipeline": q_clean_pipeline,
}

RAW_SQL = """(SELECT d.doc_id AS ord, d.source AS match,
        CASE WHEN l.toxic = 1 THEN '[deleted]' WHEN l.toxic = 0 THEN 'user' END AS author,
        d.text AS body, d.n_chars AS score
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _first(src, key="body", order="ord"):
    return (f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY {order}) AS rn FROM {src}) WHERE rn = 1)")


_AUTHOR_OK = "author IS DISTINCT FROM '[deleted]'"
_PLACE_OK = "NOT coalesce(body IN ('[deleted]', '[removed]'), false)"
_LINKS_OK = "len(regexp_extract_all(body, 'https?://')) < 3"

ORACLE = {
    "min_length_filter": "SELECT doc_id, source AS match, text AS body FROM documents WHERE length(text) > 15",
    "dedup_keep_first": "SELECT doc_id, match, body FROM " + _first(
        "(SELECT doc_id, source AS match, text AS body FROM documents)", "body", "doc_id"),
    "nullsafe_neq_filter": f"SELECT ord AS doc_id, author FROM {RAW_SQL} WHERE {_AUTHOR_OK}",
    "not_in_filter": ("SELECT doc_id, source AS match FROM documents "
                      "WHERE NOT coalesce(source IN ('src0', 'src1'), false)"),
    "pattern_count_filter": ("SELECT page_id, len(regexp_extract_all(html, 'href='))::BIGINT AS n_links "
                             "FROM pages WHERE len(regexp_extract_all(html, 'href=')) < 6"),
    "literal_replace": "SELECT page_id, replace(replace(html, '&amp;', '&'), '&quot;', '\"') AS html FROM pages",
    "phrase_filter": ("SELECT doc_id FROM documents WHERE NOT (coalesce(contains(lower(text), 'license'), false) "
                      "OR coalesce(contains(lower(text), '@'), false))"),
    "cleaning_funnel": f"""
WITH d AS {_first(RAW_SQL)}
SELECT (SELECT count(*) FROM {RAW_SQL}) AS n_input, count(*) AS n_dedup,
       sum(CASE WHEN {_AUTHOR_OK} THEN 1 ELSE 0 END)::BIGINT AS n_author,
       sum(CASE WHEN {_AUTHOR_OK} AND {_PLACE_OK} THEN 1 ELSE 0 END)::BIGINT AS n_placeholder,
       sum(CASE WHEN {_AUTHOR_OK} AND {_PLACE_OK} AND coalesce({_LINKS_OK}, false)
                THEN 1 ELSE 0 END)::BIGINT AS n_links
FROM d""",
    "clean_pipeline": f"""
WITH h AS {_first(f"(SELECT * FROM {RAW_SQL} WHERE length(body) > 15)")},
c AS {_first('h')}
SELECT ord AS doc_id, match, replace(replace(body, '&gt;', '>'), '&#x200B;', '') AS body, score
FROM c WHERE {_AUTHOR_OK} AND {_PLACE_OK} AND {_LINKS_OK}""",
}
