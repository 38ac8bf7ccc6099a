"""Comment cleaning stages, in the reference's fixed order.

Order contract: length filter and keep-first dedup at harvest; then (again)
dedup, deleted-author filter, placeholder filter, link-dump filter, literal
entity replacement, author column dropped.  Dedup runs *before* the author
filter, so a body whose first copy is by a deleted author is lost entirely;
entity replacement runs last, with no second dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import literal_replace_chain, null_safe_ne, null_safe_not_in

# Fixed values used by the reference's cleaning script.
MIN_LENGTH = 15                                   # keep len(body) > 15
DELETED_AUTHOR = "[deleted]"
PLACEHOLDER_BODIES = ("[deleted]", "[removed]")
LINK_PATTERN = "https?://"
MAX_LINKS = 3                                     # keep count < 3
ENTITY_REPLACEMENTS = (("&gt;", ">"), ("&#x200B;", ""))
BOT_PHRASES = ("i am a bot", "i'm a bot", "performed automatically", "contact the moderators")


def min_length_filter(df: DataFrame, col: str = "body", min_len: int = MIN_LENGTH) -> DataFrame:
    """Strict ``length > min_len``; null bodies are dropped."""
    return df.filter(F.length(col) > min_len)


def dedup_keep_first(df: DataFrame, key: str = "body", order_col: str = "ord") -> DataFrame:
    """Keep the first row (lowest ``order_col``) per ``key``; null keys form one group.

    The first order per key is a hash aggregate over numbers (a 128-bit hash of the key, the
    order): the partial aggregate collapses duplicates inside every task, and no text is
    sorted or shuffled for it.  The rows then meet their (hash, order) in a semi-join, whose keys
    are as many as the rows kept.  ``order_col`` must be a number and unique among equal keys."""
    keyed = df.select("*", F.xxhash64(key).alias("__a"), F.xxhash64(F.lit(7), key).alias("__b"))
    first = keyed.groupBy("__a", "__b", F.col(key).isNull().alias("__none")).agg(F.min(order_col).alias("__o"))
    first = first.select(F.col("__a").alias("__fa"), F.col("__b").alias("__fb"), "__none", "__o")
    return keyed.join(first, (F.col("__a") == F.col("__fa")) & (F.col("__b") == F.col("__fb"))
                      & (F.col(key).isNull() == F.col("__none")) & (F.col(order_col) == F.col("__o")),
                      "left_semi").select(*df.columns)


def drop_deleted_authors(df: DataFrame, col: str = "author", value: str = DELETED_AUTHOR) -> DataFrame:
    """``author != '[deleted]'`` keeping null authors."""
    return df.filter(null_safe_ne(col, value))


def drop_placeholders(df: DataFrame, col: str = "body", values=PLACEHOLDER_BODIES) -> DataFrame:
    """``~body.isin(values)`` keeping null bodies (they are dropped by later stages)."""
    return df.filter(null_safe_not_in(col, values))


def pattern_count_filter(df: DataFrame, col: str = "body", pattern: str = LINK_PATTERN,
                         max_count: int = MAX_LINKS) -> DataFrame:
    """Keep rows with fewer than ``max_count`` regex matches; null bodies are dropped."""
    return df.filter(F.regexp_count(F.col(col), F.lit(pattern)) < max_count)


def replace_entities(df: DataFrame, col: str = "body", pairs=ENTITY_REPLACEMENTS) -> DataFrame:
    return df.withColumn(col, literal_replace_chain(col, pairs))


def phrase_flag(col: str = "body", phrases=BOT_PHRASES):
    """True when the lower-cased text contains any phrase (null text -> False)."""
    low = F.lower(F.col(col))
    cond = F.lit(False)
    for p in phrases:
        cond = cond | F.coalesce(F.contains(low, F.lit(p)), F.lit(False))
    return cond


def phrase_filter(df: DataFrame, col: str = "body", phrases=BOT_PHRASES) -> DataFrame:
    """Drop rows containing any phrase (disabled in the reference's run; opt-in)."""
    return df.filter(~phrase_flag(col, phrases))


def harvest_filter(comments: DataFrame, body: str = "body", order_col: str = "ord") -> DataFrame:
    """What the harvester applies before saving: length filter, then keep-first dedup."""
    return dedup_keep_first(min_length_filter(comments, body), body, order_col)


def clean(comments: DataFrame, body: str = "body", author: str = "author",
          order_col: str = "ord", drop_bots: bool = False) -> DataFrame:
    """The cleaning script's stages in order; returns the input columns minus author."""
    df = dedup_keep_first(comments, body, order_col)
    if drop_bots:
        df = phrase_filter(df, body)
    df = drop_deleted_authors(df, author)
    df = drop_placeholders(df, body)
    df = pattern_count_filter(df, body)
    df = replace_entities(df, body)
    return df.drop(author)


def cleaning_funnel(comments: DataFrame, body: str = "body", author: str = "author",
                    order_col: str = "ord") -> DataFrame:
    """Row counts after each stage, one row: input, dedup, author, placeholder, links.

    One aggregation pass over the deduplicated rows with a flag per stage (each
    stage's flag includes the previous ones)."""
    n_in = comments.agg(F.count(F.lit(1)).alias("n_input"))
    d = dedup_keep_first(comments, body, order_col)
    a = null_safe_ne(author, DELETED_AUTHOR)
    p = a & null_safe_not_in(body, PLACEHOLDER_BODIES)
    lnk = p & F.coalesce(F.regexp_count(F.col(body), F.lit(LINK_PATTERN)) < MAX_LINKS, F.lit(False))
    counts = d.agg(F.count(F.lit(1)).alias("n_dedup"),
                   F.sum(F.when(a, 1).otherwise(0)).cast("bigint").alias("n_author"),
                   F.sum(F.when(p, 1).otherwise(0)).cast("bigint").alias("n_placeholder"),
                   F.sum(F.when(lnk, 1).otherwise(0)).cast("bigint").alias("n_links"))
    from quarry.functions.sizing import one_row_join
    return one_row_join(n_in, counts)
