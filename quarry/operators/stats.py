"""Statistics build: lookups with defaults, guarded ratios, stable ordering, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ordering import global_positions, positions_within

# Defaults of the reference's champion build and its role order.
DEFAULT_TITLE = "Unknown"
DEFAULT_ROLES = ("Unknown",)
ROLE_ORDER = ("Top", "Jungle", "Mid", "Bot", "Support", "Unknown")


# Fixed value: where an entity's image is, under the address of the images and the data's version.
IMAGE_PATH = "img/champion/{key}.png"


def image_url(key, version: str, base: str) -> Column:
    """The image of an entity, from its key."""
    k = F.col(key) if isinstance(key, str) else key
    before, after = IMAGE_PATH.split("{key}")
    return F.concat(F.lit(f"{base}/{version}/{before}"), k, F.lit(after))


def base_entry(roster: DataFrame, base: DataFrame, version: str, image_base: str) -> DataFrame:
    """roster (data_dragon_key, display_name, ...) with name, title, tags, blurb and image from ``base``
    (data_dragon_key, name, title, tags, blurb); an entity that is not there gets its display name, the default
    title, no tags, an empty blurb and no image."""
    known = base.select("data_dragon_key", F.col("name").alias("b_name"), "title", "tags", "blurb", F.lit(True).alias("found"))
    both = roster.join(known, "data_dragon_key", "left")
    found = F.coalesce("found", F.lit(False))
    return both.withColumns({
        "name": F.when(found, F.col("b_name")).otherwise(F.col("display_name")),
        "title": F.when(found, F.col("title")).otherwise(F.lit(DEFAULT_TITLE)),
        "tags": F.when(found, F.col("tags")).otherwise(F.array().cast("array<string>")),
        "blurb": F.when(found, F.col("blurb")).otherwise(F.lit("")),
        "image": F.when(found, image_url("data_dragon_key", version, image_base))}).drop("b_name", "found")


def left_join_defaults(left: DataFrame, right: DataFrame, key, defaults: dict) -> DataFrame:
    """Left lookup; every column named in ``defaults`` is coalesced to its default
    (a Column or a literal).  The lookup side can be as large as the left side, so
    no static broadcast: AQE switches to a broadcast join at runtime when the
    measured lookup side is small."""
    out = left.join(right, key, "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)))
    return out


def guarded_rate(num: str, den: str, scale: int = 100, digits: int = 1) -> Column:
    """``round_half_even(num / den * scale, digits)`` for integer counts; null when
    ``den`` is 0 or null.  Integer arithmetic (quotient, remainder, tie to even),
    so the rounding is exact and engine-independent."""
    m = scale * 10 ** digits
    q = F.expr(f"({num} * {m}) div nullif({den}, 0)")
    r = F.expr(f"({num} * {m}) - (({num} * {m}) div nullif({den}, 0)) * {den}")
    up = (2 * r > F.col(den)) | ((2 * r == F.col(den)) & (F.pmod(q, F.lit(2)) == 1))
    return F.when(F.col(den) > 0, (q + F.when(up, 1).otherwise(0)) / float(10 ** digits))


def stable_sort_desc(df: DataFrame, value_col: str, ord_col: str, out: str = "pos") -> DataFrame:
    """Stable descending sort: ties keep input order; adds the 0-based position."""
    return global_positions(df, [F.desc(value_col), F.asc(ord_col)], out)


def ordered_members(df: DataFrame, group_col: str, value_col: str, ord_col: str,
                    out: str = "pos") -> DataFrame:
    """Members of each group in (value desc, input order) order, as positions --
    the long form of "names grouped by role in presence order"."""
    return positions_within(df, [group_col], [F.desc(value_col), F.asc(ord_col)], out)


def in_role_order(members: DataFrame, group_col: str, order=ROLE_ORDER) -> DataFrame:
    """Keep the groups named in ``order`` and number them in that fixed order (``role_ord``);
    groups outside the list are not shown."""
    spark = members.sparkSession
    roles = spark.createDataFrame(list(enumerate(order)), f"role_ord int, {group_col} string")
    return members.join(F.broadcast(roles), group_col)  # fixed, tiny configuration table


def join_members(members: DataFrame, group_col: str, pos_col: str, name_col: str,
                 sep: str = ", ") -> DataFrame:
    """One string per group from the long form.  Only for groups of bounded size
    (display); the long form is the scalable result."""
    return members.groupBy(group_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos_col, name_col))),
                                 lambda x: x[name_col]), sep).alias("members"))


def strip_thread_suffix(label) -> Column:
    """Match name of a thread label: drop a trailing `` (Series)`` or `` - Game N``."""
    c = F.col(label) if isinstance(label, str) else label
    return F.regexp_replace(c, r"( \(Series\)| - Game \d+)$", "")


def count_by_label(df: DataFrame, label_col: str = "match") -> DataFrame:
    """(match, n_comments, total): comments per match after suffix stripping; the
    per-match counts reconcile to ``total``."""
    per = df.groupBy(strip_thread_suffix(label_col).alias("match")).agg(
        F.count(F.lit(1)).alias("n_comments"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    from quarry.functions.sizing import one_row_join
    return one_row_join(per, total)
