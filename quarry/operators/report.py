"""Flat text report (the legacy context block) from ordered line tables.

Each section contributes (section_ord, line_ord, line) rows computed by
ordinary aggregations; the report is those lines in order joined by newlines.
Only reports whose line count is bounded (fixed sections over small domains,
top-k lists) should be assembled into one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opponent(winner: str = "winner", team1: str = "team1", team2: str = "team2") -> Column:
    """The team that is not the winner: team1 unless team1 won."""
    return F.when(F.col(winner) != F.col(team1), F.col(team1)).otherwise(F.col(team2))


def joined(arr, sep: str = " and ") -> Column:
    return F.array_join(F.col(arr) if isinstance(arr, str) else arr, sep)


def coach_text(coach: str = "coach") -> Column:
    """`` Coach: ign (real_name)`` of a VARIANT that is an object, `` Coach: text`` of one that is text, nothing
    where it is absent, null or empty."""
    v = F.col(coach)
    kind = F.schema_of_variant(v)

    def field(name):
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("None"))

    text = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(""))
             .when(kind.startswith("OBJECT"), F.concat(F.lit(" Coach: "), field("ign"), F.lit(" ("), field("real_name"), F.lit(")")))
             .when((kind == "STRING") & (text != ""), F.concat(F.lit(" Coach: "), text)).otherwise(F.lit("")))


def roster_line(roster: str = "roster") -> Column:
    """``full_name/abbr (region, result): name (role), ....`` and the coach; ``roster`` holds (role, name)
    in the team's order."""
    players = F.array_join(F.transform(roster, lambda p: F.concat(p["name"], F.lit(" ("), p["role"], F.lit(")"))), ", ")
    return F.concat(F.col("full_name"), F.lit("/"), F.col("abbr"), F.lit(" ("), F.col("region"), F.lit(", "), F.col("result"),
                    F.lit("): "), players, F.lit("."), coach_text())


def group_line() -> Column:
    """``- group: a and b advanced. c and d eliminated.``"""
    return F.concat(F.lit("- "), F.col("group_name"), F.lit(": "), joined("advanced"), F.lit(" advanced. "),
                    joined("eliminated"), F.lit(" eliminated."))


def storyline() -> Column:
    return F.concat(F.lit("- "), F.col("narrative"), F.lit(": "), F.col("description"))


def lines(section_ord: int, df: DataFrame, line_ord, line) -> DataFrame:
    lo = F.col(line_ord) if isinstance(line_ord, str) else line_ord
    ln = F.col(line) if isinstance(line, str) else line
    return df.select(F.lit(section_ord).alias("section_ord"), lo.cast("bigint").alias("line_ord"),
                     ln.alias("line"))


def fixed_line(spark, section_ord: int, line_ord: int, text: str) -> DataFrame:
    return spark.createDataFrame([(section_ord, line_ord, text)],
                                 "section_ord int, line_ord bigint, line string")


def assemble(parts) -> DataFrame:
    """(report): every line in (section, line) order joined by newline."""
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return allp.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("section_ord", "line_ord", "line"))),
        lambda x: x["line"]), "\n").alias("report"))
