"""Size-checked broadcast.

A side is broadcast only after an explicit, bounded check of its row count
(``limit(n + 1).count()`` stops scanning once the bound is exceeded).  Above
the bound the caller gets the plain DataFrame and Spark plans a shuffle join;
AQE may still convert it at runtime from measured shuffle sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
#: Terms of a vocabulary that are broadcast.
FREQUENT_TERMS = 300_000


def fits(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows) else df


def join_by_term(rows: DataFrame, terms: DataFrame, most: int = FREQUENT_TERMS) -> DataFrame:
    """Inner join of ``rows`` (term, ...) with ``terms`` (term, df, ...; one row per term), without ``df``.

    A vocabulary that outgrows a broadcast is split: its most frequent terms (``most`` at most, by powers of two
    of ``df``) are broadcast and meet most rows in place, stop words among them; only rows of rare terms are
    shuffled, and no task gets a frequent term's rows."""
    tiers = terms.agg(*[F.count_if(F.col("df") >= 2 ** i).alias(f"c{i}") for i in range(48)]).first()
    cut = next((2 ** i for i in range(48) if tiers[i] <= most), 2 ** 48)
    if cut == 1:
        return rows.join(F.broadcast(terms.drop("df")), "term")
    frequent = F.broadcast(terms.where(F.col("df") >= cut))
    rare = rows.join(frequent.select("term"), "term", "left_anti").join(terms.where(F.col("df") < cut).drop("df"), "term")
    return rows.join(frequent.drop("df"), "term").unionByName(rare)


def one_row_join(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The single row (bounded by construction) is fetched once and attached as
    typed literals: no join operator at all, and Catalyst can fold the
    constants into the expressions that use them."""
    row = stats.first()
    if row is None:
        raise ValueError("one_row_join expects a one-row aggregate")
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name)
                            for f in stats.schema.fields])
