"""Positional numbering and running sums without a single-task window.

``row_number() over (partition by g order by k)`` sends a whole group to one
task; a group holding a third of the rows then serialises the job.  Here the
rows are range-partitioned on (group, order keys), so a hot group spans many
partitions; each partition numbers its own rows, and a tiny table of
per-(partition, group) totals gives every partition its offset.

Rows and totals must mean the same partitions.  Range bounds are sampled anew by
every exchange, so the partitioned rows are written once, with the partition's
number as a column, and both branches read that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def _as_cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def running_sums_within(df: DataFrame, group_cols, order_cols, sums: dict[str, str],
                        num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums (value column -> new column) inside each group under
    ``order_cols``, all in one pass.  ``order_cols`` must form a total order (end with
    a unique key) for the result to be deterministic; null groups are a group."""
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    order = _as_cols(order_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *_as_cols(group_cols), *order)
    rows = materialize(ranged.withColumn("__pid", F.spark_partition_id()), "ranged")
    up_to = (Window.partitionBy("__pid", *group_cols).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.select("*", *[F.sum(v).over(up_to).alias(f"__l{i}") for i, v in enumerate(sums)])
    totals = rows.groupBy("__pid", *group_cols).agg(
        *[F.sum(v).alias(f"__t{i}") for i, v in enumerate(sums)])
    before = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__pid").alias("__opid"), *[F.col(g).alias(f"__o_{i}") for i, g in enumerate(group_cols)],
        *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__off{i}") for i in range(len(sums))])
    cond = F.col("__pid") == F.col("__opid")
    for i, g in enumerate(group_cols):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__o_{i}"))
    # a left join: a row without its offset would show as a null, never vanish
    out = local.join(offsets, cond, "left")
    return out.select(*[F.col(c) for c in df.columns if c not in sums.values()],
                      *[(F.col(f"__off{i}") + F.col(f"__l{i}")).alias(o) for i, o in enumerate(sums.values())])


def running_sum_within(df: DataFrame, group_cols, order_cols, value_col: str, out: str,
                       num_partitions: int | None = None) -> DataFrame:
    """One inclusive running sum; see :func:`running_sums_within`."""
    return running_sums_within(df, group_cols, order_cols, {value_col: out}, num_partitions)


def positions_within(df: DataFrame, group_cols, order_cols, out: str = "pos", base: int = 0,
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based (plus ``base``) position of each row inside its group
    under ``order_cols`` (a total order)."""
    counted = running_sums_within(df.withColumn("__one", F.lit(1)), group_cols, order_cols,
                                  {"__one": "__pos"}, num_partitions)
    keep = [F.col(c) for c in df.columns if c != out]
    return counted.select(*keep, (F.col("__pos") + (base - 1)).cast("bigint").alias(out))


def global_positions(df: DataFrame, order_cols, out: str = "pos", base: int = 0,
                     num_partitions: int | None = None) -> DataFrame:
    """Positions in one total order over the whole table (a stable sort's index)."""
    return positions_within(df.withColumn("__g", F.lit(0)), ["__g"], order_cols, out, base,
                            num_partitions).drop("__g")
