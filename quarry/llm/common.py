"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize  # noqa: F401  (re-exported for the operators)

#: One word: a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: str | Column) -> Column:
    """The whole text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 128-bit key of a whole text, as a struct of two 64-bit hashes.

    Equal texts have equal keys; two different texts of a corpus of n texts share
    one with a probability of about n^2 / 2^129."""
    return F.struct(F.xxhash64(text).alias("a"),
                    F.xxhash64(F.lit(7), text, F.length(text)).alias("b"))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Bounds the bytes (not only the rows) of a batch that goes to a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, most)
