"""CSV and JSON sources and sinks with explicit schemas.

* CSV: multi-line quoted fields, doubled quotes, whitespace preserved, so
  bodies with commas, quotes, newlines and outer spaces round-trip.
* JSON documents holding *maps* (name -> entity) are read with an explicit
  MAP schema and ``posexplode``-d: a declared MAP keeps the file's key order,
  an inferred struct would sort fields alphabetically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ordering import global_positions
from quarry.session import materialize

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


# The default NA tokens of the pandas CSV reader used by the reference.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: str, pandas_na: bool = False) -> DataFrame:
    """Read CSV with an explicit schema.  Empty fields read as null.  With
    ``pandas_na`` every string field equal to a pandas NA token becomes null too,
    as the reference's reader does."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    if pandas_na:
        for f in df.schema.fields:
            if f.dataType.simpleString() == "string":
                df = df.withColumn(f.name, F.when(~F.col(f.name).isin(list(PANDAS_NA_TOKENS)), F.col(f.name)))
    return df


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One (possibly pretty-printed) JSON document per file, explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def explode_map(df: DataFrame, map_col: str, key_name: str = "key", ord_name: str = "ord") -> DataFrame:
    """(ord, key, value.*) for every map entry, in file order; a null map gives no rows."""
    e = df.select(F.posexplode(F.map_entries(F.col(map_col))).alias(ord_name, "__e"))
    return e.select(F.col(ord_name).cast("bigint").alias(ord_name),
                    F.col("__e.key").alias(key_name), "__e.value.*")


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scalable JSON sink: one JSON object per row (per entity), many files."""
    df.write.mode(mode).json(path)


def write_ordered_document(entities: DataFrame, path: str, key_col: str, value: F.Column, order_cols, meta: dict,
                           count_field: str, field: str) -> None:
    """One JSON document ``{"meta": {..., count_field: n}, field: {key: value, ...}}`` with its entries in
    ``order_cols`` order (a total order), a line each, in as many text parts as there are partitions.

    Ranges of positions go to tasks of their own; the parts, put one after the other by name, are the document."""
    numbered = materialize(global_positions(entities, order_cols, "__pos"), "ordered-entries")
    n = numbered.count()
    head = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], F.lit(n).alias(count_field)))
    comma = F.when(F.col("__pos") < n - 1, F.lit(",")).otherwise(F.lit(""))
    # a key as JSON: the only element of an array, without the brackets
    key = F.to_json(F.array(key_col))
    entry = F.concat(F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": "), value, comma)
    one = entities.sparkSession.range(1)
    rows = (one.select(F.lit(-1).cast("long").alias("__pos"), F.concat(F.lit('{"meta": '), head, F.lit(f', "{field}": {{')).alias("value"))
            .unionByName(numbered.select("__pos", entry.alias("value")))
            .unionByName(one.select(F.lit(n).cast("long").alias("__pos"), F.lit("}}").alias("value"))))
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(parts, "__pos").sortWithinPartitions("__pos").select("value").write.mode("overwrite").text(path))


def read_ordered_document(spark: SparkSession, path: str, value_schema: str, meta_schema: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(entries, meta) of a document that ``write_ordered_document`` wrote: entries (pos, key, value.*)
    in document order, meta as one row.  The parts are read in parallel, line by line."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start",
                                         F.monotonically_increasing_id().alias("line"))
    first = F.col("value").startswith('{"meta": ')
    meta = lines.where(first).select(F.from_json(F.concat("value", F.lit("}}")), f"meta STRUCT<{meta_schema}>").alias("m")).select("m.meta.*")
    inner = lines.where(~first & (F.col("value") != "}}"))
    pair = F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}"))
    entry = F.element_at(F.map_entries(F.from_json(pair, f"MAP<STRING, STRUCT<{value_schema}>>")), 1)
    numbered = global_positions(inner, ["file_path", "file_block_start", "line"], "pos")
    return numbered.select("pos", entry.alias("e")).select("pos", F.col("e.key").alias("key"), "e.value.*"), meta
