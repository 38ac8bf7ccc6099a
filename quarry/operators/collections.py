"""Collections: chunks joined to their vectors, persisted partitioned by name,
reused unless stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunks import assign_chunk_ids


def build_collection(chunks: DataFrame, vectors: DataFrame, collection: str | None = None,
                     id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """chunks (``collection``?, doc_id, text, ...) joined to vectors (doc_id,
    embedding) with positional chunk ids per collection."""
    c = chunks if collection is None else chunks.withColumn("collection", F.lit(collection))
    joined = c.join(vectors.select(id_col, vec_col), id_col)
    return assign_chunk_ids(joined.withColumn("ord", F.col(id_col))).drop("ord")


def write_collections(df: DataFrame, path: str) -> None:
    """Partitioned by collection; with dynamic partition overwrite only the
    rebuilt collections are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("collection").parquet(path))


def stale_collections(stored_counts: DataFrame, expected_counts: DataFrame) -> DataFrame:
    """(collection, stored, expected, action): ``reuse`` when the stored count is
    positive and equals the expected chunk count, else ``rebuild``."""
    j = stored_counts.join(expected_counts, "collection", "full_outer")
    s = F.coalesce(F.col("stored"), F.lit(0))
    e = F.coalesce(F.col("expected"), F.lit(0))
    return j.select("collection", s.alias("stored"), e.alias("expected"),
                    F.when((s > 0) & (s == e), F.lit("reuse")).otherwise(F.lit("rebuild")).alias("action"))


def content_hash(row_hash):
    """An order-independent hash of all rows: XOR and sum together, since equal rows cancel
    each other in an XOR alone."""
    total = F.sum(row_hash.cast("decimal(38,0)"))
    return F.xxhash64(F.bit_xor(row_hash), total)


def fingerprint(df: DataFrame, group_col: str = "collection", id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(collection, n, fp): count plus an order-independent content hash, so edits
    that keep the count are detected too."""
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        content_hash(F.xxhash64(F.col(id_col), F.col(text_col))).alias("fp"))


def stale_by_hash(stored: DataFrame, expected: DataFrame, group_col: str = "collection") -> DataFrame:
    a = stored.select(group_col, F.col("n").alias("stored"), F.col("fp").alias("stored_fp"))
    b = expected.select(group_col, F.col("n").alias("expected"), F.col("fp").alias("expected_fp"))
    j = a.join(b, group_col, "full_outer")
    same = (F.coalesce(F.col("stored"), F.lit(0)) > 0) & (F.col("stored") == F.col("expected")) \
        & (F.col("stored_fp") == F.col("expected_fp"))
    return j.select(group_col, "stored", "expected",
                    F.when(same, F.lit("reuse")).otherwise(F.lit("rebuild")).alias("action"))


def _content_fingerprint(df: DataFrame, key: str) -> tuple:
    from quarry.session import memo_fingerprint

    def compute():
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(content_hash(F.xxhash64(*[F.col(c) for c in df.columns])), F.lit(0)).alias("fp")
                   ).first()
        return int(r["n"]), int(r["fp"]) & (2 ** 64 - 1)
    return memo_fingerprint(df, compute)


def stored_bucketed(df: DataFrame, key: str = "doc_id", n_buckets: int | None = None,
                    name: str = "collection") -> DataFrame:
    """``df`` as a table bucketed (and sorted) by ``key`` under the shared folder,
    reused while its content fingerprint is unchanged.

    Joins on ``key`` against a bucketed table shuffle only the other side, so a
    large vector collection is written once (clustered by document) and never
    exchanged again at query time.  The bucket count defaults to the session's
    shuffle partition count (and is part of the table key): the planner keeps
    the bucketed scan only when the other side is shuffled to the same count."""
    from quarry.session import index_dir, is_complete, mark_complete
    spark = df.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, fp = _content_fingerprint(df, key)
    tag = f"{name}_{n}_{fp:016x}_{n_buckets}"
    table = f"quarry_{tag}"
    path = f"{index_dir(spark)}/bucketed/{tag}"
    if spark.catalog.tableExists(table):
        return spark.table(table)
    if not is_complete(spark, path):
        # one task per bucket (same hash as bucketing): one file per bucket, not
        # one per (task, bucket)
        (df.repartition(n_buckets, key).write.bucketBy(n_buckets, key).sortBy(key).mode("overwrite")
           .option("path", f"{path}/data").saveAsTable(table))
        mark_complete(spark, path)
        return spark.table(table)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                     for f in spark.read.parquet(f"{path}/data").schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet CLUSTERED BY ({key}) "
              f"SORTED BY ({key}) INTO {n_buckets} BUCKETS LOCATION '{path}/data'")
    return spark.table(table)
