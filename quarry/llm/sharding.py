"""Sharding by extendible hashing.

Rows hash to 64 bits.  The directory starts as one bucket; a bucket whose rows exceed the
byte limit splits on the next bit of the hash prefix, and only such buckets do, until every
shard fits.  Splitting is a matter of sums: a round sums bytes by ``ROUND_BITS`` further
bits, the sums of all shorter prefixes follow from those, and a shard is the shortest
prefix that fits.  Buckets that need still more bits go on in the next round, alone.

Rows equal in id and text share all bits, so a bucket of one key is not split; if it
exceeds the limit it is cut into pages of as many rows as fit.  Only a single row
beyond the limit makes a page that exceeds it.

Defined results: a null text has 0 bytes; null ids and null texts hash like values of their
own; repeated rows share a shard (its pages); an empty table gives an empty directory; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

ROUND_BITS = 16
HASH_BITS = 64


def hash_bits(id_col: str, text_col: str):
    """64 bits as a text of 0 and 1: the first 16 hex digits of an MD5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"),
                            F.coalesce(F.md5(F.col(text_col)), F.lit("-"))))
    return F.concat(*[F.lpad(F.conv(F.substring(digest, at, 8), 16, 2), 32, "0") for at in (1, 9)])


def _first_bits(col, n):
    return F.substring(col, F.lit(1), n)


def _round(keys: DataFrame, done: int, byte_limit: int) -> tuple[DataFrame, DataFrame]:
    """One round of splits of the open buckets' ``keys`` (bits, bytes): the directory entries
    of ``done + ROUND_BITS`` bits (``entry`` -> shard), and the prefixes that stay open."""
    upto = done + ROUND_BITS
    fine = keys.groupBy(_first_bits("bits", F.lit(upto)).alias("entry")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys"))
    levels = F.explode(F.sequence(F.lit(done + 1 if done else 0), F.lit(upto))).alias("depth")
    by_level = fine.select("entry", "bytes", "keys", levels)
    sums = by_level.groupBy(_first_bits("entry", F.col("depth")).alias("prefix"), "depth").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("keys").alias("keys"))
    closed = sums.where((F.col("shard_bytes") <= byte_limit) | (F.col("keys") == 1))
    at = by_level.select("entry", F.col("depth").alias("e_depth"),
                         _first_bits("entry", F.col("depth")).alias("e_prefix"))
    entries = (at.join(closed, (F.col("e_depth") == F.col("depth")) & (F.col("e_prefix") == F.col("prefix")))
                 .groupBy("entry").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("shard"))
                 .select("entry", F.col("shard.prefix").alias("shard"), "shard.depth", "shard.shard_bytes"))
    entries = materialize(entries, "llm-shard-entries")
    still = fine.select("entry").join(entries.select("entry"), "entry", "left_anti")
    return entries, still


def shards(docs: DataFrame, byte_limit: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, bits, n_bytes, shard (a hash prefix), depth,
    page, shard_bytes (of the shard's page)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), hash_bits(id_col, text_col).alias("bits"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = materialize(rows, "llm-shard-rows")
    keys = rows.groupBy("bits").agg(F.sum("n_bytes").alias("bytes"))
    open_rows, parts = rows, []
    for done in range(0, HASH_BITS, ROUND_BITS):
        entries, still = _round(keys, done, byte_limit)
        if not done:
            entries = F.broadcast(entries)      # 2 ** ROUND_BITS rows at most
        cut = _first_bits("bits", F.lit(done + ROUND_BITS))
        parts.append(open_rows.join(entries, cut == F.col("entry")).drop("entry"))
        if not still.limit(1).count():
            break
        left = still.select(F.col("entry").alias("open"))
        keys = keys.join(left, cut == F.col("open"), "left_semi")
        open_rows = open_rows.join(left, cut == F.col("open"), "left_semi")
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    fits = placed.where(F.col("shard_bytes") <= byte_limit).withColumn("page", F.lit(0).cast("long"))
    # a shard over the limit holds equal rows: as many to a page as fit
    per_page = F.greatest(F.floor(F.lit(byte_limit) / F.col("n_bytes")), F.lit(1))
    equal = placed.where(F.col("shard_bytes") > byte_limit).groupBy(
        "doc_id", "bits", "n_bytes", "shard", "depth").agg(F.count(F.lit(1)).alias("n"))
    paged = (equal.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
                  .withColumn("page", F.floor(F.col("i") / per_page))
                  .withColumn("shard_bytes", F.col("n_bytes") * F.least(
                      per_page, F.col("n") - F.col("page") * per_page)))
    cols = ["doc_id", "bits", "n_bytes", "shard", "depth", "page", "shard_bytes"]
    return fits.select(cols).unionByName(paged.select(cols))


def write_shards(docs: DataFrame, path: str, byte_limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Writes ``docs`` as Parquet, one folder per shard; a row finds its shard through its bits.
    Pages of equal rows share their shard's folder, in files of at most a page each."""
    places = (shards(docs, byte_limit, id_col, text_col).groupBy("bits")
              .agg(F.first("shard").alias("shard"), F.first("n_bytes").alias("b")))
    places = places.select(F.col("bits").alias("p_bits"), F.col("shard").alias("_shard"), "b")
    out = docs.withColumn("_bits", hash_bits(id_col, text_col)).join(
        places, F.col("_bits") == F.col("p_bits")).drop("_bits", "p_bits", "b")
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)


ORACLE = """
with h as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(md5(text), '-')), 1, 16))::ubigint), 64, '0') as bits
  from documents),
lv as (select unnest(range(0, 65)) as depth),
s as (select substr(bits, 1, depth::int) as prefix, depth, sum(n_bytes)::bigint as bytes, count(distinct bits) as keys
      from h, lv group by 1, 2),
d as (select h.doc_id, h.bits, h.n_bytes, min(s.depth) as depth
      from (select distinct * from h) h, s
      where s.prefix = substr(h.bits, 1, s.depth::int) and (s.bytes <= {limit} or s.keys = 1)
      group by all),
r as (select h.*, d.depth, substr(h.bits, 1, d.depth::int) as shard,
             row_number() over (partition by h.doc_id, h.bits) - 1 as i,
             count(*) over (partition by h.doc_id, h.bits) as n
      from h join d on h.doc_id is not distinct from d.doc_id and h.bits = d.bits),
t as (select r.*, s.bytes as total, greatest({limit} // greatest(n_bytes, 1), 1) as per_page
      from r join s on s.prefix = r.shard and s.depth = r.depth)
select doc_id, n_bytes, shard, depth::int as depth,
       (case when total <= {limit} then 0 else i // per_page end)::bigint as page,
       (case when total <= {limit} then total
             else n_bytes * least(per_page, n - (i // per_page) * per_page) end)::bigint as shard_bytes
from t
"""
