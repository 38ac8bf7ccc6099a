"""The registered queries of this subpackage: thin digests over the operators' outputs.

Each reads its whole table; the DuckDB twin is given where SQL can express the result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (collocations, decontamination, filter_audit, lattice, metric_tree, mixing, packing, secret_scan,
                        sharding, simhash, substrings, toxicity, wrappers)

SHARD_BYTES = 1 << 20
SEQUENCE_TOKENS = 2048
END_ID = 1
REPEAT_WORDS = 35
LEAST_COSINE = 0.95
TOXIC_FROM = 0.7
SHINGLE_WORDS, FINGERPRINT_BITS = 4, 4
BENCHMARK_WORDS = 10
PHRASE_LEAST, PHRASES_SHOWN = 100, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"), REPEAT_WORDS)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = wrappers.extract(table(spark, sf_dir, "pages"))
    return read.withColumn("n_chars", F.length("text").cast("long"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


OP4_ORACLE = """
with v as (
  select vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES).drop("bits")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), LEAST_COSINE)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule_no"] < len(secret_scan.BASE_RULES))
    found = found.withColumn("base", base)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secret_scan.BASE_RULES],
                        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenized(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return packing.pack(tokens, SEQUENCE_TOKENS).withColumn("ids", F.crc32("ids")).withColumnRenamed(
        "ids", "ids_crc32")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS, FINGERPRINT_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                         BENCHMARK_WORDS)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), PHRASE_LEAST, PHRASES_SHOWN)
    return found.drop("left", "right")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_remove_repeats": op2_remove_repeats,
    "op3_main_text": op3_main_text,
    "op4_top_k": op4_top_k,
    "op5_extendible_shards": op5_extendible_shards,
    "op6_toxicity": op6_toxicity,
    "op7_lattice_near_dups": op7_lattice_near_dups,
    "op8_secrets": op8_secrets,
    "op9_pack": op9_pack,
    "op10_simhash": op10_simhash,
    "op11_decontaminate": op11_decontaminate,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op4_top_k": OP4_ORACLE,
    "op5_extendible_shards": sharding.ORACLE.format(limit=SHARD_BYTES),
    "op11_decontaminate": decontamination.ORACLE.replace("{n}", str(BENCHMARK_WORDS)),
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_collocations": collocations.ORACLE.replace("{least}", str(PHRASE_LEAST)).replace("{most}", str(PHRASES_SHOWN)),
}
