"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) -- ``docs`` being all that its predecessor kept, reread from
Parquet -- and calls one operator of ``quarry.llm``; all but the last return the columns of
documents:

1. ``toxicity`` drops the documents whose score reaches the threshold;
2. ``simhash`` keeps one document of each group of near duplicates;
3. ``secrets`` puts a mark in the place of every secret; all documents stay;
4. ``mix`` takes of each source what its weight asks for: a row per document and epoch;
5. ``pack`` cuts the documents' token ids into sequences: a row per piece, with its ids.

Nulls, empty and long texts, repeated rows, empty tables and further columns are handled as the
operators' descriptions say; further columns go through the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, queries, secret_scan, simhash, toxicity
from quarry.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"), queries.TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, queries.SHINGLE_WORDS, queries.FINGERPRINT_BITS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = packing.tokenized(docs, queries.tokenizer_path(), queries.END_ID)
    return packing.pack(tokens, queries.SEQUENCE_TOKENS).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Fingerprints, a trained classifier, pseudorandom permutations and a tokenizer: no SQL for these;
#: the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
