from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, queries, secret_scan, simhash, toxicity
from llm_fixtures import EDGE_ROWS, documents
from test_packing import check_pieces
from test_secret_scan import brute as brute_spans
from test_simhash import brute as brute_groups

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(str, df.collect()))


def check_stages(spark, docs, sf_dir):
    """Every stage on all that its predecessor kept, against a brute-force version."""
    scores = {r["text"]: r["score"] for r in toxicity.score_documents(
        docs.withColumn("doc_id", F.col("doc_id")), queries.table(spark, sf_dir, "labels"))
        .join(docs.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()} \
        if docs.select("doc_id").distinct().count() == docs.count() else None
    one = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    assert one.columns == docs.columns and not rows_of(one) - rows_of(docs)
    if scores is not None:
        kept = {r["text"] for r in one.collect()}
        assert kept == {t for t, s in scores.items() if s < queries.TOXIC_FROM}
    two = corpus_pipeline.drop_near_duplicates(spark, one, sf_dir).cache()
    assert two.columns == docs.columns and not rows_of(two) - rows_of(one)
    groups = brute_groups([(r["doc_id"], r["text"]) for r in one.collect()])
    ids = [r["doc_id"] for r in two.collect()]
    assert Counter(i for i in ids if i is not None) == Counter({c for _, _, c in groups if c is not None})
    three = corpus_pipeline.mask_secrets(spark, two, sf_dir).cache()
    assert three.columns == docs.columns and three.count() == two.count()
    before = Counter(r["text"] for r in two.collect() if not any(brute_spans(r["text"])[:3]))
    after = Counter(r["text"] for r in three.collect())
    changed = Counter(r["text"] for r in two.collect() if any(brute_spans(r["text"])[:3]))
    assert not changed & after and sum((before - after).values()) <= 3      # the method's further rules
    assert all(not any(brute_spans(t)[:3]) for t in after)
    four = corpus_pipeline.mix_sources(spark, three, sf_dir).cache()
    assert four.columns == docs.columns
    want = mixing.Mix(three).taken().agg(F.sum("taken")).first()[0] or 0
    assert sum(len((r["text"] or "").encode().split()) for r in four.collect()) == want
    five = corpus_pipeline.pack_sequences(spark, four, sf_dir).withColumn("crc", F.col("ids_crc32"))
    check_pieces(five.collect(), [(r["doc_id"], r["text"]) for r in four.collect()], queries.SEQUENCE_TOKENS)


def test_stages_on_the_whole_table(spark):
    check_stages(spark, queries.table(spark, SF, "documents"), SF)


def test_edge_rows(spark):
    rows = EDGE_ROWS + [(30, "you pathetic idiot, worthless moron and loser", "a"), (31, "token=abcdefghijklmnop ok", "b")]
    check_stages(spark, documents(spark, rows, ("kept", "row", "score", "hits", "spans", "key")), SF)


def test_empty(spark):
    docs = documents(spark, EDGE_ROWS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if name != "pack" else docs


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["offset"] for r in rows if r["sequence_id"] == 0} >= {0}
    assert max(r["length"] for r in rows) <= queries.SEQUENCE_TOKENS
