"""Property tests: BM25 on random corpora, skew-safe ordering helpers on a hot group."""

import random

from conftest import rows
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st
from test_lexical import py_bm25

from quarry.functions.ordering import positions_within, running_sum_within
from quarry.operators import lexical as lx

WORDS = st.sampled_from(["ab", "cd", "ef", "gh", "AB", "ij"])
DOC = st.lists(WORDS, min_size=0, max_size=8).map(" ".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(DOC, min_size=1, max_size=6), query=st.lists(WORDS, min_size=1, max_size=4))
def test_bm25_random_corpora(spark, docs, query):
    assume(any(d.split() for d in docs))  # an all-empty corpus has no vocabulary to average
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = " ".join(query)
    idx = lx.build_bm25_index(corpus, materialized=False)
    qs = spark.createDataFrame([(0, q)], "qid long, question string")
    got = {d: s for _, d, s in rows(lx.bm25_scores(idx, qs), "qid", "doc_id", "score")}
    want = py_bm25(docs, q)
    for i, w in enumerate(want):
        assert abs(got.get(i, 0.0) - w) < 1e-9


def test_positions_and_running_sums_with_a_hot_group(spark):
    rnd = random.Random(7)
    data = [("hot", i, rnd.randint(0, 3)) for i in range(4000)]
    data += [(f"g{j}", i, rnd.randint(0, 3)) for j in range(20) for i in range(rnd.randint(0, 30))]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g string, o long, v long").repartition(8)
    pos = {(g, o): p for g, o, p in rows(positions_within(df, ["g"], ["o"], num_partitions=16), "g", "o", "pos")}
    run = {(g, o): s for g, o, s in rows(running_sum_within(df, ["g"], ["o"], "v", "s", num_partitions=16),
                                         "g", "o", "s")}
    by_group = {}
    for g, o, v in sorted(data, key=lambda r: (r[0], r[1])):
        by_group.setdefault(g, []).append((o, v))
    for g, items in by_group.items():
        acc = 0
        for i, (o, v) in enumerate(items):
            acc += v
            assert pos[(g, o)] == i
            assert run[(g, o)] == acc


def test_positions_keep_every_row_beyond_the_range_sample(spark):
    """Payload columns, a hot group and more rows than a range exchange samples."""
    from pyspark.sql import functions as F
    n = 120_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(
            F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    for parts in (4, 8):
        got = positions_within(df, ["g"], ["o"], num_partitions=parts)
        want = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        back = got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("d"),
                                    F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        assert sorted(map(str, back.select("g", "n").collect())) == sorted(map(str, want.collect()))
        assert back.where("d != n or lo != 0 or hi != n - 1").count() == 0
        summed = running_sum_within(df, ["g"], ["o"], "v", "s", num_partitions=parts)
        plain = {(r["g"], r["o"]): r["s"] for r in summed.where("o % 1000 = 0").collect()}
        exact = df.toPandas().sort_values("o")
        exact["s"] = exact.fillna({"g": "?"}).groupby("g")["v"].cumsum()
        for r in exact[exact["o"] % 1000 == 0].itertuples():
            if (r.g, r.o) in plain:
                assert plain[(r.g, r.o)] == r.s
