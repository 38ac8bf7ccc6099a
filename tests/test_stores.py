"""Persisted index / bucketed table: reuse while unchanged, rebuild when stale."""

import io
from contextlib import redirect_stdout

from conftest import rows
from pyspark.sql import functions as F

from quarry.operators import lexical as lx
from quarry.operators.collections import stored_bucketed


def test_bm25_index_reused_then_rebuilt_on_change(spark):
    a = spark.createDataFrame([(0, "red fox"), (1, "blue fox"), (2, "green owl")], "doc_id long, text string")
    i1 = lx.stored_bm25_index(a)
    i2 = lx.stored_bm25_index(spark.createDataFrame(a.collect(), a.schema))
    assert sorted(i1.postings.inputFiles()) == sorted(i2.postings.inputFiles())  # same stored index
    b = spark.createDataFrame([(0, "red fox"), (1, "blue fox"), (2, "green fox")], "doc_id long, text string")
    i3 = lx.stored_bm25_index(b)
    assert sorted(i3.postings.inputFiles()) != sorted(i1.postings.inputFiles())
    q = spark.createDataFrame([(0, "owl")], "qid long, question string")
    assert {d for _, d in rows(lx.bm25_scores(i1, q), "qid", "doc_id")} == {2}
    assert rows(lx.bm25_scores(i3, q)) == []


def test_bucketed_vectors_reused_and_not_exchanged(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "doc_id long, v array<double>")
    # default bucket count = the session's shuffle partitions: the planner only
    # keeps a bucketed scan when the other side is shuffled to the same count
    t1 = stored_bucketed(v, "doc_id", name="testvec")
    t2 = stored_bucketed(spark.createDataFrame(v.collect(), v.schema), "doc_id", name="testvec")
    assert sorted(t1.inputFiles()) == sorted(t2.inputFiles())
    hits = (spark.createDataFrame([(1, i, 0.5) for i in range(0, 50, 7)], "qid long, doc_id long, b double")
                 .groupBy("doc_id").agg(F.collect_list(F.struct("qid", "b")).alias("hits")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = t1.join(hits, "doc_id", "left")
        buf = io.StringIO()
        with redirect_stdout(buf):
            j.explain()
        plan = buf.getvalue()
        scan_line = [ln for ln in plan.splitlines() if "Bucketed: true" in ln]
        assert scan_line, plan
        # the only exchange feeds the hit lists; the bucketed scan sits directly under its sort
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert j.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
