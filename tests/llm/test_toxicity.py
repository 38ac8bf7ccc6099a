import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, toxicity
from llm_fixtures import EDGE_ROWS, documents

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op6_toxicity(spark, SF).toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = scored.merge(labels, on="doc_id")
    assert (scored.held_out == [is_held_out(i) for i in scored.doc_id]).all()
    assert (scored.predicted == (scored.score >= 0.7)).all() and scored.score.between(0, 1).all()
    out = both[both.held_out]
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit / (out.toxic == 1).sum() > 0.88         # a few labels are wrong on purpose
    assert hit / (out.predicted == 1).sum() > 0.97
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels_and_other_columns_have_no_say(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("hits", F.lit(1)).withColumn("toxic", F.lit(1))
    got = toxicity.score_documents(other, turned).toPandas().sort_values("doc_id")
    assert np.allclose(got.score.values, scored.sort_values("doc_id").score.values)


def test_edge_rows(spark):
    rows = EDGE_ROWS + [(20, "You idiot, what a worthless pathetic moron.", "a"), (21, None, "a")]
    labels = spark.createDataFrame([(20, 1, 1), (20, 1, 0), (1, 1, 0), (2, 0, None), (None, 1, 1), (99, 1, 1)], LABELS)
    for known in (labels, labels.limit(0)):
        got = toxicity.score_documents(documents(spark, rows), known).collect()
        assert len(got) == len(rows)
        score = {}
        for r in got:
            assert 0 <= r["score"] <= 1
            score.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(score[4]) == 1 and score[1] == score[2] == score[21]
        assert min(score[20]) > max(score[4])
    assert toxicity.score_documents(documents(spark, rows).limit(0), labels).count() == 0


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    single = np.where(rng.random(4000) < 0.85, y, ~y)
    copied = np.where(rng.random(4000) < 0.85, y, ~y)
    v = np.zeros((4000, toxicity.GROUPS + 8))
    v[:, 0], v[:, 1:5] = single, copied[:, None]
    model = toxicity.LabelModel.from_sums(toxicity.moments(v, y.astype(float)))
    assert model.weights[1:5].sum() < 1.6 * model.weights[0] and model.weights[0] > 0
