import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import metric_tree, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, set()).add(tuple(math.floor(64 * float(np.float32(x))) for x in v))
    out = []
    flat = [(i, v) for i, vs in ok.items() for v in vs]
    for q, qv in flat:
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in flat if i != q and len(v) == len(qv))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(table):
    return sorted(map(tuple, metric_tree.top_k(table, F.col("vec_id") % 20 == 0).collect()))


def test_many_small_regions(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "REGION", 60)
    monkeypatch.setattr(metric_tree, "SUBTREE", 40)
    monkeypatch.setattr(metric_tree, "PAGE", 5)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    x = np.concatenate([base[rng.integers(0, 6, 500)] + rng.normal(size=(500, 12)) * .05, np.tile(base[0], (60, 1)),
                        rng.normal(size=(100, 12)) * 3])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    assert run(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)) == brute(rows)


def test_pruning_computes_less():
    rng = np.random.default_rng(5)
    x = np.rint(np.concatenate([rng.normal(size=(400, 8)) + 40 * c for c in range(6)]) * 16)
    most = float((x * x).sum(axis=1).max())
    space = metric_tree._Space(most)
    lifted = space.lift(x)
    pages = [{"route": route, "radius": r, "to_parent": up, "distances": d, "vectors": x[e], "points": e, "least": e}
             for e, route, r, up, d in metric_tree.build_pages(lifted, lifted[0])]
    assert sum(len(p["points"]) for p in pages) == len(x)
    tree = metric_tree.Subtree(pages, lifted[0])
    q = x[2399]
    points, scores = tree.search(q, most, 21, -math.inf)
    best = sorted(zip((-x @ q).tolist(), range(len(x))))[:21]
    assert [-s for s, _ in best] == scores and [p for _, p in best] == points
    assert tree.computed < len(x) / 2


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]),
            (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [-1.0, -2.0]), (4, [1.0, 2.0, 3.0]), (120, [1.0, 2.0, 3.0]),
            (140, [5.0]), (160, [0.0, 0.0]), (160, [0.5, 0.5]), (5, [-0.01, 0.01])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for c in ("score", "rank", "point", "vector", "raw", "query", "ids", "key"):
        table = table.withColumn(c, F.lit("x"))
    assert run(table) == brute(rows)


def test_copies_beyond_k(spark):
    rows = [(i, [1.0, 1.0]) for i in range(200)] + [(i, [0.5, 1.0]) for i in range(200, 230)]
    assert run(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)) == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op4_top_k(spark, sf).collect())) == brute(rows)
