from collections import defaultdict

import duckdb
import pytest

from quarry.llm import sharding
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", [1, 40, 2000, 1 << 30])
def test_edge_rows(spark, limit):
    docs = documents(spark, EDGE_ROWS + [(4, "one two three four five", "a")] * 30, CLASHING)
    rows = sharding.shards(docs, limit).collect()
    assert len(rows) == docs.count()
    held = defaultdict(int)
    for r in rows:
        assert r["bits"].startswith(r["shard"]) and len(r["shard"]) == r["depth"] and len(r["bits"]) == 64
        held[r["shard"], r["page"]] += r["n_bytes"]
    count = defaultdict(int)
    for r in rows:
        assert held[r["shard"], r["page"]] == r["shard_bytes"]
        count[r["shard"], r["page"]] += 1
    for at, n in held.items():
        assert n <= limit or count[at] == 1
    names = {s for s, _ in held}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for s in names:                             # a shard's parent had to split
        if s:
            assert sum(r["n_bytes"] for r in rows if r["bits"].startswith(s[:-1])) > limit


@pytest.mark.parametrize("limit", [3000, 1 << 20])
def test_against_sql(spark, limit, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shards(docs, limit).drop("bits")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(sharding.ORACLE.format(limit=limit))
    cols = want.columns
    assert sorted(map(str, got.select(cols).toPandas().itertuples(index=False, name=None))) == sorted(
        map(str, want.df().itertuples(index=False, name=None)))


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROUND_BITS", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = {tuple(r) for r in sharding.shards(docs, 5000).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in sharding.shards(docs, 5000).collect()}


def test_files(spark, tmp_path):
    docs = documents(spark, EDGE_ROWS, ("shard", "bits"))
    sharding.write_shards(docs, str(tmp_path / "out"), 40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(EDGE_ROWS)
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_empty(spark):
    assert sharding.shards(documents(spark, EDGE_ROWS).limit(0), 10).count() == 0
