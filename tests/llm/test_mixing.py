import glob
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import mixing, queries
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.01"


def test_permutation_is_one_to_one_and_inverts():
    for n in (1, 2, 3, 17, 256, 1000):
        x = np.arange(n)
        y = mixing.permute(x, n, 99)
        assert sorted(y) == list(x)
        assert (mixing.permute(y, n, 99, inverse=True) == x).all()


def test_targets():
    t = mixing.source_targets([100, 100, 100, 0])
    assert t[1] < t[2] < t[0] == 200 and t[3] == 0
    assert abs(sum(t) - 450) < 1e-9
    assert mixing.source_targets([]) == []
    assert mixing.source_targets([10]) == [15.0]


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_edge_rows(spark, block):
    docs = documents(spark, EDGE_ROWS, CLASHING)
    rows = mixing.Mix(docs, block_words=block, shard_blocks=5).taken().collect()
    assert len(rows) == len(EDGE_ROWS)
    by_target = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[(r["source_size"], r["target"])] += r["taken"]
    for (_, target), taken in by_target.items():
        assert taken == int(target)


def test_query(spark):
    first = {tuple(r) for r in queries.op1_mix_sources(spark, SF).collect()}
    src = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(first) == len(src)
    taken, target = defaultdict(int), {}
    for doc, size, source_size, t, n in first:
        assert n <= 2 * size
        taken[src[doc]] += n
        target[src[doc]] = t
    assert {s: int(t) for s, t in target.items()} == dict(taken)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    assert {tuple(r) for r in mixing.Mix(docs).taken().collect()} == first     # in any partitioning


def test_pieces_slots_and_documents_agree(spark):
    docs = documents(spark, EDGE_ROWS, ("lang2",))
    mix = mixing.Mix(docs, block_words=3, shard_blocks=4)
    slots = mix.slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    assert len({(r["source_no"], r["epoch"], r["block"]) for r in slots}) == len(slots)
    pieces = mix.pieces().collect()
    total = sum(r["to_word"] - r["from_word"] for r in pieces)
    assert total == sum(r["taken"] for r in mix.taken().collect())
    out = mixing.mixed_documents(docs, block_words=3, shard_blocks=4)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(r["text"].encode().split()) for r in rows) == total
    texts = {t for _, t, _ in EDGE_ROWS}
    assert any(r["text"] in texts for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_documents_stand_in_slot_order(spark, tmp_path):
    """What is packed follows the shards and slots of the mix, file by file; the epochs of a document stand apart."""
    rows = [(i, f"doc{i} " + "w " * (3 + i % 5), "abc"[i % 3]) for i in range(300)]
    docs = documents(spark, rows)
    options = {"block_words": 8, "shard_blocks": 16}
    place = {}
    for r in mixing.Mix(docs, **options).pieces().collect():
        at = (r["doc_id"], r["epoch"])
        place[at] = min(place.get(at, (9**9,)), (r["from_word"], r["shard"], r["slot"]))
    place = {at: p[1:] for at, p in place.items()}
    path = str(tmp_path / "mixed")
    mixing.mixed_documents(docs, **options).write.parquet(path)
    files = sorted(glob.glob(f"{path}/part-*.parquet"))
    assert len(files) > 2
    order = []
    for f in files:
        order += [r["doc_id"] for r in spark.read.parquet(f).coalesce(1).collect()]
    # slots hold pieces of several documents: within one they may stand in any order
    want = [d for d, _ in sorted(place, key=place.get)]
    assert Counter(order) == Counter(want)
    firsts = sorted(place.values())
    ranks = {}
    for d, e in place:
        ranks.setdefault(d, []).append(place[d, e])
    assert all(firsts[i] in ranks[d] for i, d in enumerate(order))


def test_empty(spark):
    docs = documents(spark, EDGE_ROWS).limit(0)
    assert mixing.Mix(docs).taken().count() == 0
    assert mixing.mixed_documents(docs).count() == 0
