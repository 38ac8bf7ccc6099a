import random

import numpy as np
import pytest
import xxhash

from quarry.llm import queries, simhash
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.01"


def fingerprint(text, words=4):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ")
         .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    sh = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r[0], f"{r[1] & (2**64 - 1):016x}", r[2]) for r in df.collect()), key=str)


def test_edge_rows(spark):
    got = result(simhash.near_duplicates(documents(spark, EDGE_ROWS, CLASHING)))
    assert got == brute([(i, t) for i, t, _ in EDGE_ROWS])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op10_simhash(spark, SF).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_connect_what_is_near(spark, bucket):
    """Chains and dense groups of fingerprints, with buckets small enough to be dealt in blocks."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:6]:
        for _ in range(40):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = [(r[0] & (2**64 - 1), r[1] & (2**64 - 1)) for r in simhash.fingerprint_links(table, 4, bucket).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def parts(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for f in fps:
            groups.setdefault(find(f), set()).add(f)
        return {frozenset(g) for g in groups.values()}
    every = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert parts(links) == parts(every)


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, EDGE_ROWS).limit(0)).count() == 0
