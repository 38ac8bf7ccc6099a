import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations, queries
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.01"


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0A-\x0D]", lowered):
        yield re.findall("[^\x20\x09]+", piece)


def counted(docs):
    f = defaultdict(Counter)
    for text, lang in docs:
        for w in pieces(text):
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang][tuple(w[i:i + n])] += 1
    return f


def inside(short, long):
    return any(long[i:i + len(short)] == short for i in range(len(long) - len(short) + 1))


def brute(docs, least, most):
    out = []
    for lang, f in counted(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        longer = defaultdict(list)
        for p in found:
            for w in set(p):
                longer[w].append(p)
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * found[q] >= 100 * a and inside(p, q) for q in longer[p[0]]):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def some_docs(seed, words="abcdefg"):
    rng = random.Random(seed)
    passage = "one two three four five six"
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 40)))
        rows.append((text + (" " + passage if i % 3 == 0 else ""), rng.choice(["en", "de", None, "und"])))
    return rows + [("Aé bÉ aé bé " * 30, "en"), (None, "en"), ("", None), (" \t..", "xx"), ("a " * 3000, "en")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shard", [200, 1 << 20])
@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_random_texts(spark, monkeypatch, seed, shard, bits):
    """Many small shards and few, a bitmap that is nearly full and one that is not."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    monkeypatch.setattr(collocations, "LEAST_BITS", min(bits, 4096))
    docs = some_docs(seed)
    got = result(collocations.collocations(frame(spark, docs).repartition(5), least=4, most=60))
    assert got == brute(docs, 4, 60)


def test_left_and_right(spark):
    docs = frame(spark, [("x a b. a b y, a b", "en"), ("a b", "de")] * 3)
    every, totals = collocations.frequent_phrases(docs, 3)
    got = {(r["lang"], r["phrase"]): (r["words"], r["f"], r["left"], r["right"]) for r in every.collect()}
    assert got["en", "a b"] == (2, 9, 3, 3) and got["de", "a b"] == (2, 3, 0, 0)
    assert got["en", "x a b"] == (3, 3, 0, 0) and got["en", "b"] == (1, 9, 9, 3)
    assert {r["lang"]: r["n"] for r in totals.collect()} == {"en": 24, "de": 6}


def test_edge_rows(spark):
    docs = documents(spark, EDGE_ROWS, CLASHING + ("a", "phrase", "f", "rank", "cut")).withColumn(
        "lang", F.when(F.col("source") == "b", F.lit(None)).otherwise(F.col("lang")))
    want = brute([tuple(r) for r in docs.select("text", "lang").collect()], 2, 2000)
    assert want and result(collocations.collocations(docs, least=2)) == want


def test_empty(spark):
    assert collocations.collocations(documents(spark, EDGE_ROWS).limit(0)).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert result(queries.op13_collocations(spark, SF)) == brute(docs, 100, 2000)


def test_frequent_hashes_miss_no_pair(spark, monkeypatch):
    """Every pair that is frequent in sum stands in the bitmap, over many shards and merges."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 100)
    docs = some_docs(5)
    index = collocations.index_shards(frame(spark, docs).repartition(7))
    every = collocations.FrequentPhrases(64, np.array([0]), np.array([-1]))
    found = {r[0] for r in collocations.frequent_hashes(index, 2, [every], 5).collect()}
    for lang, f in counted(docs).items():
        pairs = [p for p in f if len(p) == 2]
        langs = pa.array([lang] * len(pairs)).dictionary_encode()
        own = collocations.phrase_hashes([collocations.word_hashes(pa.array([p[i] for p in pairs], type=pa.string()), langs) for i in (0, 1)])
        own = ((own >> np.uint64(32)) << np.uint64(32)).view(np.int64).tolist()
        assert all((h in found) == (f[p] >= 5) for p, h in zip(pairs, own))


def test_exact_score(spark):
    rows = [(10**13 + 7, 10**14 + 9, 10**13 + 11, 10**13 + 13), (100, 10**15, 100, 100), (3, 10, 7, 9)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.exact_score("a", "n", "l", "r")).collect()]
    assert got == [1000 * a * n // (b * c) for a, n, b, c in rows]


def test_intervals_of_both_directions():
    """Every phrase's interval holds its occurrences in either index, however it was extended."""
    docs = ["a b a b c. b a", "c b a, a b a b"]
    rows = next(collocations._index_rows([pa.RecordBatch.from_arrays(
        [pa.array(["en", "en"]), pa.array(docs)], names=["lang", "text"])])).to_pylist()[0]
    row = rows | {"words": pa.array(rows["words"]), "langs": pa.array(rows["langs"])}
    every = collocations.FrequentPhrases(64, np.array([0]), np.array([-1]))
    assert all(collocations.unpacked(collocations.packed(x)).tolist() == x.tolist() for x in
               (np.array([], dtype=np.int64), np.array([7]), np.array([5, 2**32 - 1, 0, 300, 300])))
    want = counted([(d, "en") for d in docs])["en"]
    for n in range(1, 6):
        columns, size, left, right, _ = collocations.shard_phrases(row, n, [every] * 4)
        got = {tuple(rows["words"][c - 1] for c in p): s for *p, s in zip(*columns, size)}
        assert got == {p: c for p, c in want.items() if len(p) == n}
