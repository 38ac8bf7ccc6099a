import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import queries, substrings
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.01"


def brute(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[j:j + window]) for _, w in docs for j in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j:j + window])] > 1:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest())
                  for r in df.collect())


@pytest.mark.parametrize("window", [1, 3, 8, 12])
@pytest.mark.parametrize("frequent", [2, 10**6])
def test_random_texts(spark, monkeypatch, window, frequent):
    """Few different words, shared passages, copies; with frequent prefixes and without."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    rng = random.Random(window)
    shared = [" ".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randint(0, 30)))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        rows.append((i, " \n".join(parts), "a"))
    rows += [(100, rows[3][1], "a"), (101, rows[4][1], "a"), (None, rows[4][1] + " x", "a")]
    got = result(substrings.remove_repeats(documents(spark, rows), window))
    assert got == brute([(i, t) for i, t, _ in rows], window)


@pytest.mark.parametrize("window", [2, 35])
def test_edge_rows(spark, window):
    got = result(substrings.remove_repeats(documents(spark, EDGE_ROWS, CLASHING + ("a", "b", "mask")), window))
    assert got == brute([(i, t) for i, t, _ in EDGE_ROWS], window)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"])
                 for r in queries.op2_remove_repeats(spark, SF).collect())
    assert got == brute(rows, 35)


def test_empty(spark):
    assert substrings.remove_repeats(documents(spark, EDGE_ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [0, 10**6])
def test_windows_that_share_40_bits(spark, monkeypatch, frequent):
    """Different windows of one prefix whose fingerprints agree in 40 bits repeat nothing."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    shared = "all of these words stand before the last "
    pairs = [(100873, 987735), (925209, 1162741), (1328773, 2241422)]
    low = substrings._U(2**40 - 1)
    rows = []
    for pair in pairs:
        texts = [f"{shared}w{n}" for n in pair]
        g, whole = substrings.window_suffixes(*substrings.word_hashes(pa.array(texts)), 9)[3:5]
        assert g[0] == g[1] and whole[0] & low == whole[1] & low
        rows += [(n, t, "a") for n, t in zip(pair, texts)]
    assert result(substrings.remove_repeats(documents(spark, rows), 9)) == brute([(i, t) for i, t, _ in rows], 9)
