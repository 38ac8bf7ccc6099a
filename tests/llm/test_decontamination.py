import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontamination, queries, suffix_arrays
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.01"
TESTS = "item_id long, text string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, tests, window):
    items = [(i, words(t)) for i, t in tests]
    windows = {}
    for i, w in items:
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out)


def result(found):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(
        ",".join(x for x in r["items"] if x is not None).encode()).hexdigest()) for r in found.collect())


def random_case(seed):
    rng = random.Random(seed)
    tests = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 5, 9, 30])))) for i in range(12)]
    tests += [(3, "zz yy xx ww"), (None, "qq rr ss tt uu"), (77, None), (78, tests[5][1]), (79, "b b b b b b b b b")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30))), rng.choice(tests)[1] or "", "x1"]
        rng.shuffle(parts)
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts), "a"))
    docs += [(90, docs[3][1], "a"), (91, docs[3][1], "a"), (None, "Qq RR\tss tt-uu", "b"), (92, "b " * 3000, "b")]
    return docs, tests


@pytest.mark.parametrize("window", [1, 4, 10])
@pytest.mark.parametrize("blocks", [False, True])
def test_random_texts(spark, monkeypatch, window, blocks):
    """Few different words, so that windows occur often; test texts in one block and in many."""
    if blocks:
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", 40)
        monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    docs, tests = random_case(window)
    found = decontamination.find_matches(documents(spark, docs), spark.createDataFrame(tests, TESTS), window)
    assert result(found) == brute([(i, t) for i, t, _ in docs], tests, window)


def test_edge_rows(spark):
    docs = documents(spark, EDGE_ROWS, CLASHING + ("a", "b", "item_id", "spans", "gone"))
    tests = spark.createDataFrame([(1, "Two three FOUR"), (2, None), (None, "word word"), (4, "it s <|endoftext|>"), (5, "?!")], TESTS)
    found = decontamination.find_matches(docs, tests, 10)
    want = brute([(i, t) for i, t, _ in EDGE_ROWS], [tuple(r) for r in tests.collect()], 10)
    assert result(found) == want
    left = decontamination.decontaminated(docs, tests, 10)
    assert left.columns == docs.columns
    clean = sorted(x[0] for x in want if not x[2])
    assert sorted(str(r["doc_id"]) for r in left.collect()) == clean


def test_empty(spark):
    docs, tests = documents(spark, EDGE_ROWS), spark.createDataFrame([(1, "one two")], TESTS)
    assert decontamination.find_matches(docs.limit(0), tests).count() == 0
    assert {r["n_hit"] for r in decontamination.find_matches(docs, tests.limit(0)).collect()} == {0}
    assert decontamination.decontaminated(docs, tests.limit(0)).count() == len(EDGE_ROWS)


def test_longest_matches(spark):
    docs = documents(spark, [(1, "a b c d e f", "a"), (2, "x c d e f g h y", "a"), (3, "c d e f g h", "a"), (4, "g h i", "a")])
    tests = spark.createDataFrame([(7, "a b c d e f g h i")], TESTS)
    found = decontamination.find_matches(docs.coalesce(1), tests, 3)
    assert [r["n_hit"] for r in found.orderBy("doc_id").collect()] == [6, 6, 6, 3]
    best = {(r["item"], r["item_word"]): (r["length"], r["doc_id"], r["doc_word"])
            for r in decontamination.longest_matches(found).collect()}
    assert best == {("7", 0): (6, 1, 0), ("7", 2): (6, 2, 1), ("7", 6): (3, 4, 0)}


def test_query(spark):
    def read(name, *cols):
        return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]

    got = queries.op11_decontaminate(spark, SF).collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == brute(
        read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), 10)


@pytest.mark.parametrize("kinds", [1, 2, 50, 10**6])
def test_suffix_array(kinds):
    rng = np.random.default_rng(kinds)
    code = rng.integers(1, kinds + 1, 400)
    order = suffix_arrays.suffix_array(code, 400)
    assert [code[i:].tolist() for i in order] == sorted(code[i:].tolist() for i in range(400))


def test_shard_of_slices():
    """A batch that starts inside a longer one."""
    texts = pa.array(["zz", "one two three", "", "two three four"]).slice(1, 3)
    tests = decontamination.TestBlock(pa.table({"item": ["1"], "begin": [0], "piece": [["two", "three"]]}))
    words_of, (pos, size, _), items, _, begin = decontamination.shard_matches(texts, tests, 2)
    assert words_of.tolist() == [3, 0, 3] and begin.tolist() == [0, 4, 5]
    assert sorted(pos.tolist()) == [1, 5] and size.tolist() == [2, 2] and [x.tolist() for x in items] == [[0]]
