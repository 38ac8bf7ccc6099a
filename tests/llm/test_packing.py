import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing, queries
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.001"


@functools.cache
def reference_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def reference_ids(text):
    return reference_tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, docs, length):
    """Every id in exactly one piece; sequences without gaps; only the last one short."""
    by_seq, total = {}, 0
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        total += r["length"]
    assert total == sum(len(reference_ids(t)) for _, t in docs)
    for s, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length or s == max(by_seq)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(np.array(reference_ids(t), dtype="<u4"))
    for r in rows:
        ids = [x for x in texts[r["doc_id"]] if len(x) == r["doc_tokens"]]
        crcs = {zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) for x in ids}
        assert r["crc"] in crcs


@pytest.mark.parametrize("length", [7, 2048])
def test_edge_rows(spark, length):
    docs = documents(spark, EDGE_ROWS, CLASHING)
    tokens = packing.tokenized(docs, queries.tokenizer_path(), 1)
    rows = packing.pack(tokens, length).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(rows, [(i, t) for i, t, _ in EDGE_ROWS], length)


def test_query_on_whole_table(spark):
    rows = queries.op9_pack(spark, SF).withColumnRenamed("ids_crc32", "crc").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_pieces(rows, [tuple(d) for d in docs], 2048)


def test_empty_table(spark):
    docs = documents(spark, EDGE_ROWS).limit(0)
    tokens = packing.tokenized(docs, queries.tokenizer_path(), 1)
    assert packing.pack(tokens).count() == 0


def test_memory_of_words_may_overflow(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 3)
    tok = packing.WordTokenizer(queries.tokenizer_path())
    texts = ["a b c d e", "f g a", "", "h i j a"]
    for _ in range(2):
        ids, ends = tok.encode(pa.array(texts))
        for t, a, b in zip(texts, ends, ends[1:]):
            assert ids[a:b].tolist() == reference_ids(t)[:-1]


def test_words_of_all_kinds():
    """Parts found here are those of the tokenizer, for characters of many kinds."""
    tok = packing.WordTokenizer(queries.tokenizer_path())
    assert tok.cuts and tok.separable
    rng = np.random.default_rng(0)
    plain = [chr(c) for c in [*range(0x21, 0x7f), *range(0xa1, 0x100)]] + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>"]
    odd = ["\u0130", "\u03a3", "K", "H\u0331", "e\u0301", "\u1e9e", "\u4f60", "\U0001f600", "\x1c", "\x85", "\xa0", "\u2028"]
    words = ["".join(rng.choice(plain, rng.integers(1, 9))) for _ in range(3000)]
    words += ["".join(rng.choice(plain + odd * 8, rng.integers(1, 9))) for _ in range(1500)]
    texts = [" ".join(words[i:i + 5]) for i in range(0, len(words), 5)]
    ids, ends = tok.encode(pa.array(texts))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == reference_ids(t)[:-1], t
