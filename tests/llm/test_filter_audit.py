import itertools
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, queries
from llm_fixtures import CLASHING, EDGE_ROWS, documents

SF = "/root/testdata/sf0.01"


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(j < i for j in ids[t])}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, name in enumerate(order):
                c = [0] * 6
                for fails, g, x in own:
                    before = any(fails[o] for o in order[:k])
                    here = fails[name] and not before
                    c[0] += not before and not here
                    c[1] += here
                    c[2] += fails[name] and before
                    c[3] += fails[name] and sum(fails.values()) == 1
                    c[4] += here and g
                    c[5] += here and x
                shapley[name] += c[1]
                out[part, order, k + 1] = c
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, name in enumerate(order):
                out[part, order, k + 1].append(shapley[name])
    return out


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.FIELDS, "shapley")]
            for r in df.collect()}


def test_edge_rows(spark):
    rows = EDGE_ROWS + [(20, "a b # c", "a"), (21, "AAA BBB", "a"), (22, "x " * 99 + "x", "a"), (6, "AAA BBB", "b"),
                        (23, " ".join(f"w{i % 80}" for i in range(100)), "b"), (24, "A" + "é" * 9, "b"),
                        (25, " ".join(f"w{i % 79}" for i in range(100)), "b")]
    langs = ["en", None, "", "de"]
    docs = documents(spark, rows, CLASHING + ("mask", "good", "total")).withColumn(
        "lang", F.element_at(F.array(*[F.lit(x) for x in langs]), F.pmod(F.coalesce("doc_id", F.lit(1)), F.lit(4)).cast("int") + 1))
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (22, None, 1), (99, 1, 1), (21, 1, 1)]
    got = result(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], labels)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, EDGE_ROWS).limit(0), labels).count() == 0


def test_query(spark):
    def read(name, *cols):
        return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]

    got = result(queries.op12_filter_audit(spark, SF))
    assert got == brute(read("documents", "doc_id", "text", "lang"), read("labels", "doc_id", "quality", "toxic"))


def test_fields_do_not_overflow():
    """A sum of very many integers leaves every field its own count."""
    n = 2**62
    total = n * filter_audit.packed_outcomes(0b00101, True, False) + 3 * filter_audit.packed_outcomes(0, False, False)
    found = filter_audit.unpacked(total.to_bytes(filter_audit.WIDE_BYTES, "little"))
    first = filter_audit.orders().index("ABCDE")
    assert found[first].tolist() == [[3, n, 0, 0, n, 0], [3, 0, 0, 0, 0, 0], [3, 0, n, 0, 0, 0], [3, 0, 0, 0, 0, 0],
                                     [3, 0, 0, 0, 0, 0]]


@pytest.mark.parametrize("parts_at_once", [1, 2])
def test_many_parts(spark, monkeypatch, parts_at_once):
    """Parts that a task sends on one by one add up all the same."""
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", parts_at_once)
    rows = [(f"p{i % 7}", i % 32, i % 2, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame([(p, m, g, int(t)) for p, m, g, t in rows], "part string, mask int, good int, toxic int")
    got = {r["part"]: filter_audit.unpacked(r["total"]) for r in filter_audit.packed_sums(df.repartition(5)).collect()}
    for p in {r[0] for r in rows}:
        want = sum(filter_audit.packed_outcomes(m, bool(g), t) for q, m, g, t in rows if q == p)
        assert (got[p] == filter_audit.unpacked(want.to_bytes(filter_audit.WIDE_BYTES, "little"))).all()


def test_masks_of_slices():
    texts = pa.array(["AB c", "x" * 3, "", "a|b"] * 3).slice(1, 9)
    whole = filter_audit.text_failures(texts).tolist()
    assert whole == [int(filter_audit.text_failures(pa.array([t]))[0]) for t in texts.to_pylist()]
