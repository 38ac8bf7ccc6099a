"""The ordered document, entity defaults, coach variants and masked pooling on hand-made rows."""

import glob
import json
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarry.operators import dense as dn
from quarry.operators import prompts as pr
from quarry.operators import report as rp
from quarry.operators import sparse as sp
from quarry.operators import stats as stt
from quarry.sources import files as fl


@pytest.mark.parametrize("n", [0, 1, 500])
def test_ordered_document(spark, tmp_path, n):
    """The parts, one after the other, are one JSON document in order; read back in parallel they give the same."""
    path = str(tmp_path / "doc")
    d = spark.range(n).select("id", F.concat(F.lit('Na"me\n, é '), "id").alias("name"), (F.col("id") % 7).alias("rank"),
                              F.when(F.col("id") % 3 == 0, F.lit("}},")).alias("note")).repartition(6)
    value = F.to_json(F.struct("id", "note"), {"ignoreNullFields": "false"})
    fl.write_ordered_document(d, path, "name", value, [F.desc("rank"), F.asc("id")], {"title": "t"}, "total", "items")
    whole = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))
    doc = json.loads(whole)
    want = sorted(range(n), key=lambda i: (-(i % 7), i))
    assert doc["meta"] == {"title": "t", "total": n}
    assert [(k, v["id"], v["note"]) for k, v in doc["items"].items()] == [(f'Na"me\n, é {i}', i, "}}," if i % 3 == 0 else None) for i in want]
    found, meta = fl.read_ordered_document(spark, path, "id bigint, note string", "title string, total bigint", "items")
    assert rows(meta) == [("t", n)]
    assert sorted(rows(found, "pos", "key", "id", "note")) == [(p, f'Na"me\n, é {i}', i, "}}," if i % 3 == 0 else None) for p, i in enumerate(want)]
    if n > 100:
        assert len(glob.glob(f"{path}/part-*")) > 2


def test_base_entry_defaults(spark):
    roster = spark.createDataFrame([("Aa", "Ah Ah"), ("Bb", "Bee")], "data_dragon_key string, display_name string")
    base = spark.createDataFrame([("Aa", "A a", "the first", ["x", "y"], "long ago")],
                                 "data_dragon_key string, name string, title string, tags array<string>, blurb string")
    got = sorted(rows(stt.base_entry(roster, base, "1.2", "https://h/cdn"), "data_dragon_key", "name", "title", "tags", "blurb", "image"))
    assert got == [("Aa", "A a", "the first", ["x", "y"], "long ago", "https://h/cdn/1.2/img/champion/Aa.png"),
                   ("Bb", "Bee", "Unknown", [], "", None)]


def test_coach_read_as_variant(spark, tmp_path):
    """A document whose coach is an object, a text, null, empty or absent, read with one schema."""
    teams = [{"abbr": "A", "coach": {"ign": "Co", "real_name": "Real N."}}, {"abbr": "B", "coach": "Plain \"Name\""},
             {"abbr": "C"}, {"abbr": "D", "coach": None}, {"abbr": "E", "coach": ""}, {"abbr": "F", "coach": {"ign": "Solo"}}]
    p = tmp_path / "teams.json"
    p.write_text("\n".join(map(json.dumps, teams)))
    t = spark.read.schema("abbr string, coach variant").json(str(p))
    got = dict(rows(t.select("abbr", rp.coach_text().alias("c"))))
    assert got == {"A": " Coach: Co (Real N.)", "B": ' Coach: Plain "Name"', "C": "", "D": "", "E": "", "F": " Coach: Solo (None)"}


def test_report_lines(spark):
    t = spark.createDataFrame([("AA", "Team A", "EU", "Champion", [("top", "P1"), ("mid", "P2")], None)],
                              "abbr string, full_name string, region string, result string, roster array<struct<role:string,name:string>>, c string")
    assert rows(t.withColumn("coach", F.parse_json("c")).select(rp.roster_line())) == [("Team A/AA (EU, Champion): P1 (top), P2 (mid).",)]
    g = spark.createDataFrame([("Group A", ["X", "Y"], ["Z"]), ("Group B", [], ["Q", "R"])],
                              "group_name string, advanced array<string>, eliminated array<string>")
    assert rows(g.select(rp.group_line())) == [("- Group A: X and Y advanced. Z eliminated.",), ("- Group B:  advanced. Q and R eliminated.",)]
    n = spark.createDataFrame([("Upset", "They won.")], "narrative string, description string")
    assert rows(n.select(rp.storyline())) == [("- Upset: They won.",)]


def test_masks_drop_rows(spark):
    t = spark.createDataFrame([(1, [2.0, 4.0], 1), (1, [4.0, 0.0], 1), (1, [100.0, 100.0], 0), (2, [7.0, 7.0], 0)],
                              "doc_id long, embedding array<double>, m int")
    got = {(r["doc_id"], r["dim"]): r["value"] for r in dn.mean_pool(t, "doc_id", mask_col="m").collect()}
    assert got == {(1, 0): 3.0, (1, 1): 2.0, (2, 0): 0.0, (2, 1): 0.0}
    w = spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 3.0, 1), (1, "a", 9.0, 0), (1, "b", 5.0, 0), (1, "c", -1.0, 1)],
                              "doc_id long, term string, logit double, m int")
    assert rows(sp.sparse_weights(w, mask_col="m"), "doc_id", "term", "weight") == [(1, "a", pytest.approx(math.log1p(3.0)))]


def test_debug_lines(spark):
    """Three decimals as printf gives them: the binary value decides, also where the shortest decimal ends in 5."""
    rng = random.Random(3)
    values = [0.0005, 0.0015, 0.6345, 0.6355, 1.0005, 2.5, 0.1235, 12.3445, 0.0, 123456.8905, 0.0625, 0.1875, 0.0004999999, 1e-30,
              2.0 ** 20 - 2.0 ** -30, -0.0005, -1.2345] + [round(rng.uniform(0, 3), 4) for _ in range(300)] + [rng.random() for _ in range(100)]
    r = spark.createDataFrame([(1, "comments", i + 1, i, v, "text", "m") for i, v in enumerate(values)],
                              "qid long, collection string, rk long, doc_id long, score double, text string, match string")
    got = [x[0] for x in pr.debug_lines(r, n_comments=999).orderBy("rk").select("line").collect()]
    assert got == [f"[{v:.3f}] [m] text..." for v in values]


def test_debug_lines_by_name(spark):
    r = spark.createDataFrame([(1, c, 1, d, 0.5, "x" * 200, "m") for c, d in
                               (("comments", 1), ("players", 1), ("players", 2), ("players", 3), ("tournament", 1))],
                              "qid long, collection string, rk long, doc_id long, score double, text string, match string")
    named = spark.createDataFrame([("players", 1, "Ann", "Reds"), ("players", 2, "Solo", None)],
                                  "collection string, doc_id long, name string, detail string")
    got = sorted(x[0] for x in pr.debug_lines(r, named=named).select("line").collect())
    assert got == sorted(["[0.500] [m] " + "x" * 80 + "...", "[0.500] Ann (Reds)", "[0.500] Solo (?)", "[0.500] ? (?)",
                          "[0.500] " + "x" * 100 + "..."])
