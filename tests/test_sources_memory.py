"""Snapshot harvest, CSV round trip, cache / memory / command rules, grading."""

import json

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from quarry.operators import memory as mem
from quarry.plans.answering import parse_grade
from quarry.sources import files as fl
from quarry.sources import snapshots as sn


def _is_clear(role, text):
    return role == "user" and isinstance(text, str) and text.strip().lower() == "clear"


def listing(children):
    return [{"data": {"children": []}}, {"data": {"children": children}}]


def c(body, author="u", kind="t1", score=1):
    d = {"author": author, "score": score}
    if body is not None:
        d["body"] = body
    return {"kind": kind, "data": d}


def test_links_first_of_three_ordered_distinct(spark, tmp_path):
    kids = [c("no links here"), c("see comments/aaa1/ and comments/bbb2/ and comments/aaa1/"),
            c(None), c("comments/ccc3/ later")]
    (tmp_path / "main1.json").write_text(json.dumps(listing(kids)))
    ch = sn.thread_children(sn.read_snapshots(spark, str(tmp_path / "*.json")))
    assert rows(sn.first_links(ch), "thread_id", "link_pos", "link") == [
        ("main1", 0, "aaa1"), ("main1", 1, "bbb2")]


def test_harvest_shared_thread_goes_to_earlier_label(spark, tmp_path):
    body = "a comment long enough to survive"
    (tmp_path / "t1.json").write_text(json.dumps(listing([c(body), c("more text for the day one")])))
    (tmp_path / "g1.json").write_text(json.dumps(listing([c("game thread comment text")])))
    (tmp_path / "t2.json").write_text(json.dumps(listing([c("links comments/g1/ here ok"), c("x", kind="more")])))
    (tmp_path / "bad.json").write_text("{not json")
    threads = spark.createDataFrame([(0, "Open: A vs B", "t1"), (1, "Open: C vs D", "t1"), (2, "Final", "t2")],
                                    "ord long, label string, thread_id string")
    raw = sn.harvest(spark, threads, str(tmp_path))
    from quarry.operators.clean import harvest_filter
    out = rows(harvest_filter(raw, "body", "ord").orderBy("ord"), "match", "body")
    assert ("Open: A vs B (Series)", body) in out
    assert all(m != "Open: C vs D (Series)" for m, _ in out)
    assert ("Final - Game 1", "game thread comment text") in out


def test_csv_round_trip_hard_bodies(spark, tmp_path):
    data = [(0, ' spaced, "quoted"\nsecond line ', "m", 3), (1, "", "m", 0), (2, None, "m", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    fl.write_csv(d, str(tmp_path / "c"))
    back = fl.read_csv(spark, str(tmp_path / "c"), "doc_id long, text string, source string, n_chars long")
    # an empty body reads back as null, as the reference's pandas reader does
    assert sorted(rows(back)) == [data[0], (1, None, "m", 0), data[2]]
    na = spark.createDataFrame([(0, "NA"), (1, "None"), (2, "fine")], "doc_id long, text string")
    fl.write_csv(na, str(tmp_path / "n"))
    back = fl.read_csv(spark, str(tmp_path / "n"), "doc_id long, text string", pandas_na=True)
    assert sorted(rows(back)) == [(0, None), (1, None), (2, "fine")]


def turns_df(spark, data):
    return spark.createDataFrame(data, "session_id long, turn long, role string, content string")


SESSION = [(1, 0, "system", "sys"), (1, 1, "user", "First question?"), (1, 2, "assistant", "A1"),
           (1, 3, "user", "debug"), (1, 4, "user", "  DEBUG why so?  "), (1, 5, "user", "clear"),
           (1, 6, "user", "first question?"), (1, 7, "assistant", "A2")]


def test_command_parse_rules(spark):
    got = sorted(rows(mem.command_parse(turns_df(spark, SESSION).filter("role = 'user'"))))
    assert got == [(1, 1, "ask", False, "First question?"), (1, 3, "debug", True, None),
                   (1, 4, "ask", False, "why so?"), (1, 5, "clear", False, None),
                   (1, 6, "ask", False, "first question?")]


def test_turns_after_quit_are_ended(spark):
    t = turns_df(spark, [(2, 1, "user", "hello there"), (2, 2, "user", " Quit "), (2, 3, "user", "still here?")])
    got = sorted(rows(mem.command_parse(t), "turn", "command", "query"))
    assert got == [(1, "ask", "hello there"), (2, "quit", None), (3, "ended", None)]


def test_memory_reset_and_messages(spark):
    m = mem.memory_since_reset(turns_df(spark, SESSION))
    assert sorted(rows(m, "turn")) == [(0,), (6,), (7,)]
    assert sorted(rows(mem.messages_long(m), "msg_pos", "role")) == [
        (0, "system"), (1, "user"), (2, "assistant")]


def test_cache_hits_bypass_and_upsert(spark):
    t = turns_df(spark, SESSION)
    ex = mem.exchanges(t).withColumn("version", F.col("turn"))
    cache = mem.cache_from_exchanges(ex)
    assert rows(cache, "question_key", "answer") == [("first question?", "A2")]
    q = spark.createDataFrame([(1, " FIRST question? ", False), (2, "first question?", True), (3, "new", False)],
                              "qid long, question string, dbg boolean")
    hits, misses = mem.cache_split(q, cache, ["qid"], bypass_col="dbg")
    assert rows(hits, "qid") == [(1,)]
    assert sorted(rows(misses, "qid")) == [(2,), (3,)]
    new = spark.createDataFrame([("first question?", "A3", 99)], "question_key string, answer string, version long")
    assert rows(mem.cache_upsert(cache, new), "answer") == [("A3",)]


def test_memory_append_numbers_after_last_turn(spark):
    t = turns_df(spark, SESSION)
    ex = spark.createDataFrame([(1, "q1", "a1", 0), (1, "q2", "a2", 1)],
                               "session_id long, question string, answer string, ex_ord long")
    got = sorted(rows(mem.memory_append(t, ex), "turn", "role", "content"))
    assert got == [(8, "user", "q1"), (9, "assistant", "a1"), (10, "user", "q2"), (11, "assistant", "a2")]


def test_grade_parse_and_pass_rate(spark):
    from quarry.operators.stats import guarded_rate
    g = spark.createDataFrame([("PASS",), (" pass.",), ("FAIL",), (None,)], "raw_grade string")
    assert [r[0] for r in rows(g.select(parse_grade()))] == ["PASS", "PASS", "FAIL", "ERROR"]
    agg = g.select(parse_grade().alias("grade")).selectExpr(
        "sum(CASE WHEN grade = 'PASS' THEN 1 ELSE 0 END) AS passed", "count(*) AS total")
    assert rows(agg.select(guarded_rate("passed", "total"))) == [(50.0,)]


def test_stream_memory_matches_simulation(spark):
    from conftest import SF_SMALL
    from quarry.plans.streams import q_stream_memory
    got = {(s, t): n for s, t, n in rows(q_stream_memory(spark, SF_SMALL))}
    pdf = pd.read_parquet(f"{SF_SMALL}/conversations.parquet").sort_values(["conv_id", "turn"])
    want = {}
    for sid, g in pdf.groupby("conv_id"):
        has_sys, size = False, 0
        for r in g.itertuples():
            if _is_clear(r.role, r.text):
                size = 1 if has_sys else 0
            else:
                has_sys = has_sys or r.role == "system"
                size += 1
            want[(sid, r.turn)] = size
    assert got == want


def test_cache_log_load_missing_and_last_write(spark, tmp_path):
    p = str(tmp_path / "cache")
    assert mem.load_cache(spark, p).count() == 0
    mem.save_cache_writes(spark.createDataFrame([("q", "old", 1)], mem.CACHE_SCHEMA), p)
    mem.save_cache_writes(spark.createDataFrame([("q", "new", 2), ("r", "x", 2)], mem.CACHE_SCHEMA), p)
    assert sorted(rows(mem.load_cache(spark, p), "question_key", "answer")) == [("q", "new"), ("r", "x")]


def test_required_column_and_row_label(spark):
    import pytest
    from quarry.functions.text import label_or_row, require_columns
    d = spark.createDataFrame([(0, "m"), (1, None)], "doc_id long, match string")
    with pytest.raises(ValueError):
        require_columns(d, "body")
    assert rows(d.select(label_or_row(d, "match", "doc_id"))) == [("m",), ("Row 1",)]
    nd = d.drop("match")
    assert rows(nd.select(label_or_row(nd, "match", "doc_id"))) == [("Row 0",), ("Row 1",)]


def test_collection_sink_partitioned_dynamic_overwrite(spark, tmp_path):
    from quarry.operators import collections as co
    p = str(tmp_path / "colls")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    a = spark.createDataFrame([("players", 0, "x"), ("comments", 0, "y")], "collection string, doc_id long, text string")
    co.write_collections(a, p)
    b = spark.createDataFrame([("players", 1, "z")], "collection string, doc_id long, text string")
    co.write_collections(b, p)  # rebuilds only the players partition
    got = sorted(rows(spark.read.parquet(p), "collection", "doc_id"))
    assert got == [("comments", 0), ("players", 1)]


def test_json_lines_sink_round_trip(spark, tmp_path):
    p = str(tmp_path / "j")
    d = spark.createDataFrame([(1, "a", ["x", "y"])], "id long, name string, tags array<string>")
    fl.write_json_lines(d, p)
    back = spark.read.schema("id long, name string, tags array<string>").json(p)
    assert rows(back) == [(1, "a", ["x", "y"])]


def test_memory_size_closed_form_matches_simulation(tmp_path):
    import duckdb

    from quarry.plans.streams import ORACLE
    conv = pd.DataFrame({
        "conv_id": [1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3],
        "turn": [0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 0, 1, 2],
        "role": ["system", "user", "assistant", "user", "user", "assistant",
                 "user", "user", "system", "user", "user", "user", "assistant"],
        "text": ["s", "q", "a", " CLEAR ", "q2", "a2", "x", "clear", "late system", "clear",
                 "clear", "y", "z"]})
    p = str(tmp_path / "conversations.parquet")
    conv.to_parquet(p)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{p}')")
    got = {(s, t): n for s, t, n in con.execute(ORACLE["stream_memory"]).fetchall()}
    want = {}
    for sid, g in conv.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        has_sys, size = False, 0
        for r in g.itertuples():
            if _is_clear(r.role, r.text):
                size = 1 if has_sys else 0
            else:
                has_sys = has_sys or r.role == "system"
                size += 1
            want[(sid, r.turn)] = size
    assert got == want


def test_memory_sizes_do_not_depend_on_chunks():
    import random

    import pandas as pd

    from quarry.streaming.memory import _flags, memory_after
    rnd = random.Random(1)
    turns = [(i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["clear", " Clear ", "x", None])) for i in range(300)]
    size, system, want = 0, False, []
    for _, role, content in turns:
        if role == "user" and (content or "").strip().lower() == "clear":
            size = int(system)
        else:
            system |= role == "system"
            size += 1
        want.append(size)
    shuffled = turns[:]
    rnd.shuffle(shuffled)
    chunks = [_flags(pd.DataFrame(shuffled[i:i + 7], columns=["turn", "role", "content"])) for i in range(0, 300, 7)]
    out, has, last = memory_after(pd.concat(chunks), False, 0)
    assert out["memory_size"].tolist() == want and (has, last) == (system, size)
    first = memory_after(pd.concat([_flags(pd.DataFrame(turns[:140], columns=["turn", "role", "content"]))]), False, 0)
    rest = memory_after(_flags(pd.DataFrame(turns[140:], columns=["turn", "role", "content"])), first[1], first[2])
    assert first[0]["memory_size"].tolist() + rest[0]["memory_size"].tolist() == want


def test_a_stream_still_running_is_an_error():
    from quarry.streaming.questions import finish

    class Running:
        stopped = False

        def awaitTermination(self, timeout):
            return False

        def stop(self):
            self.stopped = True
    q = Running()
    import pytest
    with pytest.raises(TimeoutError):
        finish(q, 1)
    assert q.stopped
