"""The question feed, turns as state and message lists at a turn, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import memory as mem
from quarry.operators import prompts as pr
from quarry.streaming import feed as fd
from quarry.streaming import turns as st

TURNS = "session_id long, turn long, role string, content string"
FILES = "conv_id long, turn long, role string, text string"


def random_turns(seed, sessions=6, n=60):
    rng = random.Random(seed)
    out = []
    for s in range(sessions):
        for t in range(rng.choice([0, 1, 5, n])):
            role = rng.choices(["user", "assistant", "system", None], [6, 6, 1, 0.3])[0]
            out.append((s, t, role, rng.choice(["clear", " CLEAR\n", "x", "y z", "", None]) if rng.random() < 0.4 else f"m{t}"))
    return out


def is_clear(role, content):
    return role == "user" and (content or "").strip().lower() == "clear"


def memory_of(turns):
    """The console's list after all turns: system turns, then what came after the last clear."""
    memory = {}
    for s, t, role, content in sorted(turns, key=lambda x: (x[0], x[1])):
        own = memory.setdefault(s, [])
        if is_clear(role, content):
            own[:] = [m for m in own if m[1] == "system"]
        else:
            own.append((t, role, content))
    return sorted(((s, *m) for s, own in memory.items() for m in own), key=str)


@pytest.mark.parametrize("seed,block", [(1, None), (2, 3), (3, 1)])
def test_messages_at(spark, seed, block):
    turns = random_turns(seed)
    want = []
    for s, t, role, content in turns:
        if role == "user" and not is_clear(role, content):
            before = [x for x in turns if x[0] == s and x[1] < t]
            list_ = [(r, c) for _, _, r, c in sorted(memory_of(before), key=lambda m: m[1])] + [("user", content)]
            want += [(s, t, i, r, c) for i, (r, c) in enumerate(list_)]
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    assert sorted(map(tuple, mem.messages_at(df, block=block).collect()), key=str) == sorted(want, key=str)


def test_messages_at_with_what_is_sent(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "p")], TURNS)
    sent = spark.createDataFrame([(1, 3, "context and p"), (1, 2, "no question")], "session_id long, turn long, content string")
    got = sorted(tuple(r) for r in mem.messages_at(turns, sent).collect())
    assert got == [(1, 3, 0, "system", "s"), (1, 3, 1, "user", "q"), (1, 3, 2, "assistant", "a"), (1, 3, 3, "user", "context and p")]


def test_messages_of_a_hot_session_are_spread(spark):
    """No task holds a session's memory whole: the join is keyed by blocks."""
    turns = spark.range(40).select(F.lit(1).alias("session_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 39, "user").otherwise("assistant").alias("role"), F.lit("m").alias("content"))
    met = mem.messages_at(turns, block=8)
    assert met.where("turn = 39").count() == 40
    assert "__block" in met._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_turns(spark, tmp_path, seed):
    """Turns arrive in files that cut sessions anywhere; late ones come after their clear."""
    turns = random_turns(seed)
    rng = random.Random(seed)
    parts = [[], [], []]
    for x in turns:
        parts[min(x[1] // 25, 2) if rng.random() < 0.9 else 2].append(x)
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    seen = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, FILES).coalesce(1).write.parquet(f"{path}/p={i}")
        st.keep_turns(st.turns_of_files(spark, f"{path}/p=*"), checkpoint)
        seen += part
        got = sorted((tuple(r) for r in st.stored_turns(spark, checkpoint).collect()), key=str)
        assert got == memory_of(seen)
    df = spark.createDataFrame(turns, TURNS)
    assert sorted(map(tuple, mem.memory_since_reset(df).collect()), key=str) == memory_of(turns)


def test_a_silent_session_is_forgotten(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    for i, (session, wait) in enumerate([(1, 0), (2, 1.5)]):
        time.sleep(wait)
        spark.createDataFrame([(session, 0, "user", "hello"), (session, 1, "system", "s")], FILES).write.parquet(f"{path}/p={i}")
        st.keep_turns(st.turns_of_files(spark, f"{path}/p=*"), checkpoint, expiry_ms=1000)
        assert {r["session_id"] for r in st.stored_turns(spark, checkpoint).collect()} == {session}


class Console:
    """The reference loop's order of things for one question after the other."""

    def __init__(self, answers, refused):
        self.answers, self.refused, self.cache, self.memory = answers, refused, {}, []

    def ask(self, qid, session, text):
        q = text.strip()
        if not q:
            return None
        if q.lower() in self.cache:
            got = ("cached", self.cache[q.lower()])
        elif q in self.refused:
            return (qid, "refused", pr.REFUSAL)
        elif q not in self.answers:
            return (qid, "failed", None)
        else:
            got = ("answered", self.answers[q])
            self.cache[q.lower()] = got[1]
        self.memory += [(session, qid, "user", q), (session, qid, "assistant", got[1])]
        return (qid, *got)


def make_feed(spark, path, answers, refused):
    calls = []

    def retrieve(questions):
        calls.append(sorted(r[0] for r in questions.select("qid").collect()))
        score = F.when(F.col("question").isin(refused), 0.05).otherwise(0.5)
        return questions.select("qid", F.lit("comments").alias("collection"), F.lit(1).cast("long").alias("rk"), F.lit(7).cast("long").alias("doc_id"),
                                score.alias("score"), F.lit("text").alias("text"), F.lit("m").alias("match"), F.lit(3).alias("upvotes"))

    known = spark.createDataFrame(list(answers.items()), "q string, answer string")

    def answer(prompts):
        return prompts.withColumn("q", F.substring_index("message", "Question: ", -1)).join(known, "q")

    sections = pr.section_table(spark, [("comments", "Reactions:")])
    return fd.Feed(retrieve, answer, sections, path), calls


def test_feed(spark, tmp_path):
    answers, refused = {"How many?": "42", "Who?": "Me", "why": "because"}, ["Never"]
    feed, calls = make_feed(spark, str(tmp_path / "feed"), answers, refused)
    console = Console(answers, refused)
    batches = [[(1, 10, "How many?"), (2, 10, " how many?  "), (3, 11, "Never"), (4, 11, "Unknown"), (5, 12, "")],
               [(6, 10, "HOW MANY?"), (7, 13, "Who?"), (8, 13, "Never"), (9, 13, "unknown"), (10, 13, "why"), (11, 10, "WHO?")]]
    want = []
    arrived, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "qid long, session_id long, question string").coalesce(1).write.parquet(f"{arrived}/p={i}")
        feed.run(spark.readStream.schema("qid long, session_id long, question string").parquet(f"{arrived}/p=*"), checkpoint)
        want += [x for x in (console.ask(*q) for q in batch) if x]
    rows = feed.answers(spark).collect()
    assert sorted((r["qid"], r["status"], r["answer"]) for r in rows) == want
    assert sorted(tuple(r)[:4] for r in feed.memory(spark).collect()) == sorted(console.memory)
    assert {r["qid"] for r in rows if r["message"]} == {1, 4, 7, 9, 10}
    # a repeated question is not looked up again, neither in its batch nor in the next
    assert calls == [[1, 3, 4], [7, 8, 9, 10]]


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    feed, calls = make_feed(spark, str(tmp_path / "feed"), {"a": "1", "b": "2"}, [])

    def state():
        return [sorted(map(tuple, t.collect()), key=str) for t in (feed.answers(spark), feed.memory(spark), feed.cache_before(spark, 99))]

    batches = [spark.createDataFrame(x, "qid long, session_id long, question string") for x in
               ([(1, 1, "a")], [(2, 1, "A "), (3, 2, "b")], [(4, 2, "c")])]
    for i, b in enumerate(batches):
        feed.process(b, i)
    before = state()
    for i in (1, 0, 2, 1):
        feed.process(batches[i], i)
    assert state() == before
    assert [x[:3] for x in before[0]] == [(1, 1, "answered"), (2, 1, "cached"), (3, 2, "answered"), (4, 2, "failed")]


def test_an_empty_feed(spark, tmp_path):
    feed, calls = make_feed(spark, str(tmp_path / "feed"), {"a": "1"}, [])
    feed.process(spark.createDataFrame([], "qid long, session_id long, question string"), 0)
    assert feed.answers(spark).count() == 0 and not calls
