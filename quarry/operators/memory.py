"""Answer cache and conversation memory as tables.

Per-session state (reset segments, debug toggles, positions) is computed with
range-partitioned running sums, not a window over the whole session, so one
session holding a third of all turns still spreads over many tasks.  Pairing a
question with its answer is an equi-join on (session, turn + 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.ordering import positions_within, running_sum_within, running_sums_within
from quarry.functions.text import py_strip

# The console's commands.
CMD_QUIT = "quit"
CMD_CLEAR = "clear"
CMD_DEBUG = "debug"


def cache_key(col) -> F.Column:
    return F.lower(py_strip(col))


def exchanges(turns: DataFrame) -> DataFrame:
    """(session_id, turn, question, answer): a user turn answered by the next turn."""
    u = turns.filter(F.col("role") == "user").select("session_id", "turn",
                                                     py_strip("content").alias("question"))
    a = turns.filter(F.col("role") == "assistant").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer"))
    return u.join(a, ["session_id", "turn"])


def latest_per_key(writes: DataFrame) -> DataFrame:
    """(question_key, answer, version): last version wins per key.
    The last version is found over numbers with a map-side aggregate, so a hot key costs
    one row per task before the shuffle; only rows of that version carry their answer on."""
    narrow = writes.select("question_key", "version")
    # the answer texts stay out of the aggregate: numbers hash-aggregate, strings would sort
    last = narrow.groupBy("question_key").agg(F.max("version").alias("version")).select(
        F.col("question_key").alias("l_key"), F.col("version").alias("l_version"))
    kept = writes.join(last, F.col("question_key").eqNullSafe(F.col("l_key"))
                       & F.col("version").eqNullSafe(F.col("l_version")))
    return kept.groupBy("question_key", "version").agg(F.max("answer").alias("answer")).select(
        "question_key", "answer", "version")


def cache_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of the stored cache and new answers, last write wins."""
    cols = ["question_key", "answer", "version"]
    return latest_per_key(old.select(*cols).unionByName(new.select(*cols)))


def cache_from_exchanges(ex: DataFrame, version_col: str = "version") -> DataFrame:
    return latest_per_key(ex.select(cache_key("question").alias("question_key"), "answer",
                                    F.col(version_col).alias("version")))


def cache_split(questions: DataFrame, cache: DataFrame, id_cols, key_of: str = "question",
                bypass_col: str | None = None):
    """(hits, misses) of a question table against the cache.  Hits carry the cached
    answer; questions with ``bypass_col`` true (debug mode) always miss."""
    id_cols = list(id_cols)
    q = questions.withColumn("question_key", cache_key(key_of))
    eligible = q if bypass_col is None else q.filter(~F.coalesce(F.col(bypass_col), F.lit(False)))
    hits = eligible.join(cache.select("question_key", "answer"), "question_key")
    misses = q.join(hits.select(*id_cols), id_cols, "left_anti")
    return hits, misses


def command_parse(user_turns: DataFrame) -> DataFrame:
    """(session_id, turn, command, debug_on, query) for user turns.

    ``quit`` / ``clear`` are exact (case-insensitive, trimmed); any text starting
    with ``debug`` toggles debug mode (running parity) and, unless it is exactly
    ``debug``, its remainder after 5 characters is asked; empty queries are
    skipped (command ``skip``); turns after the session's first ``quit`` are
    ``ended``."""
    t = user_turns.withColumn("__q", py_strip("content")).withColumn("__l", F.lower("__q"))
    t = t.withColumn("__tog", F.when(
        (F.col("__l") != CMD_QUIT) & (F.col("__l") != CMD_CLEAR) & F.col("__l").startswith(CMD_DEBUG),
        1).otherwise(0))
    t = t.withColumn("__quit", F.when(F.col("__l") == CMD_QUIT, 1).otherwise(0))
    t = running_sums_within(t, ["session_id"], [F.asc("turn")], {"__tog": "__ntog", "__quit": "__nquit"})
    query = F.when(F.col("__tog") == 1, py_strip(F.substring("__q", 6, 1 << 30))).otherwise(F.col("__q"))
    # the console loop stops at the first quit: later turns are never processed
    cmd = (F.when(F.col("__nquit") - F.col("__quit") > 0, F.lit("ended"))
            .when(F.col("__l") == CMD_QUIT, F.lit("quit"))
            .when(F.col("__l") == CMD_CLEAR, F.lit("clear"))
            .when(F.col("__l") == CMD_DEBUG, F.lit("debug"))
            .when(query == "", F.lit("skip"))
            .otherwise(F.lit("ask")))
    return t.select("session_id", "turn", cmd.alias("command"),
                    (F.pmod(F.col("__ntog"), F.lit(2)) == 1).alias("debug_on"),
                    F.when(cmd == "ask", query).alias("query"))


def memory_since_reset(turns: DataFrame) -> DataFrame:
    """Turns still in memory: the system turn plus every turn after the session's
    last ``clear`` (the clear turns themselves are not kept)."""
    t = turns.withColumn("__clr", F.when((F.col("role") == "user")
                                         & (F.lower(py_strip("content")) == CMD_CLEAR), 1).otherwise(0))
    t = running_sum_within(t, ["session_id"], [F.asc("turn")], "__clr", "__seg")
    last = t.groupBy("session_id").agg(F.max("__seg").alias("__last"))
    t = t.join(last, "session_id")
    keep = (F.col("role") == "system") | ((F.col("__seg") == F.col("__last")) & (F.col("__clr") == 0))
    return t.filter(keep).select(*turns.columns)


def messages_long(memory: DataFrame) -> DataFrame:
    """(session_id, msg_pos, role, content): the message list of each session in
    long form (0-based positions), without collecting a session into one row."""
    return positions_within(memory, ["session_id"], [F.asc("turn")], out="msg_pos").select(
        "session_id", "msg_pos", "role", "content")


#: Messages in a block: what a question joins with, besides the block it stands in itself.
MESSAGE_BLOCK = 1024


def messages_at(turns: DataFrame, asked: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(session_id, turn, msg_pos, role, content): for every question the message list as it is sent -- the
    memory at that turn, in turn order, and the question itself last.

    The memory at a turn holds the system turns before it and the turns between the session's last ``clear``
    before it and the turn.  ``asked`` (session_id, turn, content) are the questions with what is sent for them
    (a prompt, say); by default every user turn that is no ``clear``, as it is.  Turns are numbered uniquely in a
    session.

    Positions come from running sums.  A question meets its memory by blocks of ``block`` messages, keyed by
    (session, segment, block), so that a session of very many turns spreads over many tasks."""
    size = block or MESSAGE_BLOCK
    user_clear = (F.col("role") == "user") & (F.lower(py_strip("content")) == CMD_CLEAR)
    clear = F.coalesce(user_clear, F.lit(False))
    system = ~clear & F.coalesce(F.col("role") == "system", F.lit(False))
    t = turns.select("session_id", "turn", "role", "content", clear.cast("int").alias("__clr"),
                     system.cast("int").alias("__sys"), (~clear & ~system).cast("int").alias("__own"))
    t = running_sums_within(t, ["session_id"], [F.asc("turn")],
                            {"__clr": "__seg", "__sys": "__nsys", "__own": "__nown"})
    # before a turn: its segment's start, system turns, own turns
    t = t.withColumns({"__sys_at": F.col("__nsys") - F.col("__sys"), "__own_at": F.col("__nown") - F.col("__own")})
    from quarry.session import materialize
    t = materialize(t, "message-turns")
    base = t.groupBy("session_id", "__seg").agg(F.min("__own_at").alias("__base"))
    based = t.join(base, ["session_id", "__seg"])
    questions = based.where((F.col("role") == "user") & (F.col("__clr") == 0))
    if asked is not None:
        questions = questions.drop("content").join(asked.select("session_id", "turn", "content"), ["session_id", "turn"])
    questions = materialize(questions.select(
        "session_id", "turn", "content", "__seg", "__base", "__sys_at", (F.col("__own_at") - F.col("__base")).alias("__idx")),
        "message-questions")

    def blocks(upto):
        """The blocks that hold the first ``upto`` messages."""
        n = F.ceil(F.col(upto) / F.lit(size)).cast("int")
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    def keyed(rows, kind, segment, block_col):
        return rows.select("*", F.lit(kind).alias("__kind"), segment.alias("__part"), block_col.alias("__block"))

    wants = keyed(questions, 0, F.col("__seg"), blocks("__idx")).unionByName(
        keyed(questions, 1, F.lit(0).cast("bigint"), blocks("__sys_at")))
    wants = wants.select(F.col("session_id").alias("q_session"), F.col("turn").alias("q_turn"), F.col("__idx").alias("q_idx"),
                         F.col("__sys_at").alias("q_sys"), F.col("__base").alias("q_base"), "__kind", "__part", "__block")
    idx = F.col("__own_at") - F.col("__base")
    holds = keyed(based.where("__own = 1").withColumn("__i", idx), 0, F.col("__seg"), F.floor(F.col("__i") / size).cast("int"))
    holds = holds.unionByName(keyed(based.where("__sys = 1").withColumn("__i", F.col("__sys_at")), 1,
                                    F.lit(0).cast("bigint"), F.floor(F.col("__i") / size).cast("int")))
    holds = holds.select("session_id", "role", "content", "__i", "__sys_at", "__own_at", "__kind", "__part", "__block")
    met = holds.join(wants, (F.col("session_id") == F.col("q_session")) & (holds["__kind"] == wants["__kind"])
                     & (holds["__part"] == wants["__part"]) & (holds["__block"] == wants["__block"]))
    met = met.where(F.col("__i") < F.when(holds["__kind"] == 0, F.col("q_idx")).otherwise(F.col("q_sys")))
    # an own turn stands after the system turns before it, a system turn after the segment's turns before it
    pos = F.when(holds["__kind"] == 0, F.col("__sys_at") + F.col("__i")).otherwise(
        F.col("__sys_at") + F.greatest(F.col("__own_at") - F.col("q_base"), F.lit(0)))
    memory = met.select("session_id", F.col("q_turn").alias("turn"), pos.cast("bigint").alias("msg_pos"), "role", "content")
    own = questions.select("session_id", "turn", (F.col("__sys_at") + F.col("__idx")).cast("bigint").alias("msg_pos"),
                           F.lit("user").alias("role"), "content")
    return memory.unionByName(own)


def memory_append(memory: DataFrame, new_exchanges: DataFrame) -> DataFrame:
    """Rows appended to each session: the question alone (no context block), then
    the answer, numbered after the session's last turn in exchange order."""
    last = memory.groupBy("session_id").agg(F.max("turn").alias("__last"))
    ex = positions_within(new_exchanges, ["session_id"], [F.asc("ex_ord")], out="__i")
    ex = ex.join(last, "session_id", "left").withColumn("__base",
                                                        F.coalesce("__last", F.lit(-1)) + 1 + 2 * F.col("__i"))
    user = ex.select("session_id", F.col("__base").alias("turn"), F.lit("user").alias("role"),
                     F.col("question").alias("content"))
    asst = ex.select("session_id", (F.col("__base") + 1).alias("turn"), F.lit("assistant").alias("role"),
                     F.col("answer").alias("content"))
    return user.unionByName(asst)


CACHE_SCHEMA = "question_key string, answer string, version long"


def save_cache_writes(writes: DataFrame, path: str) -> None:
    """Append a batch of cache writes (question_key, answer, version) to the cache
    log; readers resolve last-write-wins, so a rewrite never loses old answers."""
    writes.select("question_key", "answer", "version").write.mode("append").parquet(path)


def load_cache(spark, path: str) -> DataFrame:
    """Current cache from the write log; a missing cache is empty, any other error is raised."""
    from pyspark.errors import AnalysisException
    try:
        log = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return latest_per_key(log)
