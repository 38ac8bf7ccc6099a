"""The turns themselves as keyed state of a stream: what each session has in memory.

``transformWithStateInPandas`` with a list of turns per session.  A user ``clear`` forgets all turns before it
but system turns.  Whether a turn is kept depends only on the last clear's number, so turns may arrive in any
order and in any number of chunks: each chunk is appended as it comes and a session is never put together.  With
an expiry, a timer forgets a session that has been silent for so long.

The stored turns are read from the state with Spark's state reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.session import shared_path
from quarry.streaming.questions import finish

TURN = "turn long, role string, content string"
KEPT = "session_id long, kept long"
CLEAR = "clear"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionTurns(StatefulProcessor):
    """State of a session: ``turns`` since the last clear, ``system`` turns, the ``cleared`` turn's number."""

    def __init__(self, expiry_ms: int | None = None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", TURN)
        self.system = handle.getListState("system", TURN)
        self.cleared = handle.getValueState("cleared", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.cleared.get()
        last = int(last[0]) if last is not None else None
        kept = 0
        for chunk in rows:
            chunk = chunk.astype({"role": object, "content": object}).where(chunk.notna(), None)
            words = chunk["content"].map(lambda c: (c or "").strip().lower())
            clear = chunk["role"].eq("user") & words.eq(CLEAR)
            system = chunk["role"].eq("system")
            newest = chunk.loc[clear, "turn"].max() if clear.any() else None
            if newest is not None and (last is None or newest > last):
                last = int(newest)
                self.cleared.update((last,))
                # of what is stored only turns after the clear stay: those that came before it out of turn
                late = [tuple(t) for t in self.turns.get() if t[0] > last]
                self.turns.put(late) if late else self.turns.clear()
            own = chunk[~clear & ~system & (chunk["turn"].gt(last) if last is not None else True)]
            for state, part in ((self.turns, own), (self.system, chunk[system])):
                if len(part):
                    kept += len(part)
                    state.appendList([(int(t), r, c) for t, r, c in zip(part["turn"], part["role"], part["content"])])
        if self.expiry_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expiry_ms)
        yield pd.DataFrame({"session_id": [int(key[0])], "kept": [kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.turns, self.system, self.cleared):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def keep_turns(turns: DataFrame, checkpoint: str, expiry_ms: int | None = None, timeout_s: int = 1800) -> None:
    """Takes everything that has arrived in the stream of (session_id, turn, role, content) into the state at
    ``checkpoint``; called again, it goes on from there."""
    spark = turns.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              # a pending timer would otherwise keep a bounded stream running
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        kept = turns.select("session_id", "turn", "role", "content").groupBy("session_id").transformWithStateInPandas(
            statefulProcessor=SessionTurns(expiry_ms), outputStructType=KEPT, outputMode="append",
            timeMode="none" if expiry_ms is None else "processingTime")
        query = (kept.writeStream.format("noop").option("checkpointLocation", checkpoint).outputMode("append")
                 .trigger(availableNow=True).start())
        finish(query, timeout_s)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, turn, role, content): what the sessions have in memory now."""
    parts = None
    for name in ("turns", "system"):
        state = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
                 .select("key.session_id", "list_element.turn", "list_element.role", "list_element.content"))
        parts = state if parts is None else parts.unionByName(state)
    return parts


def turns_of_files(spark: SparkSession, path: str) -> DataFrame:
    """Streaming turns of conversation files."""
    return (spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(path)
            .select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")))


def session_memory(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """The memory of all sessions after the conversation files under ``path``."""
    checkpoint = checkpoint or shared_path(spark, "session-turns")
    keep_turns(turns_of_files(spark, path), checkpoint)
    return stored_turns(spark, checkpoint)
