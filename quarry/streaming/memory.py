"""Per-session memory over a stream of conversation turns.

Keyed state per session (``applyInPandasWithState``): whether the session has
a system turn and how many turns are currently in memory.  A user ``clear``
resets memory to the system turn.  Turns of one session that arrive in the
same micro-batch are applied in turn order, over all chunks they come in.  The
state is two numbers per session, and can expire, so it stays bounded however long a
session runs and however many there are.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.session import shared_path
from quarry.streaming.questions import finish

OUTPUT_SCHEMA = "session_id long, turn long, memory_size long"
STATE_SCHEMA = "has_system boolean, size long"
CLEAR = "clear"


def _flags(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a chunk of turns means for the memory's size; contents go no further."""
    user = pdf["role"].eq("user")
    clear = user & pdf["content"].fillna("").str.strip().str.lower().eq(CLEAR)
    return pd.DataFrame({"turn": pdf["turn"], "clear": clear, "system": pdf["role"].eq("system") & ~clear})


def memory_after(turns: pd.DataFrame, has_system: bool, size: int) -> tuple[pd.DataFrame, bool, int]:
    """Memory sizes after each of a session's turns (turn, clear, system), from a state on."""
    t = turns.sort_values("turn", kind="stable").reset_index(drop=True)
    seen = t["system"].cummax() | has_system
    segment = t["clear"].cumsum()
    added = (~t["clear"]).groupby(segment).cumsum()
    # a segment begins with what its clear leaves: the system turn, if one was seen by then
    base = seen.where(t["clear"]).groupby(segment).transform("first").map({True: 1, False: 0}).fillna(size)
    sizes = (added + base).astype("int64")
    out = pd.DataFrame({"turn": t["turn"].astype("int64"), "memory_size": sizes})
    return out, bool(seen.iloc[-1]), int(sizes.iloc[-1])


def _stepper(expiry_ms: int | None):

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        has_system, size = (state.get if state.exists else (False, 0))
        # a session's chunks come in any order: sorted together, as flags only
        out, has_system, size = memory_after(pd.concat([_flags(p) for p in pdfs]), bool(has_system), int(size))
        state.update((has_system, size))
        if expiry_ms:
            state.setTimeoutDuration(expiry_ms)
        out.insert(0, "session_id", int(key[0]))
        yield out

    return step


def memory_sizes(turns_stream: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """Streaming (session_id, turn, memory_size) from streaming (session_id, turn, role, content).

    ``expiry_ms``: a session without turns for this long is forgotten.  For streams that run on;
    one that ends with its input needs none (a pending timeout would keep it running)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expiry_ms else GroupStateTimeout.NoTimeout
    return turns_stream.groupBy("session_id").applyInPandasWithState(
        _stepper(expiry_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def run_memory_stream(spark: SparkSession, path: str, out_path: str | None = None,
                      checkpoint: str | None = None, timeout_s: int = 1800) -> DataFrame:
    """Drive the memory stream over conversation parquet files (``availableNow``) into
    parquet under the shared folder; return what was written."""
    out_path = out_path or shared_path(spark, "stream-memory")
    checkpoint = checkpoint or shared_path(spark, "stream-memory-ckpt")
    turns = (spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(path)
                  .select(F.col("conv_id").alias("session_id"), "turn", "role",
                          F.col("text").alias("content")))
    q = (memory_sizes(turns).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    finish(q, timeout_s)
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out_path)
