"""Mixing sources to target weights, block by block.

The words of each source form a stream (documents in a pseudorandom order that
depends on their content only) that is packed into blocks of ``block_words``
words.  The mix is a number of output shards of ``shard_blocks`` slots each:

* ``source_targets`` turns weights and source sizes into a target per source;
* every shard draws its source counts from a multinomial with the targets' shares,
  seeded by the shard number.  The draws' sums differ from the targets by chance;
  what a source has drawn beyond its slots goes to the sources that drew too few;
* slot k of a source is mapped to block ``permute(k mod blocks)`` of epoch ``k div
  blocks``; each (source, epoch) has its own Feistel permutation, so no task
  ever holds a list of indices;
* slots and blocks meet in an equi-join on (source, block).

The last slot of a source is cut short so that the words taken are the whole part of
its target.  An epoch uses each block once, so no document is taken more often than
``ceil(target / source size)`` times, and never beyond ``cap``.

Defined results: a null text has size 0 and takes part with nothing taken; a null
source is a source of its own, last in order; a null id is kept; repeated rows are separate
documents; an empty table gives an empty mix; other columns are ignored.  One row per
source reaches the driver, at most ``MOST_SOURCES`` (an error beyond).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import count_words, materialize, shuffle_partitions, text_key, text_or_empty

MOST_SOURCES = 1_000_000
#: Rows that a bucket of the stream's order holds on average.
BUCKET_ROWS = 20_000
_U = np.uint64


def source_targets(sizes: list[int], weights=(3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> list[float]:
    """Targets of the sources, given in their order.  Weights repeat along it; together
    the targets are ``share`` of all sizes; none exceeds ``cap`` times its source's size,
    and what is above goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total = share * sum(sizes)
    capped: set[int] = set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        open_w = sum(w[i] for i in range(len(sizes)) if i not in capped)
        unit = left / open_w if open_w else 0.0
        more = {i for i in range(len(sizes)) if i not in capped and unit * w[i] > cap * sizes[i]}
        if not more:
            return [float(cap * n) if i in capped else float(unit * w[i])
                    for i, n in enumerate(sizes)]
        capped |= more


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(_U) + _U(key & (2**64 - 1))
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _feistel(x: np.ndarray, half: int, key: int, rounds) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for r in rounds:
        if rounds.step > 0:
            left, right = right, left ^ (_mixed(right, key + 0x9E3779B97F4A7C15 * (r + 1)) & mask)
        else:
            left, right = right ^ (_mixed(left, key + 0x9E3779B97F4A7C15 * (r + 1)) & mask), left
    return (left << _U(half)) | right


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 (Feistel network, walking the cycle of
    a power of four until the value is below n)."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    rounds = range(3, -1, -1) if inverse else range(0, 4, 1)
    out = _feistel(np.asarray(x, dtype=_U), half, key, rounds)
    while (over := out >= _U(n)).any():
        out[over] = _feistel(out[over], half, key, rounds)
    return out.astype(np.int64)


def _key(seed: int, source: int, epoch: int) -> int:
    return int(_mixed(np.array([(source * 1_000_003 + epoch) & (2**64 - 1)], dtype=_U), seed * 7919 + 17)[0])


@dataclass(frozen=True)
class SourcePlan:
    """What the mix takes of each source (arrays by source number)."""
    names: list
    sizes: np.ndarray
    targets: list[float]
    blocks: np.ndarray
    slots: np.ndarray
    last: np.ndarray  # words of a source's last slot


def plan_sources(names: list, sizes: list[int], block_words: int, seed: int, **rule) -> SourcePlan:
    targets = source_targets(sizes, **rule)
    blocks, slots, last = [], [], []
    for s, (n, target) in enumerate(zip(sizes, targets)):
        nb, take = -(-n // block_words), min(math.floor(target), math.floor(rule.get("cap", 2.0) * n))
        blocks.append(nb)
        if not take:
            slots.append(0)
            last.append(0)
            continue
        epoch, rest = divmod(take, n)
        if not rest:
            slots.append(epoch * nb)
            last.append(block_words)
            continue
        short = block_words - (nb * block_words - n)           # words of the stream's last block
        at = int(permute(np.array([nb - 1]), nb, _key(seed, s, epoch), inverse=True)[0])
        m = -(-rest // block_words)
        if at < m:
            m = max(at + 1, -(-(rest + block_words - short) // block_words))
        before = (m - 1) * block_words - (block_words - short if at < m - 1 else 0)
        slots.append(epoch * nb + m)
        last.append(rest - before)
    return SourcePlan(names, np.array(sizes, dtype=np.int64), targets, np.array(blocks, dtype=np.int64),
                      np.array(slots, dtype=np.int64), np.array(last, dtype=np.int64))


def documents_in_streams(docs: DataFrame) -> DataFrame:
    """Adds each document's ``start`` in its source's stream: bucket totals give the
    buckets' offsets, a window inside a bucket the rest, so that no task holds a source."""
    order = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "key")
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (docs.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
                  .select(F.col("source").alias("t_source"), F.col("bucket").alias("t_bucket"),
                          F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead")))
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (docs.withColumn("inside", inside - F.col("size"))
                .join(totals, F.col("source").eqNullSafe(F.col("t_source"))
                      & (F.col("bucket") == F.col("t_bucket")))
                .withColumn("start", F.col("ahead") + F.col("inside"))
                .drop("inside", "ahead", "t_source", "t_bucket"))


class Mix:
    """A mix of ``docs``; see the module's description.

    ``documents``: doc_id, source, key (of the text), size, source_no, source_size,
    target, start.  ``slots``: shard, slot, source_no, epoch, block, words.  ``taken()``: the
    words taken of each document; ``pieces()``: the word ranges that each slot takes."""

    def __init__(self, docs: DataFrame, block_words: int = 256, shard_blocks: int = 4096,
                 seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", **rule):
        self.block_words, self.shard_blocks, self.seed = block_words, shard_blocks, seed
        spark = self.spark = docs.sparkSession
        text = text_or_empty(text_col)
        narrow = materialize(docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            text_key(text).alias("key"), count_words(F.col(text_col)).alias("size")), "llm-mix-sizes")
        rows = narrow.count()
        buckets = max(256, 1 << max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))
        order = F.xxhash64(F.lit(seed), "doc_id", "key")
        keyed = (narrow.withColumn("order", order)
                       .withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int")))
        stats = (narrow.groupBy("source").agg(F.sum("size").alias("size"))
                       .limit(MOST_SOURCES + 1).collect())
        if len(stats) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.plan = plan_sources([r["source"] for r in stats], [int(r["size"]) for r in stats],
                                 block_words, seed, **rule)
        table = spark.createDataFrame(
            [(n, i, int(z), t) for i, (n, z, t) in
             enumerate(zip(self.plan.names, self.plan.sizes, self.plan.targets))],
            "s_source string, source_no int, source_size long, target double")
        self.documents = (documents_in_streams(keyed)
                          .join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s_source")))
                          .select("doc_id", "source", "key", "size", "source_no", "source_size",
                                  "target", "start"))
        self.slots = self._slots()

    def _slots(self) -> DataFrame:
        p, seed, per, block_words = self.plan, self.seed, self.shard_blocks, self.block_words
        total = int(p.slots.sum())
        schema = "shard long, slot long, source_no int, epoch int, block long, words long"
        if not total:
            return self.spark.createDataFrame([], schema)
        shares = p.slots / total

        def drawn(frames):
            for f in frames:
                for shard in f["id"]:
                    rng = np.random.default_rng([seed, int(shard)])
                    n = rng.multinomial(min(per, total - int(shard) * per), shares)
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({"shard": int(shard), "source_no": some.astype(np.int32),
                                        "n": n[some], "at": (np.cumsum(n) - n)[some]})

        shards = -(-total // per)
        counts = self.spark.range(0, shards, 1, min(shards, 64 + shards // 64)).mapInPandas(
            drawn, "shard long, source_no int, n long, at long")
        sums = {r[0]: int(r[1]) for r in counts.groupBy("source_no").agg(F.sum("n")).collect()}
        had = np.array([sums.get(i, 0) for i in range(len(p.slots))], dtype=np.int64)
        over, under = np.maximum(had - p.slots, 0), np.maximum(p.slots - had, 0)
        over_at, under_end = np.cumsum(over) - over, np.cumsum(under)
        ahead = (Window.partitionBy("source_no").orderBy("shard")
                       .rowsBetween(Window.unboundedPreceding, -1))
        entries = counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))

        def slot_rows(frames):
            for f in frames:
                for shard, s, n, at, base in f[["shard", "source_no", "n", "at", "base"]].itertuples(index=False):
                    k, src = base + np.arange(n), np.full(n, s)
                    extra = k >= p.slots[s]
                    if extra.any():            # goes to the sources that drew too few
                        o = over_at[s] + k[extra] - p.slots[s]
                        d = np.searchsorted(under_end, o, side="right")
                        src[extra], k[extra] = d, had[d] + o - (under_end[d] - under[d])
                    block, epoch = np.empty(n, dtype=np.int64), k // p.blocks[src]
                    for one, e in set(zip(src.tolist(), epoch.tolist())):
                        m = (src == one) & (epoch == e)
                        block[m] = permute(k[m] % p.blocks[one], int(p.blocks[one]), _key(seed, one, e))
                    size = min(per, total - shard * per)
                    yield pd.DataFrame({
                        "shard": shard, "slot": permute(at + np.arange(n), int(size), _key(seed, -1 - shard, 0)),
                        "source_no": src.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block,
                        "words": np.where(k == p.slots[src] - 1, p.last[src], block_words)})

        # few rows, but each stands for many slots: dealt out before they unfold
        return entries.repartition(shuffle_partitions(entries), "shard").mapInPandas(slot_rows, schema)

    def _in_blocks(self) -> DataFrame:
        """A row per document and block of its source that it has words in."""
        b, end = F.lit(self.block_words), F.col("start") + F.col("size")
        rows = self.documents.where("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
        return (rows.withColumn("first", F.greatest(F.col("start") - F.col("block") * b, F.lit(0)))
                    .withColumn("past", F.least(end - F.col("block") * b, b)))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: words taken of each document,
        repeats counted."""
        per_block = (self.slots.groupBy("source_no", "block")
                     .agg(F.collect_list("words").alias("uses")))  # one for each epoch
        words = F.aggregate(F.coalesce("uses", F.array().cast("array<bigint>")), F.lit(0).cast("long"),
                            lambda a, w: a + F.greatest(F.least(w, F.col("past")) - F.col("first"), F.lit(0)))
        some = (self._in_blocks().join(per_block.hint("merge"), ["source_no", "block"], "left")
                .groupBy("source_no", "start", "doc_id", "size", "source_size", "target")
                .agg(F.sum(words).alias("taken")))
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        cols = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(cols).unionByName(none.select(cols))

    def pieces(self) -> DataFrame:
        """One row per slot and document that it takes words of: shard, slot, epoch,
        doc_id, source, key, start, size, from_word, to_word (of the document, end
        exclusive)."""
        at = F.col("block") * self.block_words - F.col("start")
        return (self._in_blocks().join(self.slots.hint("merge"), ["source_no", "block"])
                .withColumn("from_word", at + F.col("first"))
                .withColumn("to_word", at + F.least("past", "words"))
                .where("to_word > from_word")
                .select("shard", "slot", "epoch", "doc_id", "source", "key", "start", "size",
                        "from_word", "to_word"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row with the columns of ``docs`` for each document and
    epoch that takes words of it.  The text is the whole text where all words are taken, else
    the words taken, in their order, joined by one space; ``n_chars`` (if there is such
    a column) follows the text.

    Rows stand in the order of the slots that their first words fill: partition by partition, and within each, as the
    shards and slots of the mix follow each other.  Written and read again, every file keeps that order."""
    mix = Mix(docs, **options)
    id_col, text_col, source_col = (options.get(f"{n}_col", d) for n, d in
                                    (("id", "doc_id"), ("text", "text"), ("source", "source")))
    ranges = (mix.pieces().groupBy("doc_id", "source", "key", "start", "size", "epoch")
              .agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("ranges"),
                   F.sum(F.col("to_word") - F.col("from_word")).alias("words"),
                   # not the least of its slots: those of long documents would all come first
                   F.min_by(F.col("shard") * mix.shard_blocks + F.col("slot"), F.struct("from_word", "shard", "slot")).alias("place"))
              .select(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"),
                      F.col("key").alias("k_key"), "size", "words", "place",
                      F.when(F.col("words") < F.col("size"), F.col("ranges")).alias("ranges")))
    # repeated rows of one document are equal in what the mix reads: one stands for all
    once = docs.select(F.struct("*").alias("row"),
                       text_key(text_or_empty(F.col(text_col))).alias("d_key"),
                       F.col(id_col).alias("d_id"), F.col(source_col).alias("d_source"))
    once = once.groupBy("d_id", "d_source", "d_key").agg(F.first("row").alias("row"))
    both = ranges.join(once, F.col("k_id").eqNullSafe(F.col("d_id"))
                       & F.col("k_source").eqNullSafe(F.col("d_source"))
                       & (F.col("k_key") == F.col("d_key")))
    whole = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.flatten(F.transform(
        "ranges", lambda r: F.slice(words, (r["from_word"] + 1).cast("int"),
                                    (r["to_word"] - r["from_word"]).cast("int")))), " ")
    text = F.when(F.col("ranges").isNull(), whole).otherwise(part)
    out = both.withColumn("mixed_text", text)
    # slots are numbered without gaps, so equal ranges of them go to the partitions without a sample
    n, slots = shuffle_partitions(docs), max(int(mix.plan.slots.sum()), 1)
    out = out.repartitionById(n, F.least(F.floor(F.col("place") * n / slots), F.lit(n - 1)).cast("int")).sortWithinPartitions("place")
    return out.select(*[
        F.col("mixed_text").alias(c) if c == text_col else
        F.length("mixed_text").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c, t in docs.dtypes])
