"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has 64 bits; two fingerprints link when at most ``distance``
bits differ.  The 64 bits are cut into ``distance // 2 + 1`` segments, so that of any
two linked fingerprints one segment differs by one bit at most.  Each segment is
indexed with one of its bits left out, once per bit ("one wildcard"): segments that
differ in one bit, or none, share a variant.  An equality on (segment, wildcard, other bits)
brings the candidates together, and the whole fingerprints verify them.

Only distinct fingerprints are indexed; copies follow their fingerprint.  A bucket
never gives all its pairs, only enough links to connect what is linked in it, which leaves the
components the same.  A bucket of more than ``BUCKET`` fingerprints is dealt in blocks, each pair of
blocks being a group of its own.

Defined results: a null or empty text, or one of white space, has fingerprint zero, and
links like any other; a null id is kept and ignored as a component's smallest id
(null if there is no other); repeated rows are copies; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, shuffle_partitions, text_key, text_or_empty
from quarry.llm.components import components
from quarry.llm.packing import slices

BUCKET = 2048
#: Runs up to this length are compared at once, longer ones one by one.
SHORT_RUN = 16
#: 256 rows: the eight bits of a byte, lowest first, in the eight bytes of a word.
_LANES = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1))
          << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: str, words: int) -> list[int]:
    """Hashes of all runs of ``words`` words, repeats included (of the whole sequence if
    it is shorter, none if empty); A-Z lower-cased, words joined by one space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= words:
        return [digest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    view = memoryview(joined)
    return [digest(view[a:b], 42) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes follow each other, ``counts`` each: a bit is 1
    if it is set in over half of the document's hashes."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    # sums of at most 255 rows fit the bytes of a word; then sums of those by document
    pieces = -(-counts[some] // 255)
    first = np.cumsum(counts[some]) - counts[some]
    piece0 = np.cumsum(pieces) - pieces
    at = np.repeat(first - piece0 * 255, pieces) + np.arange(pieces.sum()) * 255
    part = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64)
    ones = np.add.reduceat(part.astype(np.int64), piece0, axis=0)
    bits = ones * 2 > counts[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (a long with the fingerprint's 64 bits) and ``key`` (of the text) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       text_key(text_or_empty(text_col)).alias("key"))

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in slices(texts, 1 << 20):
                each = [shingle_hashes(t, shingle_words) for t in texts.slice(lo, hi - lo).to_pylist()]
                counts = np.array([len(x) for x in each], dtype=np.int64)
                flat = np.fromiter((h for x in each for h in x), dtype=np.uint64, count=int(counts.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(bit_majorities(flat, counts).view(np.int64)),
                     batch.column(2).slice(lo, hi - lo)], names=["doc_id", "fp", "key"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, fp long, key struct<a: long, b: long>")


def segments_of(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments."""
    n = distance // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _variants(fp, distance: int):
    """Spark column: keys of all one-wildcard variants of a fingerprint's segments."""
    keys = []
    for s, (first, bits) in enumerate(segments_of(distance)):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        for w in range(bits):
            rest = value.bitwiseAND(F.lit(~(1 << w)))
            keys.append(F.xxhash64(F.lit(s * 64 + w), rest) if bits > 40 else
                        (rest + F.lit((s * 64 + w) << 41)))
    return F.array(*keys)


def spanning_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect all that is linked among ``fp``: each fingerprint is
    reached once, from one within ``distance``."""
    rest, a, b, todo = np.arange(len(fp)), [], [], []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        u = todo.pop()
        near = np.bitwise_count(fp[rest] ^ fp[u]) <= distance
        if near.any():
            new = rest[near]
            a += [u] * len(new)
            b += new.tolist()
            todo += new.tolist()
            rest = rest[~near]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _links_in_groups(distance: int):
    """Kernel over rows sorted by group (key, block pair): spanning links of each group."""

    def links(group: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero(group[1:] != group[:-1]) + 1
        start = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([start, [len(group)]]))
        run = np.repeat(np.arange(len(start)), size)
        short = np.repeat(size <= SHORT_RUN, size)
        out = []
        for step in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
            i = np.flatnonzero((run[step:] == run[:-step]) & short[step:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            out.append((fp[i], fp[i + step]))
        for k in np.flatnonzero(size > SHORT_RUN):
            own = fp[start[k]:start[k] + size[k]]
            a, b = spanning_links(own, distance)
            out.append((own[a], own[b]))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (fp[:0], fp[:0])
        return np.unique(np.stack([np.maximum(a.view(np.int64), b.view(np.int64)),
                                   np.minimum(a.view(np.int64), b.view(np.int64))], axis=1), axis=0)

    def run(batches):
        held_g, held_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            g = batch.column(0).to_numpy()
            f = batch.column(1).to_numpy().view(np.uint64)
            g, f = np.concatenate([held_g, g]), np.concatenate([held_f, f])
            last = int(np.searchsorted(-(g != g[-1]).astype(np.int8), 0)) if len(g) else 0
            held_g, held_f = g[last:], f[last:]     # the last group may go on in the next batch
            found = links(g[:last], f[:last])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        found = links(held_g, held_f)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp``: as many as connect all that
    are within ``distance`` bits."""
    n = shuffle_partitions(fps)
    indexed = fps.select("fp", F.explode(_variants(F.col("fp"), distance)).alias("key"))
    # no bucket is larger than the two values of its segment together
    values = fps.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", first).bitwiseAND(
            F.lit((1 << bits) - 1 if bits < 64 else -1)).alias("v"))
        for s, (first, bits) in enumerate(segments_of(distance))])).alias("x"))
    large = values.groupBy("x").count().where(F.col("count") > bucket // 2).limit(1).count()
    if large:
        hot = (indexed.groupBy("key").count().where(F.col("count") > bucket)
               .select(F.col("key").alias("h_key"), F.ceil(F.col("count") / bucket).alias("blocks")))
        hot = materialize(hot, "llm-simhash-hot")
        marked = indexed.join(hot, F.col("key") == F.col("h_key"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.when(F.col("blocks").isNull(), F.array(F.col("key"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o))))
        indexed = marked.select("fp", F.explode(pairs).alias("key"))
    dealt = indexed.select("key", "fp").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links_in_groups(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 4, distance: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable by links), key (of the text) of every row."""
    bounded_batches(docs.sparkSession)
    each = materialize(fingerprints(docs, shingle_words, id_col, text_col), "llm-fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "llm-distinct")
    comp = components(fingerprint_links(distinct.select("fp"), distance))
    rooted = distinct.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("n_fp"), "root", "component_id")
    return each.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id", "root", "key")


def keep_one(docs: DataFrame, shingle_words: int = 4, distance: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``: the one with the
    smallest id (a null id only where there is no other; of rows equal in id and text, any)."""
    found = near_duplicates(docs, shingle_words, distance, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"))
    kept = materialize(first.select(F.col("one.doc_id").alias("k_id"), F.col("one.key").alias("k_key")), "llm-kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("r_id"),
                       text_key(text_or_empty(F.col(text_col))).alias("r_key"))
    own = rows.join(kept, F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_key") == F.col("k_key")), "left_semi")
    return own.groupBy("r_id", "r_key").agg(F.first("row").alias("row")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
