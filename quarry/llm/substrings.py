"""Repeated passages across documents, by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document; the words of every window whose sequence
also starts anywhere else are removed.  Nodes of the suffix tree of all texts that lie
``window`` words deep and have two leaves are those windows.

The tree is sparse: of each window only the suffix at its anchor is entered, the position whose
``PREFIX``-word prefix has the smallest hash in the window.  Equal windows have equal anchors, so no
repeat is missed.  Neighbouring windows share an anchor and travel as one suffix record, with a
fingerprint for each window that the suffix, with what stands before it, makes up.  Suffixes split by
prefix:

* the ``PREFIX``-word prefix is the rule; all suffixes of one prefix form a subtree, built in one task,
  whose nodes at window depth are found by sorting the fingerprints;
* prefixes that a sample of texts (by hash) shows to be frequent take the whole
  window as prefix instead: those subtrees are single nodes, counted with partial aggregates
  and joined back, which Spark can split.

Copies of a text are entered once per task; texts that occur twice are removed whole (if they have a
window).  Word hashes have 64 bits; a node is told by the 64-bit hash of its prefix and the 64-bit
fingerprint of the whole window: windows under one frequent prefix have only the fingerprint.

Defined results: null, empty and blank texts have no words; a text shorter than a window loses
nothing; a null id is kept; repeated rows are documents of their own and repeat each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, shuffle_partitions, text_or_empty
from quarry.llm.packing import slices
from quarry.llm.vectors import by_group

PREFIX = 8
#: Frequent prefixes: texts that are sampled at least, as many or one of so many; records of a
#: prefix in the sample, and in all, from which it counts as frequent; the most there can be.
SAMPLE_TEXTS, SAMPLE_EVERY = 20_000, 5_000
FREQUENT, SUBTREE, MOST_FREQUENT = 100, 50_000, 100_000
BYTES = 8           # of a window's fingerprint
_U = np.uint64


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of the texts in them."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=_U, count=len(words))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    # white space at a text's ends leaves empty strings: no words
    real = np.array([bool(w) for w in words], dtype=bool)[code] if len(words) else np.zeros(0, dtype=bool)
    if not real.all():
        kept = np.concatenate([[0], np.cumsum(real)])
        return hashes[code[real]], kept[offsets]
    return hashes[code], offsets


def window_suffixes(h: np.ndarray, offsets: np.ndarray, window: int):
    """Suffix records of texts that follow each other: (text, first window, number of windows,
    prefix hash, fingerprints of all windows, window -> record offsets)."""
    prefix = min(PREFIX, window)
    spread = window - prefix + 1            # prefixes in a window
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(h) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none.astype(_U), none.astype(_U), np.zeros(1, dtype=np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - prefix + 1, dtype=_U)
        for i in range(prefix):
            g = g * _U(0x9E3779B97F4A7C15) + h[i:i + len(g)]
        g = _mixed(g)
        whole = np.zeros(n, dtype=_U)
        for i in [*range(0, window - prefix + 1, prefix), window - prefix]:
            whole = whole * _U(0xC2B2AE3D27D4EB4F) + g[i:i + n]
        whole = _mixed(whole)
    starts = np.flatnonzero(text[:n] == text[window - 1:])
    anchor = np.empty(len(starts), dtype=np.int64)
    seen = sliding_window_view(g, spread)
    for lo in range(0, len(starts), 200_000):
        part = starts[lo:lo + 200_000]
        if len(part) and part[-1] - part[0] == len(part) - 1:
            anchor[lo:lo + 200_000] = part + seen[part[0]:part[-1] + 1].argmin(axis=1)
        else:
            anchor[lo:lo + 200_000] = part + seen[part].argmin(axis=1)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    at = np.flatnonzero(new)
    ends = np.append(at, len(starts))
    return (text[starts[at]], starts[at] - offsets[text[starts[at]]], np.diff(ends), g[anchor[at]],
            whole[starts], ends)


def _records(window: int):
    """Rows (prefix, a, b, place, prints): suffix records of each text; place holds the first window and,
    in its lowest 6 bits, the number of windows less one."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts, 4 << 20):
                a, b = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (0, 1))
                fresh = np.array([k not in seen and not seen.add(k) for k in zip(a.tolist(), b.tolist())], dtype=bool)
                own = texts.slice(lo, hi - lo).filter(pa.array(fresh))
                if not len(own):
                    continue
                text, first, count, g, whole, ends = window_suffixes(*word_hashes(own), window)
                data = np.ascontiguousarray(whole.astype("<u8"))
                prints = pa.Array.from_buffers(pa.binary(), len(g), [
                    None, pa.py_buffer((ends * BYTES).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(a[fresh][text]), pa.array(b[fresh][text]),
                     pa.array(first * 64 + count - 1), prints], names=["prefix", "a", "b", "place", "prints"])

    return run


def _windows(table: pa.Table):
    """(record, position in it, fingerprint) of every window of a table of records."""
    column = table.column("prints").combine_chunks()
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    prints = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].view("<u8")
    n = np.diff(ends) // BYTES
    record = np.repeat(np.arange(len(n)), n)
    return record, np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n), prints


def _subtrees(batches):
    """Records sorted by prefix -> rows (a, b, first, mask): windows with another leaf, as bits."""
    for table in by_group(batches):
        g = table.column("prefix").to_numpy()
        twice = np.zeros(len(g), dtype=bool)
        twice[1:] = g[1:] == g[:-1]
        twice[:-1] |= twice[1:]
        if not twice.any():
            continue
        table = table.filter(pa.array(twice))
        g, a, b, place = (table.column(c).to_numpy() for c in ("prefix", "a", "b", "place"))
        # a copy entered by another task is the same leaf
        order = np.lexsort((place, b, a, g))
        same = np.zeros(len(g), dtype=bool)
        o = order
        same[o[1:]] = ((g[o[1:]] == g[o[:-1]]) & (a[o[1:]] == a[o[:-1]]) & (b[o[1:]] == b[o[:-1]])
                       & (place[o[1:]] == place[o[:-1]]))
        record, at, prints = _windows(table)
        use = ~same[record]
        record, at, prints = record[use], at[use], prints[use]
        node = np.lexsort((prints, g[record]))
        r, f = g[record][node], prints[node]
        leaf = np.zeros(len(node), dtype=bool)
        leaf[1:] = (r[1:] == r[:-1]) & (f[1:] == f[:-1])
        leaf[:-1] |= leaf[1:]
        hit = node[leaf]
        mask = np.zeros(len(g), dtype=np.int64)
        np.bitwise_or.at(mask, record[hit], np.int64(1) << at[hit])
        some = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[some]), pa.array(b[some]), pa.array(place[some] >> 6), pa.array(mask[some])],
            names=["a", "b", "first", "mask"])


def _each_window(batches):
    """Records -> a row for each window: (node_a, node_b, a, b, at)."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        record, at, prints = _windows(table)
        g, a, b, place = (table.column(c).to_numpy() for c in ("prefix", "a", "b", "place"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(g[record]), pa.array(prints.view(np.int64)), pa.array(a[record]), pa.array(b[record]),
             pa.array((place[record] >> 6) + at)], names=["node_a", "node_b", "a", "b", "at"])


def frequent_prefixes(keyed: DataFrame, window: int) -> DataFrame:
    """Prefixes of large subtrees, as a sample of texts shows them: those that more than
    ``FREQUENT`` sampled texts have, or that stand for more than ``SUBTREE`` records.  At most
    ``MOST_FREQUENT``; a frequent prefix that is missed costs balance, not results."""
    share = max(SAMPLE_TEXTS / max(keyed.count(), 1), 1 / SAMPLE_EVERY)
    some = keyed.where(F.pmod(F.xxhash64(F.lit(11), "a", "b"), F.lit(10**9)) < int(min(share, 1) * 10**9))
    seen = some.mapInArrow(_records(window), "prefix long, a long, b long, place long, prints binary")
    least = min(FREQUENT, share * SUBTREE)
    return (seen.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
            .orderBy(F.desc("n"), "prefix").limit(MOST_FREQUENT).select(F.col("prefix").alias("often")))


def repeated_windows(docs: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    """(a, b, first, mask): of the text with key (a, b), the windows first + i, for the bits i of
    the mask, occur elsewhere too.  A mask of -1 marks a text that occurs more than once."""
    text = text_or_empty(text_col)
    keyed = docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), text.alias("text"))
    often = materialize(frequent_prefixes(keyed, window), "llm-frequent")
    records = keyed.mapInArrow(_records(window), "prefix long, a long, b long, place long, prints binary")
    small = F.broadcast(often)      # MOST_FREQUENT rows at most
    rare = records.join(small, F.col("prefix") == F.col("often"), "left_anti")
    dealt = rare.repartition(shuffle_partitions(docs), "prefix").sortWithinPartitions("prefix")
    found = dealt.mapInArrow(_subtrees, "a long, b long, first long, mask long")
    each = (records.join(small, F.col("prefix") == F.col("often"), "left_semi")
            .mapInArrow(_each_window, "node_a long, node_b long, a long, b long, at long").distinct())
    nodes = (each.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
             .select(F.col("node_a").alias("n_a"), F.col("node_b").alias("n_b")))
    deep = (each.join(nodes, (F.col("node_a") == F.col("n_a")) & (F.col("node_b") == F.col("n_b")))
            .select("a", "b", F.col("at").alias("first"), F.lit(1).cast("long").alias("mask")))
    copies = (keyed.select("a", "b").groupBy("a", "b").count().where("count > 1")
              .select("a", "b", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("mask")))
    return found.unionByName(deep).unionByName(copies)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    if window > 63 + PREFIX:
        raise ValueError(f"windows of up to {63 + PREFIX} words")
    bounded_batches(docs.sparkSession)
    found = materialize(repeated_windows(docs, window, text_col), "llm-repeats")
    lists = found.groupBy("a", "b").agg(F.collect_list(F.struct("first", "mask")).alias("found")).select(
        F.col("a").alias("f_a"), F.col("b").alias("f_b"), F.col("found.first").alias("firsts"),
        F.col("found.mask").alias("masks"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("a"),
                       F.xxhash64(F.lit(7), text).alias("b"))
    both = rows.join(lists, (F.col("a") == F.col("f_a")) & (F.col("b") == F.col("f_b")), "left").select(
        "doc_id", "text", "firsts", "masks")

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().encode().split()
                first = batch.column(2)[i]
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                if first.is_valid and len(words) >= window:
                    first, mask = first.values.to_numpy(), batch.column(3)[i].values.to_numpy()
                    if (mask < 0).any():
                        cover[0] = 1
                    else:
                        for bit in range(int(mask.max()).bit_length()):
                            at = first[(mask >> bit) & 1 == 1] + bit
                            np.add.at(cover, at, 1)
                            np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not gone.any() else [words[j] for j in np.flatnonzero(~gone)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()),
                 pa.array(kept, type=pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_words long, n_removed long, kept string")
