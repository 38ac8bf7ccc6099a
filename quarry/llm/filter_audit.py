"""Audit of how filters interact: every order of the filters, step by step, for each part of a corpus.

A document's failures are a mask with a bit for each filter.  What a mask does in every step of every
order is fixed: it is kept, removed there, or failed there though removed before.  So each
(mask, labels) has one wide integer whose 64-bit fields hold all outcomes -- for five
filters 120 orders x 5 steps x ``len(FIELDS)`` counters -- and the integers of a part's documents are
simply added: one addition counts all steps at once.  A field holds up to 2^64 - 1 documents,
so no sum of a table's rows carries into its neighbour.  Tasks add up their own rows, then rows of the same part
meet in salted groups, then those in one; an integer is some 29 kB however many documents it stands for.

The duplicate filter looks at the whole table: a document fails it if any smaller id has the same
text.  The least id of each text that occurs under several ids comes from a partial aggregate over
text keys and is joined back, which Spark can split where one text is frequent.

Defined results: a null text is empty; a null part is the empty string; a null id is neither smaller nor larger
than any other and has no labels; rows that repeat an id and a text do not make each other fail; labels that repeat an id count if any of their rows
has the value; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, shuffle_partitions, text_or_empty
from quarry.llm.packing import slices
from quarry.llm.words import byte_kinds, cut_words, per_text

FILTERS = "ABCDE"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: A document of a lesser number of words fails A; so many distinct words of a hundred B, capitals of a
#: hundred characters C, any of these characters D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, "#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
FIELD_BYTES = 8
SALTS = 64
#: Parts that a task adds up at a time; more are sent on and begun anew.
PARTS_AT_ONCE = 256
_WORDS = byte_kinds(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), dtype=np.uint8))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def text_failures(texts: pa.Array) -> np.ndarray:
    """Masks of the filters A to D for whole texts (no nulls)."""
    w = cut_words(texts, _WORDS)
    words = np.diff(w.first)
    distinct = np.zeros(len(texts), dtype=np.int64)
    if len(w.code):
        text = np.repeat(np.arange(len(texts)), words)
        seen = np.sort(text * len(w.vocabulary) + w.code)
        new = np.ones(len(seen), dtype=bool)
        new[1:] = seen[1:] != seen[:-1]
        distinct = np.bincount(seen[new] // len(w.vocabulary), minlength=len(texts))
    capitals = per_text((w.data >= 0x41) & (w.data <= 0x5A), w.offsets)
    points = per_text((w.data & 0xC0) != 0x80, w.offsets)
    symbols = per_text(_SYMBOL[w.data], w.offsets)
    return ((words < LEAST_WORDS) * 1 + (100 * distinct < DISTINCT_PERCENT * words) * 2
            + (100 * capitals > CAPITALS_PERCENT * points) * 4 + (symbols > 0) * 8)


def packed_outcomes(mask: int, good: bool, toxic: bool) -> int:
    """The wide integer of one document: a field for each (order, step, counter), lowest first."""
    fields = np.zeros((len(orders()), len(FILTERS), len(FIELDS)), dtype="<u8")
    for i, order in enumerate(orders()):
        gone = False
        for j, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            here = fails and not gone
            gone = gone or fails
            fields[i, j] = [not gone, here, fails and not here, mask == bit, here and good, here and toxic]
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: bytes) -> np.ndarray:
    """(order, step, counter) of a sum of wide integers."""
    return np.frombuffer(total, dtype="<u8").reshape(-1, len(FILTERS), len(FIELDS)).astype(np.int64)


WIDE_BYTES = 120 * len(FILTERS) * len(FIELDS) * FIELD_BYTES


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part and the mask of all five filters of every row."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), text.alias("text"))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(4), 8 << 20):
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:4], pa.array(text_failures(own.column(4)), type=pa.int32())],
                    names=["doc_id", "part", "a", "b", "mask"])

    seen = materialize(rows.mapInArrow(
        run, f"doc_id {rows.dtypes[0][1]}, part string, a long, b long, mask int"), "llm-failures")
    # written, so that the join reads plain shuffles on both sides: those Spark can split
    firsts = materialize(seen.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                         .where("least < most").select(F.col("a").alias("f_a"), F.col("b").alias("f_b"), "least"),
                         "llm-first-copies")
    both = seen.join(firsts, (F.col("a") == F.col("f_a")) & (F.col("b") == F.col("f_b")), "left")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return both.select("doc_id", "part", (F.col("mask") + again.cast("int") * DUPLICATE).alias("mask"))


def _added(batches):
    """Rows (part, salt, wide integer) -> one row for each run of a part in the task."""
    part, salt, total = None, 0, 0
    names = ["part", "salt", "total"]
    for batch in batches:
        for p, s, t in zip(*(batch.column(n).to_pylist() for n in names)):
            if p != part:
                if part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([salt], type=pa.int32()), pa.array(
                        [total.to_bytes(WIDE_BYTES, "little")])], names=names)
                part, salt, total = p, s, 0
            total += int.from_bytes(t, "little")
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([salt], type=pa.int32()), pa.array(
            [total.to_bytes(WIDE_BYTES, "little")])], names=names)


def packed_sums(marked: DataFrame) -> DataFrame:
    """Rows (part, mask, good, toxic) -> (part, total): the sum of the wide integers of each part."""
    classes = 4 << len(FILTERS)

    def run(batches):
        wide = {}
        salt = pa.array([TaskContext.get().partitionId() % SALTS], type=pa.int32())
        totals: dict[str, int] = {}

        def sent():
            for p, t in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), salt, pa.array([t.to_bytes(WIDE_BYTES, "little")])], names=["part", "salt", "total"])
            totals.clear()

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            mask, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * classes + mask * 4 + good * 2 + toxic
            found, counts = np.unique(key, return_counts=True)
            for k, n in zip(found.tolist(), counts.tolist()):
                p, c = names[k // classes], k % classes
                if c not in wide:
                    wide[c] = packed_outcomes(c >> 2, bool(c & 2), bool(c & 1))
                if p not in totals and len(totals) >= PARTS_AT_ONCE:
                    yield from sent()
                totals[p] = totals.get(p, 0) + n * wide[c]
        yield from sent()

    schema = "part string, salt int, total binary"
    parts = marked.select("part", "mask", "good", "toxic").mapInArrow(run, schema)
    n = shuffle_partitions(marked)
    salted = parts.repartition(n, "part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_added, schema)
    return salted.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_added, schema).select("part", "total")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, the counters of ``FIELDS`` and shapley: what the step's filter removes,
    summed over all orders."""
    bounded_batches(docs.sparkSession)
    known = labels.groupBy(F.col(id_col).alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs, id_col, text_col, part_col)
    marked = rows.join(known, F.col("doc_id") == F.col("l_id"), "left").select(
        "part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def run(batches):
        names = orders()
        filter_no = np.array([[FILTERS.index(c) for c in o] for o in names])
        removed = FIELDS.index("removed")
        for batch in batches:
            for part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = unpacked(total)
                shapley = np.zeros(len(FILTERS), dtype=np.int64)
                np.add.at(shapley, filter_no.ravel(), found[:, :, removed].ravel())
                n = len(names) * len(FILTERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n), pa.array(np.repeat(names, len(FILTERS)).tolist()),
                     pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(names)), type=pa.int32()),
                     *[pa.array(found[:, :, i].ravel()) for i in range(len(FIELDS))], pa.array(shapley[filter_no].ravel())],
                    names=["part", "filter_order", "step", *FIELDS, "shapley"])

    counters = ", ".join(f"{c} long" for c in (*FIELDS, "shapley"))
    return packed_sums(marked).mapInArrow(run, f"part string, filter_order string, step int, {counters}")


#: The same counts from the masks alone.
ORACLE = """
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (
  select part, (len(w) < 100)::int as a, (100 * len(list_distinct(w)) < 80 * len(w))::int as b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int as c,
    regexp_matches(t, '[#$%&*|]')::int as d,
    coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as e,
    coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from d left join l on d.doc_id = l.doc_id),
g as (
  select part, [a, b, c, d, e] as f, good, toxic, count(*) as n from m group by all),
s as (select unnest(['A', 'B', 'C', 'D', 'E']) as s, unnest([1, 2, 3, 4, 5]) as i),
o as (
  select s1.s || s2.s || s3.s || s4.s || s5.s as filter_order, [s1.i, s2.i, s3.i, s4.i, s5.i] as p
  from s s1, s s2, s s3, s s4, s s5 where len(list_distinct([s1.i, s2.i, s3.i, s4.i, s5.i])) = 5),
x as (
  select part, filter_order, k as step, n, good, toxic, p[k] as filter_no, f[p[k]] as fails,
    coalesce(list_sum(list_transform(p[1:k - 1], lambda i: f[i])), 0) > 0 as before,
    list_sum(f) = 1 as alone
  from g, o, (select unnest([1, 2, 3, 4, 5]) as k)),
y as (
  select part, filter_order, step, any_value(filter_no) as filter_no,
    sum(case when not before and fails = 0 then n else 0 end)::bigint as kept,
    sum(case when not before and fails = 1 then n else 0 end)::bigint as removed,
    sum(case when before and fails = 1 then n else 0 end)::bigint as redundant,
    sum(case when fails = 1 and alone then n else 0 end)::bigint as unique_fails,
    sum(case when not before and fails = 1 and good = 1 then n else 0 end)::bigint as good_lost,
    sum(case when not before and fails = 1 and toxic = 1 then n else 0 end)::bigint as toxic_lost
  from x group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, filter_no))::bigint as shapley
from y
"""
