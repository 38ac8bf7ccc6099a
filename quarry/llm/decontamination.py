"""Benchmark decontamination with training suffix arrays.

The documents are the shards: each task cuts its texts into words and sorts the suffixes of a
stretch of texts (``SHARD_BYTES``, one document at least) into a suffix array.  Every suffix of every test text
is searched in every such array by binary search, word by word: the slots narrow until no
suffix is left.  The depth reached is the longest verbatim match with that shard, the slots left are its
locations; the slots at the depth of a window hold every occurrence of that window.  A document lies in one shard,
so nothing about it has to meet anything else, and no text is shuffled.

A window is ``window`` words in a row of a test text; a text of fewer words, but some, is one window.  Words are
compared as they are, by the shard's own vocabulary; no hash decides a match.

The test texts go to the tasks in blocks of about ``BLOCK_WORDS`` words, which bounds what a block sends to
the driver and the tasks; the corpus is read once for each block, and blocks meet by text.  A test text of
more than ``PIECE_WORDS`` words is searched in pieces that overlap by a window less a word: no
window is lost, a longer match is reported in parts.

Defined results: null, empty and wordless texts hold nothing and are hit by nothing; test texts that share
an id count as one item; a null id counts as an item of its own and is left out of lists of
ids; repeated rows are documents of their own; an empty table on either side hits nothing; other columns are ignored
(``decontaminated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, text_or_empty
from quarry.llm.packing import slices
from quarry.llm.suffix_arrays import narrowed, spread, suffix_array
from quarry.llm.words import byte_kinds, cut_words

SHARD_BYTES = 12 << 20
BLOCK_WORDS = 2_000_000
PIECE_WORDS = 8192
#: The contract's words, of texts in which A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = byte_kinds(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = "array<struct<begin: long, end: long>>"
MATCH = "array<struct<item: string, item_word: long, doc_word: long, length: long>>"


class TestBlock:
    """Test texts as numbers of their own vocabulary: piece p has the words ``first[p]:first[p + 1]``."""

    __test__ = False        # no test case

    def __init__(self, rows: pa.Table):
        pieces = rows.column("piece").combine_chunks()
        coded = pieces.flatten().cast(pa.binary()).dictionary_encode()
        self.vocabulary = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        self.begin = rows.column("begin").to_numpy()
        names = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        self.items = names.dictionary.to_pylist()
        self.item = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def suffixes(self, window: int):
        """(piece, first word, end of the piece, words of a window) of all suffixes of a window or more."""
        n = np.diff(self.first)
        need = np.minimum(n, window)
        piece, at = spread(self.first[:-1], np.where(n > 0, self.first[1:] - need + 1, self.first[:-1]))
        return piece, at, self.first[1:][piece], need[piece]


def blocks_of(tests: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[pa.Table]:
    """Rows (item, begin, piece) of the test texts, block by block."""
    lower = F.translate(F.col(text_col), _LETTERS, _LETTERS.lower())
    words = tests.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(
        lower, F.lit(WORD), F.lit(0)).alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(PIECE_WORDS))
    pieces = words.select("item", "words", F.explode(starts).alias("begin")).select(
        "item", F.col("begin").cast("long").alias("begin"),
        F.slice("words", F.col("begin") + 1, F.lit(PIECE_WORDS + window - 1)).alias("piece"))
    pieces = materialize(pieces, "llm-test-texts")
    total = pieces.agg(F.sum(F.size("piece").cast("long"))).first()[0] or 0
    n = max(-(-total // BLOCK_WORDS), 1)
    block = F.pmod(F.xxhash64("item", "begin", "piece"), F.lit(n))
    for i in range(n):
        yield pieces.where(block == i).toArrow()


def shard_matches(texts: pa.Array, tests: TestBlock, window: int):
    """Words of each text, and what the block's texts have in common with them: (occurrences
    as (position, words of the window, window), items of each window, longest matches as (position,
    suffix, words), first position of each text).  Positions count the words of all texts, with one more
    after each text."""
    w = cut_words(texts, _WORDS, lower=True)
    words = np.diff(w.first)
    text = np.repeat(np.arange(len(texts)), words)
    code = np.zeros(len(w.code) + len(texts), dtype=np.int64)       # 0 ends a text
    code[np.arange(len(w.code)) + text] = w.code + 1
    begin = w.first[:-1] + np.arange(len(texts))
    piece, at, end, need = tests.suffixes(window)
    known = pc.index_in(tests.vocabulary, value_set=w.vocabulary) if len(w.code) else None
    none = np.zeros(0, dtype=np.int64)
    if known is None or not len(at):
        return words, (none, none, none), [], (none, none, none), begin
    symbol = pc.fill_null(known, -2).to_numpy(zero_copy_only=False).astype(np.int64)[tests.code] + 1
    depth = int(np.diff(tests.first).max())
    order = suffix_array(code, depth)
    padded = np.concatenate([code, np.zeros(depth, dtype=np.int64)])

    lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(code), dtype=np.int64)
    length = np.zeros(len(at), dtype=np.int64)
    window_lo, window_hi = lo.copy(), lo.copy()
    todo = np.arange(len(at))
    d = 0
    while len(todo):
        todo = todo[at[todo] + d < end[todo]]
        wanted = symbol[at[todo] + d]
        a, b = narrowed(padded, order, lo[todo], hi[todo], d, wanted)
        found = a < b
        todo = todo[found]
        lo[todo], hi[todo] = a[found], b[found]
        d += 1
        length[todo] = d
        whole = todo[need[todo] == d]
        window_lo[whole], window_hi[whole] = lo[whole], hi[whole]

    hit = np.flatnonzero(length >= need)
    if not len(hit):
        return words, (none, none, none), [], (none, none, none), begin
    # windows of the same words have the same slots
    slots = np.stack([window_lo[hit], window_hi[hit], need[hit]], axis=1)
    slots, same = np.unique(slots, axis=0, return_inverse=True)
    which, slot = spread(slots[:, 0], slots[:, 1])
    pairs = np.unique(np.stack([same.ravel(), tests.item[piece[hit]]], axis=1), axis=0)
    items = np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1)
    # a suffix whose longest match goes on from the suffix before it, in as many places, is a part of that
    part = np.zeros(len(at), dtype=bool)
    part[1:] = ((piece[1:] == piece[:-1]) & (length[:-1] == length[1:] + 1) & (length[:-1] >= need[:-1])
                & (hi[1:] - lo[1:] == hi[:-1] - lo[:-1]))
    top = hit[~part[hit]]
    top = top[np.unique(np.stack([lo[top], hi[top], length[top]], axis=1), axis=0, return_index=True)[1]]
    w2, s2 = spread(lo[top], hi[top])
    return (words, (order[slot], slots[which, 2], which), items,
            (order[s2], top[w2], length[top[w2]]), begin)


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """Lists of ``values`` for 0..n-1, by sorted owners."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _kernel(tests: TestBlock, window: int, only_hit: bool):
    """Batches (doc_id, a, b, text) -> (doc_id, a, b, n_words, spans, items, matches)."""

    def run(batches):
        piece, at, _, _ = tests.suffixes(window)
        for batch in batches:
            for lo, hi in slices(batch.column(3), SHARD_BYTES):
                own = batch.slice(lo, hi - lo)
                n = own.num_rows
                words, (pos, size, which), items, (m_pos, suffix, length), begin = shard_matches(
                    own.column(3), tests, window)
                # hit words: windows laid over each other
                cover = np.zeros(int(words.sum()) + n + 1, dtype=np.int64)
                np.add.at(cover, pos, 1)
                np.add.at(cover, pos + size, -1)
                inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                s, e = edge[0::2], edge[1::2]
                doc = np.searchsorted(begin, s, side="right") - 1
                spans = _lists(doc, pa.StructArray.from_arrays(
                    [pa.array(s - begin[doc]), pa.array(e - begin[doc])], names=["begin", "end"]), n)
                # items of a document: those of its windows
                own_doc = np.searchsorted(begin, pos, side="right") - 1
                seen = np.unique(np.stack([own_doc, which], axis=1), axis=0)
                counts = np.array([len(x) for x in items], dtype=np.int64)[seen[:, 1]] if len(items) else seen[:, 1]
                flat = np.concatenate([items[k] for k in seen[:, 1]]) if len(seen) else seen[:, 1]
                both = np.unique(np.stack([np.repeat(seen[:, 0], counts), flat], axis=1), axis=0)
                names = pa.array(tests.items, type=pa.string())
                item_lists = _lists(both[:, 0], names.take(pa.array(both[:, 1])), n)
                m_doc = np.searchsorted(begin, m_pos, side="right") - 1
                sort = np.lexsort((m_pos, m_doc))
                m_doc, m_pos, suffix, length = m_doc[sort], m_pos[sort], suffix[sort], length[sort]
                matches = _lists(m_doc, pa.StructArray.from_arrays(
                    [names.take(pa.array(tests.item[piece[suffix]])),
                     pa.array(at[suffix] - tests.first[piece[suffix]] + tests.begin[piece[suffix]]),
                     pa.array(m_pos - begin[m_doc]), pa.array(length)],
                    names=["item", "item_word", "doc_word", "length"]), n)
                out = pa.RecordBatch.from_arrays(
                    [*own.columns[:3], pa.array(words), spans, item_lists, matches],
                    names=["doc_id", "a", "b", "n_words", "spans", "items", "matches"])
                yield out.filter(pc.greater(pc.list_value_length(spans), 0)) if only_hit else out

    return run


def covered(spans) -> F.Column:
    """Number of words in spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(s, x):
        return F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["begin"], s["to"]), F.lit(0))).alias("n"),
                        F.greatest(s["to"], x["end"]).alias("to"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def find_matches(docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                 test_id_col: str = "item_id", test_text_col: str = "text") -> DataFrame:
    """Of every document: doc_id, n_words, n_hit (words inside an occurrence of a window), spans (of
    them), items (with occurring windows, as sorted strings; null ids as null), matches (longest verbatim
    matches with its shard: item, item_word, doc_word, length) and the text's key (a, b)."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("a"),
                       F.xxhash64(F.lit(7), text).alias("b"), text.alias("text"))
    schema = f"doc_id {rows.dtypes[0][1]}, a long, b long, n_words long, spans {SPAN}, items array<string>, matches {MATCH}"
    found, more = None, None
    for block in blocks_of(tests, window, test_id_col, test_text_col):
        own = rows.mapInArrow(_kernel(TestBlock(block), window, found is not None), schema)
        own = materialize(own, "llm-matches")
        if found is None:
            found = own
        else:
            own = own.select("a", "b", "spans", "items", "matches").dropDuplicates(["a", "b"])
            more = own if more is None else more.unionByName(own)
    if more is not None:
        more = more.groupBy(F.col("a").alias("m_a"), F.col("b").alias("m_b")).agg(
            *[F.flatten(F.collect_list(c)).alias(f"m_{c}") for c in ("spans", "items", "matches")])
        both = found.join(more, (F.col("a") == F.col("m_a")) & (F.col("b") == F.col("m_b")), "left")
        found = both.select("doc_id", "a", "b", "n_words", *[
            F.concat(c, F.coalesce(f"m_{c}", F.array().cast(kind))).alias(c)
            for c, kind in (("spans", SPAN), ("items", "array<string>"), ("matches", MATCH))])
    return found.select("doc_id", "a", "b", "n_words", covered(F.col("spans")).alias("n_hit"), "spans",
                        F.array_sort(F.array_distinct("items")).alias("items"), "matches")


def longest_matches(found: DataFrame) -> DataFrame:
    """Per word of a test text at which a longest match of some shard begins: the longest in the whole
    corpus, with one place of it (the smallest doc_id)."""
    each = found.select("doc_id", F.explode("matches").alias("m")).select(
        "m.item", "m.item_word", "m.length", "doc_id", "m.doc_word")
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_word")).alias("best")
    return each.groupBy("item", "item_word").agg(best).select(
        "item", "item_word", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_word")


def decontaminated(docs: DataFrame, tests: DataFrame, window: int = 10, text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of a test text."""
    found = find_matches(docs, tests, window, text_col=text_col, **columns)
    gone = found.where("n_hit > 0").select(F.struct("a", "b").alias("gone")).distinct()
    text = text_or_empty(text_col)
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    return docs.join(gone, key == gone["gone"], "left_anti")


#: The same from a join of windows.
ORACLE = """
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}') as w
  from documents),
t as (
  select item_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}') as w from benchmark),
i as (
  select item_id, least(len(w), {n}) as m, list_aggregate(w[k + 1:k + least(len(w), {n})], 'string_agg', ' ') as g
  from (select *, unnest(range(greatest(len(w) - {n} + 1, 1))) as k from t where len(w) > 0)),
p as (
  select r, m, k, list_aggregate(w[k + 1:k + m], 'string_agg', ' ') as g
  from (select r, w, m, unnest(range(len(w) - m + 1)) as k from d, (select distinct m from i) where len(w) >= m)),
h as (select r, p.m, k, item_id from p join i on p.g = i.g and p.m = i.m),
c as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + m)) as x from h) group by r),
l as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item_id::varchar as item from h) group by r)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.r = c.r left join l on d.r = l.r
""".replace("{upper}", _LETTERS).replace("{lower}", _LETTERS.lower()).replace("{word}", WORD)
