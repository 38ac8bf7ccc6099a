"""Phrase collocations, mined from an FM-index per shard.

A shard is a stretch of texts (``SHARD_BYTES``) as word numbers, a number for each (language, word),
with a zero between pieces.  Its index holds the Burrows-Wheeler transform of the sequence and of its reverse, each as
the places of every symbol in symbol order.  Sorting to ``MOST_WORDS`` words is enough, since no phrase is longer.
A phrase is an interval in both indexes.  Extending all phrases of a length by a word on the right (even lengths) or
left (odd lengths) reads the symbols in their intervals: the number of each is the count of the longer phrase, the
symbols before it give one interval, the places of the symbol the other.  Zeros in an interval are occurrences at the edge
of a piece: the rest can be extended.

The shards are written once and read for each length.  The counts of a length are summed across shards; phrases that
reach ``least`` go on.  A phrase of n words is only enumerated if both of its parts of n - 1 words may be frequent, which
the tasks look up in a bitmap of hashes: its size is bounded (``MOST_BITS``), and since every count is summed in
full a chance hit adds a row to the shuffle, but no result.  Pairs of frequent words are many: they are counted by 32 bits
of their hashes first, packed in sorted runs of a few bytes a pair, and only pairs whose bits reach ``least`` are counted
by their words.

A cut of a phrase after its first k words scores floor(1000 * a * n / (l * r)) in exact decimals.  A phrase is
dropped if it stands in a longer one as often as anywhere; the longer one by a word decides, as counts never grow with length.

Defined results: a null text is empty, a null language is ``und``; empty and blank texts and an empty table have no
phrases; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, text_or_empty
from quarry.llm.packing import slices
from quarry.llm.suffix_arrays import spread, suffix_array
from quarry.llm.words import byte_kinds, cut_words
from quarry.session import shared_path

SHARD_BYTES = 8 << 20
#: Shards in a file: a reader holds a file's rows at once.
SHARDS_A_FILE = 2
MOST_WORDS = 5
#: Bits of a bitmap: a multiple of the phrases in it, a power of two, at most 16 MB.
BITS_A_PHRASE, LEAST_BITS, MOST_BITS = 32, 1 << 12, 1 << 27
_WORDS = byte_kinds(lambda b: b not in (0x20, 0x09), cut=b".,;:!?\n\x0b\x0c\r")
_U = np.uint64


def word_hashes(words: pa.Array, langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (language, word)."""
    seeds = [xxhash.xxh64_intdigest(x) for x in langs.dictionary.cast(pa.binary()).to_pylist()]
    seed = np.array(seeds, dtype=_U)[langs.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.zeros(0, dtype=_U)
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), dtype=_U, count=len(words))
    with np.errstate(over="ignore"):
        return own ^ (seed * _U(0x9E3779B97F4A7C15))


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, one array for each place."""
    with np.errstate(over="ignore"):
        z = np.zeros_like(columns[0])
        for c in columns:
            z = (z ^ c) * _U(0xBF58476D1CE4E5B9)
            z ^= z >> _U(29)
        return z


class FrequentPhrases:
    """A bitmap of phrase hashes: a phrase that was put in is always found."""

    def __init__(self, bits: int, block: np.ndarray, word: np.ndarray):
        self.shift = _U(64 - (bits.bit_length() - 1))
        self.words = np.zeros(max(bits >> 6, 1), dtype=np.int64)
        self.words[block] = word

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1

    @staticmethod
    def of_hashes(hashed: DataFrame) -> FrequentPhrases:
        """From rows (hash): as longs; of which only the first bits count."""
        bits, n = LEAST_BITS, hashed.count()
        while bits < min(n * BITS_A_PHRASE, MOST_BITS):
            bits *= 2
        at = F.shiftrightunsigned("hash", 64 - (bits.bit_length() - 1))
        found = hashed.groupBy((at / 64).cast("long").alias("block")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("word")).toArrow()
        return FrequentPhrases(bits, found.column("block").to_numpy(), found.column("word").to_numpy())

    @staticmethod
    def of(frequent: DataFrame) -> FrequentPhrases:
        """From rows (lang, phrase)."""

        def hashed(batches):
            for batch in batches:
                words = pc.split_pattern(batch.column(1), " ")
                size = pc.list_value_length(words).to_numpy()
                lang = batch.column(0).dictionary_encode()
                owner = np.repeat(np.arange(batch.num_rows), size)
                each = word_hashes(words.flatten(), lang.take(pa.array(owner)))
                first = np.cumsum(size) - size
                for k in np.unique(size):
                    rows = np.flatnonzero(size == k)
                    own = phrase_hashes([each[first[rows] + i] for i in range(k)])
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["hash"])

        return FrequentPhrases.of_hashes(frequent.select("lang", "phrase").mapInArrow(hashed, "hash long"))


class Transform:
    """One direction of a shard's index: ``places`` are the slots in which each symbol stands before the suffix
    (of the sequence or its reverse), in symbol order."""

    def __init__(self, places: np.ndarray, counts: np.ndarray):
        self.places, self.counts = places, counts

    def extended(self, lo: np.ndarray, other: np.ndarray, size: np.ndarray):
        """All intervals lo:lo + size by a symbol more: (parent, symbol, lo, other, size); ``other`` begins the
        interval in the other direction."""
        n, kinds = len(self.places), len(self.counts)
        in_order = np.repeat(np.arange(kinds, dtype=np.int32), self.counts)
        before = np.empty(n, dtype=np.int32)
        before[self.places] = in_order
        which, slot = spread(lo, lo + size)
        which *= kinds
        which += before[slot]
        del before, slot
        which.sort()
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        pairs, counts = which[first], np.diff(first, append=len(which))
        del which
        parent, symbol = np.divmod(pairs, kinds)
        # smaller symbols in the parent's interval
        below = first - (np.cumsum(size) - size)[parent]
        word = symbol > 0
        parent, symbol, counts, below = parent[word], symbol[word], counts[word], below[word]
        # where the symbol stands before a suffix below the interval: the longer phrase begins there
        key = in_order.astype(np.int64)
        key *= n + 1
        key += self.places
        return parent, symbol, np.searchsorted(key, symbol * (n + 1) + lo[parent]), other[parent] + below, counts

    def at_edge(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Occurrences with no word before (or, in the reverse, after) them."""
        zeros = self.places[:self.counts[0]]
        return np.searchsorted(zeros, lo + size) - np.searchsorted(zeros, lo)


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32, each less the one before, byte by byte: what compresses well where they are sorted."""
    steps = np.diff(x.astype("<u4"), prepend=np.zeros(1, dtype="<u4"))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(b) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype="<u4")


def transform_places(sequence: np.ndarray) -> np.ndarray:
    """``places`` of a sequence's transform."""
    order = suffix_array(sequence, MOST_WORDS)
    return np.argsort(sequence[order - 1], kind="stable").astype("<i4")


INDEX = "words array<string>, langs array<string>, lang_of binary, counts binary, forward binary, backward binary"


def _index_rows(batches):
    """Batches (lang, text) -> a row for each shard."""
    for batch in batches:
        for lo, hi in slices(batch.column(1), SHARD_BYTES):
            own = batch.slice(lo, hi - lo)
            w = cut_words(own.column(1), _WORDS, lower=True)
            if not len(w.code):
                continue
            lang = own.column(0).dictionary_encode()
            lang_code = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(w.first))
            each, symbol, counts = np.unique(lang_code * len(w.vocabulary) + w.code, return_inverse=True, return_counts=True)
            at = np.arange(len(w.code)) + np.cumsum(w.opens)
            sequence = np.zeros(at[-1] + 2, dtype=np.int64)
            sequence[at] = symbol.ravel() + 1
            counts = np.concatenate([[len(sequence) - len(w.code)], counts])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, len(each)], w.vocabulary.take(pa.array(each % len(w.vocabulary))).cast(pa.string())),
                 pa.ListArray.from_arrays([0, len(lang.dictionary)], lang.dictionary),
                 *[pa.array([packed(x)], type=pa.binary()) for x in (
                     each // len(w.vocabulary), counts, transform_places(sequence), transform_places(sequence[::-1]))]],
                names=["words", "langs", "lang_of", "counts", "forward", "backward"])


def index_shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The index of every shard, written to the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    path = shared_path(docs.sparkSession, "llm-phrase-index")
    rows.mapInArrow(_index_rows, INDEX).write.option("maxRecordsPerFile", SHARDS_A_FILE).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def shard_phrases(row: dict, n: int, frequent: list[FrequentPhrases], among: FrequentPhrases | None = None):
    """(symbols by place, count, left, right, hash) of all phrases of ``n`` words of a shard both of whose parts may be
    frequent, and that may be in ``among``; left and right are the occurrences that have a word before or after them
    in their piece."""
    counts = unpacked(row["counts"]).astype(np.int64)
    forward, backward = (Transform(unpacked(row[c]).view("<i4"), counts) for c in ("forward", "backward"))
    lang_of = pa.DictionaryArray.from_arrays(pa.array(unpacked(row["lang_of"]).view("<i4")), row["langs"])
    hashes = np.concatenate([np.zeros(1, dtype=_U), word_hashes(row["words"], lang_of)]) if n > 1 else None

    columns, size = [np.arange(1, len(counts))], counts[1:]
    lo = back = np.cumsum(counts)[:-1]
    for length in range(2, n + 1):
        keep = frequent[length - 2].has(phrase_hashes([hashes[c] for c in columns]))
        columns, size, lo, back = [c[keep] for c in columns], size[keep], lo[keep], back[keep]
        if not len(size):
            break
        if length % 2 == 0:
            parent, symbol, back, lo, size = backward.extended(back, lo, size)
            columns = [c[parent] for c in columns] + [symbol]
            other = columns[1:]
        else:
            parent, symbol, lo, back, size = forward.extended(lo, back, size)
            columns = [symbol] + [c[parent] for c in columns]
            other = columns[:-1]
        keep = frequent[length - 2].has(phrase_hashes([hashes[c] for c in other]))
        columns, size, lo, back = [c[keep] for c in columns], size[keep], lo[keep], back[keep]
    if len(columns) < n:
        return [np.zeros(0, dtype=np.int64)] * n, size, size, size, np.zeros(0, dtype=_U)
    own = phrase_hashes([hashes[c] for c in columns]) if n > 1 else np.zeros(len(size), dtype=_U)
    if among is not None:
        keep = among.has(own)
        columns, size, lo, back, own = [c[keep] for c in columns], size[keep], lo[keep], back[keep], own[keep]
    return columns, size, size - forward.at_edge(lo, size), size - backward.at_edge(back, size), own


COUNTED = "lang string, phrase string, f long, left long, right long"


def _rows(batches):
    """The shards of batches, as arrays and buffers."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].values for name in ("words", "langs")} | {
                name: batch.column(name)[i].as_buffer() for name in ("lang_of", "counts", "forward", "backward")}


def count_phrases(index: DataFrame, n: int, frequent: list[FrequentPhrases], among: FrequentPhrases | None = None) -> DataFrame:
    """lang, phrase, f, left, right: the phrases of ``n`` words, summed across shards."""

    def run(batches):
        for row in _rows(batches):
            columns, *numbers, _ = shard_phrases(row, n, frequent, among)
            lang = unpacked(row["lang_of"])
            for lo in range(0, len(columns[0]), 200_000):
                some = [c[lo:lo + 200_000] - 1 for c in columns]
                texts = [row["words"].take(pa.array(c)) for c in some]
                phrase = pc.binary_join_element_wise(*texts, " ") if n > 1 else texts[0]
                yield pa.RecordBatch.from_arrays(
                    [row["langs"].take(pa.array(lang[some[0]])), phrase,
                     *[pa.array(x[lo:lo + 200_000]) for x in numbers]], names=["lang", "phrase", "f", "left", "right"])

    each = index.mapInArrow(run, COUNTED)
    return each.groupBy("lang", "phrase").agg(*[F.sum(c).alias(c) for c in ("f", "left", "right")])


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its counts."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[first], np.add.reduceat(count, first) if len(key) else count


def frequent_hashes(index: DataFrame, n: int, frequent: list[FrequentPhrases], least: int) -> DataFrame:
    """(hash): of phrases of ``n`` words, the first 32 bits (the others are 0) that ``least`` occurrences share."""
    parts = 1 << max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, 0).bit_length()
    shift = np.uint32(33 - parts.bit_length())

    def run(batches):
        for row in _rows(batches):
            _, size, _, _, own = shard_phrases(row, n, frequent)
            key, count = _summed((own >> _U(32)).astype(np.uint32), np.minimum(size, least))
            edge = np.searchsorted(key >> shift if parts > 1 else np.zeros_like(key), np.arange(parts + 1))
            some = np.flatnonzero(edge[1:] > edge[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, type=pa.int64()),
                 *[pa.array([packed(x[edge[i]:edge[i + 1]]) for i in some.tolist()], type=pa.binary()) for x in (key, count)]],
                names=["part", "keys", "counts"])

    def reduced(batches):
        part, held = None, []

        def merged():
            key, count = _summed(*(np.concatenate(x) for x in zip(*held)))
            return key, np.minimum(count, least)

        def sent():
            key, count = merged()
            return pa.RecordBatch.from_arrays([pa.array((key[count >= least].astype(_U) << _U(32)).view(np.int64))], names=["hash"])

        for batch in batches:
            for p, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != part:
                    if held:
                        yield sent()
                    part, held = p, []
                held.append((unpacked(keys.as_buffer()), unpacked(counts.as_buffer()).astype(np.int64)))
                if len(held) > 64:
                    held = [merged()]
        if held:
            yield sent()

    each = index.mapInArrow(run, "part long, keys binary, counts binary")
    dealt = each.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(reduced, "hash long")


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f, left, right) of the phrases of 1 to ``MOST_WORDS`` words that occur ``least``
    times in their language; (lang, n): all word occurrences."""
    index = index_shards(docs, text_col, lang_col)
    words = materialize(count_phrases(index, 1, []), "llm-phrases-1")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found, frequent = [words.where(F.col("f") >= least)], []
    for n in range(2, MOST_WORDS + 1):
        frequent.append(FrequentPhrases.of(found[-1]))
        # pairs are many more than what either word lets expect
        among = FrequentPhrases.of_hashes(materialize(frequent_hashes(index, n, frequent, least), "llm-pairs")) if n == 2 else None
        found.append(materialize(count_phrases(index, n, frequent, among).where(F.col("f") >= least), f"llm-phrases-{n}"))
    every = None
    for n, level in enumerate(found, 1):
        level = level.select("lang", "phrase", F.lit(n).alias("words"), "f", "left", "right")
        every = level if every is None else every.unionByName(level)
    return every, totals


def exact_score(a, n, l, r):
    """floor(1000 * a * n / (l * r)) of counts up to 10^15."""
    wide = [F.col(c).cast("decimal(18,0)") for c in (a, n, l, r)]
    top = (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).cast("decimal(38,0)")
    return F.call_function("div", top, (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score, left, right."""
    every, totals = frequent_phrases(docs, least, text_col, lang_col)
    candidates = every.where("words > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")

    def part(first, size):
        return F.array_join(F.slice(split, first, size), " ")

    longer = every.where("words > 2")
    inner = (longer.select("lang", part(F.lit(1), F.col("words") - 1).alias("inner"), "f")
             .unionByName(longer.select("lang", part(F.lit(2), F.col("words") - 1).alias("inner"), "f"))
             .groupBy(F.col("lang").alias("i_lang"), F.col("inner")).agg(F.max("f").alias("outside")))
    kept = candidates.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("inner"))
                           & (F.col("outside") >= F.col("a")), "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns(
        {"head": part(F.lit(1), F.col("cut")), "tail": part(F.col("cut") + 1, F.col("words") - F.col("cut"))})
    counts = every.select(F.col("lang").alias("c_lang"), F.col("phrase").alias("c_phrase"), F.col("f"))
    for name, of in (("l", "head"), ("r", "tail")):
        cuts = cuts.join(counts.withColumnRenamed("f", name), (F.col("lang") == F.col("c_lang")) & (F.col(of) == F.col("c_phrase")))
        cuts = cuts.drop("c_lang", "c_phrase")
    scored = cuts.join(totals.withColumnRenamed("lang", "t_lang"), F.col("lang") == F.col("t_lang")).withColumn(
        "score", exact_score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(
        *[F.first(c).alias(c) for c in ("a", "n", "left", "right")], F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "left", "right")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
            .withColumn("rank", F.col("rank").cast("long")))


#: All phrases counted in one go.
ORACLE = """
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) as s
  from documents),
w as (select lang, regexp_extract_all(s, '[^\\x20\\x09]+') as w from p),
g as (
  select lang, k, list_aggregate(w[i + 1:i + k], 'string_agg', ' ') as phrase
  from (select lang, w, k, unnest(range(len(w) - k + 1)) as i from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= {least}),
i as (
  select lang, part, max(a) as outside
  from (select lang, a, unnest([list_aggregate(w[1:k - 1], 'string_agg', ' '), list_aggregate(w[2:k], 'string_agg', ' ')]) as part
        from c where k > 2)
  group by lang, part),
d as (
  select c.*, unnest(range(1, k)) as cut from c left join i on c.lang = i.lang and phrase = part
  where coalesce(outside, 0) < a),
s as (
  select d.lang, d.phrase, cut, a, x.f as l, y.f as r, n,
    ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
  from d
  join f x on x.lang = d.lang and x.phrase = list_aggregate(w[1:cut], 'string_agg', ' ')
  join f y on y.lang = d.lang and y.phrase = list_aggregate(w[cut + 1:d.k], 'string_agg', ' ')
  join n on n.lang = d.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r, n, score from t where rank <= {most}
"""
