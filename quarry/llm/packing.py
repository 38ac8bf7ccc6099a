"""Packing by concatenate-and-cut.

All documents' token ids, each closed by an end id, form one long stream; the
stream is cut into windows of ``length`` ids.  Two passes:

1. every partition tokenizes its documents and numbers them with a running sum
   of ids inside the partition; the rows are written once (a task's rows are
   committed as a whole, so a lost executor only repeats its own partitions);
2. a prefix sum over the partition totals -- one number per partition -- gives
   every document its global offset; the windows it crosses follow by arithmetic
   and each crossing is one boundary record (a piece).

Only the last sequence of the whole stream can be shorter than ``length``.

Defined results: a null text counts as empty and yields the end id alone; a null
document id is kept as it is; repeated rows are separate documents; a document
longer than a window becomes several pieces; an empty table gives no piece.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize
from quarry.llm.suffix_arrays import spread
from quarry.llm.words import text_bytes

#: Bytes of text that a task tokenizes at a time; words and parts whose ids a worker remembers.
SLICE_BYTES = 4 << 20
REMEMBERED_WORDS = 300_000
REMEMBERED_PARTS = 600_000
#: The pattern by which the lower-casing word tokenizer cuts words.  Words of plain characters (printable
#: ASCII and the Latin-1 letters, where lower case is plain and there is nothing to normalize) are cut here by the same.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
GAP, LETTER, DIGIT, SIGN, ODD = range(5)
_KIND = np.full(256, ODD, dtype=np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = GAP
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER


def cut_parts(texts: pa.Array, special: list[bytes]):
    """The parts of whole texts: (codes, their dictionary, whether each of it is a word that is not plain and was left whole,
    offsets of the texts in the codes).  A word that holds a special token is left whole too."""
    raw, offsets = text_bytes(texts)
    n = len(raw)
    kind = np.append(_KIND[raw], np.uint8(GAP))
    lower = raw.copy()
    lower[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, dtype=np.int64)
    second = raw[lead + 1]
    fine = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    lead, second = lead[fine], second[fine]
    kind[lead] = kind[lead + 1] = LETTER
    lower[lead[second <= 0x9E] + 1] += 0x20
    whole = raw.tobytes() if special else b""
    for s in special:
        at = whole.find(s)
        while at >= 0:
            kind[at:at + len(s)] = ODD
            at = whole.find(s, at + 1)

    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = kind != GAP
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    words = np.flatnonzero(begins)
    # words that are not plain stay whole and as they are
    odd = np.flatnonzero(kind == ODD)
    odd_word = np.unique(np.searchsorted(words, odd, side="right") - 1)
    where, at = spread(words[odd_word], ends[odd_word])
    lower[at], kind[at] = raw[at], ODD
    cut = begins
    change = np.zeros(n + 1, dtype=bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut |= change & inside
    # an apostrophe by itself takes an ending along: the letters after it begin later
    mark = np.flatnonzero((raw == 0x27) & (kind[:-1] == SIGN) & cut[:-1] & (kind[1:] == LETTER) & ~edge[1:])
    free = np.ones(len(mark), dtype=bool)
    next_edge = ends[np.searchsorted(ends, mark, side="right")] if len(mark) else mark
    padded = np.append(lower, np.zeros(2, dtype=np.uint8))
    for e in ENDINGS:
        hit = free & (mark + len(e) < next_edge)
        for k, c in enumerate(e):
            hit &= padded[mark + 1 + k] == c
        own = mark[hit]
        cut[own + 1] = False
        after = own + 1 + len(e)
        cut[after[kind[after] == LETTER]] |= ~edge[after[kind[after] == LETTER]] & inside[after[kind[after] == LETTER]]
        free &= ~hit
    start = np.flatnonzero(cut)
    if not len(start):
        return start, pa.array([], type=pa.binary()), np.zeros(0, dtype=bool), np.zeros(len(offsets), dtype=np.int64)
    # a part ends where the next one begins or its word ends
    stop = np.minimum(np.append(start[1:], n), ends[np.searchsorted(ends, start, side="right")])
    bounds = np.empty(2 * len(start), dtype=np.int32)
    bounds[0::2], bounds[1::2] = start, stop
    coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(lower))]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    left = np.zeros(len(coded.dictionary), dtype=bool)
    left[codes[kind[start] == ODD]] = True
    return codes, coded.dictionary, left, np.searchsorted(start, offsets)


class WordTokenizer:
    """Ids of whole texts, through a memory of the ids of words and of their parts.

    Exact for tokenizers that never join characters across ASCII white space and
    drop it (the default one cuts at white space before its merges): the ids of a
    text are then those of its words, in order.  A probe holds a tokenizer to that;
    others encode whole texts.  Where the tokenizer's file names ``CUT_PATTERN``, words of
    plain characters are cut by it here, all words of a slice of texts at once, and each different part is
    encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        rules.pop("model")
        self.special = [t["content"] for t in rules.get("added_tokens", [])]
        self.cuts = json.dumps(CUT_PATTERN) in json.dumps(rules) and '"Lowercase"' in json.dumps(rules)
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.separable = self._probe()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _probe(self) -> bool:
        words = ["It's", "a", "PROBE,", "\xe9t\xe9", "\xe9", "12.5%", "\u4f60\u597d", "<|x|>", "\U0001f600!"]
        for gap in (" ", "  ", "\n", "\t\r\n"):
            if self._encode([gap + gap.join(words) + gap])[0] != b"".join(self._encode(words)):
                return False
        return True

    def _learn_parts(self, parts: list[str]) -> None:
        """Ids of parts that the tokenizer takes one at a time, many in one text."""
        new = [p for p in parts if p not in self.parts]
        if len(self.parts) + len(new) > REMEMBERED_PARTS:
            self.parts, new = {}, parts
        for lo in range(0, len(new), 1000):
            some = new[lo:lo + 1000]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.asarray(done.ids, dtype="<u4")
            ends = np.cumsum(np.bincount(np.asarray(done.word_ids, dtype=np.int64), minlength=len(some)))
            for p, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist()):
                self.parts[p] = ids[a:b].tobytes()

    def _joined(self, each: list[bytes], codes: np.ndarray, first: np.ndarray):
        """(all ids in order, offsets of the texts in them), from the ids of each code."""
        ids = np.frombuffer(b"".join(each), dtype="<u4")
        sizes = np.array([len(x) for x in each], dtype=np.int64) // 4
        begin = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])
        return ids[at], ends[first]

    def _by_parts(self, texts: pa.Array):
        codes, dictionary, left, first = cut_parts(texts, [s.encode() for s in self.special])
        used = np.zeros(len(dictionary), dtype=bool)
        used[codes] = True
        parts = [p.decode() for p in dictionary.to_pylist()]
        # gaps between words are in the dictionary too
        plain = [p for p, u, w in zip(parts, used.tolist(), left.tolist()) if u and not w]
        whole = [p for p, u, w in zip(parts, used.tolist(), left.tolist()) if u and w]
        self._learn_parts(plain)
        new = [w for w in whole if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known, new = {"": b""}, whole
        self.known.update(zip(new, self._encode(new)))
        each = [b"" if not u else self.known[p] if w else self.parts[p]
                for p, u, w in zip(parts, used.tolist(), left.tolist())]
        return self._joined(each, codes, first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, offsets of the texts in them)."""
        if not self.separable:
            each = self._encode(texts.to_pylist())
            sizes = np.array([len(x) // 4 for x in each], dtype=np.int64)
            return np.frombuffer(b"".join(each), dtype="<u4"), np.concatenate([[0], np.cumsum(sizes)])
        if self.cuts:
            return self._by_parts(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known = {"": b""}
            new = [w for w in words if w]
        self.known.update(zip(new, self._encode(new)))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return self._joined([self.known[w] for w in words], codes, split.offsets.to_numpy() - split.offsets[0].as_py())


@functools.lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its memory outlives a task."""
    return WordTokenizer(path)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, at least one row each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(size):
        yield begin, len(size)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int | None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (little-endian unsigned 32-bit, the end id
    last unless it is None), ``n`` ids, ``part`` and ``before`` (ids before it in its
    partition).  Written once to the shared folder."""
    bounded_batches(docs.sparkSession, 16 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        part, before, tok = TaskContext.get().partitionId(), 0, word_tokenizer(tokenizer_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in slices(texts):
                ids, ends = tok.encode(texts.slice(lo, hi - lo))
                if end_id is not None:
                    ids = np.insert(ids, ends[1:], end_id)
                    ends = ends + np.arange(len(ends))
                n = np.diff(ends)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [
                    None, pa.py_buffer((ends * 4).astype(np.int32)),
                    pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), packed, pa.array(n),
                     pa.array(np.full(hi - lo, part, dtype=np.int32)),
                     pa.array(before + ends[:-1])], names=["doc_id", "ids", "n", "part", "before"])
                before += int(ends[-1])

    out = rows.mapInArrow(run, "doc_id long, ids binary, n long, part int, before long")
    return materialize(out, "llm-tokens", compression="zstd")


def pack(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of the concatenated stream: ``doc_id, start, length, ids, doc_tokens,
    sequence_id, offset``.  ``ids`` holds the piece's ids as in :func:`tokenized`.

    The prefix sum runs over one row per partition of the token table (a number
    that Spark's driver tracks task by task anyway) and is small enough to send
    to every task."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    at = F.col("ahead") + F.col("before")
    n = F.col("n")

    def cut(window):
        start = F.greatest(window * length - at, F.lit(0))
        size = F.least((window + 1) * length - at, n) - start
        return F.struct(
            start.alias("start"), size.alias("length"),
            F.substring("ids", (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
            window.alias("sequence_id"), (at + start - window * length).alias("offset"))

    windows = F.sequence(F.floor(at / length), F.floor((at + n - 1) / length))
    placed = tokens.where(n > 0).join(F.broadcast(parts), "part")
    return (placed.select("doc_id", n.alias("doc_tokens"),
                          F.explode(F.transform(windows, cut)).alias("piece"))
                  .select("doc_id", "piece.start", "piece.length", "piece.ids", "doc_tokens",
                          "piece.sequence_id", "piece.offset"))
