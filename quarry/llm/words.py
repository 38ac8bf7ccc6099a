"""Words of many texts at once, as numbers, by a table of byte kinds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Kinds of bytes: part of a word, between words, between pieces of a text.
WORD_BYTE, BLANK, CUT = 0, 1, 2
_LOWER = bytes(range(256)).lower()      # A-Z only: other letters have bytes of 128 and more


def byte_kinds(word, cut=()) -> np.ndarray:
    """The table: ``word`` says of a byte whether it belongs to words, ``cut`` lists those between pieces."""
    return np.array([CUT if b in cut else WORD_BYTE if word(b) else BLANK for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """``code[i]`` is the place of word i in ``vocabulary`` (binary); text t has the words
    ``first[t]:first[t + 1]``; ``opens[i]`` says that word i is the first of its piece."""

    code: np.ndarray
    vocabulary: pa.Array
    first: np.ndarray
    opens: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the texts' offsets in them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    ends = ends[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    return data, ends - ends[0]


def cut_words(texts: pa.Array, kinds: np.ndarray, lower: bool = False) -> Words:
    """Words are maximal runs of word bytes within a text; ``lower`` lower-cases A-Z first."""
    data, offsets = text_bytes(texts)
    if lower:
        data = np.frombuffer(data.tobytes().translate(_LOWER), dtype=np.uint8)
    n = len(data)
    kind = kinds[data]
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = kind == WORD_BYTE
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends = inside[:-1] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    opens = np.zeros(len(start), dtype=bool)
    cuts = np.flatnonzero(kind == CUT)
    if len(cuts):
        piece = np.searchsorted(cuts, start)
        opens[1:] = piece[1:] != piece[:-1]
    opens[first[:-1][first[:-1] < first[1:]]] = True
    if not len(start):
        return Words(np.zeros(0, dtype=np.int64), pa.array([], type=pa.binary()), first, opens, data, offsets)
    # words and what lies between them, in turn: the bytes need not be copied
    bounds = np.empty(2 * len(start), dtype=np.int32)
    bounds[0::2], bounds[1::2] = start, end
    every = pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                  [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    return Words(code, coded.dictionary, first, opens, data, offsets)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a number a word or byte) for each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
