"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor empty, no component null or not finite."""
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vector_key(vector: str) -> Column:
    """A 128-bit key of a whole vector."""
    return F.struct(F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(7), vector).alias("b"))


def matrices(column: pa.Array):
    """(row numbers, matrix of doubles) for each length of vector in a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)].astype(np.float64)


def by_group(batches):
    """Whole groups from batches sorted by their first column: yields tables in which no
    group is cut.  Holds one batch and the unfinished group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables(
            [held, pa.Table.from_batches([batch])])
        g = now.column(0).to_numpy()
        last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
        if last:
            yield now.slice(0, last).combine_chunks()
        held = now.slice(last)
    if held is not None:
        yield held.combine_chunks()
