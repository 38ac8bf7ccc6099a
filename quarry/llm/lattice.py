"""Near-duplicate embeddings by lattice hashing.

In each of ``tables`` tables a vector of unit length is projected on ``blocks`` times eight
random directions, scaled, and each group of eight coordinates decoded to the nearest
point of the E8 lattice; the points together name the vector's cell.  A vector is indexed in its
own cell and probes the ``probes`` cells that one step of the lattice (one of the 240
shortest vectors, in one block) brings nearest.  Two vectors meet in a cell that
one of them owns and the other owns or probes; what meets is verified by cosine.

Recall is set by ``tables``, ``probes`` and ``scale``: at a cosine of 0.95 a pair meets in one
table with a probability of about 0.55, so six tables find over 99 % (measured in
the tests).  More ``blocks`` make cells finer for more vectors.

Only distinct vectors are hashed; copies link to each other and follow.  Cells travel
without vectors first, and only those where vectors meet get them.  A cell of more than
``BUCKET`` vectors is dealt in blocks, each pair of blocks being a group of its own.  A
pair that meets in several cells counts in the one with the smallest key.  Pairs stay inside a
task: out come sums of links per vector, and the links of small groups or, of large ones,
as many as connect them.

Defined results: vectors that are null, empty, zero, or hold a null or a component that is not
finite link with nothing; vectors link with such of their own length only; a null id is kept, and
a component's smallest id ignores it; rows that repeat an id count as further vectors; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, shuffle_partitions
from quarry.llm.components import components
from quarry.llm.vectors import by_group, matrices, usable, vector_key

BUCKET = 1024
SHORT_RUN = 16
PAIRS_AT_ONCE = 20_000


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even
    number of minus signs."""
    out = []
    for (i, j), signs in product(combinations(range(8), 2), product((1, -1), repeat=2)):
        v = np.zeros(8)
        v[[i, j]] = signs
        out.append(v)
    out += [np.array(s) for s in product((.5, -.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: rounded, and where the sum is odd the
    coordinate with the largest error goes to its other neighbour."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        e = y[odd] - r[odd]
        worst = np.abs(e).argmax(axis=1)
        r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better one of the even integer points and those shifted by 1/2."""
    a, b = _nearest_even(y), _nearest_even(y - .5) + .5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


@dataclass(frozen=True)
class Lattice:
    tables: int = 6
    blocks: int = 2
    probes: int = 4
    scale: float = 0.5
    seed: int = 42

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Cell keys, (vectors, tables, 1 + probes), the own cell first."""
        n, d = unit.shape
        rng = np.random.default_rng([self.seed, d])
        steps = shortest_vectors()
        out = np.empty((n, self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            directions = rng.normal(size=(d, 8 * self.blocks))
            mix = rng.integers(1, 2**62, size=(self.blocks, 8), dtype=np.int64) * 2 + 1
            salt = int(rng.integers(0, 2**62))
            y = (unit @ directions * self.scale).reshape(-1, 8)
            own = decode_e8(y)
            # a step v brings the cell nearer by 2 (y - own) v - v v, and v v is 2
            gain = (2 * (y - own) @ steps.T - 2).reshape(n, -1)
            best = np.argpartition(-gain, self.probes, axis=1)[:, :self.probes]
            with np.errstate(over="ignore"):
                code = (2 * own).astype(np.int64).reshape(n, self.blocks, 8)
                key = (code * mix).sum(axis=(1, 2)) + salt
                moved = (2 * steps).astype(np.int64) @ mix.T                 # (240, blocks)
                out[:, t, 0] = key
                out[:, t, 1:] = key[:, None] + moved[best % 240, best // 240]
        return _spread(out)


def _spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits, so that sums of coordinates make even keys."""
    with np.errstate(over="ignore"):
        z = x.view(np.uint64)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (z ^ (z >> np.uint64(33))).view(np.int64)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """node, key, vector, copies, least (vec_id) of the vectors that can link."""
    can = usable("vector") & F.exists("vector", lambda x: x != 0)
    nodes = (rows.where(can).groupBy(vector_key("vector").alias("key"))
             .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"),
                  F.min("vec_id").alias("least")))
    return materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "llm-vectors")


def cells(nodes: DataFrame, lattice: Lattice) -> DataFrame:
    """(cell, node, own) for every cell that a vector owns or probes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in matrices(batch.column(1)):
                for lo in range(0, len(rows), 2000):
                    k = lattice.keys(unit_vectors(x[lo:lo + 2000]))
                    own = np.zeros(k.shape, dtype=bool)
                    own[:, :, 0] = True
                    node = np.broadcast_to(ids[rows[lo:lo + 2000], None, None], k.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k.ravel()), pa.array(node.ravel()), pa.array(own.ravel())],
                        names=["cell", "node", "own"])

    return nodes.select("node", "vector").mapInArrow(run, "cell long, node long, own boolean")


def _pairs(group, part, own, unit, least_cosine):
    """Rows (i, j) that meet in a group and reach the cosine, and whether their group is large."""
    edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    size = np.diff(edge)
    run, short = np.repeat(np.arange(len(size)), size), np.repeat(size <= SHORT_RUN, size)
    for step in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
        i = np.flatnonzero((run[step:] == run[:-step]) & short[step:] & (own[step:] | own[:-step])
                           & (part[step:] == part[:-step]))
        for lo in range(0, len(i), PAIRS_AT_ONCE):
            a = i[lo:lo + PAIRS_AT_ONCE]
            near = np.einsum("ij,ij->i", unit[a], unit[a + step]) >= least_cosine
            yield a[near], a[near] + step, False
    for k in np.flatnonzero(size > SHORT_RUN):
        lo, hi = edge[k], edge[k + 1]
        # dealt in blocks: across the two blocks only; else every pair once
        crossing = len(np.unique(part[lo:hi])) > 1
        for at in range(lo, hi, 64):
            rows = np.arange(at, min(at + 64, hi))
            near = unit[rows] @ unit[lo:hi].T >= least_cosine
            near &= own[rows][:, None] | own[lo:hi][None, :]
            near &= (rows[:, None] < np.arange(lo, hi)[None, :]) if not crossing else (
                part[rows][:, None] < part[lo:hi][None, :])
            a, b = np.nonzero(near)
            yield rows[a], b + lo, True


def _meet_first(cell, keys, a, b):
    """Whether the pair's smallest common cell is this one."""
    first = np.iinfo(np.int64).max
    out = np.full(len(a), first)
    for x, y in ((a, b), (b, a)):
        own = keys[x][:, :, 0]
        met = (own[:, :, None] == keys[y]).any(axis=2)
        out = np.minimum(out, np.where(met, own, first).min(axis=1))
    return out == cell


def _count_links(lattice: Lattice, least_cosine: float):

    def run(batches):
        for table in by_group(batches):
            group, cell, part, node, copies = (table.column(i).to_numpy() for i in range(5))
            own = table.column(5).to_numpy()
            vectors = table.column(6).combine_chunks()
            for rows, x in matrices(vectors):
                g, c, p, o = group[rows], cell[rows], part[rows], own[rows]
                unit = unit_vectors(x)
                keys = np.concatenate([lattice.keys(unit[i:i + 2000]) for i in range(0, len(unit), 2000)])
                links = np.zeros(len(rows), dtype=np.int64)
                out = []
                for a, b, large in _pairs(g, p, o, unit, least_cosine):
                    for lo in range(0, len(a), PAIRS_AT_ONCE):
                        i, j = a[lo:lo + PAIRS_AT_ONCE], b[lo:lo + PAIRS_AT_ONCE]
                        once = _meet_first(c[i], keys, i, j)
                        i, j = i[once], j[once]
                        np.add.at(links, i, copies[rows[j]])
                        np.add.at(links, j, copies[rows[i]])
                        if large:       # of a large group, as many as connect
                            i, j = _forest(i, j)
                        out.append((node[rows[i]], node[rows[j]]))
                some = np.flatnonzero(links)
                a = np.concatenate([node[rows[some]], *[x for x, _ in out]])
                b = np.concatenate([np.full(len(some), -1), *[y for _, y in out]])
                n = np.concatenate([links[some], np.zeros(len(a) - len(some), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, as many as connect what they connect (repeated least labels)."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label, keep = np.arange(len(ids)), []
    while True:
        lx, ly = label[x], label[y]
        apart = np.flatnonzero(lx != ly)
        if not len(apart):
            break
        hi = np.maximum(lx, ly)[apart]
        _, one = np.unique(hi, return_index=True)       # each larger label joins a smaller one
        chosen = apart[one]
        keep.append(chosen)
        root = np.arange(len(ids))
        root[np.maximum(lx, ly)[chosen]] = np.minimum(lx, ly)[chosen]
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
    keep = np.concatenate(keep)
    return a[keep], b[keep]


def near_duplicates(embeddings: DataFrame, least_cosine: float = 0.95, lattice: Lattice = Lattice(),
                    id_col: str = "vec_id", vector_col: str = "embedding",
                    bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    nodes = distinct_vectors(rows)
    every = materialize(cells(nodes, lattice), "llm-cells")
    met = (every.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned"))
           .where("n > 1 and owned").select(F.col("cell").alias("m_cell"), F.ceil(F.col("n") / bucket).alias("parts")))
    active = every.join(met, F.col("cell") == F.col("m_cell"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    active = active.withColumn("part", part).withColumn("other", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    active = active.withColumn("group", F.xxhash64(
        "cell", F.least("part", "other"), F.greatest("part", "other")))
    full = active.select("group", "cell", "part", "node", "own").join(
        nodes.select("node", "copies", "vector"), "node")
    dealt = (full.select("group", "cell", "part", "node", "copies", "own", "vector")
             .repartition(shuffle_partitions(rows), "group").sortWithinPartitions("group"))
    found = materialize(dealt.mapInArrow(_count_links(lattice, least_cosine), "a long, b long, n long"),
                        "llm-vector-links")
    links = found.where("b < 0").groupBy(F.col("a").alias("l_node")).agg(F.sum("n").alias("links"))
    comp = components(found.where("b >= 0").select("a", "b"))
    rooted = (nodes.join(comp, nodes["node"] == comp["node"], "left")
              .select(nodes["node"], "key", "copies", "least", F.coalesce("root", nodes["node"]).alias("root"))
              .join(links, F.col("node") == F.col("l_node"), "left"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(
        F.col("key").alias("n_key"), "component_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    can = usable("vector") & F.exists("vector", lambda x: x != 0)
    keyed = rows.select("vec_id", F.when(can, vector_key("vector")).alias("key"))
    own = F.when(F.col("n_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return keyed.join(named, F.col("key") == F.col("n_key"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
