"""Lexical and dense scores of a block of questions, side by side over one scan of the documents.

The store holds a row per document: its tokens, its vector (or null) and what routes can ask for.
Nothing is shuffled to score it.  A first pass gives per question the largest lexical score and
the distance bounds (three numbers per task and question); a second one scores again with those
and keeps a running top-k per task, so that at most tasks x questions x k rows leave the scan.
Two scans answer any number of questions: the blocks go to the executors' disks as broadcasts of bounded
size, and a task takes them up one after the other for each batch of documents.

A document without a vector, and every document for a question without one, has semantic
score 0 and competes on its lexical half; a document without a hit competes on the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import lexical as lx
from quarry.operators.collections import content_hash

#: Scores that a task holds at a time, tokens whose terms it looks up at a time, and questions in a block.
CELLS = 500_000
TOKENS = 500_000
QUESTIONS = 1024
#: Values this close to the k-th best go on to the ranking, which rounds to 6 digits.
RANK_MARGIN = 2e-6
#: Candidates that a task holds for all its questions.
HELD_ROWS = 4_000_000


@dataclass
class Store:
    """``rows``: doc_id, tokens, v, rv; ``index``: the idf table and statistics."""
    rows: DataFrame
    index: lx.BM25Index
    _avgdl: float | None = None

    @property
    def avgdl(self) -> float:
        if self._avgdl is None:
            self._avgdl = float(self.index.stats.first()["avgdl"] or 0.0)
        return self._avgdl


#: Stores that this application has opened, by path; a path is named after its content.
_OPEN: dict[tuple, Store] = {}


def route_tags(columns) -> F.Column:
    """``column=value`` of each of a document's route columns that is not null."""
    tags = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns or ()]
    return F.array_compact(F.array(*tags)).cast("array<string>")


def open_store(collection: DataFrame, route_cols: list[str] | None = None,
               index: lx.BM25Index | None = None) -> Store:
    """The collection (doc_id, text, embedding, ...) as a store in the index folder; built when
    there is none with the same content, reopened otherwise, by this session or a later one."""
    from quarry.session import index_dir, is_complete, mark_complete, memo_fingerprint
    spark = collection.sparkSession
    route = route_tags(route_cols)
    vector = F.col("embedding") if "embedding" in collection.columns else F.lit(None)
    vector, known_hash = vector.cast("array<double>"), "text_hash" in collection.columns
    narrow = collection.select("doc_id", "text", vector.alias("v"), route.alias("rv"))
    # a collection that was joined brings its texts' hashes along: no text is shuffled to be told from others
    hashed = collection.select("doc_id", (F.col("text_hash") if known_hash else F.xxhash64("text")).alias("text"),
                               F.xxhash64(vector).alias("v"), route.alias("rv"))

    def compute():
        r = hashed.agg(F.count(F.lit(1)).alias("n"), content_hash(F.xxhash64(*hashed.columns)).alias("h"),
                       F.coalesce(content_hash(F.xxhash64("doc_id", "text")), F.lit(0)).alias("fp")).first()
        return int(r["n"]), int(r["h"] or 0) & (2 ** 64 - 1), int(r["fp"])

    n, h, fp = memo_fingerprint(hashed, compute)
    path = f"{index_dir(spark)}/store/{n}-{h:016x}"
    known = _OPEN.get((spark.sparkContext.applicationId, path))
    if known is not None and index is None:
        return known
    if not is_complete(spark, path):
        (narrow.select(F.col("doc_id").cast("long").alias("doc_id"), tokens("text").alias("tokens"), "v", "rv")
               .write.mode("overwrite").parquet(f"{path}/rows"))
        mark_complete(spark, path)
    rows = spark.read.parquet(f"{path}/rows")
    # postings from the tokens that the store has, not from the texts once more
    store = Store(rows, index or lx.stored_bm25_index(rows.select("doc_id", "tokens"), fingerprint=(n, fp), tokens_col="tokens"))
    if index is None:
        _OPEN[spark.sparkContext.applicationId, path] = store
    return store


@dataclass
class Block:
    """Questions of a block: ids, vectors (rows of NaN where there is none), and for each term of
    the vocabulary the questions that ask for it and its weight there."""
    qids: np.ndarray
    vectors: np.ndarray
    terms: list
    first: np.ndarray
    asker: np.ndarray
    weight: np.ndarray
    k1: float
    b: float
    avgdl: float
    routes: list | None = None


def blocks(questions: DataFrame, store: Store, most: int = QUESTIONS):
    """Blocks of about ``most`` questions at most (qid, question, embedding and route_value if there
    are such columns), split by a hash of the id."""
    index = store.index
    routed = "route_value" in questions.columns
    vector = F.col("embedding") if "embedding" in questions.columns else F.lit(None)
    q = questions.select(F.col("qid").cast("long").alias("qid"), "question",
                         vector.cast("array<double>").alias("v"),
                         (F.col("route_value") if routed else F.lit(None).cast("string")).alias("rv"))
    pending = [(1, 0)]
    while pending:
        parts, i = pending.pop()
        some = q if parts == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)
        asked = lx.question_terms(some).join(index.idf.select("term", "idf"), "term")
        by_q = asked.groupBy("qid").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("t"))
        rows = some.select("qid", "v", "rv").join(by_q, "qid", "left").limit(most + 1).collect()
        if len(rows) > most:            # too many for a block: halves by one more bit of the hash
            pending += [(2 * parts, i), (2 * parts, i + parts)]
            continue
        rows.sort(key=lambda r: r["qid"])
        if not rows:
            continue
        dim = max((len(r["v"]) for r in rows if r["v"] is not None), default=1)
        if any(r["v"] is not None and len(r["v"]) != dim for r in rows):
            raise ValueError("question vectors of different dimensions")
        vectors = np.array([r["v"] if r["v"] is not None else [math.nan] * dim for r in rows], dtype=np.float64)
        asks: dict[str, list] = {}
        for j, r in enumerate(rows):
            for t in r["t"] or []:
                asks.setdefault(t["term"], []).append((j, t["w"]))
        terms = sorted(asks)
        sizes = [len(asks[t]) for t in terms]
        flat = [x for t in terms for x in asks[t]]
        yield Block(np.array([r["qid"] for r in rows], dtype=np.int64), vectors, terms,
                    np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                    np.array([j for j, _ in flat], dtype=np.int64), np.array([w for _, w in flat]),
                    index.k1, index.b, store.avgdl, [r["rv"] for r in rows] if routed else None)


def _cuts(sizes: np.ndarray, most: int, rows: int):
    """(from, to) of runs of at most ``rows`` and, but for single larger ones, ``most`` in sum."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(ends, before + most, side="right")), lo + 1), lo + rows)
        yield lo, min(hi, len(sizes))
        lo = hi


def _scored(batches, block: Block, dense: bool):
    """(ids, lexical scores, hits, squared distances or NaN, routes) of some documents at a time; what is
    held for them is bounded by ``CELLS`` and ``TOKENS``, whatever the batch."""
    q, m = block.vectors, len(block.qids)
    known = ~np.isnan(q).any(axis=1)
    filled = np.where(known[:, None], q, 0.0)
    norm = (filled * filled).sum(axis=1)
    vocabulary = pa.array(block.terms, type=pa.string())
    step = max(1, CELLS // max(m, 1))
    for whole in batches:
        lengths = whole.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in _cuts(lengths, TOKENS, step):
            bt = whole.slice(lo, hi - lo)
            ids = bt.column("doc_id").to_numpy(zero_copy_only=False)
            n = len(ids)
            lexical, hits = np.zeros((n, m)), np.zeros((n, m), dtype=bool)
            lists = bt.column("tokens")
            dl = lengths[lo:hi]
            if len(vocabulary):
                term = pc.index_in(lists.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
                here = ~np.isnan(term) if term.dtype.kind == "f" else np.ones(len(term), dtype=bool)
                row = np.repeat(np.arange(n), dl)[here]
                pair, tf = np.unique(row * len(vocabulary) + term[here].astype(np.int64), return_counts=True)
                row, term = np.divmod(pair, len(vocabulary))
                w = tf * (block.k1 + 1) / (tf + block.k1 * (1 - block.b + block.b * dl[row] / block.avgdl))
                count = block.first[term + 1] - block.first[term]
                # a frequent word has many askers: pairs are spread out to them a bounded number at a time
                for p0, p1 in _cuts(count, CELLS, len(count)):
                    c, t = count[p0:p1], term[p0:p1]
                    at = np.repeat(block.first[t] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    r, a = np.repeat(row[p0:p1], c), block.asker[at]
                    np.add.at(lexical, (r, a), np.repeat(w[p0:p1], c) * block.weight[at])
                    hits[r, a] = True
            distance = np.full((n, m), np.nan)
            if dense and known.any():
                v = bt.column("v")
                has = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                if len(has):
                    x = v.take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(len(has), -1)
                    if x.shape[1] != q.shape[1]:
                        raise ValueError("document and question vectors differ in dimension")
                    d = (x * x).sum(axis=1)[:, None] + norm[None, :] - 2 * x @ filled.T
                    # where the subtraction cancels, the difference is taken exactly
                    close = np.argwhere(d < 1e-6 * (norm[None, :] + (x * x).sum(axis=1)[:, None]))
                    for i, j in close:
                        d[i, j] = ((x[i] - filled[j]) ** 2).sum()
                    distance[has] = np.where(known[None, :], d, np.nan)
            yield ids, lexical, hits, distance, bt.column("rv").to_pylist() if block.routes else None


class HeldBlocks:
    """Blocks that tasks take up one at a time: each a broadcast of its own, of bounded size."""

    #: Blocks that a worker keeps in memory; of more it keeps one.
    KEPT = 4

    def __init__(self, spark, blocks):
        self.sizes, self.handles = [], []
        for block in blocks:
            self.sizes.append(len(block.qids))
            self.handles.append(spark.sparkContext.broadcast(block))

    def __len__(self):
        return len(self.sizes)

    def take(self):
        """(number, block) of all, in a task."""
        for i, handle in enumerate(self.handles):
            yield i, handle.value
            if len(self) > self.KEPT:
                handle.__dict__.pop("_value", None)     # read again from the local file when needed


def _no_bounds(m: int) -> np.ndarray:
    return np.stack([np.full(m, -np.inf), np.full(m, -np.inf), np.full(m, np.inf)])


def all_bounds(store: Store, held: HeldBlocks) -> list[np.ndarray]:
    """For each block, per question: largest lexical score of a hit (NaN without one), largest and smallest
    distance.  One scan."""

    def run(batches):
        outs = [_no_bounds(m) for m in held.sizes]
        for whole in batches:
            for i, block in held.take():
                out = outs[i]
                for _, lexical, hits, distance, _ in _scored([whole], block, True):
                    out[0] = np.maximum(out[0], np.where(hits, lexical, -np.inf).max(axis=0, initial=-np.inf))
                    out[1] = np.maximum(out[1], np.where(np.isnan(distance), -np.inf, distance).max(axis=0, initial=-np.inf))
                    out[2] = np.minimum(out[2], np.where(np.isnan(distance), np.inf, distance).min(axis=0, initial=np.inf))
        for i, out in enumerate(outs):
            m = out.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i)), pa.array(np.arange(m)), *[pa.array(x) for x in out]],
                                             names=["block", "q", "top", "far", "near"])

    outs = [_no_bounds(m) for m in held.sizes]
    if not outs:
        return outs
    rows = (store.rows.select("doc_id", "tokens", "v", "rv")
            .mapInArrow(run, "block long, q long, top double, far double, near double").groupBy("block", "q")
            .agg(F.max("top").alias("top"), F.max("far").alias("far"), F.min("near").alias("near")).toArrow())
    block, q = (rows.column(c).to_numpy() for c in ("block", "q"))
    for i, out in enumerate(outs):
        own = block == i
        out[:, q[own]] = np.stack([rows.column(c).to_numpy()[own] for c in ("top", "far", "near")])
    return outs


def bounds(store: Store, block: Block) -> np.ndarray:
    """The bounds of one block's questions."""
    return all_bounds(store, HeldBlocks(store.rows.sparkSession, [block]))[0]


class _Best:
    """A running top-k per question: what may still be among the k best after rounding; of equally
    scored documents (copies, or no hit) only the k smallest ids, which rank before the others."""

    def __init__(self, m: int, k: int):
        self.k, self.rows = k, [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)] * 3
        self.kth = np.full(m, -np.inf)

    def add(self, ids, score, live, b, sn):
        order = np.argsort(ids, kind="stable")
        ids, score, live, b, sn = (x[order] for x in (ids, score, live, b, sn))
        zero = live & (score == 0)
        keep = live & (score >= self.kth - RANK_MARGIN) & ~(zero & (np.cumsum(zero, axis=0) > self.k))
        i, j = np.nonzero(keep)
        new = [j, ids[i], score[i, j], b[i, j], sn[i, j]]
        q, d, s, lex, sem = (np.concatenate([x, y]) for x, y in zip(self.rows, new))
        order = np.lexsort((d, -s, q))
        q, d, s, lex, sem = (x[order] for x in (q, d, s, lex, sem))
        first = np.searchsorted(q, np.arange(len(self.kth)))
        rank = np.arange(len(q)) - first[q]
        last = first + self.k - 1
        full = last < np.append(first[1:], len(q))
        self.kth[full] = s[last[full]]
        fresh = np.flatnonzero(np.diff(q, prepend=-1).astype(bool) | np.diff(s, prepend=0).astype(bool))
        equal = np.arange(len(q)) - np.repeat(fresh, np.diff(fresh, append=len(q)))     # place among its equals
        keep = ((rank < self.k) | (s >= self.kth[q] - RANK_MARGIN)) & (equal < self.k)
        self.rows = [x[keep] for x in (q, d, s, lex, sem)]


def all_candidates(store: Store, held: HeldBlocks, found: list | None, alpha: float, threshold: float | None,
                   k: int, dense_only: bool = False) -> DataFrame:
    """(qid, doc_id, score, b, sn): a superset of each question's top-k, in one scan.  ``found`` are the bounds of each
    block (None: plain lexical scores); ``threshold`` is strict; with ``dense_only`` only pairs of vectors
    take part."""

    def sent(block, best):
        q, d, s, lex, sem = best.rows
        return pa.RecordBatch.from_arrays([pa.array(block.qids[q]), pa.array(d), pa.array(s), pa.array(lex), pa.array(sem)],
                                          names=["qid", "doc_id", "score", "b", "sn"])

    def run(batches):
        bests = [_Best(m, k) for m in held.sizes]
        for whole in batches:
            for i, block in held.take():
                best = bests[i]
                for ids, lexical, hits, distance, routes in _scored([whole], block, found is not None):
                    if found is None:
                        b, sn, score = lexical, np.zeros_like(lexical), lexical
                    else:
                        top, far, near = found[i]
                        b = np.where(hits, np.where(top > 0, lexical / np.where(top > 0, top, 1), lexical), 0.0)
                        span = np.where(far > near, far - near, 1.0)
                        sn = np.where(np.isnan(distance), 0.0, (np.where(np.isfinite(far), far, 0) - distance) / span)
                        score = alpha * b + (1 - alpha) * sn
                    live = np.ones(score.shape, dtype=bool) if threshold is None else score > threshold
                    if dense_only:
                        live &= ~np.isnan(distance)
                    if routes is not None:
                        live &= _routed(routes, block.routes)
                    best.add(ids, score, live, b, sn)
            if sum(len(b.rows[0]) for b in bests) > HELD_ROWS:      # very many questions: what is held goes on, to be ranked
                for i, block in held.take():
                    yield sent(block, bests[i])
                bests = [_Best(m, k) for m in held.sizes]
        for i, block in held.take():
            yield sent(block, bests[i])

    if not len(held):
        return store.rows.sparkSession.createDataFrame([], CANDIDATE_SCHEMA)
    return store.rows.select("doc_id", "tokens", "v", "rv").mapInArrow(run, CANDIDATE_SCHEMA)


def _routed(has: list, wanted: list) -> np.ndarray:
    """Which documents a question may have: all, or those with its route."""
    free = np.array([r is None for r in wanted])
    out = np.repeat(free[None, :], len(has), axis=0)
    for tag in {r for r in wanted if r is not None}:
        own = np.array([r == tag for r in wanted])
        out |= np.array([tag in (tags or ()) for tags in has], dtype=bool)[:, None] & own[None, :]
    return out


def candidates(store: Store, block: Block, found: np.ndarray | None, alpha: float, threshold: float | None,
               k: int, dense_only: bool = False) -> DataFrame:
    """The candidates of one block's questions."""
    return all_candidates(store, HeldBlocks(store.rows.sparkSession, [block]), None if found is None else [found], alpha, threshold,
                          k, dense_only)


CANDIDATE_SCHEMA = "qid long, doc_id long, score double, b double, sn double"
