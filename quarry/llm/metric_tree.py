"""Exact top-k by inner product: best-first search in an M-tree.

Inner products become distances by one more coordinate: with x' = (x, sqrt(M - x.x)), M the
largest x.x, and q' = (q, 0), |q' - x'|^2 = q.q + M - 2 q.x.  So the highest scores are the
nearest points of a metric space, and the triangle inequality holds bounds.

The tree has three levels.  Top: at most ``MOST_REGIONS`` routing vectors, a vector
belongs to the nearest one.  Middle: each region's vectors, dealt in subtrees of at
most about ``SUBTREE`` vectors, form pages of at most ``PAGE`` around routing vectors of
their own; a page stores its covering radius and its distance to the region's routing
vector ("parent distance").  Bottom: page entries, each with its distance to the page's
routing vector.  The pages are written to the shared folder, one row each.

A query first searches the region it is nearest to, which bounds its k-th score, then
the regions whose covering radius reaches that bound.  Inside a subtree pages that the parent
distance excludes never get a distance computed; the others are visited nearest
bound first until the bound passes the k-th score; entries are excluded through their own
stored distances.  Pages and queries meet by (region, subtree): pages come first and
stay in memory, queries stream past in batches.

Equal vectors are one point with its ``k + 1`` smallest ids (no query can return more of them).

Defined results: rows whose id or vector is null, or whose vector is empty or holds a null or a
component that is not finite, take no part; rows that repeat an id and its vector count once;
a query does not return its own id; vectors of another length than the query's are no
candidates of it; ties go to the smaller id; empty tables give no rows; other columns are ignored.
Scores are exact while M < 2^53 (an error beyond).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize, shuffle_partitions
from quarry.llm.vectors import by_group, matrices, usable, vector_key

MOST_REGIONS = 512
REGION, SUBTREE, PAGE = 4096, 8192, 256
#: Distances are doubles: bounds give way by this part of their size, scores are integers.
SLACK = 1e-9


def quantized(vector: str, scale: int):
    """floor(scale * x) of every component, as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """point, key, vector (longs), ids (the k + 1 smallest, ascending) of the distinct vectors."""
    keyed = rows.withColumn("key", vector_key("vector"))
    once = keyed.groupBy("key", "vec_id").agg(F.first("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    some = once.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    points = some.groupBy("key").agg(F.first("vector").alias("vector"),
                                     F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(points.withColumn("point", F.monotonically_increasing_id()), "llm-points")


class _Space:
    """Distances of vectors of one length, with the added coordinate."""

    def __init__(self, most: float):
        self.most = most

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        return np.sqrt(np.maximum(d, 0))


def build_pages(lifted: np.ndarray, parent: np.ndarray):
    """Pages of a subtree: (entries, routing vector, radius, parent distance, entry distances)."""
    pivots = lifted[:: max(1, len(lifted) // max(1, math.ceil(len(lifted) / PAGE * 2)))]
    near = _Space.distances(lifted, pivots)
    home = near.argmin(axis=1)
    for c in np.unique(home):
        own = np.flatnonzero(home == c)
        own = own[np.argsort(near[own, c], kind="stable")]
        for lo in range(0, len(own), PAGE):         # a crowded pivot has several pages, shell by shell
            e = own[lo:lo + PAGE]
            d = near[e, c]
            yield e, pivots[c], float(d.max()), float(_Space.distances(parent[None], pivots[c:c + 1])[0, 0]), d


class Subtree:
    """Pages of one subtree in memory, and best-first search in them."""

    def __init__(self, pages: list, parent: np.ndarray):
        self.parent = parent
        self.routes = np.array([p["route"] for p in pages])
        self.radius = np.array([p["radius"] for p in pages])
        self.to_parent = np.array([p["to_parent"] for p in pages])
        self.pages = pages
        self.computed = 0           # vectors whose score was computed

    def search(self, q: np.ndarray, most: float, k: int, floor: float):
        """(points, scores) with the k best scores of at least ``floor``, ties to the smaller id."""
        qq = float(q @ q)
        reach = math.sqrt(max(qq + most - 2 * floor, 0)) * (1 + SLACK) + SLACK if floor > -math.inf else math.inf
        lifted = np.append(q, 0.0)
        up = math.sqrt(float(((lifted - self.parent) ** 2).sum()))
        # stored distances first: pages that the parent distance excludes cost nothing more
        open_ = np.flatnonzero(np.abs(up - self.to_parent) - self.radius <= reach)
        if not len(open_):
            return [], []
        d = np.sqrt(((self.routes[open_] - lifted) ** 2).sum(axis=1))
        bound = d - self.radius[open_]
        best: list[tuple] = []      # (-score, least id, point)
        for i in np.argsort(bound, kind="stable"):
            if bound[i] > reach:
                break
            page = self.pages[open_[i]]
            near = np.flatnonzero(np.abs(d[i] - page["distances"]) <= reach)
            if not len(near):
                continue
            scores = page["vectors"][near] @ q
            self.computed += len(near)
            good = np.flatnonzero(scores >= floor)
            if not len(good):
                continue
            best += zip((-scores[good]).tolist(), page["least"][near[good]].tolist(), page["points"][near[good]].tolist())
            best.sort()
            del best[k:]
            if len(best) == k and -best[-1][0] > floor:
                floor = -best[-1][0]
                reach = math.sqrt(max(qq + most - 2 * floor, 0)) * (1 + SLACK) + SLACK
        return [b[2] for b in best], [-b[0] for b in best]


class MetricTree:
    """An M-tree over the distinct points of a table (see the module's description)."""

    def __init__(self, points: DataFrame):
        spark = self.spark = points.sparkSession
        norm = F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
        # one space for each length of vector
        stats = points.groupBy(F.size("vector").alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).collect()
        self.most = {r["d"]: float(r["most"]) for r in stats}
        if any(m >= 2**53 for m in self.most.values()):
            raise ValueError("vectors are too large for exact scores")
        self.routes: dict[int, np.ndarray] = {}
        first = 0
        self.first_region: dict[int, int] = {}
        for r in stats:
            want = max(1, min(MOST_REGIONS, math.ceil(r["n"] / REGION)))
            some = (points.where(F.size("vector") == r["d"]).orderBy(F.xxhash64("key"), "key")
                    .select("vector").limit(want).collect())
            x = np.array([s[0] for s in some], dtype=np.float64)
            self.routes[r["d"]] = _Space(self.most[r["d"]]).lift(x)
            self.first_region[r["d"]] = first
            first += len(x)
        self.pages, self.radius, self.subtrees = self._build(points)

    def _nearest(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds the nearest region and the distance to its routing vector."""
        routes, most, first = self.routes, self.most, self.first_region

        def run(batches):
            for batch in batches:
                region = np.zeros(batch.num_rows, dtype=np.int32)
                to_route = np.zeros(batch.num_rows)
                for at, x in matrices(batch.column(1)):
                    if x.shape[1] in routes:
                        d = _Space.distances(_Space(most[x.shape[1]]).lift(x) if name == "point" else
                                             np.concatenate([x, np.zeros((len(x), 1))], axis=1), routes[x.shape[1]])
                        region[at] = first[x.shape[1]] + d.argmin(axis=1)
                        to_route[at] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(region), pa.array(to_route)],
                    names=[*batch.schema.names, "region", "to_route"])

        cols = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        return rows.mapInArrow(run, f"{cols}, region int, to_route double")

    def _build(self, points: DataFrame):
        placed = materialize(self._nearest(points.select(
            "point", "vector", F.col("ids")[0].alias("least")), "point"), "llm-tree-points")
        regions = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("to_route").alias("r")).collect()
        radius = {r["region"]: r["r"] for r in regions}
        subtrees = {r["region"]: math.ceil(r["n"] / SUBTREE) for r in regions}
        routes = {first + i: x for d, first in self.first_region.items()
                              for i, x in enumerate(self.routes[d])}
        most = {first + i: self.most[d] for d, first in self.first_region.items()
                for i in range(len(self.routes[d]))}
        parts = F.element_at(F.create_map(*[F.lit(x) for kv in subtrees.items() for x in kv]), F.col("region")) \
            if subtrees else F.lit(1)
        node = (F.col("region").cast("long") * (1 << 32) + F.pmod(F.xxhash64("point"), parts))
        dealt = (placed.select(node.alias("subtree"), "region", "point", "least", "vector")
                 .repartition(shuffle_partitions(points), "subtree").sortWithinPartitions("subtree", "point"))

        def run(batches):
            for table in by_group(batches):
                sub = table.column("subtree").to_numpy()
                edge = np.concatenate([[0], np.flatnonzero(sub[1:] != sub[:-1]) + 1, [len(sub)]])
                for lo, hi in zip(edge, edge[1:]):
                    t = table.slice(lo, hi - lo).combine_chunks()
                    region = int(t.column("region")[0].as_py())
                    ids, least = t.column("point").to_numpy(), t.column("least").to_numpy()
                    for at, x in matrices(t.column("vector").combine_chunks()):
                        out = [(e, route, r, up, d) for e, route, r, up, d in build_pages(
                            _Space(most[region]).lift(x), routes[region])]
                        yield pa.RecordBatch.from_pydict({
                            "subtree": [int(sub[lo])] * len(out), "region": [region] * len(out),
                            "route": [o[1].tobytes() for o in out], "radius": [o[2] for o in out],
                            "to_parent": [o[3] for o in out],
                            "vectors": [x[o[0]].astype(np.int32).tobytes() for o in out],
                            "points": [ids[at][o[0]].astype(np.int64).tobytes() for o in out],
                            "least": [least[at][o[0]].astype(np.int64).tobytes() for o in out],
                            "distances": [o[4].tobytes() for o in out]}, schema=pa.schema([
                                ("subtree", pa.int64()), ("region", pa.int32()), ("route", pa.binary()),
                                ("radius", pa.float64()), ("to_parent", pa.float64()), ("vectors", pa.binary()),
                                ("points", pa.binary()), ("least", pa.binary()), ("distances", pa.binary())]))

        self._routes_by_region, self._most_by_region = routes, most
        pages = dealt.mapInArrow(run, "subtree long, region int, route binary, radius double, to_parent double, "
                                      "vectors binary, points binary, least binary, distances binary")
        return materialize(pages, "llm-tree-pages"), radius, subtrees

    def _visit(self, visits: DataFrame, k: int) -> DataFrame:
        """Searches (query, region, floor, vector): the k best points of every subtree of the region."""
        routes, most, subtrees = self._routes_by_region, self._most_by_region, self.subtrees
        parts = F.element_at(F.create_map(*[F.lit(x) for kv in subtrees.items() for x in kv]), F.col("region"))
        each = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        nothing = F.lit(None).cast("binary")
        asked = each.select((F.col("region").cast("long") * (1 << 32) + F.col("part")).alias("subtree"), "region",
                            F.lit(1).alias("is_query"), "query", "floor", "vector",
                            *[nothing.alias(c) for c in ("route", "vectors", "points", "least", "distances")],
                            F.lit(0.0).alias("radius"), F.lit(0.0).alias("to_parent"))
        pages = self.pages.select("subtree", "region", F.lit(0).alias("is_query"), F.lit(None).cast("long").alias("query"),
                                  F.lit(None).cast("double").alias("floor"),
                                  F.lit(None).cast("array<bigint>").alias("vector"),
                                  "route", "vectors", "points", "least", "distances", "radius", "to_parent")
        both = (pages.unionByName(asked).repartition(shuffle_partitions(visits), "subtree")
                .sortWithinPartitions("subtree", "is_query"))

        def run(batches):
            now, held, tree = None, [], None
            for batch in batches:
                subs = batch.column("subtree").to_numpy()
                is_query = batch.column("is_query").to_numpy()
                found: tuple[list, list, list] = ([], [], [])
                for i in range(batch.num_rows):
                    if subs[i] != now:
                        now, held, tree = subs[i], [], None
                    if not is_query[i]:
                        r = {c: batch.column(c)[i].as_py() for c in (
                            "route", "vectors", "points", "least", "distances", "radius", "to_parent", "region")}
                        n = len(r["points"]) // 8
                        held.append({"region": r["region"], "route": np.frombuffer(r["route"]), "radius": r["radius"],
                                     "to_parent": r["to_parent"], "distances": np.frombuffer(r["distances"]),
                                     "vectors": np.frombuffer(r["vectors"], dtype=np.int32).reshape(n, -1).astype(np.float64),
                                     "points": np.frombuffer(r["points"], dtype=np.int64),
                                     "least": np.frombuffer(r["least"], dtype=np.int64)})
                        continue
                    if not held:
                        continue
                    if tree is None:
                        tree = Subtree(held, routes[held[0]["region"]])
                    q = np.array(batch.column("vector")[i].as_py(), dtype=np.float64)
                    points, scores = tree.search(q, most[held[0]["region"]], k, batch.column("floor")[i].as_py())
                    found[0].extend([batch.column("query")[i].as_py()] * len(points))
                    found[1].extend(points)
                    found[2].extend(int(s) for s in scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=pa.int64()) for x in found], names=["query", "point", "score"])

        return both.mapInArrow(run, "query long, point long, score long")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, point, score): a superset of each query's k best points (``queries``: query,
        vector); every subtree visited gives its k best."""
        if not self.most:
            return self.spark.createDataFrame([], "query long, point long, score long")
        home = materialize(self._nearest(queries.select("query", "vector"), "query")
                           .where(F.size("vector").isin([int(d) for d in self.most])), "llm-tree-queries")
        first = materialize(self._visit(home.withColumn("floor", F.lit(-math.inf)), k), "llm-tree-first")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        kth = (first.withColumn("rank", rank).where(F.col("rank") == k)
               .select(F.col("query").alias("b_query"), F.col("score").cast("double").alias("floor")))
        bounded = home.join(kth, F.col("query") == F.col("b_query"), "left").withColumn(
            "floor", F.coalesce("floor", F.lit(-math.inf)))
        further = materialize(self._visit(self._reached(bounded), k), "llm-tree-further")
        return first.unionByName(further)

    def _reached(self, queries: DataFrame) -> DataFrame:
        """One row per query and further region that may hold a point of at least its floor."""
        routes, most, first, radius = self.routes, self.most, self.first_region, self.radius

        def run(batches):
            for batch in batches:
                home, floor = batch.column("region").to_numpy(), batch.column("floor").to_numpy()
                for at, x in matrices(batch.column("vector")):
                    d = x.shape[1]
                    r = np.array([radius.get(first[d] + i, -math.inf) for i in range(len(routes[d]))])
                    far = _Space.distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), routes[d])
                    reach = np.sqrt(np.maximum((x * x).sum(axis=1) + most[d] - 2 * floor[at], 0)) * (1 + SLACK) + SLACK
                    go = far - r <= reach[:, None]
                    go[np.arange(len(x)), home[at] - first[d]] = False
                    i, region = np.nonzero(go)
                    rows = pa.array(at[i])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query").take(rows), batch.column("vector").take(rows),
                         pa.array((region + first[d]).astype(np.int32)), batch.column("floor").take(rows)],
                        names=["query", "vector", "region", "floor"])

        return queries.select("query", "vector", "region", "floor").mapInArrow(
            run, "query long, vector array<bigint>, region int, floor double")


def top_k(rows: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row that ``is_query`` (a column over vec_id)
    holds for, the k other rows with the highest integer inner products."""
    bounded_batches(rows.sparkSession)
    usable_rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("raw")).where(
        F.col("vec_id").isNotNull() & usable("raw")).select("vec_id", quantized("raw", scale).alias("vector"))
    points = distinct_points(usable_rows, k)
    asking = usable_rows.where(is_query).distinct()
    asking = materialize(asking.withColumn("query", F.monotonically_increasing_id()), "llm-queries")
    tree = MetricTree(points)
    found = tree.search(asking.select("query", "vector"), k + 1)
    # of a query's points, those that can be among the best: k others, and its own
    least = points.select(F.col("point").alias("p"), "ids")
    named = found.join(least, F.col("point") == F.col("p"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))
    some = named.withColumn("r", rank).where(F.col("r") <= k + 1)
    own = asking.select(F.col("query").alias("a_query"), F.col("vec_id").alias("query_id"))
    rows = (some.join(own, F.col("query") == F.col("a_query"))
            .select("query", "query_id", "score", F.explode("ids").alias("vec_id"))
            .where("vec_id != query_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))
