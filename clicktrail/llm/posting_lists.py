"""Approximate nearest neighbours in balanced posting lists.

Centroids are fitted on a bounded sample. Every vector is put into the lists of its nearest
centroid and, where it lies near a boundary, of the next ones too. A query searches the graph
of centroids, kept in memory, and reads the lists whose centroids are not much further away
than the nearest. Long lists, and lists that many queries read, are cut into parts, so that no
task gets a whole hot list. Distances are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.vectors import matrix, usable
from clicktrail.sources.shared import stash

SAMPLE = 20_000         # vectors the centroids are fitted on at most
PER_CENTROID = 256      # vectors per centroid aimed at
MOST_CENTROIDS = 2048   # bound of the graph that tasks keep in memory
DEGREE = 16             # neighbours of a centroid in the graph
LEAST_SHARE, MOST_SHARE = 0.25, 2.0     # of an even list, beyond which the fit moves a centroid
COPIES, COPY_RATIO = 4, 1.15    # lists of a vector at most, and how much further they may be
PROBE_RATIO = 1.15              # how much further than the nearest a list may be that is read
PART, QUERY_PART = 4096, 1024   # vectors and queries that meet in a task


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest vectors found for each query.

    Queries are the rows of ``vectors`` (``vec_id``, ``embedding``; other columns are ignored)
    whose id is divisible by ``every``; candidates are all rows with another id. ``score`` is
    the Euclidean distance in double precision; ties go to the smaller id. A null id, a vector
    that is null, zero or holds null or non-finite components, or one of other length than
    most, takes no part. Rows that repeat an id and vector count once. With fewer candidates
    than ``k`` all are returned; an empty table gives no rows.
    """
    able = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    length = able.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a repeated row would take the place of another neighbour
    points = stash(able.where(F.size("v") == length[0].d).dropDuplicates(["vec_id", "v"]), "vectors")
    graph = fit_graph(points)
    listed = stash(points.mapInArrow(_lists(graph), "vec_id long, v array<double>, list int, first boolean"), "lists")
    sizes = {r["list"]: (r.n, r.own) for r in listed.groupBy("list").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("own")).collect()}
    own = np.array([sizes.get(i, (0, 0))[1] for i in range(len(graph["centroids"]))])
    asked = stash(points.where(F.col("vec_id") % every == 0).mapInArrow(
        _probes(graph, own, probe_ratio, k), "query_id long, q array<double>, list int"), "probes")
    asks = {r["list"]: r.n for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}

    # parts per list, for vectors and queries: a row per centroid, so bounded like the graph
    parts = vectors.sparkSession.createDataFrame(
        [(i, -(-n // PART), -(-asks.get(i, 0) // QUERY_PART)) for i, (n, _) in sizes.items() if asks.get(i)] or [(-1, 1, 1)],
        "list int, parts int, query_parts int")
    held = listed.join(F.broadcast(parts), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), "vec_id", "v")
    wanted = asked.join(F.broadcast(parts), "list").select(
        F.col("list").alias("of_list"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"),
        F.pmod(F.xxhash64("query_id"), "query_parts").cast("int").alias("of_query_part"), "query_id", "q")
    found = held.groupBy("list", "part", "query_part").cogroup(
        wanted.groupBy("of_list", "of_part", "of_query_part")
    ).applyInArrow(_scan(k), "query_id long, list int, found array<struct<score: double, vec_id: long>>")
    # by list first: what meets in a row is k of each part of one list, then k of each list
    for keys in (["query_id", "list"], ["query_id"]):
        found = found.groupBy(*keys).agg(F.slice(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found"))
    best = found
    return best.select("query_id", F.posexplode("found").alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "f.vec_id", "f.score")


def fit_graph(points: DataFrame) -> dict:
    """Centroids by k-means on a bounded sample drawn by hash, with their nearest neighbours."""
    n = points.count()
    drawn = points.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    x = matrix(drawn["v"])
    m = int(min(MOST_CENTROIDS, max(1, n // PER_CENTROID), len(x)))
    centroids = x[np.linspace(0, len(x) - 1, m).astype(int)].copy()
    for _ in range(10):
        near = np.argmin((centroids ** 2).sum(axis=1)[None, :] - 2 * x @ centroids.T, axis=1)
        count = np.bincount(near, minlength=m)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        full = count > 0
        centroids[full] = sums[full] / count[full][:, None]
        # balance: centroids of few vectors move into groups of too many, to the member furthest out
        even = len(x) / m
        few = np.flatnonzero(count < LEAST_SHARE * even)
        many = np.argsort(-count, kind="stable")[:np.count_nonzero(count > MOST_SHARE * even)]
        for i, big in zip(few, many):
            members = np.flatnonzero(near == big)
            centroids[i] = x[members[np.argmax(((x[members] - centroids[big]) ** 2).sum(axis=1))]]
    apart = (centroids ** 2).sum(axis=1)[None, :] - 2 * centroids @ centroids.T
    np.fill_diagonal(apart, np.inf)
    links = [set(row) for row in np.argsort(apart, axis=1)[:, :min(DEGREE, m - 1)].tolist()]
    for i in range(m - 1):      # a path through all keeps the graph in one piece
        links[i].add(i + 1)
    for i in range(m):
        for j in list(links[i]):
            links[j].add(i)
    return {"centroids": centroids, "links": [np.array(sorted(s), np.int64) for s in links]}


class _Search:
    """Best-first search of the centroid graph."""

    def __init__(self, graph: dict):
        self.c, self.links = graph["centroids"], graph["links"]
        m = len(self.c)
        self.entries = np.unique(np.linspace(0, m - 1, min(m, 16)).astype(int))

    def walk(self, q: np.ndarray, enough) -> list[tuple[float, int]]:
        """Centroids by distance, until ``enough(found, next distance)`` holds."""
        seen = np.zeros(len(self.c), bool)
        seen[self.entries] = True
        heap = [(d, int(i)) for d, i in zip(np.linalg.norm(self.c[self.entries] - q, axis=1), self.entries)]
        heapq.heapify(heap)
        found: list[tuple[float, int]] = []
        while heap and not enough(found, heap[0][0]):
            d, i = heapq.heappop(heap)
            found.append((d, i))
            new = self.links[i][~seen[self.links[i]]]
            if len(new):
                seen[new] = True
                for e, j in zip(np.linalg.norm(self.c[new] - q, axis=1).tolist(), new.tolist()):
                    heapq.heappush(heap, (e, j))
        return found


def _lists(graph: dict):
    """Lists of each vector: of the nearest centroids, up to the ratio and number allowed."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("list", pa.int32()), ("first", pa.bool_())])

    def place(source):
        search = _Search(graph)

        def enough(found, following):
            # a few steps beyond, since a search may reach the nearest by way of others
            if len(found) < 3 * COPIES:
                return False
            fourth = heapq.nsmallest(COPIES, found)[-1][0]
            return following > fourth

        for batch in source:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            rows, lists, first = [], [], []
            for r, q in enumerate(x):
                near = heapq.nsmallest(COPIES, search.walk(q, enough))
                for n, (d, i) in enumerate(near):
                    if n == 0 or d <= COPY_RATIO * near[0][0]:
                        rows.append(r)
                        lists.append(i)
                        first.append(n == 0)
            rows = pa.array(rows)
            yield pa.record_batch([batch.column("vec_id").take(rows), batch.column("v").take(rows).cast(pa.list_(pa.float64())),
                                   pa.array(lists, pa.int32()), pa.array(first)], schema=schema)

    return place


def _probes(graph: dict, own: np.ndarray, ratio: float, k: int):
    """Lists that a query reads: all within the ratio, and as many as hold ``k`` others for certain."""
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("list", pa.int32())])

    def ask(source):
        search = _Search(graph)

        def enough(found, following):
            return (bool(found) and following > ratio * min(found)[0] and len(found) >= min(8, len(own))
                    and sum(own[i] for _, i in found) > k)

        for batch in source:
            if not batch.num_rows:
                continue
            rows, lists = [], []
            for r, q in enumerate(matrix(batch.column("v"))):
                for _, i in search.walk(q, enough):
                    rows.append(r)
                    lists.append(i)
            rows = pa.array(rows)
            yield pa.record_batch([batch.column("vec_id").take(rows), batch.column("v").take(rows).cast(pa.list_(pa.float64())),
                                   pa.array(lists, pa.int32())], schema=schema)

    return ask


def _scan(k: int):
    """Best ``k`` of a part of a list for each of a part of its queries."""
    item = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
    schema = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("found", item)])

    def scan(held: pa.Table, wanted: pa.Table) -> pa.Table:
        if not held.num_rows or not wanted.num_rows:
            return schema.empty_table()
        ids, x = held["vec_id"].to_numpy(), matrix(held["v"])
        asked, q = wanted["query_id"].to_numpy(), matrix(wanted["q"])
        squares, out = (x ** 2).sum(axis=1), []
        for at in range(0, len(q), 64):
            rough = squares[None, :] - 2 * q[at:at + 64] @ x.T
            rough[asked[at:at + 64][:, None] == ids[None, :]] = np.inf
            for row, mine in zip(rough, q[at:at + 64]):
                most = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                some = np.flatnonzero((row <= most + 1e-9 * (1 + abs(most) + mine @ mine)) & np.isfinite(row))
                exact = np.sqrt(((x[some] - mine) ** 2).sum(axis=1))
                order = np.lexsort((ids[some], exact))[:k]
                out.append([{"score": float(exact[o]), "vec_id": int(ids[some[o]])} for o in order])
        return pa.table([pa.array(asked), wanted["of_list"].combine_chunks(), pa.array(out, item)], schema=schema)

    return scan
