"""Embedding near-duplicates by dual traversal of a cover tree.

Vectors of equal label and length form a cover tree. A node is a centre, which is one of the
vectors, and the vectors that came to it; its covering radius is the distance of the furthest
of them. A node's children are nested: the first keeps its centre, the others are further
apart than the level's radius, the next power of two below the node's own, so radii halve from
level to level. A level that needs more than :data:`CHILDREN` centres is spread over several
splits. Distances are those of unit vectors, for which a cosine threshold is a distance
threshold. Two nodes whose covering radii leave them further apart than the threshold are
pruned; two so close that all their vectors must be within it are linked as a whole; other
pairs are followed down, and leaves compared exactly. So every pair at or over the threshold
is found, and groups of many near copies are counted without listing pairs.

The upper levels are tables: nodes with more than :data:`LEAF` vectors are split until there
are none; a child that keeps nearly all of its node, as scaled copies of one direction do, is
cut by hash, so that every split shrinks. The traversal of these levels is a series of joins.
Open pairs of leaves are dealt in tiles, all pairs of two parents to a task, which gets each
leaf once and goes on with the traversal inside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.components import components, local_roots
from clicktrail.llm.vectors import matrix, usable
from clicktrail.sources.shared import stash

LEAF = 1024          # vectors of a node that is not split in tables
CHILDREN = 16        # centres a node is split by at once
SHRUNK = 0.9         # share of a node that a child may keep uncut
SAMPLE = 256         # members of a node among which centres are chosen
SALTS = 16           # parts in which the vectors of one node meet what is known of it
BLOCK = 128          # vectors of the smallest nodes within a task
SLACK = 1e-9         # rounding left to bounds; what they don't settle is compared exactly

VECTORS = "rep long, n long, v array<double>, node string, path array<string>, gap double"


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; other columns are ignored. Rows
    are linked if their labels are equal and the cosine is at least ``threshold``. A null id
    or label, and a vector that is null, zero or holds null or non-finite components, links
    with nothing; nor do vectors of different length. ``n_links`` counts linked rows, equal
    vectors and repeated rows included. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label",
        (usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"))
    able = rows.where("ok")
    # equal vectors become one point that weighs as much as they do
    points = stash(able.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "points")
    found = _links(points, threshold)
    counts = found.groupBy("rep").agg(F.sum("n").alias("linked"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    settled = stash(
        points.select("label", "v", "rep", "n").join(counts, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")), "settled")
    linked = able.join(settled, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.union(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(points: DataFrame, threshold: float) -> DataFrame:
    """(``rep``, ``n``, ``other``): rows that a point is linked with, in parts, and a point of its component."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    top = points.select("rep", "n", "v", F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")).alias("node"))
    open_points = top.select("rep", "n", "v", "node", F.array("node").alias("path"))
    # the root's centre is the vector of its smallest id; no two unit vectors are over 2 apart
    nodes = stash(top.groupBy("node").agg(
        F.min_by("v", "rep").alias("v"), F.lit(2.0).alias("radius"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"),
        F.min("rep").alias("rep")).withColumn("center", _unit_column("v")).drop("v"), "nodes")
    pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    members, bulk, leaf_pairs = [], [], []
    level = 0
    while True:
        judged = stash(_judged(pairs, nodes, reach), "judged")
        bulk.append(judged.where("verdict = 1"))
        leaf_pairs.append(judged.where("verdict = 0 and leaf_a and leaf_b").select("a", "b"))
        big = stash(nodes.where(F.col("rows") > LEAF), "big-nodes")
        if not big.limit(1).count():
            members.append(open_points)
            break
        level += 1
        members.append(_by_node(open_points, big.select("node"), "left_anti"))
        open_points, kids = _split(open_points, big, level)
        children = kids.select(F.col("above").alias("node"), F.col("node").alias("child"))
        leaves = nodes.where(F.col("rows") <= LEAF)
        down = children.union(leaves.select("node", F.col("node").alias("child")))
        pairs = _children_pairs(judged.where("verdict = 0 and not (leaf_a and leaf_b)").select("a", "b"), down)
        nodes = stash(leaves.unionByName(kids.drop("above")), "nodes")

    every = _union(members)
    compared = _compare_leaves(every, _union(leaf_pairs), threshold, reach)
    whole = stash(_union(bulk), "bulk")
    # what holds for a whole node holds for each of its members: a row per node tells them
    gains = whole.select(F.col("a").alias("node"), F.col("size_b").alias("n"), F.col("rep_b").alias("other"), (F.col("a") == F.col("b")).alias("own"))
    gains = gains.union(whole.where("a <> b").select("b", "size_a", "rep_a", F.lit(False)))
    gains = gains.groupBy("node").agg(F.sum("n").alias("gain"), F.min("other").alias("other"), F.max("own").alias("own"))
    held = every.select("rep", "n", F.explode("path").alias("node"))
    spread = _by_node(held, gains, "inner").select(
        "rep", (F.col("gain") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("n"), "other")
    between = whole.where("a <> b").select(F.col("rep_a").alias("rep"), F.lit(0).cast("long").alias("n"), F.col("rep_b").alias("other"))
    return compared.union(spread).union(between)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select(*frames[-1].columns)
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _unit_column(v: str):
    return F.expr(f"transform({v}, x -> x / sqrt(aggregate({v}, 0D, (t, y) -> t + y * y)))")


def _by_node(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Join by ``node``; the rows of one node are dealt over salts, for each of which ``known`` has a copy."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["node", "salt"], how).drop("salt")


def _judged(pairs: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """Node pairs that are not pruned, with their verdict."""
    told = nodes.withColumn("leaf", F.col("rows") <= LEAF).drop("rows")
    a, b = (told.select([F.col(c).alias(f"{c}_{side}" if c != "node" else side) for c in told.columns]) for side in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(
        _judge(reach), "a string, b string, verdict int, size_a long, size_b long, rep_a long, rep_b long, leaf_a boolean, leaf_b boolean")


def _children_pairs(pairs: DataFrame, down: DataFrame) -> DataFrame:
    """Pairs of the children of either node; each pair of children of one node once."""
    below = pairs.join(down.select(F.col("node").alias("a"), F.col("child").alias("x")), "a").join(
        down.select(F.col("node").alias("b"), F.col("child").alias("y")), "b")
    return below.where("a <> b or x <= y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _split(points: DataFrame, big: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Members of big nodes, each at the nearest of its node's centres, and these children.

    Children that hardly shrink are cut by a hash of the vector, another one at each level.
    Any cut is right: radii are those of the members, and pairs are followed across it.
    """
    # a bounded number of members per node, cut before the shuffle
    ranked = points.select("node", "v", F.xxhash64("rep").alias("h"), "rep").selectExpr(
        "*", "row_number() over (partition by node order by h, rep) as k").where(F.col("k") <= SAMPLE)
    sampled = ranked.join(big.select("node", "center", "rows"), "node")
    centres = stash(sampled.groupBy("node").applyInArrow(
        _centres, "node string, child string, center array<double>, centres binary"), "centres")
    wide = centres.where("centres is not null").select("node", "centres")
    split = stash(_by_node(points, wide, "inner").select("rep", "n", "v", "node", "path", "centres").mapInArrow(_nearest, VECTORS), "split")
    counted = split.groupBy("node", F.element_at("path", -2).alias("above")).agg(F.count(F.lit(1)).alias("left"))
    stuck = stash(counted.join(big.select(F.col("node").alias("above"), "rows"), "above").where(
        (F.col("left") > LEAF) & (F.col("left") > SHRUNK * F.col("rows"))).select("node", F.lit(True).alias("stuck")), "stuck")
    named = split.withColumn("child", F.col("node"))
    if stuck.limit(1).count():
        part = F.concat("node", F.lit("#"), F.pmod(F.xxhash64("v", F.lit(level)), F.lit(CHILDREN)).cast("string"))
        cut = _by_node(split, stuck, "left").withColumn("child", F.col("node")).withColumn(
            "node", F.when(F.col("stuck"), part).otherwise(F.col("node")))
        named = stash(cut.select("rep", "n", "v", "node", F.concat(F.slice("path", 1, F.size("path") - 1), F.array("node")).alias("path"),
                                 "gap", "child"), "cut")
    covers = named.groupBy("node", "child", F.element_at("path", -2).alias("above")).agg(
        F.max("gap").alias("radius"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.min("rep").alias("rep"))
    kids = covers.join(centres.select("child", "center"), "child").select("node", "radius", "rows", "size", "rep", "center", "above")
    return named.select("rep", "n", "v", "node", "path"), stash(kids, "children")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(table: pa.Table) -> pa.Table:
    """Centres of a node's children, of which the first is its own."""
    x = _unit(matrix(table["v"])[np.argsort(table["k"].to_numpy())])
    x = np.concatenate([matrix(table["center"].slice(0, 1)), x])
    # no more centres than leaves of a fair size
    chosen, _ = _net(x, min(CHILDREN, max(2, 4 * table["rows"][0].as_py() // LEAF)))
    node = table["node"][0].as_py()
    return pa.table({
        "node": pa.array([node] * len(chosen)), "child": pa.array([f"{node}.{k}" for k in range(len(chosen))]),
        "center": pa.array(x[chosen].tolist(), pa.list_(pa.float64())),
        "centres": pa.array([x[chosen].tobytes()] + [None] * (len(chosen) - 1), pa.binary())})


def _net(x: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """Numbers of centres, farthest first from the first row, and the nearest centre of each row.

    Ends when all rows are within the level's radius, the next power of two below the furthest row.
    """
    chosen, near = [0], np.zeros(len(x), np.int64)
    gap = np.linalg.norm(x - x[0], axis=1)
    furthest = gap.max(initial=0)
    if not furthest > 0:
        return chosen, near
    level = 2.0 ** (math.ceil(math.log2(furthest)) - 1)
    while len(chosen) < most and gap.max() > level:
        k = int(np.argmax(gap))
        d = np.linalg.norm(x - x[k], axis=1)
        near[d < gap] = len(chosen)
        gap = np.minimum(gap, d)
        chosen.append(k)
    return chosen, near


def _nearest(source):
    for batch in source:
        nodes, of = np.unique(np.array(batch.column("node").to_pylist(), object), return_inverse=True)
        names, gaps = np.empty(batch.num_rows, object), np.zeros(batch.num_rows)
        for k, node in enumerate(nodes):
            rows = np.flatnonzero(of == k)
            x = _unit(matrix(batch.column("v").take(pa.array(rows))))
            centres = np.frombuffer(batch.column("centres")[int(rows[0])].as_py()).reshape(-1, x.shape[1])
            child = np.argmax(x @ centres.T, axis=1)
            gaps[rows] = np.linalg.norm(x - centres[child], axis=1)
            names[rows] = [f"{node}.{c}" for c in child]
        paths = [[*p, n] for p, n in zip(batch.column("path").to_pylist(), names)]
        yield pa.record_batch([batch.column("rep"), batch.column("n"), batch.column("v"), pa.array(names, pa.string()),
                               pa.array(paths, pa.list_(pa.string())), pa.array(gaps)], names=["rep", "n", "v", "node", "path", "gap"])


def _judge(reach: float):
    """Verdict on node pairs: 0 to be followed, 1 linked as a whole; pruned pairs are left out."""
    def judge(source):
        for batch in source:
            if not batch.num_rows:
                continue
            # nodes of several lengths of vectors may be in a batch
            ca, cb = batch.column("center_a"), batch.column("center_b")
            begins = np.cumsum(ca.value_lengths().to_numpy()) - ca.value_lengths().to_numpy()
            apart = np.sqrt(np.add.reduceat((ca.flatten().to_numpy() - cb.flatten().to_numpy()) ** 2, begins))
            radii = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            verdict = np.where(apart + radii <= reach - SLACK, 1, 0)
            near = np.flatnonzero(apart - radii <= reach + SLACK)
            kept = ["size_a", "size_b", "rep_a", "rep_b", "leaf_a", "leaf_b"]
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(verdict.astype(np.int32)), *[batch.column(c) for c in kept]],
                                  names=["a", "b", "verdict", *kept])
            yield out.take(pa.array(near))

    return judge


def _pack(table: pa.Table) -> pa.Table:
    order = np.argsort(table["rep"].to_numpy())
    packed = [table["rep"].to_numpy()[order].astype("<i8"), table["n"].to_numpy()[order].astype("<i8"), matrix(table["v"])[order].astype("<f8")]
    return pa.table({"leaf": table["node"][:1], "tile": table["tile"][:1], **{
        name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("reps", "weights", "data"), packed)}})


def _compare_leaves(members: DataFrame, pairs: DataFrame, threshold: float, reach: float) -> DataFrame:
    """Links across and within open pairs of leaves; a tile holds all pairs of the leaves of two parents."""
    pairs = stash(pairs, "leaf-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    tile = F.element_at("path", F.greatest(F.size("path") - 1, F.lit(1)))
    leaves = stash(_by_node(members, asked, "left_semi").select("node", "rep", "n", "v", tile.alias("tile")).groupBy("node").applyInArrow(
        _pack, "leaf string, tile string, reps binary, weights binary, data binary"), "leaves")
    of = leaves.select("leaf", "tile")
    dealt = pairs.join(of.toDF("a", "ta"), "a").join(of.toDF("b", "tb"), "b")
    dealt = stash(dealt.select("a", "b", F.least("ta", "tb").alias("t"), F.greatest("ta", "tb").alias("u")), "dealt")
    needed = dealt.select("t", "u", "a").union(dealt.select("t", "u", "b")).distinct().toDF("of_t", "of_u", "leaf")
    blobs = needed.join(leaves.drop("tile"), "leaf")
    return stash(dealt.groupBy("t", "u").cogroup(blobs.groupBy("of_t", "of_u")).applyInArrow(
        _compare(threshold, reach), "rep long, n long, other long"), "compared")


def _compare(threshold: float, reach: float):
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def tile(pairs: pa.Table, leaves: pa.Table) -> pa.Table:
        reps, weights = ([np.frombuffer(blob.as_py(), "<i8") for blob in leaves[c]] for c in ("reps", "weights"))
        data = [np.frombuffer(blob.as_py(), "<f8").reshape(len(r), -1) for blob, r in zip(leaves["data"], reps)]
        ends = np.cumsum([len(r) for r in reps])
        rows = {leaf: np.arange(end - len(r), end) for leaf, end, r in zip(leaves["leaf"].to_pylist(), ends, reps)}
        reps, weights, data = np.concatenate(reps), np.concatenate(weights), np.concatenate(data)
        search = _DualTraversal(data, weights, threshold, reach)
        trees = {leaf: search.tree(of) for leaf, of in rows.items()}
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            search.visit(trees[a], trees[b])
        root = search.roots()
        linked = np.flatnonzero((search.count > 0) | (root != np.arange(len(data))))
        return pa.table([reps[linked], search.count[linked], reps[root[linked]]], schema=schema)

    return tile


class _DualTraversal:
    """Exact links among rows of ``x`` by two trees of nested nodes."""

    def __init__(self, x: np.ndarray, weights: np.ndarray, threshold: float, reach: float):
        self.x, self.norm, self.weights = x, np.linalg.norm(x, axis=1), weights
        self.unit = x / self.norm[:, None]
        self.threshold, self.reach = threshold, reach
        self.count = np.zeros(len(x), np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def tree(self, rows: np.ndarray) -> dict:
        """Node of ``rows``, the first of which is its centre."""
        unit = self.unit[rows]
        node = {"rows": rows, "center": unit[0], "radius": float(np.linalg.norm(unit - unit[0], axis=1).max()), "below": []}
        if len(rows) > BLOCK:
            chosen, near = _net(unit, CHILDREN)
            if len(chosen) > 1:
                # a row equal to a later centre is nearest to it, so every centre is in its own part
                node["below"] = [self.tree(np.concatenate([rows[[c]], rows[(near == k) & (np.arange(len(rows)) != c)]])) for k, c in enumerate(chosen)]
        return node

    def visit(self, a: dict, b: dict) -> None:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            apart, radii = float(np.linalg.norm(a["center"] - b["center"])), a["radius"] + b["radius"]
            if apart - radii > self.reach + SLACK:
                continue
            if apart + radii <= self.reach - SLACK:
                self._link_all(a["rows"], b["rows"], a is b)
            elif a is b and a["below"]:
                below = a["below"]
                waiting += [(below[i], below[j]) for i in range(len(below)) for j in range(i, len(below))]
            elif a is not b and (a["below"] or b["below"]):
                if a["below"] and (not b["below"] or a["radius"] >= b["radius"]):
                    waiting += [(c, b) for c in a["below"]]
                else:
                    waiting += [(a, c) for c in b["below"]]
            else:
                self._compare(a["rows"], b["rows"], a is b)

    def _link_all(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        if same:
            self.count[a] += self.weights[a].sum() - self.weights[a]
            self.links.append((a[1:], np.full(len(a) - 1, a[0])))
        else:
            self.count[a] += self.weights[b].sum()
            self.count[b] += self.weights[a].sum()
            self.links += [(a, np.full(len(a), b[0])), (b, np.full(len(b), a[0]))]

    def _compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        near = (self.x[a] @ self.x[b].T) / (self.norm[a][:, None] * self.norm[b][None, :]) >= self.threshold
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.count[a] += near @ self.weights[b]
        if not same:
            self.count[b] += near.T @ self.weights[a]
        i, j = np.nonzero(near)
        self.links.append((a[i], b[j]))

    def roots(self) -> np.ndarray:
        if not self.links:
            return np.arange(len(self.x))
        return local_roots(len(self.x), *(np.concatenate([link[k] for link in self.links]) for k in (0, 1)))
