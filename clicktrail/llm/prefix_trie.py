"""Trie of the prefixes that conversations share.

Conversations are sorted as sequences of turn digests, and the number of leading turns that
neighbours share (LCP) is laid out as a sparse table of range minima. Every prefix of every
row then finds, by itself, how far to the left and to the right rows share it: two binary
searches over the table. The rows in between are the members of the prefix's node, and sums
over them are differences of running sums. There is no stack and no tree in memory.

The sort is by Spark, by digests and id, so that equal conversations spread over tasks, too. A
task cuts its rows into blocks. A node inside a block is finished there; the nodes of a
block's first and last row may go on in the next block. These few rows, two chains per block,
are put together by grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.arrow import batches
from clicktrail.llm.mixing import word_count
from clicktrail.sources.shared import stash

GROUP = 20             # conversations that may take over the first turns of one
BLOCK_ROWS = 1 << 16   # bounds of a block
BLOCK_TURNS = 1 << 18
IDS = 2048             # ids in a piece of the list of a node that blocks share

DIGEST = 16
INNER, CHAIN, ENDS = 0, 1, 2
NOTHING = hashlib.sha256(b"").hexdigest()
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("node", pa.binary()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("words", pa.int64()), ("longer", pa.bool_()), ("chain", pa.int64()), ("ends", pa.string())])
_COLUMNS = ("kind int, node binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
            "n_children long, n_leaves long, saved_tokens long, words long, longer boolean, chain long, ends string")
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def rebuilt(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``key``, ``words``.

    A conversation c takes the first h turns of conversation c - c % 20, with h the checksum
    of its id modulo 4, and then its own turns after its first h. ``key`` holds 16 bytes of
    digest per turn, ``words`` the words of each turn's text.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Null roles and texts are empty;
    a null turn number comes first; equal turn numbers are ordered by role, then by digest, so
    repeated rows are repeated turns. Rows with a null ``conv_id`` belong to no conversation
    and are left out. Other columns are ignored. A text is read once and replaced by its
    digest, however long; the digests of a conversation have to fit into a row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where(conv.isNotNull()).select(
        (conv - conv % GROUP).alias("base"), conv.alias("conv_id"),
        F.struct("turn", role.alias("role"), digest.alias("digest"), word_count(text).alias("words")).alias("t"))
    # dealt by the conversation taken from, which serves both the grouping and the window
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 3))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    with_first = own.select("conv_id", "own", first.alias("first"), h.alias("h"))
    kept = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    sequence = with_first.select("conv_id", F.when(F.col("first").isNull(), kept).otherwise(
        F.concat(F.slice("first", F.lit(1), F.col("h")), kept)).alias("turns"))
    return sequence.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"),
        F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))


def prefix_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node: each distinct sequence of first turns, the empty one included.

    ``conversations`` has unique ``conv_id``, ``key`` and ``words`` as :func:`rebuilt` gives
    them. A node has its smallest member ``conv_id``, ``depth``, the parent's
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in its
    subtree, itself included), ``saved_tokens`` (over its subtree, words of a node's last turn
    times its members but one) and ``ends_sha256``, of the ids of members that end there.
    Without conversations there are no nodes. The list of ids of one node is hashed as a
    stream, in pieces, so equal conversations may be any share of all.
    """
    ordered = conversations.select("conv_id", "key", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = stash(ordered.mapInArrow(_blocks(block_rows, block_turns), _COLUMNS), "trie")
    shared = _shared_nodes(found)
    inner = found.where(F.col("kind") == INNER).withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING)))
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    # Parents inside a block are known. Others stand in a chain of the node's own block, and are
    # asked for there: all children of a node that many blocks share would be one key.
    known = inner.where(F.col("parent_conv_id").isNotNull()).select(columns)
    asking = inner.where(F.col("parent_conv_id").isNull()).select(columns[:2] + columns[3:] + ["chain"]).unionByName(
        shared.select(columns[:2] + columns[3:] + ["chain"]))
    ids = shared.select("node", F.col("conv_id").alias("parent_conv_id"))
    above = found.where(F.col("kind") == CHAIN).select("chain", (F.col("depth") + 1).alias("depth"), "node").join(ids, "node")
    told = asking.join(above.drop("node"), ["chain", "depth"], "left").select(columns)
    return known.unionByName(told)


def _shared_nodes(found: DataFrame) -> DataFrame:
    """The nodes of the chains, summed over their blocks.

    Within a block such nodes count neither as children nor as leaves nor for their words. Each
    does so in one of its chains, for all nodes above it there.
    """
    chains = found.where(F.col("kind") == CHAIN)
    facts = chains.groupBy("node").agg(F.min("chain").alias("home"), F.max("longer").alias("has_longer"))
    upward = Window.partitionBy("chain").orderBy(F.desc("depth"))
    at_home = F.col("chain") == F.col("home")
    leaf = F.when(at_home & ~F.col("has_longer"), 1).otherwise(0)
    words = F.when(at_home, F.col("words")).otherwise(0)
    so_far = upward.rowsBetween(Window.unboundedPreceding, 0)
    counted = chains.join(facts, "node").select(
        "node", "chain", "depth", "conv_id", "n_convs",
        (F.col("n_children") + F.coalesce(F.lag(at_home.cast("int")).over(upward), F.lit(0))).alias("n_children"),
        (F.col("n_leaves") + F.sum(leaf).over(so_far)).alias("n_leaves"),
        (F.col("saved_tokens") - F.sum(words).over(so_far)).alias("saved_tokens"))
    nodes = counted.groupBy("node").agg(
        F.min("chain").alias("chain"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in SUMS])
    pieces = found.where(F.col("kind") == ENDS).select("node", "conv_id", "ends")
    lists = pieces.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_lists, "node binary, ends_sha256 string")
    return nodes.join(lists, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def _hash_lists(source: Iterator[pa.RecordBatch]):
    """Digest of each node's ids, whose pieces come one after the other."""
    def rows():
        node, digest = None, None
        for batch in source:
            for new, ids in zip(batch.column("node"), batch.column("ends")):
                if new.as_py() != node:
                    if digest is not None:
                        yield (node, digest.hexdigest()), 100
                    node, digest = new.as_py(), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if digest is not None:
            yield (node, digest.hexdigest()), 100

    return batches(rows(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))


def _blocks(most_rows: int, most_turns: int):
    def rows(source: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for number, (conv, keys, words) in enumerate(_cut(source, most_rows, most_turns)):
            yield from _block_rows(conv, keys, words, 2 * (first + number))

    return lambda source: batches(rows(source), _SCHEMA)


def _cut(source: Iterator[pa.RecordBatch], most_rows: int, most_turns: int):
    conv, keys, words, turns = [], [], [], 0
    for batch in source:
        for c, key, w in zip(*(batch.column(n) for n in ("conv_id", "key", "words"))):
            conv.append(c.as_py())
            keys.append(key.as_py())
            words.append(w.values.to_numpy(zero_copy_only=False) if len(w) else np.zeros(0, np.int64))
            turns += len(words[-1])
            if len(conv) == most_rows or turns >= most_turns:
                yield np.array(conv), keys, words
                conv, keys, words, turns = [], [], [], 0
    if conv:
        yield np.array(conv), keys, words


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of the ranges of 1, 2, 4, ... elements that start at each position."""
    levels, step = [values], 1
    while len(levels[-1]) > step:
        last = levels[-1]
        levels.append(np.minimum(last[:-step], last[step:]))
        step *= 2
    return levels


def range_min(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum from ``first`` to ``last``, both included, by two overlapping ranges."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << k) + 1])
    return out


def left_extent(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First row that shares ``depth`` turns with ``row``; element i of the table is of rows i and i + 1."""
    low, high = np.zeros_like(row), row.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        shares = range_min(levels, mid, row[open_] - 1) >= depth[open_]
        high[open_[shares]] = mid[shares]
        low[open_[~shares]] = mid[~shares] + 1
    return low


def right_extent(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray, n: int) -> np.ndarray:
    """Last row that shares ``depth`` turns with ``row``."""
    low, high = row.copy(), np.full_like(row, n - 1)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        shares = range_min(levels, row[open_], mid - 1) >= depth[open_]
        low[open_[shares]] = mid[shares]
        high[open_[~shares]] = mid[~shares] - 1
    return low


def shared_turns(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Leading turns that each row shares with the next one."""
    lens = np.diff(starts)
    out = np.zeros(max(len(lens) - 1, 0), np.int64)
    open_, depth = np.arange(len(out)), 0
    while open_.size:
        open_ = open_[(lens[open_] > depth) & (lens[open_ + 1] > depth)]
        open_ = open_[(flat[starts[open_] + depth] == flat[starts[open_ + 1] + depth]).all(axis=1)]
        depth += 1
        out[open_] = depth
    return out


def _block_rows(conv: np.ndarray, keys: list[bytes], words: list[np.ndarray], chain: int):
    """Rows of one block of sorted conversations: nodes inside it, its two chains, shared ends."""
    n = len(conv)
    lens = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lens)])
    flat = np.frombuffer(bytearray(b"".join(keys)), np.uint64).reshape(-1, 2)
    shared = shared_turns(flat, starts)
    table, ids = sparse_table(shared), sparse_table(conv)

    # every prefix of every row, by row and depth
    row = np.repeat(np.arange(n), lens)
    depth = np.arange(starts[-1]) - starts[row] + 1
    left = left_extent(table, row, depth)
    new = left == row
    right = np.full_like(row, -1)
    right[new] = right_extent(table, row[new], depth[new], n)
    inner = new & (left > 0) & (right < n - 1)
    leaf = new & (lens[right] == depth)

    def running(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)])

    # place of the parent: the same row's prefix before, at the row where that one is new
    parent = np.full_like(row, -1)
    deep = np.flatnonzero(depth > 1)
    parent[deep] = starts[left[deep - 1]] + depth[deep] - 2
    own = np.flatnonzero(inner)
    children = np.bincount(parent[own] + 1, minlength=len(row) + 1)     # element 0 is the root's
    each = np.concatenate(words) if n else np.zeros(0, np.int64)
    before, inner_words, inner_leaves = running(each), running(each * inner), running(leaf & inner)
    all_words = running(before[starts[1:]] - before[starts[:-1]])

    def stats(at: int, first: int, last: int) -> tuple[int, int, int, int]:
        """Sums over the members, without nodes of the chains; ``at`` is -1 for the root."""
        start, members = max(at, 0), last - first + 1
        above = before[start] - before[starts[first]] if at >= 0 else 0
        end = starts[last + 1]
        total = all_words[last + 1] - all_words[first] - members * above
        return (members, int(children[at + 1]), int(inner_leaves[end] - inner_leaves[start]),
                int(total - (inner_words[end] - inner_words[start])))

    same = np.flatnonzero(~((shared == lens[:-1]) & (shared == lens[1:]))) + 1 if n > 1 else np.zeros(0, int)
    group_end = dict(zip([0, *same.tolist()], [*same.tolist(), n]))      # rows with equal keys
    least = np.zeros(len(row), np.int64)
    found = np.flatnonzero(new)
    least[found] = range_min(ids, left[found], right[found])

    def ending(first: int) -> list[str]:
        return [str(c) for c in conv[first:group_end[first]].tolist()]

    # nodes inside the block; a row's new prefixes are its deepest ones
    known = np.concatenate([[0], shared])
    for i in range(1, n):
        if known[i] == lens[i]:
            continue
        key, at = keys[i], int(known[i])
        digest = hashlib.md5(key[:at * DIGEST])
        for p in range(starts[i] + at, starts[i + 1]):
            d = int(depth[p])
            digest.update(key[(d - 1) * DIGEST:d * DIGEST])
            name = digest.digest()
            if not inner[p]:
                continue
            up = int(parent[p])
            listed = hashlib.sha256(",".join(ending(i)).encode()).hexdigest() if lens[i] == d else None
            yield (INNER, name, d, int(least[p]), int(least[up]) if up >= 0 and inner[up] else None,
                   *stats(p, i, int(right[p])), None, None, chain + int(up >= 0 and left[up] > 0), listed), 200

    # the first and the last row, whose nodes may reach beyond the block
    for side, i in enumerate([0, n - 1] if n > 1 else [0]):
        digest = hashlib.md5()
        for d in range(lens[i] + 1):
            p = int(starts[i]) + d - 1 if d else -1
            if d:
                digest.update(keys[i][(d - 1) * DIGEST:d * DIGEST])
            name = digest.digest()
            word = int(each[p]) if d else 0
            if side and (not d or left[p] == 0):       # a node of the first row, counted there
                yield (CHAIN, name, d, None, None, 0, 0, 0, 0, word, False, chain + 1, None), 150
                continue
            last = int(right[p]) if d else n - 1
            first = int(left[p]) if d else 0
            # the node's place is where it is new
            at = int(starts[first]) + d - 1 if d else -1
            last = int(right[at]) if d else last
            smallest = int(least[at]) if d else int(conv.min())
            yield (CHAIN, name, d, smallest, None, *stats(at, first, last), word,
                   bool(lens[last] > d), chain + side, None), 150
            if lens[first] == d:
                ids_here = ending(first)
                for a in range(0, len(ids_here), IDS):
                    yield (ENDS, name, None, int(ids_here[a]), None, None, None, None, None, None, None, None,
                           ",".join(ids_here[a:a + IDS])), 12 * IDS
