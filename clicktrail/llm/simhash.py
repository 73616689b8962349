r"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits if and only if some value lies within half
the radius of both. Every distinct fingerprint stands for all its variants within that half
radius. Variants are shuffled by prefix: one row carries all variants of a fingerprint that
share a prefix, as the fingerprint and the number of bits still free, and the task that holds
the prefix expands them, finds equal ones by sorting and links their owners. All owners of a
variant are within ``radius`` of each other, so a chain along the sorted run keeps every link
without listing pairs. Prefixes with too many variants are split by further bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.arrow import as_bytes, batches
from clicktrail.llm.components import components, local_roots
from clicktrail.sources.shared import stash

BITS = 64
VARIANTS_PER_TASK = 1 << 21   # aimed at on average
VARIANTS_AT_MOST = 1 << 23    # a prefix beyond is split
SPLIT_BITS = 6
HASH_SEED = 42


def fingerprint(text: bytes, shingle: int = 4) -> int:
    r"""SimHash of the word shingles of a text, A-Z in lower case.

    Words are ``[^\x20\x09-\x0D]+``; shingles are space-joined and weighted by how often they
    occur. Fewer words make one shingle, none give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, HASH_SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    counts = np.zeros(BITS, np.int64)
    values = np.array(hashes, "<u8").view("u1").reshape(-1, 8)
    for at in range(0, len(values), 1 << 15):
        counts += np.unpackbits(values[at:at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, key: Column | None = None) -> DataFrame:
    """``doc_id`` and signed ``fp`` of every row, with the long ``key`` if given; null texts have no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def rows(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for doc, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                value = fingerprint(text, shingle)
                yield (doc, own, value - (1 << BITS) if value >> (BITS - 1) else value), 24

    given = F.lit(None).cast("long") if key is None else key
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), given.alias("key"), "text").mapInArrow(
        lambda s: batches(rows(s), schema), "doc_id long, key long, fp long")
    return made if key is not None else made.drop("key")


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, key: Column | None = None) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` and ``group`` of every row, and its ``key`` if given.

    Rows are linked if their fingerprints differ in at most ``radius`` (even) bits, by nothing
    else: rows of one ``doc_id`` with unlike texts are apart. ``group`` is the smallest
    fingerprint reachable, ``component_id`` the smallest id of a row of the group, null if
    none has one. Texts without words share fingerprint 0. Rows with a null ``doc_id`` and
    repeated rows stay; other columns are ignored; an empty table gives none. A very long
    text costs its task its words and eight bytes per shingle.
    """
    prints = stash(fingerprints(docs, shingle, key), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(ball_links(nodes.select("fp", F.col("fp").alias("rep")), radius)).withColumnRenamed("node", "fp")
    grouped = stash(nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), "groups")
    ids = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = stash(grouped.join(ids, "group").select("fp", "group", "component_id"), "labels")
    return prints.join(labels, "fp", "left")


def ball_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``u``-``v`` that span the components of distinct fingerprints.

    ``nodes`` has ``fp`` and the id ``rep`` that stands for it.
    """
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("the radius is split in two, so it has to be even")
    ball = sum(_choose(BITS, k) for k in range(half + 1))
    n = nodes.count()
    width = min(24, max(4, (n * ball // VARIANTS_PER_TASK).bit_length()))
    level = _extend(nodes.select("fp", "rep", F.lit(0).cast("long").alias("prefix"), F.lit(half).alias("free")), 0, width, half)
    found = []
    while True:
        cost = F.element_at(F.array(*[F.lit(sum(_choose(BITS - width, k) for k in range(f + 1))) for f in range(half + 1)]),
                            F.col("free") + 1)
        heavy = level.groupBy("prefix").agg(F.sum(cost).alias("variants")).where(F.col("variants") > VARIANTS_AT_MOST)
        heavy = stash(heavy.select("prefix"), "heavy")
        split = width + SPLIT_BITS <= BITS - 8 and heavy.limit(1).count() > 0
        ready = level.join(heavy, "prefix", "left_anti") if split else level
        found.append(stash(ready.groupBy("prefix").applyInArrow(_collide(width, half), "u long, v long"), "ball-links"))
        if not split:
            break
        level = stash(level.join(heavy, "prefix", "left_semi"), "heavy-rows")
        level, width = _extend(level, width, width + SPLIT_BITS, half), width + SPLIT_BITS
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _flips(width: int, most: int) -> list[list[int]]:
    """Masks of ``width`` bits, by the number of bits set."""
    return [[sum(1 << b for b in bits) for bits in combinations(range(width), k)] for k in range(most + 1)]


def _extend(rows: DataFrame, old: int, new: int, half: int) -> DataFrame:
    """Rows per prefix of ``new`` bits, for each way to spend free flips on the added bits."""
    added = new - old
    own = F.shiftrightunsigned("fp", BITS - new).bitwiseAND((1 << added) - 1)
    head = F.shiftleft("prefix", added)
    masks = _flips(added, half)
    ways = [F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("used"))
                      for k, group in enumerate(masks[:free + 1]) for m in group]) for free in range(half + 1)]
    way = ways[half]
    for free in range(half):
        way = F.when(F.col("free") == free, ways[free]).otherwise(way)
    return rows.withColumn("way", F.explode(way)).select(
        "fp", "rep", head.bitwiseOR(own.bitwiseXOR(F.col("way.mask"))).alias("prefix"),
        (F.col("free") - F.col("way.used")).alias("free"))


def _collide(width: int, half: int):
    """Links between owners of equal variants that share a prefix of ``width`` bits."""
    low_bits = BITS - width
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    masks = [np.array(m, np.uint64) for m in _flips(low_bits, half)]

    def links(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        rep, free = table["rep"].to_numpy(), table["free"].to_numpy()
        low = fp & np.uint64((1 << low_bits) - 1)
        variants, owners = [], []
        for f in range(half + 1):
            own = np.flatnonzero(free == f).astype(np.int32)
            around = np.concatenate(masks[:f + 1])
            variants.append((low[own][:, None] ^ around[None, :]).ravel())
            owners.append(np.repeat(own, len(around)))
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        a, b = owners[same], owners[same + 1]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * half
        root = local_roots(len(fp), a[near], b[near])
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table([rep[linked], rep[root[linked]]], schema=schema)

    return links
