"""Packing of token pieces into sequences of a fixed length.

Hierarchical residual packing: each partition packs its pieces by best fit in order of
decreasing length. Nearly full bins leave at once; underfull ones become items of a smaller
number of partitions, merged as a tree until one is left. A bin is two numbers and a list of
at most ``capacity`` pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.arrow import as_bytes, batches
from clicktrail.sources.shared import stash

CAPACITY = 2048
PER_TASK = 200_000     # pieces that a task packs in the first round
FAN_IN = 8             # partitions merged into one per round
LONGEST_BLANK = 10_000  # white space in a row that tiktoken is given
NEARLY_FULL = 8        # bins with no more room than this leave at once

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                          ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = f"done boolean, part int, number long, fill int, pieces array<struct<{PIECE.replace(' ', ': ').replace(',:', ',')}, offset: int>>"


def byte_bpe(vocabulary: str) -> Callable[[], Callable[[str], list[int]]]:
    """Maker of an encoder for the byte-level BPE of a ``tokenizers`` file.

    Texts of Latin letters are encoded by the same merges in ``tiktoken``, which gives equal
    ids in about a third of the time; texts with other letters or with a special token's
    string go to ``tokenizers`` itself.
    """
    def make():
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # fixed value: the split pattern of the byte-level pre-tokenizer
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain = re.compile("[\x00-ɏ‐-‧]*").fullmatch
        long_blank = re.compile(r"\s{%d}" % (LONGEST_BLANK + 1)).search

        def encode(text: str) -> list[int]:
            if plain(text) and not long_blank(text) and not any(s in text for s in special):
                return fast.encode_ordinary(text)
            return whole.encode(text, add_special_tokens=False).ids

        return encode

    return make


def token_pieces(docs: DataFrame, encoder: Callable, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids, closed by ``end_id``.

    Documents of more than ``capacity`` ids are cut so that all pieces but the first are
    full. Null and empty texts are the end id alone. A null ``doc_id`` stays null; rows that
    repeat are packed as often as they come. Other columns are ignored.
    """
    def rows(source: Iterator[pa.RecordBatch]):
        encode = encoder()
        for batch in source:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = np.array([*encode(text.decode("utf-8", "replace")), end_id], "<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield (doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), 40

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda s: batches(rows(s), PIECE_SCHEMA), PIECE)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """Assign every piece to a sequence.

    Adds ``sequence_id`` and ``offset``; offsets of a sequence are gapless from 0. After a
    round each task has at most one bin that is half empty or more, so of the others no more
    than there are tasks can still take one in: a task keeps that many with the most room and
    lets the rest go. This loses no merge, since a bin with more room can stand in for one
    with less. It bounds what moves up the tree by the square of the number of tasks.
    An empty table gives no rows.
    """
    pieces = stash(pieces, "pieces")
    whole = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // per_task))
    items = rest.select(F.col("length").cast("int").alias("fill"),
                        F.array(F.struct("*", F.lit(0).alias("offset"))).alias("pieces"))
    done, level = [], 0
    while True:
        level += 1
        packed = stash(items.repartition(tasks).mapInArrow(
            _best_fit(capacity, tasks if tasks > 1 else 0), BIN), "bins")
        done.append(packed.where("done").withColumn("level", F.lit(level)))
        if tasks == 1:
            break
        items = packed.where("not done").select("fill", "pieces")
        tasks = -(-tasks // FAN_IN)
    bins = done[0]
    for more in done[1:]:
        bins = bins.union(more)
    # sequence numbers: level, task and running number, with full pieces at level 0
    number = F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 34) + F.col("number")
    shared = bins.select(number.alias("sequence_id"), F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", F.col("p.offset").cast("long").alias("offset"))
    alone = whole.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.union(alone)


def _best_fit(capacity: int, keep: int):
    """Best fit of one partition. ``keep``: roomiest underfull bins to pass on; 0 ends all."""
    item = pa.struct([*PIECE_SCHEMA, ("offset", pa.int32())])
    schema = pa.schema([("done", pa.bool_()), ("part", pa.int32()), ("number", pa.int64()),
                        ("fill", pa.int32()), ("pieces", pa.list_(item))])

    def rows(source: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        items = pa.Table.from_batches(list(source)) if (source := list(source)) else None
        if items is None or not items.num_rows:
            return
        items = items.combine_chunks()
        fills, lists = items["fill"].to_numpy(), items["pieces"].combine_chunks()
        bins = best_fit(fills, capacity)
        flat, starts = lists.flatten(), lists.offsets.to_numpy()
        starts = starts - starts[0]
        columns = {n: flat.field(n).to_pylist() for n in item.names} if hasattr(item, "names") else {
            f.name: flat.field(f.name).to_pylist() for f in item}
        fill_of = [int(fills[b].sum()) for b in bins]
        roomy = sorted((i for i, f in enumerate(fill_of) if capacity - f > NEARLY_FULL), key=lambda i: fill_of[i])
        moving = set(roomy[:keep + 1]) if keep else set()
        for number, members in enumerate(bins):
            content, at = [], 0
            for m in members:
                for k in range(starts[m], starts[m + 1]):
                    content.append({n: c[k] for n, c in columns.items()} | {"offset": at + columns["offset"][k]})
                at += int(fills[m])
            yield (number not in moving, part, number, at, content), 60 * len(content)

    return lambda source: batches(rows(source), schema)


def best_fit(fills: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, by best fit in order of decreasing size.

    A bit per amount of room tells which bins are open, so the tightest is found by a shift.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-fills, kind="stable").tolist():
        size = int(fills[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            if not by_room.setdefault(room, []):
                rooms |= 1 << room
            by_room[room].append(at)
    return bins
