r"""Removal of lines that other documents hold too.

Line hashes are partitioned by range and sorted by hash, document and position; a stream over
each partition finds first occurrences. The range key includes the document, so the rows of a
very common line spread over several partitions. What a partition can't know, the first
document of a run that began before it, is settled from two summary rows per partition. The
result is a compressed keep bitmap per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.arrow import as_bytes, batches
from clicktrail.sources.shared import stash

DROPPED, OPEN, EDGE = 0, 1, 2
LINE_SCHEMA = "doc_id long, doc_key long, n_lines int, pos int, h1 long, h2 long"
RUN_SCHEMA = "kind int, " + LINE_SCHEMA


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Keep bitmaps of the documents that lose lines.

    A line's key is the line without white space at both ends, A-Z in lower case. Lines whose
    key has at least ``min_chars`` code points stay only in the smallest ``doc_id`` that
    holds the key; keys are told apart by 128 bits of hash. Returns (``doc_id``, ``doc_key``
    hash of the text, ``n_lines``, ``n_dropped``, ``keep`` zlib of the packed bits). A
    document without a row keeps all its lines.

    Null or empty texts are one empty line. Rows with a null ``doc_id`` take no part. Rows
    that repeat a ``doc_id`` are one document for the rule, each with a bitmap of its own
    text. Other columns are ignored. An empty table gives no rows.
    """
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text")
    lines = stash(texts.mapInArrow(_hash_lines(min_chars), LINE_SCHEMA), "lines")
    order = ["h1", "h2", "doc_id", "doc_key", "pos"]
    runs = stash(
        lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions(*order)
        .mapInArrow(_first_occurrences, RUN_SCHEMA), "runs")
    # at most two rows per partition, so the broadcast does not grow with the lines
    edges = runs.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    settled = runs.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> first_doc")
    dropped = runs.where(F.col("kind") == DROPPED).select("doc_id", "doc_key", "n_lines", "pos").union(
        settled.select("doc_id", "doc_key", "n_lines", "pos"))
    return (
        dropped.groupBy("doc_id", "doc_key", "n_lines").agg(F.collect_set("pos").alias("pos"))
        .mapInArrow(_bitmaps, "doc_id long, doc_key long, n_lines int, n_dropped int, keep binary")
    )


def kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with the lines their bitmaps keep.

    Adds ``n_lines`` and ``n_dropped`` to (``row`` the document, ``kept`` its new text); a
    null text stays null.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64("text").alias("doc_key"), F.col("text").alias("kept"))
    joined = keyed.join(bitmaps.select("doc_id", "doc_key", "n_dropped", "keep"), ["doc_id", "doc_key"], "left")
    cut = F.pandas_udf(_cut, "string")(F.when(F.col("keep").isNotNull(), F.col("kept")), F.col("keep"))
    kept = F.when(F.col("keep").isNull(), F.col("kept")).otherwise(cut)
    n_lines = F.length("kept") - F.length(F.replace("kept", F.lit("\n"))) + 1
    return joined.select(
        "row", kept.alias("kept"), F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def _cut(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    def one(text, keep):
        if text is None or keep is None:
            return None
        lines = text.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), "u1"), count=len(lines))
        return "\n".join(line for line, bit in zip(lines, bits) if bit)

    return texts.combine(bitmaps, one)


def _hash_lines(min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("n_lines", pa.int32()),
                        ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def rows(source: Iterator[pa.RecordBatch]):
        for batch in source:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(as_bytes(batch.column(2))):
                lines = text.split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip().lower()
                    if len(key) >= min_chars and (
                            len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                        h = xxhash.xxh3_128_digest(key)
                        yield (ids[i], keys[i], len(lines), pos, int.from_bytes(h[:8], "little", signed=True),
                               int.from_bytes(h[8:], "little", signed=True)), 40

    return lambda source: batches(rows(source), schema)


def _first_occurrences(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped rows, undecided rows of the first run, and the ends of the partition."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("doc_key", pa.int64()),
                        ("n_lines", pa.int32()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
    names = schema.names[1:]
    first_key = last_key = None
    last_doc = first_doc = 0
    for batch in source:
        if not batch.num_rows:
            continue
        doc, key, n, pos, h1, h2 = (batch.column(c).to_numpy() for c in names)
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lead = doc[starts].copy()
        if last_key == (h1[0], h2[0]):
            lead[0] = last_doc
        if first_key is None:
            first_key, first_doc = (h1[0], h2[0]), doc[0]
        undecided = (h1 == first_key[0]) & (h2 == first_key[1])
        gone = (doc != lead[run]) & ~undecided
        pick = np.flatnonzero(gone | undecided)
        if len(pick):
            kind = np.where(undecided[pick], OPEN, DROPPED).astype("i4")
            yield pa.record_batch([pa.array(kind), *(pa.array(c[pick]) for c in (doc, key, n, pos, h1, h2))], schema=schema)
        last_key, last_doc = (h1[-1], h2[-1]), lead[-1]
    if first_key is not None:
        ends = {first_key: first_doc, last_key: last_doc} if first_key != last_key else {first_key: first_doc}
        rows = [{"kind": EDGE, "doc_id": int(d), "doc_key": 0, "n_lines": 0, "pos": 0,
                 "h1": int(h1), "h2": int(h2)} for (h1, h2), d in ends.items()]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _bitmaps(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("n_lines", pa.int32()),
                        ("n_dropped", pa.int32()), ("keep", pa.binary())])

    def rows():
        for batch in source:
            for doc, key, n, gone in zip(*(batch.column(i) for i in range(4))):
                pos, bits = np.array(gone.as_py()), np.ones(n.as_py(), bool)
                bits[pos] = False
                keep = zlib.compress(np.packbits(bits).tobytes())
                yield (doc.as_py(), key.as_py(), n.as_py(), len(pos), keep), 40 + len(keep)

    return batches(rows(), schema)
