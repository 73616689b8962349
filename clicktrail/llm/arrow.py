"""Small helpers for functions that map Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

FLUSH_BYTES = 4 << 20


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, one at a time; null gives an empty one."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def batches(rows: Iterable[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about :data:`FLUSH_BYTES` from rows that come with their weight in bytes."""
    columns: list[list] = [[] for _ in schema]
    weight = 0
    for row, size in rows:
        for column, value in zip(columns, row):
            column.append(value)
        weight += size
        if weight >= FLUSH_BYTES:
            yield _batch(columns, schema)
            columns, weight = [[] for _ in schema], 0
    if columns[0]:
        yield _batch(columns, schema)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
