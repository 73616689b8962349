"""Vectors in array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite in all components and not zero."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(doubles, lambda x: x != 0.0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long vectors without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
