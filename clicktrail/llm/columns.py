"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def running_starts(lengths: Column) -> Column:
    """Sum of all elements before each one of an array of integers.

    Sums chunks first, so that n elements cost about n times the chunk size plus the square
    of the number of chunks, and no array is grown element by element.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(part: Column, base: Column) -> Column:
        return F.transform(part, lambda x, j: base + total(F.slice(part, F.lit(1), j)))

    n = F.ceil(F.size(lengths) / CHUNK).cast("int")
    chunks = F.when(F.size(lengths) > 0, F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())
    sums = F.transform(chunks, total)
    return F.flatten(F.transform(chunks, lambda part, k: starts(part, total(F.slice(sums, F.lit(1), k)))))
