"""Functions over the columns of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_bounds(spec: str, size: int) -> tuple[int, int]:
    """Bounds of a slice like ``1:3``, ``:2`` or ``-2:``; equal bounds mean the one field there."""
    left, colon, right = spec.partition(":")
    if not colon:
        raise ValueError(f"no slice: {spec}")
    i, j = int(left or 0), int(right) if right.strip() else size
    i, j = i + size * (i < 0), min(j + size * (j < 0), size)
    if i == j:
        j = i + 1
    if not 0 <= i < size or j <= i:
        raise ValueError(f"slice {spec} of {size} columns is empty")
    return i, min(j, size)


def concat_columns(df: DataFrame, spec: str, sep: str | None = None) -> Column:
    """A slice of the columns joined by ``sep``; null if the first column is."""
    i, j = slice_bounds(spec, len(df.columns))
    cols = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return F.when(cols[0].isNotNull(), F.concat_ws(sep or "", *cols[i:j]))


def concat_fields(fields: Column, spec: str, sep: str | None = None) -> Column:
    """The same for an array column; null where the slice of an array is empty."""
    left, colon, right = spec.partition(":")
    if not colon:
        raise ValueError(f"no slice: {spec}")
    i, size = int(left or 0), F.size(fields)
    start = size + i if i < 0 else F.lit(i)
    end = F.least(size + int(right) if int(right) < 0 else F.lit(int(right)), size) if right.strip() else size
    end = F.when(start == end, start + 1).otherwise(end)
    fine = (start >= 0) & (start < size) & (end > start)
    return F.when(fine, F.array_join(F.slice(fields, F.when(fine, start + 1).otherwise(1), F.when(fine, end - start).otherwise(0)), sep or ""))


def first(fields: Column) -> Column:
    return F.get(fields, 0)


def rest(fields: Column) -> Column:
    return F.when(F.size(fields) > 1, F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1)))).otherwise(F.slice(fields, 1, 0))


def as_tuple(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def as_bag(df: DataFrame) -> Column:
    """One row for each column's value, as string."""
    return F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]))


def luid() -> Column:
    """An id unique in the job; not stable when the rows are computed again."""
    return F.monotonically_increasing_id()


def random_uuid() -> Column:
    return F.uuid()


def peek(df: DataFrame, name: str = "peek", n: int = 5) -> DataFrame:
    """Prints some rows and passes all on."""
    for row in df.limit(n).toLocalIterator():
        print(name, tuple(row))
    return df
