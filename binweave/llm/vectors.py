"""Vector columns: which rows count, and whole batches of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str, *others: str) -> DataFrame:
    """Rows (vector, x0, x1, ...) of the vectors, as double, that hold finite components only,
    with the other columns under these names, so that none clashes. Null and empty vectors go,
    and those that hold a null or a number that isn't finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(f"`{vector}`").isNotNull() & (F.size(v) > 0) & fine)
    return kept.select(v.alias("vector"), *[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(others)])


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The usable rows of the length that most of them have (of the longest such), and that
    length; others can't be compared with them and go. No rows, length 0."""
    best = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("vector") == best["d"]), best["d"]) if best else (rows, 0)


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, a row each."""
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def floors(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as integers; scales are powers of two, so the product is exact.
    Integers beyond ``most`` would overflow what is computed from them, and are refused."""
    out = np.floor(x * scale)
    if len(out) and np.abs(out).max() > most:
        raise OverflowError(f"a component's floor({scale} * x) is beyond {most}")
    return out.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of no more rows than these."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
