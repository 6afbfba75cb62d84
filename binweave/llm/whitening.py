"""Embedding whitening: covariance and projection as products of distributed block matrices.

Rows become integers, so that sums are exact. Centred rows are packed into blocks of ROWS
rows where they are read, and numbered. The scatter matrix is the product of the transposed
BlockMatrix and itself, the middle dimension cut so that a task adds a bounded number of
blocks; it has the vectors' dimensions per side, so its eigenvectors are found on the driver.
For the projection the blocks are laid out in a square, a matrix of G x G blocks, and
multiplied by a block diagonal of whitening matrices: a product of that shape is dealt to as
many tasks as wanted, where one column of blocks would go to the square root of it.

Rows are centred at the integers next to the means. What is left, less than one half, is put
right by a rank-one term in the covariance and a constant in the projection; both are exact to
double precision, and blocks of small integers shuffle at a fraction of their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches
from .vectors import floors, matrix, of_one_length, slices, usable

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Rows of a block at least, blocks at most (their places go through the driver), and bytes
#: of blocks that a task of a product holds.
ROWS, BLOCKS, HELD = 1024, 1 << 18, 64 << 20
#: Dimensions at most: the driver holds a matrix of their square (128 MB).
MOST_DIMS = 4096
#: Eigenvalues below this share of the trace are none.
NOTHING = 1e-12


class Fit(NamedTuple):
    n: int
    centre: np.ndarray  #: integers next to the means
    rest: np.ndarray  #: means less centre
    values: np.ndarray  #: eigenvalues, falling
    components: np.ndarray  #: unit eigenvectors, a column each
    trace: float


def longs(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return floors(matrix(batch, dims), SCALE, 2**46) + SHIFT


def totals(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """How many rows, and the sums of their integers; tasks send a sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + longs(batch, dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(total)], names=["d", "n", "s"])

    found = rows.select("vector").mapInArrow(lean(run), "d long, n long, s long").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = found.toPandas().sort_values("d")  # a row per dimension
    return int(found["n"].iloc[0]), found["s"].to_numpy()


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sums of (n x - total)^2 of each row, exact; null beyond a long."""
    most = max(abs(int(x.max()) * n - int(total.min())), abs(int(x.min()) * n - int(total.max()))) if x.size else 0
    if most * most * max(1, x.shape[1]) < 2**63:
        d = n * x - total
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, total.tolist())) for row in x.tolist()]
    return [d if d < 2**63 else None for d in exact]


def blocks(rows: DataFrame, dims: int, n: int, total: np.ndarray, size: int) -> DataFrame:
    """A written table (i, keys, deviation, x): blocks of ``size`` rows at most, numbered
    without a gap, x row by row and less the centre."""
    kind = rows.schema["x0"].dataType.simpleString()
    centre = centres(n, total)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, keys, far, held, have = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal count, keys, far, held, have
            key = pa.chunked_array(keys).combine_chunks()
            out = [pa.array([task]), pa.array([count]), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), pa.array([far], pa.list_(pa.int64())), pa.array([np.concatenate(held).ravel()])]
            count, keys, far, held, have = count + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(out, names=["task", "at", "keys", "deviation", "x"])

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, size - have)
                x = longs(batch, dims)
                keys.append(batch.column("x0"))
                far += deviations(x, n, total)
                held.append(x - centre)
                at, have = at + batch.num_rows, have + batch.num_rows
                if have == size:
                    yield close()
        if have:
            yield close()

    out = materialise(rows.select("vector", "x0").mapInArrow(lean(run), f"task long, at long, keys array<{kind}>, deviation array<long>, x array<long>"), "blocks")
    # numbers go on from task to task; there is a row for each task
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = out.groupBy("task").agg(F.count("*").alias("n")).select("task", F.coalesce(before, F.lit(0)).alias("before"))
    return materialise(out.join(first, "task").select((F.col("before") + F.col("at")).alias("i"), "keys", "deviation", "x"), "numbered")


def centres(n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers next to the means, and the means less these."""
    centre = (2 * total + n) // (2 * n)
    return centre, (total - n * centre) / n


def block_matrix(table: DataFrame, dims: int, size: int, side: int | None = None) -> BlockMatrix:
    """The rows of (i, x) as a BlockMatrix: block i at (i, 0), or, with ``side``, at
    (i / side, i % side). Blocks are filled up with zero rows, which add nothing."""

    def block(row) -> tuple[tuple[int, int], DenseMatrix]:
        x = np.zeros((size, dims))
        x.ravel()[: len(row["x"])] = row["x"]
        return (row["i"], 0) if side is None else divmod(row["i"], side), DenseMatrix(size, dims, x.ravel(), isTransposed=True)

    return BlockMatrix(table.select("i", "x").rdd.map(block), size, dims)


def scatter(x: BlockMatrix, splits: int) -> np.ndarray:
    """x' x as a local matrix. The Python method has no argument for the splits of the middle
    dimension that the method behind it takes."""
    across = x.transpose()
    product = across._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, x.colsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()


def fitted(xx: np.ndarray, n: int, total: np.ndarray, components: int) -> Fit:
    centre, rest = centres(n, total)
    covariance = xx / n - np.outer(rest, rest)
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v, trace = e[::-1], v[:, ::-1], float(np.trace(covariance))
    held = min(components, int((e > NOTHING * trace).sum()) if trace > 0 else 0)
    return Fit(n, centre, rest, e[:held], v[:, :held], trace)


def project(table: DataFrame, dims: int, size: int, fit: Fit) -> DataFrame:
    """A written table (i, y): the whitened rows of each block, row by row; rows beyond the
    block's own are to be ignored."""
    spark, k = table.sparkSession, len(fit.values)
    whiten = fit.components / np.sqrt(fit.values)
    shift = fit.rest @ whiten
    count = table.count()
    side = max(1, int(np.ceil(np.sqrt(count))))
    tasks = max(1, -(-count * size * dims * 8 // HELD))
    one = DenseMatrix(dims, k, whiten.ravel(order="F"))
    diagonal = BlockMatrix(spark.sparkContext.range(side, numSlices=tasks).map(lambda c: ((c, c), one)), dims, k)
    product = block_matrix(table, dims, size, side).multiply(diagonal)
    rows = product.blocks.map(lambda b: (b[0][0] * side + b[0][1], (b[1].toArray() - shift).ravel().tolist()))
    return materialise(spark.createDataFrame(rows, "i long, y array<double>"), "projected")


def identity_error(projected: DataFrame, k: int, n: int) -> float:
    """The largest entry, in size, of the whitened rows' covariance less the identity. Rows
    (keys, y); tasks send k (k + 1) sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k))
        for batch in slices(batches, 1):
            y = batch.column("y").flatten().to_numpy().reshape(-1, k)[: len(batch.column("keys").flatten())]
            held[:k] += y.T @ y
            held[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size)), pa.array(held.ravel())], names=["at", "s"])

    found = projected.select("keys", "y").mapInArrow(lean(run), "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    sums = found.toPandas().sort_values("at")["s"].to_numpy().reshape(k + 1, k) / n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> tuple[DataFrame, Fit | None]:
    """Rows (key, deviation, whitened: an array) and the fit. Vectors that are null, empty or
    hold a null or a number that isn't finite go, and so do those of another length than most
    have. A null key is a key; rows that repeat all count; other columns aren't read. There are
    no more components than dimensions, and none without variance: a single row, or equal
    rows, have none and give empty arrays. No rows, no rows and no fit."""
    small_batches(rows.sparkSession)
    found, dims = of_one_length(usable(rows, vector, key))
    if not dims:
        return found.select("x0", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions are more than {MOST_DIMS}")
    n, total = totals(found, dims)
    size = max(ROWS, -(-n // BLOCKS))
    table = blocks(found, dims, n, total, size)
    splits = max(1, -(-n * dims * 16 // HELD))
    fit = fitted(scatter(block_matrix(table, dims, size), splits), n, total, components)
    k, kind = len(fit.values), table.schema["keys"].dataType.elementType.simpleString()
    if not k:
        each = table.select(F.explode(F.arrays_zip("keys", "deviation")).alias("z"))
        return each.select(F.col("z.keys").alias("x0"), "z.deviation", F.array().cast("array<double>").alias("whitened")), fit
    both = table.select("i", "keys", "deviation").join(project(table, dims, size, fit), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys = batch.column("keys").flatten()
            y = batch.column("y").flatten().slice(0, len(keys) * k)
            ends = pa.array(np.arange(0, len(y) + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys, batch.column("deviation").flatten(), pa.ListArray.from_arrays(ends, y)], names=["x0", "deviation", "whitened"])

    both = materialise(both.select("keys", "deviation", "y"), "whitened")
    out = both.mapInArrow(lean(run), f"x0 {kind}, deviation long, whitened array<double>")
    return out.withColumn("identity_error", F.lit(identity_error(both, k, n))), fit


def op13_whitening(spark, sf_dir) -> DataFrame:
    rows, fit = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    values = fit.values.tolist() if fit else []
    n, trace = (fit.n, fit.trace) if fit else (0, 1.0)
    explained = F.array(*[F.lit(e / trace) for e in values]) if values else F.array().cast("array<double>")
    error = F.col("identity_error") if "identity_error" in rows.columns else F.lit(0.0)
    rows = rows.select(F.col("x0").alias("vec_id"), "deviation", error.alias("identity_error"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), "identity_error")
