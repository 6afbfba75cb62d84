"""Products of fixed cells with vectors that change, for the iterative operators.

Cells are packed once into blocks (``packed``), laid out by (map, bin size, block of columns),
and stay so in the executors' memory or on their disks. A vector has a row per bin; for each
product its blocks are shuffled to the cells', the cells' sums of each row are shuffled, and
the cells themselves never. Vectors are tables below the shared folder, a new one for each
sweep, which ends the lineage; what the driver gets of them are sums and limits, a row for
each map.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dropped, written
from .cells import KEY
from .packed import block, cells_in, stored

Scalars = dict[tuple, dict[str, float]]

#: Bins per side of a block of cells, and sums of row blocks that a task holds before it
#: passes them on.
SIDE, HELD = 1024, 2048


class Matrix:
    """A matrix (map, binsize, i, j, value) for many products; ``turned`` swaps i and j, for
    products from the left."""

    def __init__(self, cells: DataFrame, value: str = "v", turned: bool = False):
        self.spark = cells.sparkSession
        i, j = ("j", "i") if turned else ("i", "j")
        self.stored = stored(cells.select(*KEY, F.col(i).alias("i"), F.col(j).alias("j"), F.col(value).alias("v")), SIDE, SIDE)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.cells = self.stored.repartition(n, *KEY, "bj").sortWithinPartitions(*KEY, "bj")
        # a cached plan that is adaptive doesn't tell joins how it is laid out
        name = "spark.sql.adaptive.enabled"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "false")
        try:
            self.cells = self.cells.persist()
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def bins(self) -> DataFrame:
        """Bins that have cells: (map, binsize, i)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, size, bi, n, data in zip(*(batch.column(c) for c in (*KEY, "bi", "n", "data"))):
                    i = np.unique(cells_in(n.as_py(), data)[0]).astype(np.int64) + bi.as_py() * SIDE
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(i)), pa.repeat(size, len(i)), pa.array(i)], names=[*KEY, "i"])

        return self.stored.select(*KEY, "bi", "n", "data").mapInArrow(run, "map string, binsize long, i long").distinct()

    def times(self, vector: DataFrame, x: Column) -> DataFrame:
        """Rows (map, binsize, i, s): the product with the vector (map, binsize, i, ...) of which
        x is the value. Rows of the matrix that meet no bin of the vector are absent."""
        return self.products(vector, s=x)

    def products(self, vector: DataFrame, **x: Column) -> DataFrame:
        """Products with several vectors of one table, as columns of the names given."""
        names = list(x)
        held = F.struct((F.col("i") % SIDE).alias("k"), *[c.cast("double").alias(n) for n, c in x.items()])
        of = vector.groupBy(*KEY, block("i", SIDE).alias("bj")).agg(F.collect_list(held).alias("x"))

        def rows(place: tuple, sums: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(met)
            keys = [pa.repeat(pa.scalar(place[0], pa.string()), len(at)), pa.repeat(pa.scalar(place[1], pa.int64()), len(at)), pa.array(at + place[2] * SIDE)]
            return pa.RecordBatch.from_arrays([*keys, *[pa.array(s[at]) for s in sums]], names=[*KEY, "i", *names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, last, known, values = {}, None, None, None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in (*KEY, "bi", "bj", "n")]
                for name, size, bi, bj, n, data, some in zip(*columns, batch.column("data"), batch.column("x")):
                    if (name, size, bj) != last:
                        last, known, values = (name, size, bj), np.zeros(SIDE, dtype=bool), np.zeros((len(names), SIDE))
                        at = some.values.field("k").to_numpy()
                        known[at] = True
                        for row, c in zip(values, names):
                            row[at] = some.values.field(c).fill_null(0.0).to_numpy()
                    if (name, size, bi) not in total:
                        if len(total) >= HELD:
                            for place, of_rows in total.items():
                                yield rows(place, *of_rows)
                            total = {}
                        total[name, size, bi] = np.zeros((len(names), SIDE)), np.zeros(SIDE, dtype=bool)
                    sums, met = total[name, size, bi]
                    i, j, v = cells_in(n, data)
                    met[i[known[j]]] = True
                    for row, value in zip(sums, values):
                        row += np.bincount(i, v * value[j], SIDE)
            for place, of_rows in total.items():
                yield rows(place, *of_rows)

        found = self.cells.join(of, [*KEY, "bj"]).mapInArrow(run, ", ".join(["map string, binsize long, i long", *[f"{n} double" for n in names]]))
        return found.groupBy(*KEY, "i").agg(*[F.sum(n).alias(n) for n in names])

    def close(self) -> None:
        self.cells.unpersist()
        dropped(self.stored)


class State:
    """Vectors of one round, a table (map, binsize, i, ...), renewed by ``write``: the new table
    may be made of the old one, which then goes."""

    def __init__(self, rows: DataFrame):
        self.rows = written(rows, "state")

    def write(self, rows: DataFrame) -> DataFrame:
        old, self.rows = self.rows, written(rows, "state")
        dropped(old)
        return self.rows

    def scalars(self, rows: DataFrame | None = None, **sums: Column) -> Scalars:
        """Aggregates of each map: all that the driver gets."""
        found = (self.rows if rows is None else rows).groupBy(*KEY).agg(*[c.alias(n) for n, c in sums.items()])
        return {tuple(r[k] for k in KEY): {n: r[n] for n in sums} for r in found.collect()}  # a row for each map

    def given(self, numbers: Scalars, rows: DataFrame | None = None) -> DataFrame:
        """The rows with each map's numbers as columns."""
        rows = self.rows if rows is None else rows
        names = sorted({n for of in numbers.values() for n in of})
        kinds = dict(rows.dtypes)
        schema = ", ".join([*[f"{k} {kinds[k]}" for k in KEY], *[f"{n} double" for n in names]])
        table = rows.sparkSession.createDataFrame([(*k, *[float(of[n]) for n in names]) for k, of in numbers.items()], schema)
        return rows.join(F.broadcast(table), list(KEY))  # a row for each map


def merged(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with column s of the product, 0 where it has none."""
    return rows.join(sums, [*KEY, "i"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def picked(rows: DataFrame, maps: Iterable[tuple], inside: bool = True) -> DataFrame:
    """Rows of these maps, or of the others."""
    is_one = F.lit(False)
    for k in maps:
        here = F.lit(True)
        for name, x in zip(KEY, k):
            here = here & F.col(name).eqNullSafe(F.lit(x))
        is_one = is_one | here
    return rows.where(is_one if inside else ~is_one)
