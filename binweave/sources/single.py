"""Single-map files: a JSON description next to raw row-major numbers.

    spark.dataSource.register(SingleMapSource)
    spark.read.format("single_map").option("path", "x.json").load()

A task reads a stripe of rows; zeros are not returned. The paths must be readable on all
machines. Writing is for small maps; large ones belong into a container."""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.cells import meta

SCHEMA = "map string, binsize long, i long, j long, v double"


class Stripe(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class SingleMapReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.rows = int(options.get("rows_per_task", 1024))
        with open(self.path) as f:
            self.about = json.load(f)

    def partitions(self):
        n = self.about["shape"][0]
        return [Stripe(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        n = self.about["shape"][1]
        kind = np.dtype(self.about["dtype"])
        file = os.path.join(os.path.dirname(self.path), self.about["path2matrix"])
        with (gzip.open if file.endswith(".gz") else open)(file, "rb") as f:
            f.seek(partition.first * n * kind.itemsize)
            m = np.frombuffer(f.read((partition.last - partition.first) * n * kind.itemsize), dtype=kind).reshape(-1, n)
        i, j = np.nonzero(m)
        name = self.about["xlabel"] if self.about["xlabel"] == self.about["ylabel"] else f"{self.about['xlabel']}-{self.about['ylabel']}"
        k = len(i)
        yield pa.RecordBatch.from_pydict({"map": [name] * k, "binsize": pa.array([self.about["binsize"]] * k, pa.int64()), "i": i + partition.first, "j": j, "v": m[i, j].astype(float)})


class SingleMapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_map"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SingleMapReader:
        return SingleMapReader(self.options)


#: Bins per side of a single-map file, at most.
SIDE = 50_000


def read_single(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(SingleMapSource)
    return spark.read.format("single_map").options(path=path, **options).load()


def save_single(cells: DataFrame, path: str, compress: bool = False) -> None:
    """Write one map, with all its zeros, as one file on the driver's machine, which the format
    asks for; an existing file is kept as #name.1#, .2#, ... Cells come in order, a partition
    at a time, and the driver holds one row of the matrix; maps of over SIDE bins are refused."""
    m = meta(cells).first()
    n = max(m["nx"], m["ny"])
    if n > SIDE:
        raise ValueError(f"single-map files are for {SIDE} bins per side at most; use a container")
    data = f"{os.path.splitext(os.path.basename(path))[0]}.npbin{'.gz' if compress else ''}"
    folder = os.path.dirname(os.path.abspath(path))
    for name in (os.path.basename(path), data):
        if os.path.exists(os.path.join(folder, name)):
            k = next(k for k in range(1, 10**6) if not os.path.exists(os.path.join(folder, f"#{name}.{k}#")))
            os.rename(os.path.join(folder, name), os.path.join(folder, f"#{name}.{k}#"))
    row, at, bits = np.zeros(n, dtype=np.float32), 0, []
    with (gzip.open if compress else open)(os.path.join(folder, data), "wb") as f:

        def close() -> None:
            f.write(row.tobytes())
            bits.append("01"[not row.any()])
            row[:] = 0

        for r in cells.select("i", "j", "v").orderBy("i", "j").toLocalIterator():
            while at < r["i"]:
                close()
                at += 1
            row[r["j"]] = r["v"]
        for _ in range(at, n):
            close()
    about = {"path2matrix": data, "binsize": m["binsize"], "title": f"{m['map']}_vs_{m['map']}", "xlabel": m["map"], "ylabel": m["map"], "shape": [n, n], "minvalue": m["minvalue"], "maxvalue": m["maxvalue"], "bNoData": "".join(bits), "bLog": False, "dtype": "float32"}
    with open(path, "w") as f:
        json.dump(about, f, indent=1)


def as_cells(spark: SparkSession, source) -> DataFrame:
    """Cells of a DataFrame, a single-map file or a container."""
    if isinstance(source, DataFrame):
        return source
    if str(source).endswith((".json", ".ccmap")):
        return read_single(spark, str(source))
    from .container import read_cells

    return read_cells(spark, str(source)).select(*SCHEMA_COLUMNS)


SCHEMA_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
