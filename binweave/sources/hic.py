"""The block-compressed binary contact format (.hic, versions 6 to 8) as a data source.

    spark.dataSource.register(HicSource)
    spark.read.format("hic").option("path", p).option("chr1", "1").option("chr2", "1")
         .option("binsize", 100000).load()

The driver reads header, footer and block index of the one matrix asked for; every task
then seeks and inflates its own blocks. The path must be readable on all machines.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "chr1 string, chr2 string, binsize long, bin_x long, bin_y long, count double"


class Cursor:
    def __init__(self, file):
        self.file = file

    def take(self, form: str):
        form = "<" + form
        got = struct.unpack(form, self.file.read(struct.calcsize(form)))
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        out = bytearray()
        while (c := self.file.read(1)) not in (b"\0", b""):
            out += c
        return out.decode()

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), dtype=kind)


@dataclass
class Header:
    version: int
    genome: str
    attributes: dict[str, str]
    chromosomes: list[tuple[str, int]]
    resolutions: dict[str, list[int]]
    matrices: dict[str, int]
    norms: dict[tuple[str, int, str, int], int]
    expected: dict[tuple[str, int], tuple[list[float], dict[int, float]]]
    normed: dict[tuple[str, str, int], tuple[list[float], dict[int, float]]]

    def number(self, name: str) -> int:
        """A chromosome's index, with or without the prefix chr."""
        strip = lambda s: s.lower().removeprefix("chr")
        for k, (n, _) in enumerate(self.chromosomes):
            if strip(n) == strip(name):
                return k
        raise LookupError(f"no chromosome {name}")


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        c = Cursor(f)
        if c.text() != "HIC":
            raise ValueError("not a .hic file")
        version, footer = c.take("iq")
        if not 6 <= version <= 8:
            raise ValueError(f"version {version} is not supported")
        genome = c.text()
        attributes = {c.text(): c.text() for _ in range(c.take("i"))}
        chromosomes = [(c.text(), c.take("i")) for _ in range(c.take("i"))]
        resolutions = {unit: [c.take("i") for _ in range(c.take("i"))] for unit in ("BP", "FRAG")}
        f.seek(footer)
        c.take("i")
        matrices = {}
        for _ in range(c.take("i")):
            key, at, _ = c.text(), *c.take("qi")
            matrices[key] = at

        def vectors(normed: bool):
            out = {}
            for _ in range(c.take("i")):
                kind = (c.text(),) if normed else ()
                unit, size = c.text(), c.take("i")
                values = c.array("<f8", c.take("i")).tolist()
                out[(*kind, unit, size)] = (values, dict(c.take("id") for _ in range(c.take("i"))))
            return out

        expected, normed, norms = vectors(False), {}, {}
        try:
            normed = vectors(True)
            for _ in range(c.take("i")):
                kind, chrom, unit, size, at, _ = c.text(), c.take("i"), c.text(), *c.take("iqi")
                norms[kind, chrom, unit, size] = at
        except struct.error:  # files without normalisation end here
            pass
        return Header(version, genome, attributes, chromosomes, resolutions, matrices, norms, expected, normed)


def block_index(path: str, header: Header, chr1: str, chr2: str, binsize: int, unit: str = "BP") -> list[tuple[int, int]]:
    """(offset, size) of the blocks of one matrix at one bin size."""
    a, b = sorted((header.number(chr1), header.number(chr2)))
    if (at := header.matrices.get(f"{a}_{b}")) is None:
        raise LookupError(f"no matrix of {chr1} and {chr2}")
    with open(path, "rb") as f:
        f.seek(at)
        c = Cursor(f)
        c.take("ii")
        for _ in range(c.take("i")):
            found = c.text()
            _, *_, size, _, _ = c.take("iffffiii")
            blocks = [c.take("iqi")[1:] for _ in range(c.take("i"))]
            if found == unit and size == binsize:
                return blocks
    raise LookupError(f"no bin size {binsize}")


def norm_vector(path: str, header: Header, kind: str, chrom: str, binsize: int, unit: str = "BP") -> np.ndarray:
    at = header.norms.get((kind, header.number(chrom), unit, binsize))
    if at is None:
        raise LookupError(f"no {kind} vector of {chrom} at {binsize}")
    with open(path, "rb") as f:
        f.seek(at)
        c = Cursor(f)
        return c.array("<f8", c.take("i")).copy()


def decode_block(data: bytes, version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, count) of an inflated block. Dense blocks mark what is absent by the least
    16-bit number, or by NaN."""
    n = struct.unpack_from("<i", data)[0]
    if version < 7:
        t = np.frombuffer(data, dtype=[("x", "<i4"), ("y", "<i4"), ("c", "<f4")], count=n, offset=4)
        return t["x"].astype(np.int64), t["y"].astype(np.int64), t["c"].astype(float)
    x0, y0, as_float, kind = struct.unpack_from("<iibb", data, 4)
    at, value = 14, "<f4" if as_float else "<i2"
    if kind == 1:
        pair = np.dtype([("x", "<i2"), ("c", value)])
        xs, ys, cs = [], [], []
        rows = struct.unpack_from("<h", data, at)[0]
        at += 2
        for _ in range(rows):
            y, m = struct.unpack_from("<hh", data, at)
            t = np.frombuffer(data, dtype=pair, count=m, offset=at + 4)
            at += 4 + m * pair.itemsize
            xs.append(t["x"].astype(np.int64) + x0)
            ys.append(np.full(m, y + y0, dtype=np.int64))
            cs.append(t["c"].astype(float))
        empty = np.zeros(0)
        return (np.concatenate(xs), np.concatenate(ys), np.concatenate(cs)) if xs else (empty.astype(np.int64), empty.astype(np.int64), empty)
    if kind == 2:
        m, width = struct.unpack_from("<ih", data, at)
        c = np.frombuffer(data, dtype=value, count=m, offset=at + 6)
        held = ~np.isnan(c) if as_float else c != -32768
        k = np.flatnonzero(held)
        return x0 + k % width, y0 + k // width, c[k].astype(float)
    raise ValueError(f"unknown kind of block {kind}")


class Blocks(InputPartition):
    def __init__(self, blocks: list[tuple[int, int]], version: int, swap: bool):
        super().__init__(0)
        self.blocks, self.version, self.swap = blocks, version, swap


class HicReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.chr1, self.chr2 = options["chr1"], options.get("chr2", options["chr1"])
        self.binsize, self.unit = int(options["binsize"]), options.get("unit", "BP")
        self.per_task = int(options.get("blocks_per_task", 64))

    def partitions(self):
        header = read_header(self.path)
        blocks = block_index(self.path, header, self.chr1, self.chr2, self.binsize, self.unit)
        # matrices are stored by index; bins come in the order asked for
        swap = header.number(self.chr1) > header.number(self.chr2)
        return [Blocks(blocks[i : i + self.per_task], header.version, swap) for i in range(0, len(blocks), self.per_task)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            for at, size in partition.blocks:
                f.seek(at)
                x, y, c = decode_block(zlib.decompress(f.read(size)), partition.version)
                if partition.swap:
                    x, y = y, x
                n = len(x)
                yield pa.RecordBatch.from_pydict({"chr1": [self.chr1] * n, "chr2": [self.chr2] * n, "binsize": pa.array([self.binsize] * n, pa.int64()), "bin_x": x, "bin_y": y, "count": c})


class HicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HicReader:
        return HicReader(self.options)


def hic_map(spark: SparkSession, path: str, chr1: str, chr2: str | None = None, binsize: int | None = None, norm: str | None = None) -> DataFrame:
    """Cells of one pair of chromosomes; without a bin size at the finest. norm (VC, VC_SQRT,
    KR): counts over the product of both bins' norms, infinite where one is 0."""
    chr2 = chr2 or chr1
    header = read_header(path)
    binsize = binsize or min(header.resolutions["BP"])
    spark.dataSource.register(HicSource)
    rows = spark.read.format("hic").options(path=path, chr1=chr1, chr2=chr2, binsize=binsize).load()
    label = chr1 if chr1 == chr2 else f"{chr1}-{chr2}"
    v = F.col("count")
    if norm not in (None, "none"):
        for chrom, axis in ((chr1, "bin_x"), (chr2, "bin_y")):
            n = norm_vector(path, header, norm, chrom, binsize)
            # one number per bin of a chromosome
            side = spark.createDataFrame(pa.table({axis: pa.array(range(len(n)), pa.int64()), f"norm_{axis}": n}).to_pandas())
            rows = rows.join(side, axis)
            v = F.when(F.col(f"norm_{axis}") == 0, F.lit(float("inf"))).otherwise(F.try_divide(v, F.col(f"norm_{axis}")))
    cells = rows.select(F.lit(label).alias("map"), "binsize", F.col("bin_x").alias("i"), F.col("bin_y").alias("j"), v.alias("v")).where("v <> 0 AND NOT isnan(v)")
    if chr1 != chr2:
        return cells
    from ..operators.cells import mirror

    return mirror(cells.select("map", "binsize", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v"))


def hic_container(spark: SparkSession, path: str, binsize: int | None = None, norm: str | None = None) -> DataFrame:
    """Cells of all pairs of chromosomes that the file holds, but for those named All."""
    header = read_header(path)
    out = None
    for key in header.matrices:
        a, b = (header.chromosomes[int(k)][0] for k in key.split("_"))
        if "all" in (a.lower(), b.lower()):
            continue
        one = hic_map(spark, path, a, b, binsize, norm)
        out = one if out is None else out.unionByName(one)
    return out
