"""bigWig files as a data source, without external programs.

    spark.dataSource.register(BigWigSource)
    spark.read.format("bigwig").option("path", p).option("chrom", "chr1").load()

The driver reads the header, the tree of chromosomes and the index of data blocks (of one
chromosome if asked for); tasks seek and inflate their own blocks. The path must be
readable on all machines. Rows are intervals (chrom, start, end, value, seq), 0-based and
open at the end; seq is the place in the file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "chrom string, start long, end long, value double, seq long"
#: Numbers that mark the parts of a file: fixed values of the format.
MAGIC, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


@dataclass
class About:
    order: str
    compressed: bool
    tree: int
    index: int


def about(f) -> About:
    head = f.read(64)
    for order in "<>":
        if struct.unpack_from(order + "I", head)[0] == MAGIC:
            _, _, _, tree, _, index, _, _, _, _, buffer, _ = struct.unpack(order + "IHHQQQHHQQIQ", head)
            return About(order, buffer > 0, tree, index)
    raise ValueError("not a bigWig file")


def chromosomes(f, a: About) -> dict[int, tuple[str, int]]:
    """id -> (name, size)."""
    f.seek(a.tree)
    magic, _, width = struct.unpack(a.order + "III", f.read(12))
    if magic != TREE:
        raise ValueError("no tree of chromosomes")
    found, todo = {}, [a.tree + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(a.order + "BBH", f.read(4))
        for _ in range(n):
            name = f.read(width).rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack(a.order + "II", f.read(8))
                found[number] = (name, size)
            else:
                todo.append(struct.unpack(a.order + "Q", f.read(8))[0])
    return found


def blocks(f, a: About, number: int | None) -> list[tuple[int, int]]:
    """(offset, size) of data blocks, of one chromosome or all, in file order."""
    f.seek(a.index)
    if struct.unpack(a.order + "I", f.read(4))[0] != INDEX:
        raise ValueError("no index of blocks")
    found, todo = [], [a.index + 48]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(a.order + "BBH", f.read(4))
        for _ in range(n):
            first, _, last, _, offset = struct.unpack(a.order + "IIIIQ", f.read(24))
            size = struct.unpack(a.order + "Q", f.read(8))[0] if leaf else 0
            if number is None or first <= number <= last:
                (found.append((offset, size)) if leaf else todo.append(offset))
    return sorted(found)


def decode(data: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(chromosome id, starts, ends, values) of an inflated block."""
    number, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", data)
    u, f = order + "u4", order + "f4"
    form = {1: [("s", u), ("e", u), ("v", f)], 2: [("s", u), ("v", f)], 3: [("v", f)]}[kind]
    t = np.frombuffer(data, dtype=form, count=n, offset=24)
    s = t["s"].astype(np.int64) if kind < 3 else start + step * np.arange(n, dtype=np.int64)
    return number, s, t["e"].astype(np.int64) if kind == 1 else s + span, t["v"].astype(float)


class Blocks(InputPartition):
    def __init__(self, at: list[tuple[int, int]], a: About, names: dict[int, tuple[str, int]]):
        super().__init__(0)
        self.at, self.about, self.names = at, a, names


class BigWigReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.chrom, self.per_task = options.get("chrom"), int(options.get("blocks_per_task", 256))

    def partitions(self):
        with open(self.path, "rb") as f:
            a = about(f)
            names = chromosomes(f, a)
            number = None
            if self.chrom is not None:
                number = next((k for k, (n, _) in names.items() if n == self.chrom), None)
                if number is None:
                    raise LookupError(f"no chromosome {self.chrom}")
            at = blocks(f, a, number)
        return [Blocks(at[i : i + self.per_task], a, names) for i in range(0, len(at), self.per_task)] or [Blocks([], a, names)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            for at, size in partition.at:
                f.seek(at)
                data = f.read(size)
                number, s, e, v = decode(zlib.decompress(data) if partition.about.compressed else data, partition.about.order)
                name = partition.names[number][0]
                if self.chrom in (None, name):
                    yield pa.RecordBatch.from_pydict({"chrom": [name] * len(s), "start": s, "end": e, "value": v, "seq": at + np.arange(len(s))})


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options)


def bigwig(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    spark.dataSource.register(BigWigSource)
    rows = spark.read.format("bigwig").option("path", path)
    return (rows if chrom is None else rows.option("chrom", chrom)).load()


def chromosome_sizes(path: str) -> dict[str, int]:
    with open(path, "rb") as f:
        return dict(chromosomes(f, about(f)).values())
