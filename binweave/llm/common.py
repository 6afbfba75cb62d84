"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none one is made and set, but only for executors on the driver's
    machine; others would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"binweave-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows and bytes of texts that a Python worker gets at once, at most (a longer text is
#: a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold, by settings of the session; lower ones stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


@functools.lru_cache(1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's batches, that hands memory which allocators keep for later
    back to the system when the task ends: Spark keeps workers for the next stages."""

    @functools.wraps(run)
    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return lean_run


#: Paths written within each open scratch() of this context: threads and tasks have their own.
_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage so that a lost
    executor costs a reread, and lets several readers use rows that were computed once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/binweave-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for paths in _scratch.get()[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def last_table() -> str:
    """The path of the table that was written last within the innermost scratch()."""
    return _scratch.get()[-1][-1]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Tables written inside go at the end, but for the paths that are put into the set. What is
    returned must depend on those alone: all else has been read for the last time."""
    kept: set[str] = set()
    outer, own = _scratch.get(), []
    _scratch.set((*outer, own))
    try:
        yield kept
    finally:
        _scratch.set(outer)
        for path in own:
            if path in kept:
                for paths in outer[-1:]:
                    paths.append(path)
                continue
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def guarded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator, a function of a DataFrame and of names or expressions of its columns, whose
    internal columns begin with two underscores: columns of the caller's that do so have other
    names meanwhile, and theirs again in the result, unless the operator returns a column of
    that name itself."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own = [c for c in docs.columns if c.startswith("__")]
        if not own:
            return operator(docs, *args, **options)
        stem = "held"
        while any(c.lower().startswith(stem) for c in docs.columns):
            stem += "_"
        away = {c: f"{stem}{k}" for k, c in enumerate(own)}
        made: dict[str, Column] = {}

        def moved(x):
            if isinstance(x, Column):  # it may read such a column
                name = f"{stem}x{len(made)}"
                made[name] = x
                return F.col(name)
            return away.get(x, x) if isinstance(x, str) else x

        args, options = [moved(x) for x in args], {k: moved(x) for k, x in options.items()}
        out = operator(docs.withColumns(made).withColumnsRenamed(away), *args, **options).drop(*made)
        out = out.drop(*[a for c, a in away.items() if c in out.columns])
        return out.withColumnsRenamed({a: c for c, a in away.items() if a in out.columns})

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8_bytes(text: str) -> Column:
    """Bytes of a text column as UTF-8; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


@lean
def _pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    c = zstandard.ZstdCompressor(level=3)
    for texts in batches:
        yield pd.Series([c.compress((t or "").encode()) for t in texts], dtype=object)


def packed(text: Column) -> Column:
    """A text's UTF-8 bytes, compressed: whole texts shuffle at less than half their size."""
    return F.pandas_udf(_pack, "binary")(text)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
