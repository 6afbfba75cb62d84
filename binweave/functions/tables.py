"""Tables written below the folder that driver and executors share, and ordered ranges."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where the session names none (tests) one is set,
    but only for executors on the driver's machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), f"binweave-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/binweave-{name}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> int:
    """Removes the tables that runs have left below spark.checkpoint.dir; returns how many. Not
    for use while a run is on."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        return 0
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/binweave-*")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.globStatus(at) or ()]
    for path in found:
        files.delete(path, True)
    return len(found)


#: Options of ``written`` for rows of up to some MB: readers hold a row group at once, so these
#: are small.
BIG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written and read again: lineage ends here, and readers share one computation."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that a Python worker gets at once, at most.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what Python workers get at once, by settings of the session; lower ones stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def dropped(table: DataFrame) -> None:
    """Removes the files of a table that ``written`` made and nothing will read again."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows in ranges of (keys, order), a written table with the range's number in __range:
    ranges are even in rows, so windows within one are bounded, whatever the keys hold."""
    spread = rows.repartitionByRange(*keys, *order) if keys or order else rows
    return written(spread.withColumn("__range", F.spark_partition_id()), "ranges")


def before_range(ranged: DataFrame, keys: list[str], total: Column, combine) -> DataFrame:
    """Rows (keys, __range, before): ``combine`` (F.sum, F.max) of the totals of the same
    keys' earlier ranges. There are no more rows for a key than ranges."""
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.groupBy(*keys, "__range").agg(total.alias("__total")).select(*keys, "__range", combine("__total").over(earlier).alias("before"))


def null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df joined with other, to which every row of df belongs, on keys that may be null."""
    renamed = other.select(*[F.col(k).alias(f"__o_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    return df.join(renamed, cond, "left").drop(*[f"__o_{k}" for k in keys])
