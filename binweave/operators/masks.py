"""Bins without data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import KEY, axis, shape


def missing_bins(cells: DataFrame, percentile: float | None = None, occupancy: float | None = None, by_diagonal: bool = False) -> DataFrame:
    """bins (map, binsize, i, no_data). Empty rows have no data, and with ``by_diagonal``
    those without a cell on the diagonal. Then one rule at most: ``percentile`` (0 to 1)
    drops rows whose count of zeros, less the number of rows that count none, reaches the
    percentile of the counts above 0; ``occupancy`` drops rows of which a share of 1 -
    occupancy or more is zero."""
    if percentile is not None and occupancy is not None:
        raise ValueError("percentile and occupancy exclude each other")
    rows = cells.groupBy(*KEY, "i").agg(F.count("*").alias("held"), F.bool_or(F.col("i") == F.col("j")).alias("diagonal"))
    n = F.greatest("nx", "ny")
    found = axis(cells).join(rows, [*KEY, "i"], "left").join(shape(cells), list(KEY))
    empty = F.col("held").isNull() | (F.lit(by_diagonal) & ~F.col("diagonal"))
    found = found.select(*KEY, "i", empty.alias("empty"), F.when(empty, 0).otherwise(n - F.col("held")).alias("zeros"), n.alias("n"))
    if percentile is None and occupancy is None:
        return found.select(*KEY, "i", F.col("empty").alias("no_data"))
    if occupancy is not None:
        drop = F.col("zeros") / F.col("n") >= 1 - occupancy
        return found.select(*KEY, "i", (F.col("empty") | drop).alias("no_data"))
    cut = found.groupBy(*KEY).agg(F.percentile(F.when(F.col("zeros") != 0, F.col("zeros")), F.lit(percentile)).alias("cut"), F.count_if(F.col("zeros") == 0).alias("none"))
    drop = F.coalesce(F.col("zeros") - F.col("none") >= F.col("cut"), F.lit(False))
    return found.join(cut, list(KEY)).select(*KEY, "i", (F.col("empty") | drop).alias("no_data"))


def drop_missing(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """Cells whose two bins have data; bins keep their numbers."""
    kept = bins.where("NOT no_data").select(*KEY, "i")
    return cells.join(kept, [*KEY, "i"], "left_semi").join(kept.withColumnRenamed("i", "j"), [*KEY, "j"], "left_semi").select(*KEY, "i", "j", "v")
