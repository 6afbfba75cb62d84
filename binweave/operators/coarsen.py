"""Coarser maps and tracks: blocks, pyramids, choice of resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .cells import KEY, shape


def _block(c: str, level: int, zero_based: bool):
    return (F.floor(F.col(c) / level) if zero_based else F.ceil(F.col(c) / level)).cast("long")


def coarsen(cells: DataFrame, level: int, method: str = "sum", zero_based: bool = False, shapes: DataFrame | None = None) -> DataFrame:
    """level x level blocks into one cell: sum, mean or max. Bin 0 is a dummy: blocks start
    at bin 1 and output bin 0 stays empty; with ``zero_based`` they start at bin 0. The mean
    counts zeros: it divides by level times the rows that the block has."""
    rows = cells if zero_based else cells.where("i > 0 AND j > 0")
    keys = [*KEY, _block("i", level, zero_based).alias("i"), _block("j", level, zero_based).alias("j")]
    how = F.max("v") if method == "max" else F.sum("v")
    out = rows.groupBy(*keys).agg(how.alias("v"))
    if method == "mean":
        sizes = (shape(cells) if shapes is None else shapes).select(*KEY, "nx")
        first = F.col("i") * level if zero_based else (F.col("i") - 1) * level + 1
        held = F.least(F.lit(level), F.col("nx") - first)
        out = out.join(sizes, list(KEY)).select(*KEY, "i", "j", (F.col("v") / (held * level)).alias("v"))
    return out.where("v <> 0").withColumn("binsize", F.col("binsize") * level)


def coarsen_bins(bins: DataFrame, level: int, zero_based: bool = False) -> DataFrame:
    """A block has no data if one of its bins has none."""
    rows = bins if zero_based else bins.where("i > 0")
    return rows.groupBy(*KEY, _block("i", level, zero_based).alias("i")).agg(F.bool_or("no_data").alias("no_data")).withColumn("binsize", F.col("binsize") * level)


def coarse_bins(n: int, level: int) -> int:
    return -(-(n - 1) // level) + 1


def pyramid(cells: DataFrame, method: str = "sum", stop: int = 500, sides: dict[str, int] | None = None) -> DataFrame:
    """The map and ever coarser ones, each from the one before, until no side has more than
    ``stop`` bins. sides: bins per side of each map, else counted. Sums and maxima of blocks
    are associative, so a level is read from the level below, which has a quarter of the
    cells and is written once for this and for the result."""
    if sides is None:
        sides = {r["map"]: max(r["nx"], r["ny"]) for r in shape(cells).collect()}  # one row a map
    out, level = cells, cells
    while left := {m: n for m, n in sides.items() if n > stop}:
        level = written(coarsen(level.where(F.col("map").isin(list(left))), 2, method), "level")
        out = out.unionByName(level)
        sides = {m: coarse_bins(n, 2) for m, n in left.items()}
    return out


def base_resolution(meta: DataFrame, target: int) -> DataFrame:
    """For each map without the target bin size: the finest stored one that divides it."""
    return (
        meta.groupBy("map")
        .agg(F.min(F.when((F.lit(target) % F.col("binsize") == 0) & (F.col("binsize") < target), F.col("binsize"))).alias("base"), F.bool_or(F.col("binsize") == target).alias("there"))
        .where("base IS NOT NULL AND NOT there")
        .select("map", "base", F.lit(target).cast("long").alias("target"))
    )


def coarsen_track(track: DataFrame, level: int, method: str = "max", zero_based: bool = True) -> DataFrame:
    """A coarser track: max, sum or mean of non-zero values. Bins of tracks start at 0; with
    ``zero_based`` off bin 0 is a dummy, as in maps."""
    rows = track.where("v <> 0") if zero_based else track.where("v <> 0 AND bin > 0")
    how = {"max": F.max("v"), "sum": F.sum("v"), "mean": F.avg("v")}[method]
    return rows.groupBy("chrom", "binsize", "name", _block("bin", level, zero_based).alias("bin")).agg(how.alias("v")).withColumn("binsize", F.col("binsize") * level)
