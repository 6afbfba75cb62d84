"""What a container holds: names, resolutions, choice of a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resolution import natural_key, resolution_of


class MapNotFound(KeyError):
    """No such map."""


class ResolutionNotFound(KeyError):
    """The map is not stored at this resolution."""


def map_names(meta: DataFrame, by: str = "name") -> DataFrame:
    """Names with their largest side, in natural order or smallest map first: column rank."""
    sizes = meta.groupBy("map").agg(F.max(F.greatest("nx", "ny")).alias("side"))
    order = Window.orderBy(natural_key(F.col("map")) if by == "name" else F.col("side"), "map")
    return sizes.withColumn("rank", F.row_number().over(order))  # one row a map


def smallest_map(meta: DataFrame) -> DataFrame:
    return map_names(meta, "size").where("rank = 1").select("map", "side")


def finest(meta: DataFrame) -> DataFrame:
    return meta.groupBy("map").agg(F.min("binsize").alias("binsize"))


def neighbours(meta: DataFrame) -> DataFrame:
    """For each stored level the next finer and coarser one, null at the ends."""
    w = Window.partitionBy("map").orderBy("binsize")
    rows = meta.select("map", "binsize").distinct()
    return rows.select("map", "binsize", F.lag("binsize").over(w).alias("finer"), F.lead("binsize").over(w).alias("coarser"), resolution_of(F.col("binsize")).alias("resolution"))


def require(meta: DataFrame, name: str, binsize: int | None = None) -> None:
    """Raises unless the map, and the level if given, exist."""
    held = meta.where(F.col("map") == name)
    if held.isEmpty():
        raise MapNotFound(name)
    if binsize is not None and held.where(F.col("binsize") == binsize).isEmpty():
        raise ResolutionNotFound(f"{name}: {binsize}")


def common_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric maps that both containers hold, in natural order: column rank."""
    same = lambda m: m.where(F.coalesce(F.col("xlabel") == F.col("ylabel"), F.lit(True))) if "xlabel" in m.columns else m
    both = same(a).select("map").intersect(same(b).select("map"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(natural_key(F.col("map")))))


def common_values(rows: DataFrame, source: str, value: str) -> DataFrame:
    """Values, such as resolutions, that every source has."""
    n = rows.select(source).distinct().count()
    return rows.groupBy(value).agg(F.count_distinct(source).alias("n")).where(F.col("n") == n).select(value)


def level_for(meta: DataFrame, bins: int, current: int, coarser_above: int = 1001, finer_below: int = 500) -> DataFrame:
    """The bin size to draw ``bins`` bins at: the next coarser level if they are too many,
    the next finer one if they are too few, else the current."""
    step = F.when(F.lit(bins) > coarser_above, F.coalesce("coarser", "binsize")).when(F.lit(bins) < finer_below, F.coalesce("finer", "binsize")).otherwise(F.col("binsize"))
    return neighbours(meta).where(F.col("binsize") == current).select("map", step.alias("binsize"))


def map_label(xlabel: str, ylabel: str) -> str:
    return xlabel if xlabel == ylabel else f"{xlabel}-{ylabel}"
