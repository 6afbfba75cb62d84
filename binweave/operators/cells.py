"""Building contact maps and looking at them: binning, symmetry, thresholds, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import before_range, in_ranges, null_safe

KEY = ("map", "binsize")
CELL = ("map", "binsize", "i", "j", "v")


def infer_binsize(rows: DataFrame, position: str, order: str, by: str = "map") -> DataFrame:
    """Rows (by, binsize): the least positive step between neighbours in input order. Lines
    are ordered in ranges; a range's first line meets the last of the ranges before it."""
    rows = in_ranges(rows.select(by, F.col(position).alias("__at"), F.col(order).alias("__order")), [by], ["__order"])
    last = F.max_by(F.struct("__order", "__at"), "__order")
    rows = null_safe(rows, before_range(rows, [by], last, F.max), [by, "__range"])
    previous = F.coalesce(F.lag("__at").over(Window.partitionBy("__range", by).orderBy("__order")), F.col("before.__at"))
    step = F.abs(F.col("__at") - previous)
    return rows.select(by, step.alias("step")).groupBy(by).agg(F.min(F.when(F.col("step") > 0, F.col("step"))).alias("binsize"))


#: Values of one place that a running mean takes, the last ones: one before them would count
#: 2 to the -900th.
FOLDED = 900


def last_of(rows: DataFrame, keys: list[str], order: str, unless: Column | None = None) -> DataFrame:
    """The last FOLDED rows of each place in input order. Each task keeps no more of a place
    before rows are shuffled, so a place that many rows hit is never gathered whole."""
    rows = rows if unless is None else rows.where(~unless)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("__k", number).where(F.col("__k") <= FOLDED).drop("__k")


def running_mean(value: str = "v", order: str = "seq") -> Column:
    """Aggregate: duplicates combined as (old + new) / 2 in input order; a stored zero is
    overwritten."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    return F.aggregate(held, F.lit(None).cast("double"), lambda a, y: F.when(a.isNull() | (a == 0), y["x"]).otherwise((a + y["x"]) / 2))


def bin_contacts(contacts: DataFrame, binsize: int, combine: str = "fold", symmetric: bool = True) -> DataFrame:
    """Cells from rows (map, pos_i, pos_j, value, seq). ``combine`` of duplicates: fold (the
    running mean in input order), sum, avg, max. In a symmetric map (i, j) and (j, i) are
    duplicates and both are returned."""
    b = lambda c: F.floor(F.col(c) / F.lit(binsize)).cast("long")
    rows = contacts.select("map", b("pos_i").alias("a"), b("pos_j").alias("b"), F.col("value").cast("double").alias("v"), *(["seq"] if combine == "fold" else []))
    i, j = (F.least("a", "b"), F.greatest("a", "b")) if symmetric else (F.col("a"), F.col("b"))
    how = {"fold": running_mean, "sum": lambda: F.sum("v"), "avg": lambda: F.avg("v"), "max": lambda: F.max("v")}[combine]()
    rows = rows.select("*", i.alias("i"), j.alias("j"))
    if combine == "fold":
        rows = last_of(rows, ["map", "i", "j"], "seq")
    rows = rows.groupBy("map", "i", "j").agg(how.alias("v")).where("v <> 0")
    rows = rows.select("map", F.lit(binsize).cast("long").alias("binsize"), "i", "j", "v")
    return mirror(rows) if symmetric else rows


def mirror(upper: DataFrame) -> DataFrame:
    """Both triangles of rows with i <= j: one pass, no second scan."""
    pair = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return upper.select("map", "binsize", F.explode(pair).alias("p"), "v").select("map", "binsize", "p.i", "p.j", "v")


def upper(cells: DataFrame, offset: int | None = None) -> DataFrame:
    """The upper triangle; with an offset, what lies more than so many places above it."""
    return cells.where(F.col("j") >= F.col("i") if offset is None else F.col("j") - F.col("i") > offset)


def diagonal(cells: DataFrame, k: int) -> DataFrame:
    """The k-th diagonal: j - i = k."""
    return cells.where(F.col("j") - F.col("i") == k)


def threshold(cells: DataFrame, vmin: float | None = None, vmax: float | None = None) -> DataFrame:
    """Cells strictly between the limits; the others become zero, that is, absent."""
    if vmin is not None:
        cells = cells.where(F.col("v") > vmin)
    return cells if vmax is None else cells.where(F.col("v") < vmax)


def shape(cells: DataFrame) -> DataFrame:
    """Bins per side; symmetric maps are square."""
    return cells.groupBy(*KEY).agg((F.max("i") + 1).alias("nx"), (F.max("j") + 1).alias("ny"))


def meta(cells: DataFrame) -> DataFrame:
    """Shape, least non-zero and largest value of each map."""
    found = F.when(F.col("v") != 0, F.col("v"))
    return cells.groupBy(*KEY).agg((F.max("i") + 1).alias("nx"), (F.max("j") + 1).alias("ny"), F.min(found).alias("minvalue"), F.max("v").alias("maxvalue"))


def axis(cells: DataFrame) -> DataFrame:
    """Every bin of each map: (map, binsize, i), 0 to the last that has a cell."""
    ends = cells.groupBy(*KEY).agg(F.greatest(F.max("i"), F.max("j")).alias("last"))
    return ends.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("i"))


def ticks(cells: DataFrame) -> DataFrame:
    """Start coordinate of every bin."""
    return axis(cells).withColumn("tick", F.col("i") * F.col("binsize"))


def viewport(cells: DataFrame, name: str, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """matrix[y0:y1, x0:x1] of one map: filters that reach the scan."""
    return cells.where((F.col("map") == name) & F.col("i").between(y[0], y[1] - 1) & F.col("j").between(x[0], x[1] - 1))


def point(cells: DataFrame, name: str, i: int, j: int) -> DataFrame:
    return cells.where((F.col("map") == name) & (F.col("i") == i) & (F.col("j") == j))


def window_of(lo: int, hi: int, binsize: int, n: int) -> tuple[int, int]:
    """Bins of a coordinate range, clamped to a map of n bins."""
    a, b = sorted((lo // binsize, hi // binsize))
    return max(0, min(a, n - 1)), max(0, min(b, n - 1)) + 1


def square_window(a: int, b: int, n: int) -> tuple[int, int]:
    """A window of b - a bins moved inside a map of n bins, or the whole map."""
    size = min(b - a, n)
    a = max(0, min(a, n - size))
    return a, a + size


def scale_up(cells: DataFrame) -> DataFrame:
    """Values times 10^(d+1), d being the zeros between the point and the first digit of
    the map's least non-zero value."""
    low = cells.groupBy(*KEY).agg(F.min(F.when(F.col("v") != 0, F.abs("v"))).alias("low"))
    d = F.greatest(F.lit(0), -F.floor(F.log10("low")) - 1)
    return cells.join(low.select(*KEY, F.pow(F.lit(10.0), d + 1).alias("f")), list(KEY)).select(*KEY, "i", "j", (F.col("v") * F.col("f")).alias("v"))


def log10_map(cells: DataFrame) -> DataFrame:
    """log10 of positive cells. Empty bins are drawn with ``fill``, one hundredth of the
    range below the least; it is a column, so that nothing is made dense."""
    logs = cells.where("v > 0").withColumn("v", F.log10("v"))
    fill = logs.groupBy(*KEY).agg((F.min("v") - (F.max("v") - F.min("v")) / 99).alias("fill"))
    return logs.join(fill, list(KEY)).select(*CELL, "fill")


def log2_map(cells: DataFrame, fill: float = 0.0) -> DataFrame:
    return cells.withColumn("v", F.when(F.col("v") > 0, F.log2("v")).otherwise(F.lit(fill)))


def rescale(cells: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Non-zero values of each map stretched to lo..hi; a constant map becomes lo."""
    ends = cells.where("v <> 0").groupBy(*KEY).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    span = F.col("b") - F.col("a")
    v = F.when(span > 0, (F.col("v") - F.col("a")) / span * (hi - lo) + lo).otherwise(F.lit(lo))
    return cells.where("v <> 0").join(ends, list(KEY)).select(*KEY, "i", "j", v.alias("v"))


def colour_steps(meta: DataFrame, steps: int = 10, scale: str = "linear") -> DataFrame:
    """Limits of colours from least to largest value: linear, or even in log2."""
    s = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    rows = meta.select(*KEY, "minvalue", "maxvalue", s)
    part = F.col("step") / (steps - 1)
    if scale == "linear":
        v = F.col("minvalue") + (F.col("maxvalue") - F.col("minvalue")) * part
    else:
        v = F.pow(F.lit(2.0), F.log2("minvalue") + (F.log2("maxvalue") - F.log2("minvalue")) * part)
    return rows.select(*KEY, "step", v.alias("v"))


def from_matrix(spark, matrix, name: str, binsize: int) -> DataFrame:
    """Cells of a numpy matrix."""
    import numpy as np
    import pandas as pd

    i, j = np.nonzero(matrix)
    pdf = pd.DataFrame({"map": name, "binsize": binsize, "i": i, "j": j, "v": matrix[i, j].astype(float)})
    return spark.createDataFrame(pdf, "map string, binsize long, i long, j long, v double")
