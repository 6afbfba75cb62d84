"""Correlations of maps, correlation matrices, outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import correlation_p
from ..functions.quantiles import quantile
from ..functions.tables import before_range, in_ranges, null_safe, written
from .cells import KEY
from .packed import block, cells_in, runs, stored


def drop_outliers(rows: DataFrame, keys: list[str], limit: float = 3.5, value: str = "v") -> DataFrame:
    """Rows whose robust z-score 0.6745 |x - median| / MAD within their group is at most
    the limit; a MAD of 0 leaves the group as it is."""
    centre = quantile(rows, keys, F.col(value), 0.5, "__m")
    near = rows.join(centre, keys)
    spread = quantile(near, keys, F.abs(F.col(value) - F.col("__m")), 0.5, "__mad")
    z = F.when(F.col("__mad") > 0, 0.6745 * F.abs(F.col(value) - F.col("__m")) / F.col("__mad")).otherwise(0.0)
    return near.join(spread, keys).where(z <= limit).select(*rows.columns)


def paired(a: DataFrame, b: DataFrame, offset: int | None = 1, cutoff: float | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Cells of two maps side by side, cropped to the smaller: (i, j, a, b). Cells that one
    map lacks are 0; those that both lack, or that lie below the least non-zero value in
    both, are left out. With ``offset``, only cells more than so many places above the
    diagonal. With ``cutoff`` (percent), cells above the map's percentile in either and
    non-zero in both. on: columns that name the pair of maps."""
    keep = [*on, "i", "j"]
    size = lambda m: m.groupBy(*on).agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("n"))
    both = a.select(*keep, F.col("v").alias("a")).join(b.select(*keep, F.col("v").alias("b")), keep, "full")
    both = both.select(*keep, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    if offset is not None:
        both = both.where(F.col("j") - F.col("i") > offset)

    def with_limits(m: DataFrame, name: str) -> DataFrame:
        found = F.when(F.col("v") != 0, F.col("v"))
        ends = m.groupBy(*on).agg(F.min(found).alias(f"l_{name}"), (F.greatest(F.max("i"), F.max("j")) + 1).alias(f"n_{name}"))
        if cutoff is None:
            return ends
        limit, ends = quantile(m, list(on), found, cutoff / 100, f"l_{name}"), ends.drop(f"l_{name}")
        return ends.join(limit, list(on)) if on else ends.crossJoin(F.broadcast(limit))  # one row each

    la, lb = with_limits(a, "a"), with_limits(b, "b")
    # one row for each pair of maps
    both = both.join(la, list(on)).join(lb, list(on)) if on else both.crossJoin(F.broadcast(la)).crossJoin(F.broadcast(lb))
    both = both.where((F.col("i") < F.least("n_a", "n_b")) & (F.col("j") < F.least("n_a", "n_b")))
    if cutoff is None:
        both = both.where((F.col("a") >= F.col("l_a")) | (F.col("b") >= F.col("l_b")))
    else:
        both = both.where(((F.col("a") > F.col("l_a")) | (F.col("b") > F.col("l_b"))) & (F.col("a") != 0) & (F.col("b") != 0))
    return both.select(*keep, "a", "b")


def mean_ranks(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Values replaced by their ranks within the keys, ties by the mean rank. Ranks of the
    distinct values come from running sums of their counts: within ranges of values, and over
    the ranges' sums, so no task orders all values."""
    for c in names:
        counts = in_ranges(rows.groupBy(*keys, c).count(), keys, [c])
        before = before_range(counts, keys, F.sum("count"), F.sum)
        order = Window.partitionBy("__range", *keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        counts = null_safe(counts, before, [*keys, "__range"])
        below = F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("count").over(order), F.lit(0))
        ranks = counts.select(*keys, F.col(c), (below + (F.col("count") + 1) / 2).alias("__rank"))
        rows = rows.join(ranks, [*keys, c]).drop(c).withColumnRenamed("__rank", c)
    return rows


def correlate(a: DataFrame, b: DataFrame, kind: str = "pearson", offset: int | None = 1, cutoff: float | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """(corr, n) of two maps, for each pair of maps named by ``on``; 0 unless over ten cells
    are compared. See correlation_p for its p-value."""
    rows = paired(a, b, offset, cutoff, on)
    if kind == "spearman":
        rows = mean_ranks(rows, list(on), ["a", "b"])
    r = F.when(F.count("*") > 10, F.corr("a", "b")).otherwise(0.0)
    return rows.groupBy(*on).agg(r.alias("corr"), F.count("*").alias("n"))


def with_p(correlations: DataFrame) -> DataFrame:
    """Adds the two-sided p-value: one row for each pair of maps."""
    p = F.pandas_udf(lambda r, n: pd.Series([correlation_p(x, int(k)) for x, k in zip(r, n)]), "double")
    return correlations.withColumn("p", p("corr", "n"))


def correlate_blocks(a: DataFrame, b: DataFrame, size: int, step: int = 1, kind: str = "pearson", offset: int | None = 1, binsize: int = 1, on: tuple[str, ...] = ()) -> DataFrame:
    """Correlation within squares of ``size`` bins that slide along the diagonal by ``step``:
    (start, centre, corr). Blocks end before the map does. Each cell counts in the blocks that
    hold both its bins; a block without variance has 0."""
    rows = paired(a, b, offset, None, on)
    ends = a.groupBy(*on).agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("na"))
    endb = b.groupBy(*on).agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("nb"))
    rows = rows.join(ends, list(on)).join(endb, list(on)) if on else rows.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(endb))
    n = F.least("na", "nb")
    low = F.greatest(F.lit(0), F.ceil((F.greatest("i", "j") - size + 1) / step)) * step
    high = F.least(F.least("i", "j"), n - size - 1)
    rows = rows.select("*", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")
    starts = F.explode(F.sequence("low", "high", F.lit(step).cast("long"))).alias("start")
    if kind == "spearman":
        rows = mean_ranks(rows.select(*on, "a", "b", starts), [*on, "start"], ["a", "b"])
        r = F.when(F.count("*") > 10, F.corr("a", "b")).otherwise(0.0)
        found = rows.groupBy(*on, "start").agg(F.coalesce(r, F.lit(0.0)).alias("corr"))
    else:
        # cells of the same blocks are summed before they go to their blocks
        a, b = F.col("a"), F.col("b")
        sums = {"n": F.lit(1), "sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}
        last = F.col("low") + F.floor((F.col("high") - F.col("low")) / step) * step
        rows = rows.groupBy(*on, "low", last.alias("high")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        rows = rows.select(*on, *sums, starts).groupBy(*on, "start").agg(*[F.sum(k).alias(k) for k in sums])
        spread = lambda x: F.col("n") * F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}")
        flat = F.greatest(spread("a") / (F.col("n") * F.col("saa")), F.lit(0.0)) * F.greatest(spread("b") / (F.col("n") * F.col("sbb")), F.lit(0.0)) <= 1e-24
        r = (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(spread("a") * spread("b"))
        known = (F.col("n") > 10) & (F.col("saa") > 0) & (F.col("sbb") > 0)
        found = rows.select(*on, "start", F.when(known, F.when(flat, 0.0).otherwise(r)).otherwise(0.0).alias("corr"))
    return found.select(*on, "start", ((F.col("start") + size / 2) * binsize).alias("centre"), "corr")


def correlate_bins(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation of the two maps' rows, bin by bin. Cells that equal their map's
    least non-zero value, in either map, are left out; zeros are ordinary values. Rows are
    not made dense: sums over the cells that exist and the count of all give the moments."""
    keep = [*on, "i", "j"]
    both = a.select(*keep, F.col("v").alias("a")).join(b.select(*keep, F.col("v").alias("b")), keep, "full").select(*keep, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    ends = lambda m, x: m.groupBy(*on).agg(F.min(F.when(F.col("v") != 0, F.col("v"))).alias(f"m{x}"), (F.greatest(F.max("i"), F.max("j")) + 1).alias(f"n{x}"))
    la, lb = ends(a, "a"), ends(b, "b")
    both = both.join(la, list(on)).join(lb, list(on)) if on else both.crossJoin(F.broadcast(la)).crossJoin(F.broadcast(lb))
    both = both.withColumn("n", F.least("na", "nb")).where((F.col("i") < F.col("n")) & (F.col("j") < F.col("n")))
    out = (F.col("a") == F.col("ma")) | (F.col("b") == F.col("mb"))
    s = lambda c: F.coalesce(F.sum(F.when(~out, c)), F.lit(0.0))
    x, y = F.col("a"), F.col("b")
    m = both.groupBy(*on, "i", "n").agg(F.count_if(out).alias("masked"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    k = F.col("n") - F.col("masked")
    cov = k * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = k * F.col("sxx") - F.col("sx") * F.col("sx"), k * F.col("syy") - F.col("sy") * F.col("sy")
    return m.select(*on, "i", k.alias("n"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(0.0).alias("corr"))


#: Rows of a block of the row-by-row products, and columns that are taken at once.
TILE_ROWS = 1536
TILE_COLUMNS = 512
MOMENTS = {"n": "long", "sx": "double", "sy": "double", "sxy": "double"}


def _of_moments(m: dict[str, np.ndarray], own: list[np.ndarray]) -> dict[str, np.ndarray]:
    return m | {"n": m["n"].astype(np.int64)}


def _of_covariance(m: dict[str, np.ndarray], own: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {"cov": m["sxy"] / m["n"] - m["sx"] / m["n"] * (m["sy"] / m["n"])}


def _of_own_variance(m: dict[str, np.ndarray], own: list[np.ndarray]) -> dict[str, np.ndarray]:
    d = own[0] * own[1]
    return {"corr": np.where(d > 0, _of_covariance(m, own)["cov"] / np.sqrt(np.where(d > 0, d, 1)), 0.0)}


def _of_common_variance(m: dict[str, np.ndarray], own: list[np.ndarray]) -> dict[str, np.ndarray]:
    n, sx, sy = m["n"], m["sx"], m["sy"]
    d = (n * m["sxx"] - sx * sx) * (n * m["syy"] - sy * sy)
    return {"corr": np.where(d > 0, (n * m["sxy"] - sx * sy) / np.sqrt(np.where(d > 0, d, 1)), 0.0)}


#: Products of the left and the right block that make each sum: of values (v), of squares (s),
#: of marks of the cells that exist (m).
SUMS = {"n": "mm", "sx": "vm", "sy": "mv", "sxy": "vv", "sxx": "sm", "syy": "ms"}


def _sharing(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks that have cells, and the row blocks ``others`` of each column cut."""
    cuts = written(held.select(*KEY, "bi", "bj").distinct(), "cuts")  # a row for each block
    return cuts, cuts.groupBy(*KEY, "bj").agg(F.collect_list("bi").alias("others"))


def _to_pairs(rows: DataFrame, *more: Column | str) -> DataFrame:
    """Rows of a block bi under the pair of it and ``other``."""
    return rows.select(*KEY, F.greatest("bi", "other").alias("hi"), F.least("bi", "other").alias("lo"), "bi", *more)


def _row_pairs(cells: DataFrame, finish, out: dict[str, str], least: int, with_self: bool = True, own: DataFrame | None = None, sums: tuple[str, ...] = tuple(MOMENTS), tile: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """Rows (map, binsize, i1 >= i2, out) of what ``finish`` makes of the sums over the columns
    that two rows share, if these are ``least`` at least. Cells are packed once, by row block and
    by column cut; a packed row goes to the pairs of its row block with those that have cells in
    the same cut, and to no others. A task gets a pair's cuts one by one and adds up the
    products of dense blocks, so it holds the pair's sums and four blocks whatever the map's size.
    own: numbers (map, binsize, i, own) that finish needs of both rows."""
    held = stored(cells, tile, columns)
    cuts, sharing = _sharing(held)
    numbers = "array<struct<k:long,own:double>>"
    rows = _to_pairs(held.join(sharing, [*KEY, "bj"]).withColumn("other", F.explode("others")), F.col("bj").alias("cut"), "n", "data", F.lit(None).cast(numbers).alias("own"))
    if own is not None:
        blocks = own.groupBy(*KEY, block("i", tile).alias("bi")).agg(F.collect_list(F.struct((F.col("i") % tile).alias("k"), F.col("own").cast("double").alias("own"))).alias("own"))
        pairs = cuts.join(sharing, [*KEY, "bj"]).select(*KEY, "bi", F.explode("others").alias("other")).distinct()
        rows = rows.unionByName(_to_pairs(pairs.join(blocks, [*KEY, "bi"]), F.lit(-1).cast("long").alias("cut"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"), F.col("own").cast(numbers)))

    def products(place: tuple, sides: dict[int, tuple], total: dict[str, np.ndarray]) -> None:
        """Adds a cut's products; only rows and columns between the first and the last cell count."""
        hi, lo = (sides.get(b) for b in place[2:])
        if hi is None or lo is None:
            return
        span = lambda marks: slice(np.argmax(marks), len(marks) - np.argmax(marks[::-1]))
        shared = hi["m"].any(axis=0) & lo["m"].any(axis=0)
        if not shared.any():
            return
        across = span(shared)
        a, b = span(hi["m"].any(axis=1)), span(lo["m"].any(axis=1))
        for name in sums:
            left, right = SUMS[name]
            total[name][a, b] += hi[left][a, across] @ lo[right][b, across].T

    def found(place: tuple, total: dict[str, np.ndarray], owns: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, size, hi, lo = place
        for first in range(0, tile, 64):
            n = total["n"][first : first + 64]
            a, b = np.nonzero(n >= least)
            i1, i2 = a + first + hi * tile, b + lo * tile
            keep = i1 >= i2 if with_self else i1 > i2
            a, b, i1, i2 = a[keep], b[keep], i1[keep], i2[keep]
            if not len(a):
                continue
            both = [owns[hi][a + first], owns[lo][b]] if owns else []
            made = finish({k: x[first : first + 64][a, b] for k, x in total.items()}, both)
            keys = [pa.repeat(pa.scalar(name, pa.string()), len(a)), pa.repeat(pa.scalar(size, pa.int64()), len(a)), pa.array(i1), pa.array(i2)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(made[k]) for k in out]], names=[*KEY, "i1", "i2", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cut, total, owns, sides = None, None, {}, {}, {}
        for batch in batches:
            bi, at, n, data, numbers = (batch.column(c) for c in ("bi", "cut", "n", "data", "own"))
            for place, first, end in runs(batch, (*KEY, "hi", "lo")):
                for k in range(first, end):
                    if place != last or at[k].as_py() != cut:
                        if sides:
                            products(last, sides, total)
                        sides, cut = {}, at[k].as_py()
                    if place != last:
                        if last is not None:
                            yield from found(last, total, owns)
                        last, owns = place, {}
                        total = {name: np.zeros((tile, tile)) for name in sums}
                    b = bi[k].as_py()
                    if cut < 0:
                        owns[b] = np.zeros(tile)
                        owns[b][numbers[k].values.field("k").to_numpy()] = numbers[k].values.field("own").to_numpy()
                        continue
                    if b not in sides:
                        sides[b] = {name: np.zeros((tile, columns)) for name in {x for s in sums for x in SUMS[s]}}
                    i, j, v = cells_in(n[k].as_py(), data[k])
                    for name, x in sides[b].items():
                        x[i, j] = {"v": v, "s": v * v, "m": 1.0}[name]
        if last is not None:
            if sides:
                products(last, sides, total)
            yield from found(last, total, owns)

    # few bytes but much work: the number of tasks isn't left to the bytes
    tasks = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *KEY, "hi", "lo").sortWithinPartitions(*KEY, "hi", "lo", "cut", "bi")
    return rows.mapInArrow(run, ", ".join(["map string, binsize long, i1 long, i2 long", *[f"{k} {kind}" for k, kind in out.items()]]))


def _tiles(cells: DataFrame, tile: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """Moments (map, binsize, i1 >= i2, n, sx, sy, sxy) over the columns that two rows
    share."""
    return _row_pairs(cells, _of_moments, MOMENTS, 1, tile=tile, columns=columns)


def covariance_matrix(cells: DataFrame, mask: float | None = None) -> DataFrame:
    """Population covariance of every two rows (i1 >= i2) over the columns in which both
    have cells, if these are over three."""
    return _row_pairs(cells if mask is None else cells.where(F.col("v") != mask), _of_covariance, {"cov": "double"}, 4)


def correlation_matrix(cells: DataFrame, mask: float | None = None, pairwise: bool = False) -> DataFrame:
    """Correlation of every two rows, i1 > i2: their covariance over common columns by the
    variances over each row's own cells; with ``pairwise`` over the common columns too.
    Rows without variance give 0."""
    cells = cells if mask is None else cells.where(F.col("v") != mask)
    if pairwise:
        # Pearson over common columns needs the squares' sums as well
        return _row_pairs(cells, _of_common_variance, {"corr": "double"}, 4, with_self=False, sums=tuple(SUMS))
    cells = written(cells.select(*KEY, "i", "j", "v"), "cells")
    own = cells.groupBy(*KEY, "i").agg(F.var_pop("v").alias("own"))
    return _row_pairs(cells, _of_own_variance, {"corr": "double"}, 4, with_self=False, own=own)


def new_only(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of the maps and resolutions that have no result yet."""
    return cells.join(done.select(*KEY).distinct(), list(KEY), "left_anti")


