"""Tracks: signals in bins, combination of inputs, percentiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantile
from ..functions.tables import dropped, written
from .cells import last_of

#: Bin sizes that tracks are stored at, and ways to combine values: fixed values.
RESOLUTIONS = ("1kb", "2kb", "4kb", "5kb", "8kb", "10kb", "20kb", "40kb", "80kb", "100kb", "160kb", "200kb", "320kb", "500kb", "640kb", "1mb")
METHODS = ("min", "max", "amean", "hmean", "gmean", "median")


def measures(v: str = "value", weight: str | None = None) -> dict[str, Column]:
    """Aggregates of positive values; with a weight column (bases per value), weighted."""
    x = F.when(F.col(v) > 0, F.col(v))
    w = F.when(F.col(v) > 0, F.col(weight) if weight else F.lit(1))
    return {
        "min": F.min(x),
        "max": F.max(x),
        "amean": F.sum(x * w) / F.sum(w),
        "hmean": F.sum(w) / F.sum(w / x),
        "gmean": F.exp(F.sum(w * F.ln(x)) / F.sum(w)),
        "median": F.median(x) if weight is None else F.percentile(x, F.lit(0.5), F.coalesce(w, F.lit(0)).cast("long")),
    }


def bin_track(signal: DataFrame, binsize: int, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """One row per bin of (chrom, pos, value), a column per method."""
    known = measures()
    return signal.where("value > 0").groupBy("chrom", F.floor(F.col("pos") / binsize).cast("long").alias("bin")).agg(*[known[m].alias(m) for m in methods])


def bin_intervals(signal: DataFrame, binsizes: list[int], methods: tuple[str, ...] = METHODS) -> DataFrame:
    """All resolutions in one pass over disjoint intervals (chrom, start, end, value), bases
    start + 1 to end: bins hold bases k b + 1 to (k + 1) b. An interval counts in a bin by
    its bases there; bases are never expanded."""
    bad = set(methods) - set(METHODS)
    if bad:
        raise ValueError(f"unknown methods: {sorted(bad)}")
    sizes = F.explode(F.array(*[F.lit(int(b)).cast("long") for b in binsizes])).alias("binsize")
    rows = signal.where("value > 0 AND end > start").select("chrom", "start", "end", "value", sizes)
    first, last = F.floor(F.col("start") / F.col("binsize")), F.floor((F.col("end") - 1) / F.col("binsize"))
    rows = rows.withColumn("bin", F.explode(F.sequence(first, last)))
    inside = F.least("end", (F.col("bin") + 1) * F.col("binsize")) - F.greatest("start", F.col("bin") * F.col("binsize"))
    known = measures("value", "w")
    return rows.withColumn("w", inside).groupBy("chrom", "binsize", "bin").agg(*[known[m].alias(m) for m in methods])


#: Cuts of a part of a chromosome, which one task sweeps, and parts at most.
CUTS, MOST_PARTS = 4096, 50_000


def disjoint(signal: DataFrame, method: str = "mean") -> DataFrame:
    """Overlapping intervals (chrom, start, end, value, seq) cut where others begin or end;
    what overlaps is combined by the running mean in input order, by max or by min. Rows
    without a chromosome and empty intervals cover nothing.

    The cuts of a chromosome are ranged into parts of CUTS. An interval goes, clipped, to the
    parts in which it begins and ends; the parts that it covers wholly are handed to it as nodes
    of a binary tree over the parts, no more than two for each level. What covers the same
    stretch of a part or node is combined first (of a mean the last FOLDED values), so neither
    an interval over everything nor a place where all begin makes a task large: rows grow with
    the input, times the tree's height. A part takes the nodes above it and is swept."""
    signal = signal.where("chrom IS NOT NULL AND end >= start")
    ends = written(signal.select("chrom", F.explode(F.array("start", "end")).alias("at")).distinct(), "cuts")
    parts = max(1, min(MOST_PARTS, -(-ends.count() // CUTS)))
    cuts = written(ends.repartitionByRange(parts, "chrom", "at").withColumn("__range", F.spark_partition_id()), "ranges")
    dropped(ends)
    # the parts of a chromosome, numbered from 0, and where each begins and the next one does
    by_place = Window.partitionBy("chrom").orderBy("lo")
    bounds = cuts.groupBy("chrom", "__range").agg(F.min("at").alias("lo"))
    bounds = written(bounds.select("chrom", "__range", "lo", F.lead("lo").over(by_place).alias("hi"), (F.row_number().over(by_place) - 1).cast("long").alias("part")), "parts")
    place = cuts.join(bounds, ["chrom", "__range"]).select("chrom", "at", "part", "lo")
    of = lambda end: place.select("chrom", F.col("at").alias(end), F.col("part").alias(f"of_{end}"), F.col("lo").alias(f"lo_{end}"))
    rows = signal.where("end > start").join(of("start"), ["chrom", "start"]).join(of("end"), ["chrom", "end"])
    # an end where a part begins belongs to the part before
    first, last = F.col("of_start"), F.when(F.col("end") == F.col("lo_end"), F.col("of_end") - 1).otherwise(F.col("of_end"))
    none = F.lit(None).cast("long")
    piece = lambda node, a, b, level=F.lit(0): F.struct(level.cast("int").alias("level"), node.cast("long").alias("node"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    height = max(1, int(bounds.agg(F.max("part")).first()[0] or 0).bit_length())

    def nodes(level: Column) -> Column:
        wide = F.pow(F.lit(2.0), level)
        low, high = F.ceil((F.col("first") + 1) / wide), F.floor(F.col("last") / wide)
        found = F.array(F.when(low % 2 == 1, piece(low, none, none, level)), F.when(high % 2 == 1, piece(high - 1, none, none, level)))
        return F.when(low < high, F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast(found_kind))

    found_kind = "array<struct<level:int,node:bigint,a:bigint,b:bigint>>"
    inside = F.array(piece(F.col("first"), F.col("start"), F.col("end")))
    spread = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height)), nodes))
    over = F.concat(F.array(piece(F.col("first"), F.col("start"), none), piece(F.col("last"), none, F.col("end"))), spread)
    rows = rows.select("chrom", "start", "end", F.col("value").cast("double").alias("value"), "seq", first.alias("first"), last.alias("last"))
    pieces = rows.select("chrom", "value", "seq", F.explode(F.when(F.col("first") == F.col("last"), inside).otherwise(over)).alias("x")).select("chrom", "x.*", "value", "seq")
    pieces = written(_reduced(pieces, ["chrom", "level", "node", "a", "b"], method), "pieces")
    level = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")
    under = bounds.select("chrom", "part", level).withColumn("node", F.floor(F.col("part") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    whole = _reduced(pieces.where("a IS NULL AND b IS NULL").join(under, ["chrom", "level", "node"]).select("chrom", F.col("part").alias("node"), "a", "b", "value", "seq"), ["chrom", "node", "a", "b"], method)
    mine = pieces.where("a IS NOT NULL OR b IS NOT NULL").select("chrom", "node", "a", "b", "value", "seq").unionByName(whole)
    marks = cuts.join(bounds, ["chrom", "__range"]).select("chrom", F.col("part").alias("node"), "at", "hi")

    def sweep(cuts: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(cuts["at"].to_numpy())
        to = np.append(at[1:], cuts["hi"].iloc[0] if cuts["hi"].notna().all() else at[-1])
        seen, out = np.zeros(len(at), dtype=bool), np.full(len(at), np.nan)
        order = pieces.sort_values(["seq", "value"] if method == "mean" else ["value"], ascending=method != "min", kind="stable")
        first = np.where(order["a"].isna(), 0, np.searchsorted(at, order["a"].fillna(0).to_numpy()))
        last = np.where(order["b"].isna(), len(at), np.searchsorted(at, order["b"].fillna(0).to_numpy()))
        for a, b, x in zip(first.tolist(), last.tolist(), order["value"].tolist()):
            seen[a:b] = True
            if method == "mean":
                held = out[a:b]
                if x != x:
                    continue
                fresh = np.isnan(held) | (held == 0)
                out[a:b] = np.where(fresh, x, held if x == 0 else (held + x) / 2)
            elif x == x and (method == "max" or x != 0):
                out[a:b] = x
        seen &= to > at
        return pd.DataFrame({"chrom": cuts["chrom"].iloc[0], "start": at[seen], "end": to[seen], "value": pd.array(out[seen], dtype="Float64")}) if seen.any() else pd.DataFrame({"chrom": [], "start": [], "end": [], "value": []})

    return marks.groupBy("chrom", "node").cogroup(mine.groupBy("chrom", "node")).applyInPandas(sweep_of(sweep), f"chrom {dict(signal.dtypes)['chrom']}, start long, end long, value double")


def sweep_of(sweep):
    """sweep for the parts that have both cuts and pieces."""

    def run(cuts: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        both = len(cuts) and len(pieces)
        return sweep(cuts, pieces) if both else pd.DataFrame({"chrom": [], "start": [], "end": [], "value": []})

    return run


def _reduced(pieces: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Rows (keys, value, seq) of which no more are left for one key than the combination needs;
    values that don't count leave one row, which still covers."""
    if method != "mean":
        x = F.col("value")
        best = F.max(x) if method == "max" else F.min(F.when(x != 0, x))
        return pieces.groupBy(*keys).agg(best.alias("value"), F.lit(None).cast("long").alias("seq"))
    zero = pieces.where("value = 0 OR value IS NULL").groupBy(*keys).agg(F.max("value").alias("value"), F.min("seq").alias("seq"))
    return last_of(pieces, keys, "seq", unless=F.col("value") == 0).where("value IS NOT NULL").unionByName(zero)


def combined(method: str, value: str = "value", order: str = "seq") -> Column:
    """Aggregate of values that meet at one place: min and max of the non-zero ones, or the
    running pairwise mean in input order, in which a zero is overwritten."""
    x = F.col(value)
    if method == "min":
        return F.min(F.when(x != 0, x))
    if method == "max":
        return F.max(x)
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.cast("double").alias("x"))))
    return F.aggregate(held, F.lit(None).cast("double"), lambda a, y: F.when(a.isNull() | (a == 0), y["x"]).when(y["x"] == 0, a).otherwise((a + y["x"]) / 2))


def combine(tracks: DataFrame, method: str = "mean") -> DataFrame:
    """Tracks of several inputs (chrom, bin, value, seq) as one."""
    if method == "mean":
        tracks = last_of(tracks, ["chrom", "bin"], "seq", unless=F.col("value") == 0)
    return tracks.groupBy("chrom", "bin").agg(combined(method).alias("v"))


def long_form(wide: DataFrame, binsize: int | None = None, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(chrom, binsize, name, bin, v) from a column per method."""
    size = F.col("binsize") if binsize is None else F.lit(binsize).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("v")) for m in methods])).alias("x")
    return wide.select("chrom", size.alias("binsize"), "bin", each).select("chrom", "binsize", "x.name", "bin", "x.v").where("v <> 0")


def percentile(track: DataFrame, q: float = 0.95) -> DataFrame:
    """Percentile of non-zero values: the usual upper limit of a plot."""
    return quantile(track.where("v <> 0"), ["chrom", "binsize", "name"], F.col("v"), q, "limit")


def signs(track: DataFrame) -> DataFrame:
    """Bars below and above zero."""
    return track.where("v <> 0").select("chrom", "binsize", "name", "bin", F.least("v", F.lit(0.0)).alias("negative"), F.greatest("v", F.lit(0.0)).alias("positive"))


def chromosome_sizes(signal: DataFrame) -> DataFrame:
    return signal.groupBy("chrom").agg(F.max("end").alias("size"))


def choose_replicates(files: DataFrame, by: list[str], replicates: str = "replicates") -> DataFrame:
    """The file with the longest list of replicates in each group; all where every file
    has one replicate."""
    n = F.size(F.split(F.col(replicates), r"\s*,\s*"))
    longest = files.groupBy(*by).agg(F.max(n).alias("__n"))
    ranked = files.join(longest, by).withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(n.desc(), replicates)))
    return ranked.where("__n = 1 OR __k = 1").select(*files.columns)
