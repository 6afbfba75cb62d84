"""The container: maps and tracks as Parquet partitioned by map and bin size, and sinks."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import cells as C
from ..operators import coarsen as Z
from ..operators import masks as K
from ..operators.markov import stationary, transition, without_outliers
from ..operators.normalise import coverage, over_expected
from ..operators.stats import correlation_matrix, new_only
from ..operators.structure import compartments, correct_peaks

CELLS, BINS, META = "cells", "bins", "meta"


def write_cells(cells: DataFrame, path: str, compression: str = "zstd", bins: DataFrame | None = None, keep: bool = True) -> None:
    """Write maps, replacing those (map and bin size) that are there already, and only
    those. Rows of a level are sorted by i, j, so that row groups serve viewports. The rows are
    read twice, and kept in between; without ``keep``, for tables, they are not."""
    cells = cells.persist() if keep else cells
    _write(cells.repartition("map", "binsize", F.floor(F.col("i") / 1024)).sortWithinPartitions("map", "binsize", "i", "j"), f"{path}/{CELLS}", compression)
    _write(C.meta(cells), f"{path}/{META}", compression)
    if bins is not None:
        _write(bins, f"{path}/{BINS}", compression)
    if keep:
        cells.unpersist()


def _write(df: DataFrame, path: str, compression: str) -> None:
    df.write.partitionBy("map", "binsize").mode("overwrite").options(partitionOverwriteMode="dynamic", compression=compression).parquet(path)


def _folder(spark: SparkSession, path: str, name: str | None = None):
    """A folder, or a map's folder in it, as Hadoop sees it, and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path) if name is None else hadoop.Path(path, f"map={quote(name, safe=' -_.')}")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _folder(spark, path)
    return files.exists(at)


def drop_map(spark: SparkSession, path: str, name: str) -> None:
    """Remove a map with all its levels."""
    for part in (CELLS, BINS, META):
        at, files = _folder(spark, f"{path}/{part}", name)
        files.delete(at, True)


def add_map(cells: DataFrame, path: str, method: str | None = "sum", stop: int = 500, compression: str = "zstd", replace: bool = True) -> None:
    """Write maps with their pyramid. With ``replace`` all levels of a map of the same name go;
    else only those that are written anew. New maps are written beside the container and take
    the old ones' places when they are whole, so cells may come from the container itself,
    and a write that fails leaves it as it was."""
    spark = cells.sparkSession
    # sides, the first level and the result are made of the cells: they are computed once
    cells = written(cells, "cells")
    rows = cells if method in (None, "none") else Z.pyramid(cells, method, stop)
    if not replace:
        write_cells(rows, path, compression, keep=False)
        return
    beside = f"{path}/.new-{uuid.uuid4().hex}"
    write_cells(rows, beside, compression, keep=False)
    for r in read_meta(spark, beside).select("map").distinct().collect():  # names only
        drop_map(spark, path, r["map"])
        for part in (CELLS, META):
            at, files = _folder(spark, f"{beside}/{part}", r["map"])
            to, _ = _folder(spark, f"{path}/{part}", r["map"])
            files.mkdirs(to.getParent())
            if not files.rename(at, to):
                raise OSError(f"{at} can't be moved to {to}")
    at, files = _folder(spark, beside)
    files.delete(at, True)


def read_cells(spark: SparkSession, path: str, name: str | None = None, binsize: int | None = None) -> DataFrame:
    """Maps of a container; filters on map and bin size prune partitions."""
    rows = spark.read.schema("i long, j long, v double, map string, binsize long").parquet(f"{path}/{CELLS}").select(*C.CELL)
    if name is not None:
        rows = rows.where(F.col("map") == name)
    return rows if binsize is None else rows.where(F.col("binsize") == binsize)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("nx long, ny long, minvalue double, maxvalue double, map string, binsize long").parquet(f"{path}/{META}")


def load_map(spark: SparkSession, path: str, name: str, binsize: int | None = None) -> DataFrame | None:
    """One level of a map, the finest by default; None if it isn't stored."""
    held = read_meta(spark, path).where(F.col("map") == name)
    sizes = sorted(r["binsize"] for r in held.select("binsize").collect())  # levels of one map
    if not sizes or (binsize is not None and binsize not in sizes):
        return None
    return read_cells(spark, path, name, binsize or sizes[0])


def recompress(spark: SparkSession, source: str, target: str, compression: str) -> None:
    """A copy of the container in another codec."""
    _write(read_cells(spark, source), f"{target}/{CELLS}", compression)
    _write(read_meta(spark, source), f"{target}/{META}", compression)


def coarsen_stored(spark: SparkSession, path: str, binsize: int, method: str = "sum") -> DataFrame:
    """Adds a level to every map that lacks it, from the finest that divides it, and
    returns (map, base, target)."""
    todo = Z.base_resolution(read_meta(spark, path), binsize).persist()
    for r in todo.select("base").distinct().collect():  # levels, not maps
        rows = read_cells(spark, path).where(F.col("binsize") == r["base"]).join(todo.where(F.col("base") == r["base"]).select("map"), "map", "left_semi")
        write_cells(Z.coarsen(rows.select(*C.CELL), binsize // r["base"], method), path)
    return todo


def selected(cells: DataFrame, vmin: float | None = None, vmax: float | None = None, percentile: float | None = None, occupancy: float | None = None) -> DataFrame:
    """Cells strictly between the limits, without the bins that a rule for missing data drops."""
    cells = C.threshold(cells, vmin, vmax)
    if percentile is None and occupancy is None:
        return cells
    return K.drop_missing(cells, K.missing_bins(cells, percentile, occupancy))


RULES = ("vmin", "vmax", "percentile", "occupancy")


def normalise_container(spark: SparkSession, source: str, target: str, method: str, scale_up: bool = False, stop: int = 500, **options) -> None:
    """Coverage (vc) and distance scaling (mcfs) treat every stored level by itself; iterative
    correction (ic) and Knight-Ruiz balancing (kr) treat the finest and sum it up again.
    Options: the thresholds and rules for missing bins of ``selected``, and the method's own.
    scale_up: see cells.scale_up."""
    from ..operators import normalise as NM

    stored = selected(read_cells(spark, source), **{k: options.pop(k) for k in RULES if k in options})
    up = C.scale_up if scale_up else lambda x: x
    if method in ("vc", "mcfs"):
        out = coverage(stored, **options) if method == "vc" else over_expected(stored, **options)
        write_cells(up(out), target)
        return
    finest = read_meta(spark, source).groupBy("map").agg(F.min("binsize").alias("binsize"))
    base = stored.join(finest, ["map", "binsize"], "left_semi").select(*C.CELL)
    add_map(up(NM.correct(base, **options) if method == "ic" else NM.balance(base, **options)), target, stop=stop)


def missing_levels(spark: SparkSession, cells: DataFrame, target: str, replace: bool) -> DataFrame:
    """Cells of maps and levels that the target lacks, or all of them."""
    at, files = _folder(spark, f"{target}/{META}")
    return cells if replace or not files.exists(at) else new_only(cells, read_meta(spark, target))


def correlate_container(spark: SparkSession, source: str, target: str, log_space: bool = False, mask: float = 0.0, vmin: float | None = None, vmax: float | None = None, replace: bool = False) -> None:
    """Correlation matrices of all maps and levels, both triangles, rounded to 4 digits.
    Without ``replace`` those that the target has are left out, so a run that broke off goes on."""
    cells = C.threshold(missing_levels(spark, read_cells(spark, source), target, replace), vmin, vmax)
    if log_space:
        cells = cells.where("v > 0").withColumn("v", F.log10("v"))
    found = correlation_matrix(cells, mask).select(*C.KEY, F.col("i1").alias("i"), F.col("i2").alias("j"), F.round("corr", 4).alias("v"))
    write_cells(C.mirror(found.where("v <> 0")), target)


def transition_container(spark: SparkSession, source: str, target: str, binsize: int, percentile: float | None = None, occupancy: float | None = None) -> None:
    """Transition matrices of all maps from a bin size upward, each level from its own cells."""
    cells = selected(read_cells(spark, source).where(F.col("binsize") >= binsize), None, None, percentile, occupancy)
    write_cells(transition(cells).withColumnRenamed("p", "v"), target)


#: Levels at which a stationary distribution is stored beside its own, the bins under which
#: no coarser one follows, and those under which a map's last level is taken as done.
LEVELS, LEAST_BINS, DONE_BINS = (2, 4, 5, 8, 10, 16, 20, 32, 64), 250, 1000


def distribution_levels(w: DataFrame, least: int = LEAST_BINS) -> DataFrame:
    """A track (chrom, binsize, name, bin, v) of (map, binsize, i, w): maximum, average and
    sum at its own bin size and at LEVELS times it, up to the first level of fewer than
    ``least`` bins. Bin 0 is a dummy in coarser levels, as in maps."""
    names = {"maximum": "max", "average": "mean", "sum": "sum"}
    track = w.select(F.col("map").alias("chrom"), "binsize", "i", F.col("w").alias("v"))
    sides = w.groupBy(F.col("map").alias("chrom"), "binsize").agg((F.max("i") + 1).alias("n"))
    out = None
    for name, how in names.items():
        base = track.select("chrom", "binsize", F.lit(name).alias("name"), F.col("i").alias("bin"), "v").where("v <> 0")
        out = base if out is None else out.unionByName(base)
        # a level is there if the one before it has bins enough
        for before, level in zip((None, *LEVELS), LEVELS):
            bins = F.ceil((F.col("n") - 1) / (before or 1)) + 1
            wanted = sides.where(F.lit(True) if before is None else bins >= least)
            rows = base.join(wanted.drop("n"), ["chrom", "binsize"], "left_semi")
            out = out.unionByName(Z.coarsen_track(rows.select("chrom", "binsize", "name", "bin", "v"), level, how, zero_based=False))
    return out


def stationary_container(spark: SparkSession, source: str, target: str, binsize: int, overwrite: bool = False, least: int = LEAST_BINS, **options) -> DataFrame:
    """Stationary distributions of the transition matrices that a container has at a bin size,
    without outliers, at several levels, into a track store. Maps whose coarsest stored sum has
    under DONE_BINS bins are done and are left out, unless ``overwrite``. Returns the track."""
    cells = read_cells(spark, source, binsize=binsize)
    at, files = _folder(spark, target)
    if not overwrite and files.exists(at):
        sums = read_track(spark, target).where("name = 'sum'").groupBy("chrom", "binsize").agg((F.max("bin") + 1).alias("n"))
        done = sums.groupBy("chrom").agg(F.max_by("n", "binsize").alias("n")).where(F.col("n") < DONE_BINS)
        cells = cells.join(done.select(F.col("chrom").alias("map")), "map", "left_anti").select(*C.CELL)
    track = distribution_levels(without_outliers(stationary(cells, **options)), least)
    write_track(track, target)
    return read_track(spark, target)


def compartment_container(spark: SparkSession, source: str, target: str, binsize: int, method: str = "k-means", factor: float | None = None) -> DataFrame:
    """Compartments of all maps and levels from a bin size upward, into a track store under
    the method's name, corrected for wrong peaks with ``factor``. Returns the track."""
    cells = read_cells(spark, source).where(F.col("binsize") >= binsize)
    scores = compartments(cells, method)
    name = f"Compartment by {method}"
    if factor is not None:
        scores, name = correct_peaks(scores, cells, factor), f"{name} {factor}"
    write_track(scores.select(F.col("map").alias("chrom"), "binsize", F.lit(name).alias("name"), F.col("i").alias("bin"), F.col("score").alias("v")), target)
    return read_track(spark, target)


def export_coo(cells: DataFrame, path: str, zeros: bool = False) -> None:
    """Lower triangle with the diagonal, tab-separated i, j, v, in order; with ``zeros``
    every cell of it."""
    rows = cells.where("j <= i")
    if zeros:
        every = C.axis(cells).select(*C.KEY, "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))).alias("j"))
        rows = every.join(rows, [*C.KEY, "i", "j"], "left").select(*C.KEY, "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
    else:
        rows = rows.where("v <> 0")
    rows.select("i", "j", "v").orderBy("i", "j").write.mode("overwrite").csv(path, sep="\t")


def write_blocks(correlations: DataFrame, path: str) -> None:
    """Text ``centre corr`` of block correlations, without zeros."""
    correlations.where("corr <> 0").select("centre", "corr").orderBy("centre").write.mode("overwrite").csv(path, sep="\t")


def write_track(track: DataFrame, path: str, compression: str = "zstd") -> None:
    """A track, replacing the (chrom, binsize, name) that it has."""
    track.write.partitionBy("chrom", "binsize", "name").mode("overwrite").options(partitionOverwriteMode="dynamic", compression=compression).parquet(path)


def read_track(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bin long, v double, chrom string, binsize long, name string").parquet(path).select("chrom", "binsize", "name", "bin", "v")


def track_tree(spark: SparkSession, path: str) -> DataFrame:
    """What is stored: (chrom, binsize, name), from the partitions."""
    return read_track(spark, path).select("chrom", "binsize", "name").distinct()


class TrackNotFound(KeyError):
    """The store has no such chromosome, bin size or name."""


def track_entries(spark: SparkSession, path: str, chrom: str | None = None, binsize: int | None = None, name: str | None = None) -> DataFrame:
    """What is stored of a chromosome, bin size or name; raises TrackNotFound where there is
    nothing of it. Only folders' names are read."""
    held = track_tree(spark, path)
    for column, wanted in (("chrom", chrom), ("binsize", binsize), ("name", name)):
        if wanted is not None:
            held = held.where(F.col(column) == wanted)
            if held.isEmpty():
                raise TrackNotFound(f"{column} {wanted}")
    return held


def has_track(spark: SparkSession, path: str, chrom: str, binsize: int | None = None, name: str | None = None) -> bool:
    try:
        return not track_entries(spark, path, chrom, binsize, name).isEmpty()
    except TrackNotFound:
        return False


def track_sizes(spark: SparkSession, path: str, chrom: str) -> list[int]:
    """Bin sizes of a chromosome, finest first."""
    return sorted(r[0] for r in track_entries(spark, path, chrom).select("binsize").distinct().collect())


def track_names(spark: SparkSession, path: str, chrom: str, binsize: int) -> list[str]:
    return sorted(r[0] for r in track_entries(spark, path, chrom, binsize).select("name").distinct().collect())


def meta_json(row: dict, no_data: list[bool] | None = None) -> str:
    """A map's metadata as JSON; bins without data are a text of 0 and 1."""
    bits = None if no_data is None else "".join("1" if x else "0" for x in no_data)
    return json.dumps({**row, "bNoData": bits, "shape": [row["nx"], row["ny"]]}, sort_keys=True)


def from_json(text: str) -> dict:
    out = json.loads(text)
    if out.get("bNoData") is not None:
        out["bNoData"] = [x == "1" for x in out["bNoData"]]
    return out
