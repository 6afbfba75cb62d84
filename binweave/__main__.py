"""Commands: python -m binweave COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.resolution import to_binsize
from .functions.tables import clean_scratch
from .operators import masks, normalise, stats, tracks
from .operators.cells import scale_up, threshold
from .sources import archive, bigwig, container, hic, text
from .sources.single import as_cells


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="binweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *inputs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for x in inputs:
            c.add_argument(x)
        return c

    def store(c):
        c.add_argument("output", help="the container")
        c.add_argument("--compression", default="zstd")
        c.add_argument("--downsampling", default="sum", choices=["sum", "mean", "max", "none"])

    c = command("coo", "coordinate lists into a container", "input")
    store(c)
    c.add_argument("--archive", help="read the listed files out of this archive")
    c.add_argument("--resolution")
    c.add_argument("--index", action="store_true", help="coordinates are bins")
    c.add_argument("--map-type", default="intra", choices=["intra", "inter"])
    c = command("paircoo", "paired coordinates into a container", "input")
    store(c)
    c = command("homer", "a matrix file into a container", "input")
    store(c)
    c = command("bincontact", "bin and contact files into a container", "bins", "contacts")
    store(c)
    c = command("hic", "a .hic file into a container", "input")
    store(c)
    c.add_argument("-c", "--chromosomes", nargs=2)
    c.add_argument("-r", "--resolution")
    c.add_argument("-n", "--norm", default="none", choices=["VC", "VC_SQRT", "KR", "none"])
    for name in ("wig", "bed", "bigwig"):
        c = command(name, f"{name} files into a track store", "input", "output")
        c.add_argument("-r", "--resolutions", nargs="*", default=list(tracks.RESOLUTIONS))
        c.add_argument("-m", "--methods", nargs="*", default=list(tracks.METHODS), choices=tracks.METHODS)
        c.add_argument("--combine", default="mean", choices=["mean", "max", "min"])
        c.add_argument("--chrom")
        c.add_argument("--column", type=int, default=7)
    c = command("encode", "bigWig files that an ENCODE metadata table lists, each into a track store of its own", "input", "output")
    c.add_argument("--files", required=True, help="the folder of the files, named accession.bigWig")
    c.add_argument("--assembly", default="hg19")
    c.add_argument("--assays", nargs="*")
    c.add_argument("-r", "--resolutions", nargs="*", default=list(tracks.RESOLUTIONS))
    c.add_argument("-m", "--methods", nargs="*", default=list(tracks.METHODS), choices=tracks.METHODS)
    c.add_argument("--combine", default="mean", choices=["mean", "max", "min"])
    c = command("config", "settings in use; removes tables that runs have left")
    c.add_argument("--clean-scratch", action="store_true")
    c = command("normalise", "a container or map, normalised", "method", "input", "output")
    c.add_argument("--vmin", type=float)
    c.add_argument("--vmax", type=float)
    c.add_argument("--tolerance", type=float)
    c.add_argument("--iterations", type=int, default=500)
    c.add_argument("--stats", default="median", choices=["median", "mean"])
    c.add_argument("--kind", default="o/e", choices=["o/e", "o-e"])
    c.add_argument("--sqrt", action="store_true")
    c.add_argument("--scale-up", action="store_true", help="values times a power of ten, so that the least has a digit before the point")
    either = c.add_mutually_exclusive_group()
    either.add_argument("--percentile", type=float, help="of zeros, for bins without data")
    either.add_argument("--occupancy", type=float)
    c = command("correlate", "two containers, map by map at their finest level", "first", "second")
    c.add_argument("-k", "--kind", default="spearman", choices=["pearson", "spearman"])
    c.add_argument("--offset", type=int, default=1)
    c.add_argument("--cutoff", type=float)
    c.add_argument("--block", type=int)
    c.add_argument("--step", type=int, default=1)
    c.add_argument("-o", "--output")
    c = command("export", "a map as a coordinate list", "input", "map", "output")
    c.add_argument("--resolution")
    c = command("recompress", "a container in another codec", "input", "output", "compression")
    return p


def finest(cells):
    low = cells.groupBy("map").agg(F.min("binsize").alias("binsize"))
    return cells.join(low, ["map", "binsize"], "left_semi").select("map", "binsize", "i", "j", "v")


def read_maps(spark, a):
    if a.command == "coo":
        options = {"resolution": a.resolution, "coordinate": "index" if a.index else "real", "map_type": a.map_type}
        if not a.archive:
            return text.coo_list(spark, a.input, **options)
        from .operators.cells import bin_contacts

        out = None
        for r in text.lines(spark, a.input).select(text.columns().alias("c")).collect():
            rows = text.coo(spark, None, r["c"][1], to_binsize(a.resolution), options["coordinate"], archive.archive_lines(spark, a.archive, [r["c"][0]]))
            one = bin_contacts(rows, to_binsize(a.resolution), symmetric=a.map_type == "intra")
            out = one if out is None else out.unionByName(one)
        return out
    if a.command == "paircoo":
        return text.paired_coo(spark, a.input)
    if a.command == "homer":
        return text.homer(spark, a.input)
    if a.command == "bincontact":
        return text.bins_and_contacts(spark, a.bins, a.contacts)
    size = to_binsize(a.resolution) if a.resolution else None
    return hic.hic_map(spark, a.input, *a.chromosomes, size, a.norm) if a.chromosomes else hic.hic_container(spark, a.input, size, a.norm)


def store_track(rows, a, output: str) -> None:
    sizes = [to_binsize(r) for r in a.resolutions]
    wide = tracks.bin_intervals(tracks.disjoint(rows, a.combine), sizes, tuple(a.methods))
    container.write_track(tracks.long_form(wide, None, tuple(a.methods)), output)


def encode(spark: SparkSession, a) -> list[str]:
    """The names of the track stores that were made. Of each experiment and type the file with
    most replicates counts; stores that are there already are left out."""
    files = text.signal_types(text.encode_files(spark, a.input, a.assembly, a.assays))
    chosen = tracks.choose_replicates(files, ["experiment", "type"]).orderBy("file").collect()  # one row per file
    made = []
    for r in chosen:
        name = "-".join(x for x in (r["type"], r["experiment"], r["file"]) if x)
        if container.exists(spark, f"{a.output}/{name}"):
            continue
        store_track(bigwig.bigwig(spark, f"{a.files}/{r['file']}.bigWig"), a, f"{a.output}/{name}")
        made.append(name)
    return made


#: Settings that matter here.
SETTINGS = ("spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command in ("coo", "paircoo", "homer", "bincontact", "hic"):
        container.add_map(read_maps(spark, a), a.output, a.downsampling, compression=a.compression)
    elif a.command in ("wig", "bed", "bigwig"):
        if a.command == "bigwig":
            rows = bigwig.bigwig(spark, a.input, a.chrom)
        else:
            rows = text.wig(spark, a.input, a.chrom) if a.command == "wig" else text.bed(spark, a.input, a.column, a.chrom)
        store_track(rows, a, a.output)
    elif a.command == "encode":
        print("\n".join(encode(spark, a)))
    elif a.command == "config":
        for name in SETTINGS:
            print(f"{name} = {spark.conf.get(name, None)}")
        if a.clean_scratch:
            print(f"{clean_scratch(spark)} folders removed")
    elif a.command == "normalise":
        rows = threshold(as_cells(spark, a.input), a.vmin, a.vmax)
        if a.method in ("ic", "kr"):
            rows = finest(rows)
        if a.percentile is not None or a.occupancy is not None:
            rows = masks.drop_missing(rows, masks.missing_bins(rows, a.percentile, a.occupancy))
        up = scale_up if a.scale_up else lambda x: x
        if a.method == "vc":
            container.write_cells(up(normalise.coverage(rows, a.sqrt)), a.output)
        elif a.method == "mcfs":
            container.write_cells(up(normalise.over_expected(rows, a.stats, a.kind)), a.output)
        elif a.method == "ic":
            container.add_map(up(normalise.correct(rows, a.tolerance or 1e-4, a.iterations)), a.output)
        elif a.method == "kr":
            container.add_map(up(normalise.balance(rows, a.tolerance or 1e-12)), a.output)
        else:
            raise SystemExit(f"unknown method {a.method}: vc, mcfs, ic or kr")
    elif a.command == "correlate":
        x, y = finest(as_cells(spark, a.first)), finest(as_cells(spark, a.second))
        if a.block:
            out = stats.correlate_blocks(x, y, a.block, a.step, a.kind, a.offset, on=("map",))
        else:
            out = stats.with_p(stats.correlate(x, y, a.kind, a.offset, a.cutoff, on=("map",)))
        out.write.mode("overwrite").csv(a.output, sep="\t", header=True) if a.output else out.show(1000, False)
    elif a.command == "export":
        found = container.load_map(spark, a.input, a.map, to_binsize(a.resolution) if a.resolution else None)
        if found is None:
            raise SystemExit(f"{a.map} is not stored there")
        container.export_coo(found, a.output)
    else:
        container.recompress(spark, a.input, a.output, a.compression)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
