"""Text inputs: coordinate lists, paired coordinates, matrices, bin and contact files,
wiggle and BED files, plain tracks. Lines are parsed by column functions, but for the wide
ones of matrix files.

seq orders the lines of a file: (file, line). Spark reads text in splits, so the order
within a split is what monotonically_increasing_id gives, which grows along the file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.resolution import to_binsize
from ..functions.tables import bounded_batches
from ..operators import cells as C


def lines(spark: SparkSession, path, **options) -> DataFrame:
    """(value, seq) of the lines that aren't blank; .gz and .bz2 are inflated."""
    rows = spark.read.options(**options).text(path)
    return rows.select("value", F.monotonically_increasing_id().alias("seq")).where(F.trim("value") != "")


def columns(value: Column | str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def _long(c: Column) -> Column:
    return c.try_cast("double").cast("long")


def coo(spark: SparkSession, path, name: str, binsize: int | None = None, coordinate: str = "real", rows: DataFrame | None = None) -> DataFrame:
    """Contacts (map, pos_i, pos_j, value, seq) of lines ``i j value``. With coordinate
    'index' positions are bins and are multiplied by binsize, which must be given."""
    if coordinate == "index" and binsize is None:
        raise ValueError("index coordinates need a bin size")
    scale = F.lit(binsize if coordinate == "index" else 1)
    c = (lines(spark, path) if rows is None else rows).withColumn("c", columns())
    at = lambda k: F.get("c", F.lit(k))
    out = c.select(F.lit(name).alias("map"), (_long(at(0)) * scale).alias("pos_i"), (_long(at(1)) * scale).alias("pos_j"), at(2).try_cast("double").alias("value"), "seq")
    return out.where("pos_i IS NOT NULL AND pos_j IS NOT NULL AND value IS NOT NULL")


def coo_map(spark: SparkSession, path, xlabel: str, ylabel: str | None = None, resolution: str | None = None, coordinate: str = "real", map_type: str = "intra") -> DataFrame:
    """Cells of a coordinate list. Without a resolution the bin size is the least step
    between neighbouring lines."""
    label = xlabel if ylabel in (None, xlabel) else f"{xlabel}-{ylabel}"
    binsize = to_binsize(resolution) if resolution else None
    rows = coo(spark, path, label, binsize, coordinate)
    if binsize is None:
        found = [C.infer_binsize(rows, p, "seq").first() for p in ("pos_i", "pos_j")]
        binsize = min(r["binsize"] for r in found if r and r["binsize"])
    return C.bin_contacts(rows, binsize, symmetric=map_type == "intra")


def coo_list(spark: SparkSession, listing, **options) -> DataFrame:
    """All maps of a list: (file, xlabel[, ylabel]) tuples, or a text file of such lines."""
    if isinstance(listing, str):
        listing = [r["c"] for r in lines(spark, listing).select(columns().alias("c")).collect()]  # one line a file
    out = None
    for file, xlabel, *rest in listing:
        one = coo_map(spark, file, xlabel, rest[0] if rest else None, **options)
        out = one if out is None else out.unionByName(one)
    return out


def paired_coo(spark: SparkSession, path, binsize: int | None = None) -> DataFrame:
    """Cells of lines ``chr1 start1 end1 chr2 start2 end2 value``; pairs within a
    chromosome, placed by their ends. Chromosomes needn't be contiguous."""
    c = lines(spark, path).withColumn("c", columns())
    at = lambda k: F.get("c", F.lit(k))
    rows = c.where(at(0) == at(3)).select(at(0).alias("map"), _long(at(2)).alias("pos_i"), _long(at(5)).alias("pos_j"), at(6).try_cast("double").alias("value"), "seq")
    if binsize is None:
        found = [C.infer_binsize(rows, p, "seq").agg(F.min("binsize")).first()[0] for p in ("pos_i", "pos_j")]
        binsize = min(x for x in found if x)
    return C.bin_contacts(rows, binsize)


def with_chr(name: Column) -> Column:
    return F.when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def filled_fields(rows: DataFrame) -> DataFrame:
    """(row, k, v, seq) of lines ``name row v0 v1 ...`` with tabs: field k of a row as text. Fields
    of a single 0, nearly all of a matrix file, are left out before a row is made of them."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, seq in zip(batch.column("value"), batch.column("seq").to_pylist()):
                data = line.as_buffer()
                flat = np.frombuffer(data, np.uint8)
                tabs = np.flatnonzero(flat == ord("\t"))
                if len(tabs) < 2:
                    continue
                first, last = tabs[1:] + 1, np.append(tabs[2:], len(flat))
                filled = (last - first != 1) | (flat[np.minimum(first, len(flat) - 1)] != ord("0"))
                k, text = np.flatnonzero(filled), memoryview(data)
                fields = [bytes(text[a:b]).decode() for a, b in zip(first[k].tolist(), last[k].tolist())]
                row = bytes(text[tabs[0] + 1 : tabs[1]]).decode()
                yield pa.RecordBatch.from_arrays([pa.repeat(row, len(k)), pa.array(k), pa.array(fields, pa.string()), pa.repeat(pa.scalar(seq, pa.int64()), len(k))], names=["row", "k", "v", "seq"])

    return rows.mapInArrow(run, "row string, k long, v string, seq long")


def homer(spark: SparkSession, path, binsize: int | None = None) -> DataFrame:
    """Cells of a matrix file: a header ``... Regions chr-pos ...`` and lines
    ``name chr-pos v1 v2 ...``; non-zero values within a chromosome."""
    rows = lines(spark, path).withColumn("c", F.split("value", "\t"))
    split = lambda x: (with_chr(F.regexp_extract(x, r"^(.*)-([0-9]+)$", 1)), F.regexp_extract(x, r"^(.*)-([0-9]+)$", 2).try_cast("long"))
    is_head = F.lower("value").contains("regions")
    head = rows.where(is_head).select(F.posexplode(F.slice("c", 3, 1 << 30)).alias("k", "x"))
    head = head.select("k", *[e.alias(n) for e, n in zip(split(F.col("x")), ("chr_j", "pos_j"))])
    body = filled_fields(lines(spark, path).where(~is_head))
    body = body.select("k", "seq", *[e.alias(n) for e, n in zip(split(F.col("row")), ("map", "pos_i"))], F.col("v").try_cast("double").alias("value")).where("value <> 0")
    both = body.join(head, (body["k"] == head["k"]) & (body["map"] == head["chr_j"]))
    if binsize is None:
        steps = head.select("chr_j", F.col("pos_j"), (F.col("pos_j") - F.lag("pos_j").over(Window.partitionBy("chr_j").orderBy("k"))).alias("d"))
        binsize = steps.where("d > 0").agg(F.min("d")).first()[0]
    # both halves of the matrix are in the file
    return C.bin_contacts(both.select("map", "pos_i", "pos_j", "value", "seq"), binsize)


def bins_and_contacts(spark: SparkSession, bin_path, contact_path) -> DataFrame:
    """Cells of a bin file ``cbin chr from to count`` and a contact file ``cbin1 cbin2
    expected observed``: observed counts of contacts within a chromosome, at the bins' ends.
    Bins must have one width (the last of a chromosome may be shorter)."""

    def table(path):
        rows = lines(spark, path).where(F.trim("value").rlike("^[0-9]")).withColumn("c", columns())
        return rows, lambda k: F.get("c", F.lit(k))

    rows, at = table(bin_path)
    bins = rows.select(_long(at(0)).alias("cbin"), with_chr(at(1)).alias("map"), _long(at(2)).alias("from"), _long(at(3)).alias("to"))
    last = F.lead("cbin").over(Window.partitionBy("map").orderBy("cbin")).isNull()
    widths = bins.withColumn("last", last).where(~F.col("last")).select((F.col("to") - F.col("from")).alias("w")).distinct().limit(2).collect()
    if len(widths) != 1:
        raise ValueError("bins of one width are needed")
    rows, at = table(contact_path)
    contacts = rows.select(_long(at(0)).alias("b1"), _long(at(1)).alias("b2"), at(3).try_cast("double").alias("value"), "seq")
    one = bins.select(F.col("cbin").alias("b1"), "map", F.col("to").alias("pos_i"))
    two = bins.select(F.col("cbin").alias("b2"), F.col("map").alias("map2"), F.col("to").alias("pos_j"))
    both = contacts.join(one, "b1").join(two, "b2").where("map = map2")
    return C.bin_contacts(both.select("map", "pos_i", "pos_j", "value", "seq"), widths[0]["w"])


def bed(spark: SparkSession, path, column: int = 7, chrom: str | None = None) -> DataFrame:
    """Intervals (chrom, start, end, value, seq) of BED, broadPeak and narrowPeak files; the
    value is in the 1-based ``column`` (13 for gappedPeak). Lines with 'track' or 'browser'
    and comments are skipped; starts are 0-based and ends open."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*#|\btrack\b|\bbrowser\b")).withColumn("c", columns())
    at = lambda k: F.get("c", F.lit(k))
    out = rows.select(at(0).alias("chrom"), _long(at(1)).alias("start"), _long(at(2)).alias("end"), at(column - 1).try_cast("double").alias("value"), "seq")
    out = out.where("start IS NOT NULL AND end IS NOT NULL AND value IS NOT NULL")
    return out if chrom is None else out.where(F.col("chrom") == chrom)


def wig(spark: SparkSession, path, chrom: str | None = None) -> DataFrame:
    """Intervals (chrom, start, end, value, seq) of wiggle files with variableStep,
    fixedStep and bedGraph sections, also such as ``#bedGraph section chrN:a-b``. start is
    0-based, end open. A section's head reaches to the next one: a running maximum over
    the lines of one file, taken split by split and then over the splits' last heads."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_path").alias("file"))
    is_head = F.col("value").rlike(r"^\s*(variableStep|fixedStep|#bedGraph|track\b|browser\b)")
    part = F.shiftright("seq", 33)
    rows = rows.withColumn("part", part).withColumn("head", F.when(is_head, F.struct("seq", "value")))
    within = F.max("head").over(Window.partitionBy("file", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("in_part", within)
    # one row per split of a file
    ends = rows.groupBy("file", "part").agg(F.max("head").alias("last"))
    carried = F.max("last").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("file", "part", carried.alias("carried"))
    rows = rows.join(ends, ["file", "part"]).withColumn("h", F.coalesce("in_part", "carried"))
    rows = rows.where(~is_head & ~F.col("value").rlike(r"^\s*(#|$)")).withColumn("c", columns())
    get = lambda key, default: F.coalesce(F.regexp_extract(F.col("h.value"), rf"\b{key}=(\S+)", 1).try_cast("long"), F.lit(default))
    at = lambda k: F.get("c", F.lit(k))
    kind = F.regexp_extract(F.coalesce(F.col("h.value"), F.lit("")), r"^\s*(variableStep|fixedStep)", 1)
    # the place in its section: lines of one section are numbered within their split, and
    # splits of a section by the sums of the splits before
    counts = rows.groupBy("file", F.col("h.seq").alias("hs"), "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("file", "hs").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", F.coalesce("hs", F.lit(-1)).alias("hs"), "part", before.alias("before"))
    rows = rows.withColumn("hs", F.coalesce(F.col("h.seq"), F.lit(-1))).join(counts, ["file", "hs", "part"])
    k = F.row_number().over(Window.partitionBy("file", "hs", "part").orderBy("seq")) - 1 + F.col("before")
    rows = rows.withColumn("k", k)
    named = F.regexp_extract(F.col("h.value"), r"\bchrom=(\S+)", 1)
    first = F.when(kind == "variableStep", _long(at(0)) - 1).when(kind == "fixedStep", get("start", 1) - 1 + F.col("k") * get("step", 1)).otherwise(_long(at(1)))
    out = rows.select(
        F.when(kind == "", at(0)).otherwise(named).alias("chrom"),
        first.alias("start"),
        F.when(kind == "", _long(at(2))).otherwise(first + get("span", 1)).alias("end"),
        F.when(kind == "variableStep", at(1)).when(kind == "fixedStep", at(0)).otherwise(at(3)).try_cast("double").alias("value"),
        "seq",
    ).where("start IS NOT NULL AND end IS NOT NULL AND value IS NOT NULL")
    return out if chrom is None else out.where(F.col("chrom") == chrom)


def text_track(spark: SparkSession, path, name: str, binsize: int, bins: int | None = None, check: bool = True) -> DataFrame:
    """Track of lines ``position value``; the last line of a bin counts. With ``bins``, what
    lies beyond is dropped. A least step of the lines other than binsize is an error, unless
    ``check`` is off, as for lines in no order."""
    c = lines(spark, path).withColumn("c", columns())
    rows = c.select(_long(F.get("c", F.lit(0))).alias("pos"), F.get("c", F.lit(1)).try_cast("double").alias("v"), "seq").where("pos IS NOT NULL AND v IS NOT NULL")
    found = C.infer_binsize(rows.withColumn("map", F.lit(0)), "pos", "seq").first() if check else None
    if found and found["binsize"] and found["binsize"] != binsize:
        raise ValueError(f"the file has steps of {found['binsize']}, not of {binsize}")
    out = rows.groupBy(F.floor(F.col("pos") / binsize).cast("long").alias("bin")).agg(F.max_by("v", "seq").alias("v"))
    out = out if bins is None else out.where(F.col("bin") < bins)
    return out.select(F.lit(name).alias("chrom"), F.lit(binsize).cast("long").alias("binsize"), F.lit("text").alias("name"), "bin", "v")


def encode_files(spark: SparkSession, path, assembly: str, assays: list[str] | None = None) -> DataFrame:
    """Rows of an ENCODE metadata table that describe bigWig files of an assembly: file,
    experiment, assay, target, output, replicates, url. See tracks.choose_replicates."""
    t = spark.read.csv(path, sep="\t", header=True)
    rows = t.where((F.col("File format") == "bigWig") & (F.col("Assembly") == assembly))
    if assays is not None:
        rows = rows.where(F.col("Assay").isin(assays))
    names = {"File accession": "file", "Experiment accession": "experiment", "Assay": "assay", "Experiment target": "target", "Output type": "output", "Biological replicate(s)": "replicates", "File download URL": "url"}
    rows = rows.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])
    return rows.withColumn("target", F.regexp_extract(F.coalesce("target", F.lit("")), "^([^-]*)", 1))


def signal_types(files: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """encode_files rows with a column type, the kind of signal with the target or, for
    assays without one, the date (rows (file, date), if known); what is no signal goes."""
    dated = files.join(dates, "file", "left") if dates is not None else files.withColumn("date", F.lit(None).cast("string"))
    date = F.coalesce("date", F.lit(""))
    has = lambda x: F.col("output").contains(x)
    reads = F.when(has("all reads"), "all-reads").when(has("unique reads"), "uniq-reads")
    strand = F.when(has("plus strand"), "plus-").when(has("minus strand"), "minus-").otherwise("")
    signal = lambda kind: F.when(kind.isNotNull(), F.concat(kind, F.lit("-signal"))).otherwise("signal")
    raw = F.when(has("all reads"), "all-reads").when(has("raw"), "raw").when(has("unique reads"), "uniq-reads")
    with_target = F.col("target") != ""
    kind = (
        F.when((F.col("assay") == "ChIP-seq") & has("signal p-value"), F.concat(F.lit("signal-"), "target"))
        .when((F.col("assay") == "ChIP-seq") & has("fold change"), F.concat(F.lit("fold-"), "target"))
        .when((F.col("assay") != "ChIP-seq") & has("signal") & with_target, F.concat_ws("-", signal(reads), "target"))
        .when(F.col("assay").contains("DNase") & has("signal"), F.concat_ws("-", signal(raw), date))
        .when((F.col("assay") != "ChIP-seq") & has("signal"), F.concat_ws("-", F.when(reads.isNotNull(), F.concat(strand, reads)).otherwise("signal"), date))
    )
    return dated.withColumn("type", F.regexp_replace(kind, "-$", "")).where("type IS NOT NULL").drop("date")
