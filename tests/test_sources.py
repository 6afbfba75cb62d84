"""Importers on samples, the container and its sinks, streams."""

import gzip
import io
import os
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest

from binweave.operators import cells as C
from binweave.sources import archive, container, hic, text
from binweave.streaming.tracks import stream_track


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def cellset(df):
    return {(r["map"], r["i"], r["j"]): r["v"] for r in df.collect()}


def test_coo(spark, tmp_path):
    p = put(tmp_path, "a.txt", "0 100 8.0\n\n100\t200  2.0\n200 200 1\n100 0 4.0\n")
    want = {("chr1", 0, 1): 6.0, ("chr1", 1, 0): 6.0, ("chr1", 1, 2): 2.0, ("chr1", 2, 1): 2.0, ("chr1", 2, 2): 1.0}
    assert cellset(text.coo_map(spark, p, "chr1")) == want
    q = put(tmp_path, "i.txt", "0 1 3.5\n")
    assert cellset(text.coo_map(spark, q, "x", "y", "1kb", "index", "inter")) == {("x-y", 0, 1): 3.5}
    with pytest.raises(ValueError):
        text.coo(spark, q, "x", coordinate="index")
    listing = put(tmp_path, "list.txt", f"{p} chr1\n{p} chr2\n")
    assert {m for m, _, _ in cellset(text.coo_list(spark, listing, resolution="100b"))} == {"chr1", "chr2"}


def test_paired_coo(spark, tmp_path):
    p = put(tmp_path, "p.txt", "chr4 60 75 chr4 105 120 0.5\nchr4 60 75 chr5 105 120 9\nchr5 0 15 chr5 0 15 2\nchr4 75 90 chr4 105 120 1.5\n")
    assert cellset(text.paired_coo(spark, p, 15)) == {("chr4", 5, 8): 0.5, ("chr4", 8, 5): 0.5, ("chr4", 6, 8): 1.5, ("chr4", 8, 6): 1.5, ("chr5", 1, 1): 2.0}


def test_homer(spark, tmp_path):
    head = "HiCMatrix\tRegions\tchr1-0\tchr1-10\t2-0\n"
    p = put(tmp_path, "h.txt", head + "a\tchr1-0\t1\t2\t7\nb\tchr1-10\t2\t0\t8\nc\t2-0\t7\t8\t3\n")
    assert cellset(text.homer(spark, p)) == {("chr1", 0, 0): 1.0, ("chr1", 0, 1): 2.0, ("chr1", 1, 0): 2.0, ("chr2", 0, 0): 3.0}


def test_bins_and_contacts(spark, tmp_path):
    b = put(tmp_path, "b.txt", "cbin\tchr\tfrom.coord\tto.coord\tcount\n1\t2L\t0\t160\t7\n2\t2L\t160\t320\t7\n3\tX\t0\t160\t1\n")
    c = put(tmp_path, "c.txt", "cbin1\tcbin2\texpected_count\tobserved_count\n1\t2\t83.7\t5661\n2\t3\t1\t9\n3\t3\t1\t4\n")
    assert cellset(text.bins_and_contacts(spark, b, c)) == {("chr2L", 1, 2): 5661.0, ("chr2L", 2, 1): 5661.0, ("chrX", 1, 1): 4.0}


def test_bed_and_wig(spark, tmp_path):
    p = put(tmp_path, "x.bed", "track name=a\nchr1\t0\t10\tn\t0\t.\t2.5\nchr2\t5\t6\tn\t0\t.\t1\n")
    assert [(r["chrom"], r["start"], r["end"], r["value"]) for r in text.bed(spark, p, chrom="chr1").collect()] == [("chr1", 0, 10, 2.5)]
    w = put(tmp_path, "x.wig", "track type=wiggle_0\nvariableStep chrom=chr1 span=2\n5 1.5\n9 2\nfixedStep chrom=chr2 start=3 step=10 span=5\n7\n8\n#bedGraph section chr3:0-9\nchr3 0 9 4\n")
    got = [(r["chrom"], r["start"], r["end"], r["value"]) for r in text.wig(spark, w).orderBy("seq").collect()]
    assert got == [("chr1", 4, 6, 1.5), ("chr1", 8, 10, 2.0), ("chr2", 2, 7, 7.0), ("chr2", 12, 17, 8.0), ("chr3", 0, 9, 4.0)]


def test_wig_in_splits(spark, tmp_path):
    body = "fixedStep chrom=chr1 start=1 step=1\n" + "".join(f"{k}\n" for k in range(1, 3001)) + "fixedStep chrom=chr2 start=1 step=2\n" + "".join(f"{k}\n" for k in range(1, 2001))
    p = put(tmp_path, "big.wig", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = text.wig(spark, p).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 5000
    assert all(r["start"] == (r["value"] - 1) * (1 if r["chrom"] == "chr1" else 2) for r in got)


def test_text_track(spark, tmp_path):
    p = put(tmp_path, "t.txt", "0 1.0\n10 2.0\n20 3.0\n21 9.0\n")
    with pytest.raises(ValueError):
        text.text_track(spark, p, "chr1", 10)
    q = put(tmp_path, "u.txt", "0 1.0\n10 2.0\n20 3.0\n")
    assert {r["bin"]: r["v"] for r in text.text_track(spark, q, "chr1", 10, 2).collect()} == {0: 1.0, 1: 2.0}


def test_encode_table(spark, tmp_path):
    head = "File accession\tFile format\tOutput type\tExperiment accession\tAssay\tExperiment target\tBiological replicate(s)\tAssembly\tFile download URL\n"
    p = put(tmp_path, "m.tsv", head + "F1\tbigWig\tsignal\tE1\tChIP-seq\tCTCF-human\t1\thg19\tu\nF2\tbam\tx\tE1\tChIP-seq\tCTCF-human\t1\thg19\tu\n")
    assert [(r["file"], r["target"]) for r in text.encode_files(spark, p, "hg19").collect()] == [("F1", "CTCF")]
    rows = [
        ("F1", "ChIP-seq", "CTCF", "signal p-value", "signal-CTCF"), ("F2", "ChIP-seq", "CTCF", "fold change over control", "fold-CTCF"), ("F3", "ChIP-seq", "CTCF", "peaks", None),
        ("F4", "RNA-seq", "", "plus strand signal of unique reads", "plus-uniq-reads-2013"), ("F5", "RNA-seq", "", "signal", "signal"), ("F6", "DNase-seq", "", "raw signal", "raw-signal"),
        ("F7", "siRNA knockdown followed by RNA-seq", "ABC", "signal of all reads", "all-reads-signal-ABC"), ("F8", "DNase-seq", "", "signal of unique reads", "uniq-reads-signal"),
    ]
    files = spark.createDataFrame(rows, "file string, assay string, target string, output string, want string")
    got = text.signal_types(files, spark.createDataFrame([("F4", "2013")], "file string, date string")).collect()
    assert len(got) == 7 and all(r["type"] == r["want"] for r in got)


def bigwig_file(path):
    """A file of two chromosomes with blocks of all three kinds."""
    from binweave.sources import bigwig

    def block(number, start, kind, items, step=0, span=1):
        return zlib.compress(struct.pack("<IIIIIBBH", number, start, 0, step, span, kind, 0, len(items)) + b"".join(struct.pack({1: "<IIf", 2: "<If", 3: "<f"}[kind], *i) for i in items))

    data = [block(0, 0, 1, [(0, 5, 1.5), (7, 9, 2.0)]), block(0, 100, 2, [(100, 3.0), (120, 4.0)], span=10), block(1, 50, 3, [(5.0,), (6.0,)], step=20, span=4)]
    tree = struct.pack("<IIIIQQ", bigwig.TREE, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"chr1" + struct.pack("<II", 0, 1000) + b"chrX" + struct.pack("<II", 1, 500)
    places, at = [], 64 + len(tree)
    for d in data:
        places.append((at, len(d)))
        at += len(d)
    leaf = lambda rows: struct.pack("<BBH", 1, 0, len(rows)) + b"".join(struct.pack("<IIIIQQ", c, 0, c, 999, *p) for c, p in rows)
    one, two = leaf([(0, places[0]), (0, places[1])]), leaf([(1, places[2])])
    root = at + 48
    first = root + 4 + 2 * 24
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX, 2, 3, 0, 0, 1, 999, at, 1, 0) + struct.pack("<BBH", 0, 0, 2) + struct.pack("<IIIIQ", 0, 0, 0, 999, first) + struct.pack("<IIIIQ", 1, 0, 1, 999, first + len(one)) + one + two
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, 64 + len(tree), at, 0, 0, 0, 0, 4096, 0) + tree + b"".join(data) + index)


def test_bigwig(spark, tmp_path):
    from binweave.sources import bigwig

    p = str(tmp_path / "x.bw")
    bigwig_file(p)
    got = [(r["chrom"], r["start"], r["end"], r["value"]) for r in bigwig.bigwig(spark, p).orderBy("seq").collect()]
    assert sorted(got) == [("chr1", 0, 5, 1.5), ("chr1", 7, 9, 2.0), ("chr1", 100, 110, 3.0), ("chr1", 120, 130, 4.0), ("chrX", 50, 54, 5.0), ("chrX", 70, 74, 6.0)]
    assert bigwig.bigwig(spark, p, "chrX").count() == 2 and bigwig.chromosome_sizes(p) == {"chr1": 1000, "chrX": 500}


def test_encode_and_config_commands(spark, tmp_path, capsys):
    from binweave.__main__ import run

    head = "File accession\tFile format\tOutput type\tExperiment accession\tAssay\tExperiment target\tBiological replicate(s)\tAssembly\tFile download URL\n"
    row = "F{0}\tbigWig\tsignal p-value\tE1\tChIP-seq\tCTCF-human\t{1}\t{2}\tu\n"
    table = put(tmp_path, "m.tsv", head + row.format(1, "1", "hg19") + row.format(2, "1, 2", "hg19") + row.format(3, "1, 2, 3", "mm9"))
    for k in (1, 2):
        bigwig_file(str(tmp_path / f"F{k}.bigWig"))
    out = str(tmp_path / "enc")
    run(spark, ["encode", table, out, "--files", str(tmp_path), "-r", "1kb", "-m", "max"])
    assert os.listdir(out) == ["signal-CTCF-E1-F2"] and "signal-CTCF-E1-F2" in capsys.readouterr().out
    got = {(r["chrom"], r["bin"]): r["v"] for r in container.read_track(spark, f"{out}/signal-CTCF-E1-F2").collect()}
    assert got == {("chr1", 0): 4.0, ("chrX", 0): 6.0}
    run(spark, ["encode", table, out, "--files", str(tmp_path), "-r", "1kb"])
    assert capsys.readouterr().out.strip() == ""
    run(spark, ["config"])
    assert "spark.checkpoint.dir" in capsys.readouterr().out


def test_track_catalogue(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("chr1", 10, "max", 0, 1.0), ("chr1", 20, "max", 0, 2.0), ("chr1", 20, "min", 0, 2.0), ("chr2", 10, "max", 3, 1.0)]
    container.write_track(spark.createDataFrame(rows, "chrom string, binsize long, name string, bin long, v double"), path)
    assert container.track_sizes(spark, path, "chr1") == [10, 20] and container.track_names(spark, path, "chr1", 20) == ["max", "min"]
    assert container.has_track(spark, path, "chr2", 10, "max") and not container.has_track(spark, path, "chr2", 20)
    for wanted in (("chr3",), ("chr1", 30), ("chr1", 10, "min")):
        with pytest.raises(container.TrackNotFound):
            container.track_entries(spark, path, *wanted)


def test_a_map_is_replaced_by_what_it_held(spark, tmp_path):
    path = str(tmp_path / "c")
    container.add_map(C.from_matrix(spark, np.ones((20, 20)), "a b", 10), path, stop=8)
    own = container.load_map(spark, path, "a b").withColumn("v", C.F.col("v") * 2)
    container.add_map(own, path, stop=8)
    assert {r["v"] for r in container.load_map(spark, path, "a b", 10).collect()} == {2.0}
    assert sorted(r["binsize"] for r in container.read_meta(spark, path).collect()) == [10, 20, 40]
    broken = container.load_map(spark, path, "a b").withColumn("v", C.F.raise_error(C.F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        container.add_map(broken, path, None)
    assert container.load_map(spark, path, "a b", 10).count() == 400


def test_levels_that_are_there_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.random((12, 12))
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    container.add_map(C.from_matrix(spark, m + m.T, "a", 10), source, stop=8)
    container.correlate_container(spark, source, target)
    first = {(r["map"], r["binsize"]): r["maxvalue"] for r in container.read_meta(spark, target).collect()}
    assert len(first) == 2
    container.add_map(C.from_matrix(spark, m @ m.T, "b", 10), source, stop=8)
    container.correlate_container(spark, source, target)
    both = {(r["map"], r["binsize"]): r["maxvalue"] for r in container.read_meta(spark, target).collect()}
    assert len(both) == 4 and both.items() >= first.items()
    want = np.corrcoef(m + m.T)[3, 1]
    assert abs(container.load_map(spark, target, "a", 10).where("i = 3 AND j = 1").first()["v"] - want) < 6e-5


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "0 10 1\n10 10 2\n")
        z.writestr("two.txt.gz", gzip.compress(b"0 0 5\n"))
    got = archive.archive_lines(spark, str(tmp_path / "a.zip")).collect()
    assert {(r["member"], r["value"]) for r in got} == {("one.txt", "0 10 1"), ("one.txt", "10 10 2"), ("two.txt.gz", "0 0 5")}
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x.txt")
        info.size = 6
        t.addfile(info, io.BytesIO(b"0 0 7\n"))
    rows = archive.archive_lines(spark, str(tmp_path / "b.tar.gz"), ["x.txt", "gone.txt"])
    assert [r["value"] for r in text.coo(spark, None, "m", rows=rows).collect()] == [7.0]


def hic_file(path, version):
    """A file of two chromosomes with one matrix, two blocks and one norm vector."""
    text_ = lambda s: s.encode() + b"\0"

    def block(points):
        if version < 7:
            raw = struct.pack("<i", len(points)) + b"".join(struct.pack("<iif", *p) for p in points)
        else:
            x0, y0 = min(p[0] for p in points), min(p[1] for p in points)
            rows = {}
            for x, y, c in points:
                rows.setdefault(y - y0, []).append((x - x0, c))
            raw = struct.pack("<iiibb", len(points), x0, y0, 1, 1) + struct.pack("<h", len(rows))
            for y, row in rows.items():
                raw += struct.pack("<hh", y, len(row)) + b"".join(struct.pack("<hf", *r) for r in row)
        return zlib.compress(raw)

    dense = zlib.compress(struct.pack("<iiibb", 3, 4, 4, 0, 2) + struct.pack("<ih", 4, 2) + struct.pack("<4h", 9, -32768, 8, 7)) if version >= 7 else block([(4, 4, 9.0), (4, 5, 8.0), (5, 5, 7.0)])
    blocks = [block([(0, 0, 5.0), (0, 1, 3.0), (1, 2, 2.0)]), dense]
    head = text_("HIC") + struct.pack("<i", version)
    tail = text_("hg19") + struct.pack("<i", 1) + text_("software") + text_("test") + struct.pack("<i", 2) + text_("chrA") + struct.pack("<i", 60) + text_("chrB") + struct.pack("<i", 40) + struct.pack("<ii", 1, 10) + struct.pack("<i", 0)
    body = len(head) + 8 + len(tail)
    places, data = [], b""
    for b in blocks:
        places.append((body + len(data), len(b)))
        data += b
    matrix = body + len(data)
    data += struct.pack("<iii", 0, 0, 1) + text_("BP") + struct.pack("<iffffiiii", 0, 0, 0, 0, 0, 10, 3, 3, len(places)) + b"".join(struct.pack("<iqi", k, at, size) for k, (at, size) in enumerate(places))
    vector = body + len(data)
    data += struct.pack("<i6d", 6, 1, 2, 0, 1, 1, 1)
    footer = body + len(data)
    data += struct.pack("<ii", 0, 1) + text_("0_0") + struct.pack("<qi", matrix, 0) + struct.pack("<i", 0) + struct.pack("<i", 0) + struct.pack("<i", 1) + text_("KR") + struct.pack("<i", 0) + text_("BP") + struct.pack("<iqi", 10, vector, 0)
    with open(path, "wb") as f:
        f.write(head + struct.pack("<q", footer) + tail + data)


@pytest.mark.parametrize("version", [6, 8])
def test_hic(spark, tmp_path, version):
    p = str(tmp_path / "x.hic")
    hic_file(p, version)
    header = hic.read_header(p)
    assert [n for n, _ in header.chromosomes] == ["chrA", "chrB"] and header.attributes == {"software": "test"}
    got = cellset(hic.hic_map(spark, p, "chrA"))
    upper = {(0, 0): 5.0, (0, 1): 3.0, (1, 2): 2.0, (4, 4): 9.0, (4, 5): 8.0, (5, 5): 7.0}
    assert got == {("chrA", i, j): v for (a, b), v in upper.items() for i, j in {(a, b), (b, a)}}
    normed = cellset(hic.hic_map(spark, p, "A", norm="KR"))
    assert normed[("A", 0, 1)] == 1.5 and normed[("A", 1, 2)] == float("inf")
    with pytest.raises(LookupError):
        hic.block_index(p, header, "chrA", "chrB", 10)
    with pytest.raises(LookupError):
        hic.norm_vector(p, header, "VC", "chrA", 10)
    assert hic.hic_container(spark, p).count() == len(got)


def test_container(spark, tmp_path):
    path = str(tmp_path / "c")
    a = C.from_matrix(spark, np.ones((20, 20)), "a", 10)
    container.add_map(a, path, stop=8)
    container.add_map(C.from_matrix(spark, np.full((4, 4), 2.0), "b", 10), path)
    assert sorted((r["map"], r["binsize"]) for r in container.read_meta(spark, path).collect()) == [("a", 10), ("a", 20), ("a", 40), ("b", 10)]
    assert container.load_map(spark, path, "a").count() == 400 and container.load_map(spark, path, "a", 50) is None
    container.coarsen_stored(spark, path, 30)
    assert container.load_map(spark, path, "a", 30).agg({"v": "sum"}).first()[0] == 361
    assert container.load_map(spark, path, "b", 30) is not None
    container.add_map(C.from_matrix(spark, np.full((4, 4), 3.0), "b", 10), path)
    assert container.load_map(spark, path, "b", 30) is None
    assert {r["v"] for r in container.read_cells(spark, path, "b").collect()} == {3.0}
    out = str(tmp_path / "n")
    container.normalise_container(spark, path, out, "vc")
    assert container.load_map(spark, out, "b", 10).first()["v"] == 3 / 144
    container.recompress(spark, path, str(tmp_path / "z"), "gzip")
    assert container.read_cells(spark, str(tmp_path / "z")).count() == container.read_cells(spark, path).count()
    container.export_coo(C.from_matrix(spark, np.array([[1.0, 0], [2.0, 3.0]]), "m", 1), str(tmp_path / "coo"))
    lines = "".join(open(tmp_path / "coo" / f).read() for f in sorted(os.listdir(tmp_path / "coo")) if f.endswith(".csv"))
    assert lines == "0\t0\t1.0\n1\t0\t2.0\n1\t1\t3.0\n"
    row = {"nx": 2, "ny": 2, "binsize": 10}
    assert container.from_json(container.meta_json(row, [True, False]))["bNoData"] == [True, False]


def test_track_store(spark, tmp_path):
    path = str(tmp_path / "t")
    t = spark.createDataFrame([("chr1", 10, "max", 0, 1.0), ("chr1", 20, "max", 0, 2.0)], "chrom string, binsize long, name string, bin long, v double")
    container.write_track(t, path)
    container.write_track(t.where("binsize = 10").withColumn("v", t["v"] * 5), path)
    assert sorted(r["v"] for r in container.read_track(spark, path).collect()) == [2.0, 5.0]
    assert container.track_tree(spark, path).count() == 2


def test_stream(spark, tmp_path, data):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{data}/events.parquet").selectExpr("ts", "event_type AS chrom", "user_id AS pos", "value")
    events.write.parquet(src)
    live = stream_track(spark.readStream.schema(events.schema).parquet(src), 10)
    q = live.writeStream.format("memory").queryName("live_track").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("live_track").agg({"n": "sum"}).first()[0]
    assert got == events.where("value > 0").count()


def test_single_map_file(spark, tmp_path):
    from binweave.sources import single

    m = np.arange(25, dtype=float).reshape(5, 5)
    m = m + m.T
    p = str(tmp_path / "x.ccmap")
    for compress in (False, True):
        single.save_single(C.from_matrix(spark, m, "chr1", 10), p, compress)
        got = cellset(single.read_single(spark, p, rows_per_task=2))
        assert got == {("chr1", i, j): m[i, j] for i in range(5) for j in range(5) if m[i, j]}
    assert (tmp_path / "#x.ccmap.1#").exists()
    assert single.as_cells(spark, p).count() == len(got)


def test_commands(spark, tmp_path):
    from binweave.__main__ import run
    from binweave.sources import container

    rng = np.random.default_rng(3)
    a = rng.integers(1, 9, (12, 12))
    a = a + a.T
    body = "".join(f"{i * 10} {j * 10} {a[i, j]}\n" for i in range(12) for j in range(i, 12))
    listing = put(tmp_path, "l.txt", put(tmp_path, "a.coo", body) + " chr1\n")
    out = str(tmp_path / "store")
    run(spark, ["coo", listing, out, "--resolution", "10b"])
    assert container.load_map(spark, out, "chr1", 10).count() == 144
    for method, extra in (("vc", ["--sqrt"]), ("mcfs", []), ("ic", ["--tolerance", "1e-3"]), ("kr", ["--occupancy", "0.2"])):
        run(spark, ["normalise", method, out, str(tmp_path / method), *extra])
        assert container.load_map(spark, str(tmp_path / method), "chr1", 10).count() > 100
    run(spark, ["correlate", out, str(tmp_path / "kr"), "-k", "pearson", "-o", str(tmp_path / "corr")])
    assert spark.read.csv(str(tmp_path / "corr"), sep="\t", header=True, inferSchema=True).first()["corr"] > 0.3
    run(spark, ["export", out, "chr1", str(tmp_path / "coo_out")])
    assert spark.read.csv(str(tmp_path / "coo_out"), sep="\t").count() == 78
    bed = put(tmp_path, "x.bed", "chr1\t0\t10\tn\t0\t.\t2.5\nchr1\t5\t30\tn\t0\t.\t1\n")
    run(spark, ["bed", bed, str(tmp_path / "tracks"), "-r", "10b", "1kb", "-m", "amean", "max"])
    got = {(r["binsize"], r["name"], r["bin"]): r["v"] for r in container.read_track(spark, str(tmp_path / "tracks")).collect()}
    assert got[10, "max", 0] == 2.5 and got[10, "amean", 0] == (5 * 2.5 + 5 * 1.75) / 10 and got[1000, "max", 0] == 2.5


def test_wide_lines_give_filled_fields_only(spark):
    rows = [("r\tm-0\t" + "0\t" * 5000 + "2.5\t0\t0.0\t\t7", 3), ("r\tm-1\t0\t0", 4), ("r\tm-2\t1", 5), ("r\tm-3\t", 6), ("short", 7), ("r\tm-4", 8)]
    got = text.filled_fields(spark.createDataFrame(rows, "value string, seq long")).collect()
    assert sorted(map(tuple, got)) == [("m-0", 5000, "2.5", 3), ("m-0", 5002, "0.0", 3), ("m-0", 5003, "", 3), ("m-0", 5004, "7", 3), ("m-2", 0, "1", 5), ("m-3", 0, "", 6)]


def test_a_pyramid_computes_its_cells_once(spark, tmp_path):
    seen, n = spark.sparkContext.accumulator(0), 40

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    cells = C.from_matrix(spark, np.ones((n, n)), "m", 10)
    container.add_map(cells.mapInPandas(counted, cells.schema), f"file://{tmp_path}/store", stop=12)
    assert seen.value == n * n
    assert {r["binsize"] for r in container.read_meta(spark, f"file://{tmp_path}/store").collect()} == {10, 20, 40}
