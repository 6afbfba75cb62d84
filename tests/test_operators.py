"""Operators against small cases worked out by hand and against dense numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from binweave.functions.probability import correlation_p
from binweave.functions.resolution import binsize_of, natural_key, resolution_of, to_binsize, to_resolution
from binweave.operators import cells as C
from binweave.operators import coarsen as Z
from binweave.operators import markov as M
from binweave.operators import masks as K
from binweave.operators import navigation as N
from binweave.operators import normalise as NM
from binweave.operators import stats as S
from binweave.operators import structure as T
from binweave.operators import tracks as R


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 50, (12, 12)).astype(float)
    return a + a.T


@pytest.fixture(scope="module")
def cells(spark, matrix):
    return C.from_matrix(spark, matrix, "m", 10).persist()


def test_resolutions(spark):
    sizes = {"1b": 1, "10b": 10, "1kb": 1000, "16kb": 16000, "1.23kb": 1230, "1.6mb": 1600000, "1.457mb": 1457000}
    assert {k: to_binsize(k) for k in sizes} == sizes
    texts = {1: "1b", 10: "10b", 10000: "10kb", 100000: "100kb", 125500: "125.5kb", 1000000: "1mb", 1634300: "1.6343mb"}
    assert {k: to_resolution(k) for k in texts} == texts
    with pytest.raises(ValueError):
        to_binsize("10xb")
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, "junk")], "b long, r string")
    got = rows.select("b", "r", binsize_of(rows["r"]).alias("x"), resolution_of(rows["b"]).alias("y")).collect()
    assert all((g["x"] == g["b"]) and (g["y"] == g["r"]) for g in got if g["b"])
    assert [g["x"] for g in got if g["r"] == "junk"] == [None]


def test_natural_order(spark):
    names = spark.createDataFrame([("chr10",), ("chr2",), ("chr1",), ("chr02b",)], "n string")
    assert [r[0] for r in names.orderBy(natural_key(names["n"])).collect()] == ["chr1", "chr2", "chr02b", "chr10"]


def test_p_values():
    assert math.isclose(correlation_p(0.5, 10), 0.1411132812, rel_tol=1e-8)
    assert correlation_p(1.0, 10) == 0 and math.isnan(correlation_p(0.3, 2))


def test_running_mean_of_duplicates(spark):
    rows = spark.createDataFrame([("m", 5, 25, 4.0, 0), ("m", 25, 5, 8.0, 1), ("m", 5, 25, 1.0, 2), ("m", 1, 1, 0.0, 3), ("m", 2, 3, 6.0, 4)], "map string, pos_i long, pos_j long, value double, seq long")
    got = {(r["i"], r["j"]): r["v"] for r in C.bin_contacts(rows, 10).collect()}
    assert got == {(0, 2): 3.5, (2, 0): 3.5, (0, 0): 6.0}
    assert C.infer_binsize(rows.where("pos_i <> pos_j"), "pos_i", "seq").first()["binsize"] == 3


def test_coarsen_rules(spark):
    ones = C.from_matrix(spark, np.ones((5, 5)), "m", 1)
    assert np.array_equal(dense(Z.coarsen(ones, 2), 3), [[0, 0, 0], [0, 4, 4], [0, 4, 4]])
    four = C.from_matrix(spark, np.ones((4, 4)), "m", 1)
    mean = dense(Z.coarsen(four, 2, "mean"), 3)
    assert mean[1, 1] == 1 and mean[1, 2] == 0.5 and mean[2, 1] == 1 and mean[2, 2] == 0.5
    assert np.array_equal(dense(Z.coarsen(four, 2, zero_based=True), 2), [[4, 4], [4, 4]])
    bins = spark.createDataFrame([("m", 1, 0, True), ("m", 1, 1, False), ("m", 1, 2, True), ("m", 1, 3, False)], "map string, binsize long, i long, no_data boolean")
    assert {r["i"]: r["no_data"] for r in Z.coarsen_bins(bins, 2).collect()} == {1: True, 2: False}


def test_pyramid_keeps_mass(cells, matrix):
    levels = Z.pyramid(cells, "sum", 4).groupBy("binsize").sum("v").collect()
    assert {r[0]: r[1] for r in levels} == {10: matrix.sum(), 20: matrix[1:, 1:].sum(), 40: matrix[1:, 1:][:, :].sum() - 0 if False else dense_mass(matrix)}


def dense_mass(matrix):
    # bin 0 of the second level is empty, so nothing more is lost
    return matrix[1:, 1:].sum()


def test_track_downsampling(spark):
    t = spark.createDataFrame([("c", 1, "x", k, float(v)) for k, v in enumerate([5, 1, 0, 4])], "chrom string, binsize long, name string, bin long, v double")
    assert sorted((r["bin"], r["v"]) for r in Z.coarsen_track(t, 2, "mean").collect()) == [(0, 3.0), (1, 4.0)]
    assert sorted((r["bin"], r["v"]) for r in Z.coarsen_track(t, 2, "max", zero_based=False).collect()) == [(1, 1.0), (2, 4.0)]


def test_coverage_and_iterative_correction(cells, matrix):
    r = matrix.sum(1)
    assert np.allclose(dense(NM.coverage(cells), 12), matrix / np.outer(r, r))
    got = dense(NM.correct(cells, 1e-10), 12)
    assert np.isclose(got.sum(), matrix.sum()) and np.allclose(got.sum(0), got.sum(0).mean())


def test_knight_ruiz(spark, cells):
    got = dense(NM.balance(cells), 12)
    assert np.allclose(got.sum(0), 1, atol=1e-10) and np.allclose(got, got.T)
    swap = C.from_matrix(spark, np.array([[0.0, 1.0], [1.0, 0.0]]), "m", 1)
    assert np.allclose(dense(NM.balance(swap), 2), [[0, 1], [1, 0]])


def test_knight_ruiz_sparse(spark):
    rng = np.random.default_rng(2)
    a = rng.random((40, 40)) * (rng.random((40, 40)) < 0.3) * np.exp(3 * rng.random((40, 1)))
    a = a + a.T + np.diag(rng.random(40) + 0.1)
    got = dense(NM.balance(C.from_matrix(spark, a, "m", 1)), 40)
    assert np.allclose(got.sum(0), 1, atol=1e-9)


def test_over_expected(cells, matrix):
    m = {k: np.median(np.diag(matrix, k)) for k in range(12)}
    i, j = np.indices((12, 12))
    e = np.vectorize(m.get)(abs(i - j))
    assert np.allclose(dense(NM.over_expected(cells), 12), matrix / e)
    assert np.allclose(dense(NM.over_expected(cells, kind="o-e"), 12), np.where(matrix - e < 0, 1, matrix - e))


def test_correlation_matrix_rule(spark):
    # y has a fifth value that x lacks: its variance counts it, the covariance does not
    rows = [("m", 1, 0, j, float(v)) for j, v in enumerate([1, 2, 3, 4])] + [("m", 1, 1, j, float(v)) for j, v in enumerate([2, 4, 6, 8, 10])]
    c = spark.createDataFrame(rows, "map string, binsize long, i long, j long, v double")
    assert {(r["i1"], r["i2"]): round(r["cov"], 9) for r in S.covariance_matrix(c).collect()} == {(0, 0): 1.25, (1, 0): 2.5, (1, 1): 8.0}
    assert math.isclose(S.correlation_matrix(c).first()["corr"], 2.5 / math.sqrt(10))
    assert math.isclose(S.correlation_matrix(c, pairwise=True).first()["corr"], 1.0)


def test_tiles_join_up(spark, matrix):
    rng = np.random.default_rng(1)
    big = rng.integers(0, 9, (30, 30)).astype(float)
    c = C.from_matrix(spark, big, "m", 1)
    got = S._tiles(c, 8, 7).toPandas()
    m = (big != 0).astype(float)
    for r in got.itertuples():
        assert r.n == m[r.i1] @ m[r.i2] and r.sxy == big[r.i1] @ big[r.i2] and r.sx == big[r.i1] @ m[r.i2] and r.sy == m[r.i1] @ big[r.i2]
    assert len(got) == sum(1 for a in range(30) for b in range(a + 1) if m[a] @ m[b])


def test_correlations(spark, cells, matrix):
    other = np.roll(matrix, 1, 0)
    other = other + other.T
    b = C.from_matrix(spark, other, "m", 10)
    keep = np.triu_indices(12, 2)
    r = S.with_p(S.correlate(cells, b)).first()
    assert math.isclose(r["corr"], np.corrcoef(matrix[keep], other[keep])[0, 1]) and r["n"] == len(keep[0]) and 0 <= r["p"] <= 1
    rank = lambda x: pd.Series(x).rank()
    assert math.isclose(S.correlate(cells, b, "spearman").first()["corr"], np.corrcoef(rank(matrix[keep]), rank(other[keep]))[0, 1])
    blocks = {x["start"]: x["corr"] for x in S.correlate_blocks(cells, b, 8, 2).collect()}
    inside = np.triu_indices(8, 2)
    assert set(blocks) == {0, 2} and all(math.isclose(v, np.corrcoef(matrix[s : s + 8, s : s + 8][inside], other[s : s + 8, s : s + 8][inside])[0, 1]) for s, v in blocks.items())


def test_missing_bins(spark):
    a = np.array([[1, 1, 0, 0, 0], [1, 1, 1, 0, 1], [0, 1, 1, 0, 1], [0, 0, 0, 0, 0], [0, 1, 1, 0, 1.0]])
    c = C.from_matrix(spark, a, "m", 1)
    flags = lambda df: [r["no_data"] for r in df.orderBy("i").collect()]
    assert flags(K.missing_bins(c)) == [False, False, False, True, False]
    assert flags(K.missing_bins(c, occupancy=0.5)) == [True, False, False, True, False]
    with pytest.raises(ValueError):
        K.missing_bins(c, 0.9, 0.5)
    assert {r["i"] for r in K.drop_missing(c, K.missing_bins(c, occupancy=0.5)).collect()} == {1, 2, 4}


def test_markov(cells, matrix):
    p = matrix / matrix.sum(1, keepdims=True)
    got = M.stationary(cells, fill=False).orderBy("i").toPandas()["w"].to_numpy()
    assert np.isclose(got.sum(), 1) and np.allclose(got @ p, got, atol=1e-8)
    assert np.allclose(dense(M.power(M.transition(cells), 5).withColumnRenamed("p", "v"), 12), np.linalg.matrix_power(p, 5))
    assert np.allclose(dense(M.power(M.transition(cells), 0).withColumnRenamed("p", "v"), 12), np.eye(12))


def test_fill_acts_as_a_dense_matrix(spark):
    a = np.array([[4, 1, 0], [1, 0, 2], [0, 2, 8.0]])
    p = a / a.sum(1, keepdims=True)
    p[p == 0] = p[p > 0].min()
    c = C.from_matrix(spark, a, "m", 1)
    w = M.step(M.with_fill(M.transition(c)), M.start(c), fill=True).orderBy("i").toPandas()["w"].to_numpy()
    assert np.allclose(w, np.full(3, 1 / 3) @ p)
    found = M.stationary(c).orderBy("i").toPandas()["w"].to_numpy()
    left = found @ p
    assert np.allclose(left / left.sum(), found, atol=1e-8)


def test_smooth(cells, matrix):
    got = dense(T.smooth(cells), 12)
    for i, j in ((0, 0), (0, 5), (6, 6), (11, 3)):
        assert np.isclose(got[i, j], matrix[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].mean())


@pytest.mark.parametrize("method", ["PCA", "k-means", "hierarchical"])
def test_compartments(spark, method):
    side = np.array([1, 1, 1, 1, -1, -1, -1, 1, 1, -1])
    a = np.where(np.equal.outer(side, side), 50.0, 5.0) + np.outer(np.where(side > 0, 2, 1), np.where(side > 0, 2, 1))
    got = T.compartments(C.from_matrix(spark, a, "m", 1), method).orderBy("i").toPandas()["score"].to_numpy()
    assert np.array_equal(np.sign(got), side)


def test_overlapping_boxes(spark):
    # starts near and scores near: the smaller goes; scores apart or places apart: both stay
    rows = [("m", 1, 0, 10, 1.0), ("m", 1, 3, 30, 1.04), ("m", 1, 3, 12, 3.0), ("m", 1, 11, 20, 1.01), ("m", 1, 40, 60, 0.5), ("m", 1, 50, 63, 0.52), ("n", 1, 0, 9, 1.0), ("m", 1, 70, 80, None)]
    boxes = spark.createDataFrame(rows, "map string, binsize long, a long, b long, score double")
    got = sorted((r["map"], r["a"], r["b"]) for r in T.suppress_overlaps(boxes).collect())
    assert got == [("m", 3, 12), ("m", 3, 30), ("m", 11, 20), ("m", 40, 60), ("n", 0, 9)]


def sequential(boxes):
    """The rule, box after box."""
    left = dict(enumerate(boxes))
    for i, (a, b, s) in enumerate(boxes):
        for j in range(i):
            if j not in left:
                continue
            c, d, t = boxes[j]
            if (abs(a - c) <= 4 or abs(b - d) <= 4) and abs(s - t) <= 0.05:
                if b - a > d - c:
                    del left[j]
                else:
                    del left[i]
                    break
    return sorted(left.values())


def test_overlapping_boxes_in_order(spark):
    rng = np.random.default_rng(5)
    starts = sorted(rng.integers(0, 120, 60).tolist())
    boxes = sorted({(a, a + int(rng.integers(5, 30))) for a in starts})
    boxes = [(a, b, float(rng.integers(0, 30)) / 100) for a, b in boxes]
    rows = spark.createDataFrame([("m", 1, *b) for b in boxes], "map string, binsize long, a long, b long, score double")
    assert sorted((r["a"], r["b"], r["score"]) for r in T.suppress_overlaps(rows).collect()) == sequential(boxes)


def test_box_scores(spark, matrix):
    c = C.from_matrix(spark, np.where(matrix > 0, matrix, 1.0), "m", 1)
    m = np.where(matrix > 0, matrix, 1.0)
    boxes = spark.createDataFrame([("m", 1, 0, 6), ("m", 1, 2, 9), ("m", 1, 3, 6), ("m", 1, 4, 11)], "map string, binsize long, a long, b long")
    got = {(r["a"], r["b"]): r["score"] for r in T.box_scores(boxes, c).collect()}
    for a, b in ((0, 6), (2, 9)):
        edge = [m[i, b + 1] for i in range(a, b - 3)] + [m[b + 1, j] for j in range(a, b - 3)]
        assert math.isclose(got[a, b], -np.log(edge).mean())
    assert got[3, 6] is None and got[4, 11] is None
    holes = c.where("NOT (i = 2 AND j = 10)")
    assert {r["b"]: r["score"] for r in T.box_scores(boxes, holes).collect()}[9] == math.inf


def test_peak_correction_counts_zeros(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 9, (13, 13)) * (rng.random((13, 13)) < 0.5)
    a = (a + a.T + np.eye(13)).astype(float)
    side = np.where(rng.random(13) < 0.5, -1.0, 1.0) * rng.random(13)
    side[3] = 0.0
    want = side.copy()
    for i in range(13):
        plus, minus = np.median(a[i][side > 0]), np.median(a[i][side < 0])
        if (plus > minus * 1.1 and side[i] < 0) or (minus > plus * 1.1 and side[i] > 0):
            want[i] = -side[i]
    scores = spark.createDataFrame([("m", 1, i, float(x)) for i, x in enumerate(side)], "map string, binsize long, i long, score double")
    got = T.correct_peaks(scores, C.from_matrix(spark, a, "m", 1), 1.1).orderBy("i").toPandas()["score"].to_numpy()
    assert np.allclose(got, want) and not np.allclose(want, side)


def test_first_component_of_several_maps(spark):
    rng = np.random.default_rng(9)
    maps = {}
    for name in "ab":
        f = rng.normal(size=15)
        m = 6 * np.outer(f, f) + rng.normal(size=(15, 15))
        maps[name] = np.abs(m + m.T) + 1
    cells = C.from_matrix(spark, maps["a"], "a", 1).unionByName(C.from_matrix(spark, maps["b"], "b", 1))
    got = T.compartments(cells).toPandas()
    for name, m in maps.items():
        x = m - m.mean(0)
        u, s, _ = np.linalg.svd(x)
        want = u[:, 0] * s[0]
        want = want * np.sign(want[m.sum(1).argmax()])
        assert np.allclose(got[got["map"] == name].sort_values("i")["score"], want, atol=1e-3)
    both = T.compartments(cells, "k-means")
    assert both.count() == 30 and both.groupBy("map", "score").count().count() == 4


def test_running_means_of_a_hot_place(spark):
    values = [float(k % 7 + 1) for k in range(3000)]
    rows = spark.createDataFrame([("c", 1, x, k) for k, x in enumerate(values)] + [("c", 2, 4.0, 0), ("c", 2, 0.0, 1), ("c", 2, 8.0, 2)], "chrom string, bin long, value double, seq long").repartition(5)
    want = values[0]
    for x in values[1:]:
        want = (want + x) / 2
    got = {r["bin"]: r["v"] for r in R.combine(rows, "mean").collect()}
    assert math.isclose(got[1], want) and got[2] == 6.0


def test_ranges_agree_with_one_window(spark):
    rng = np.random.default_rng(1)
    pos = np.cumsum(rng.integers(0, 9, 500) * 5)
    rows = spark.createDataFrame([(None if k % 3 else "m", int(p), k) for k, p in enumerate(pos)], "map string, at long, seq long").repartition(3)
    got = {r["map"]: r["binsize"] for r in C.infer_binsize(rows, "at", "seq").collect()}
    for name, part in ((None, [p for k, p in enumerate(pos) if k % 3]), ("m", pos[::3])):
        step = np.abs(np.diff(part))
        assert got[name] == step[step > 0].min()
    iv = [("c" if k % 2 else "d", int(s), int(s + rng.integers(1, 40)), float(k % 5 + 1), k) for k, s in enumerate(rng.integers(0, 3000, 300))]
    df = spark.createDataFrame(iv, "chrom string, start long, end long, value double, seq long")
    found = {(r["chrom"], r["start"]): (r["end"], r["value"]) for r in R.disjoint(df, "max").collect()}
    for chrom in "cd":
        mine = [x for x in iv if x[0] == chrom]
        cuts = sorted({p for x in mine for p in x[1:3]})
        want = {}
        for a, b in zip(cuts, cuts[1:]):
            over = [x[3] for x in mine if x[1] <= a and b <= x[2]]
            if over:
                want[chrom, a] = (b, max(over))
        assert {k: v for k, v in found.items() if k[0] == chrom} == want


def test_tracks(spark):
    rows = spark.createDataFrame([("c", 1, 1.0), ("c", 2, 2.0), ("c", 3, 4.0), ("c", 3, -9.0)], "chrom string, pos long, value double")
    r = R.bin_track(rows, 10).first()
    assert (r["min"], r["max"], r["amean"], round(r["hmean"], 9), round(r["gmean"], 9), r["median"]) == (1, 4, 7 / 3, round(12 / 7, 9), 2, 2)


def test_intervals_count_bases(spark):
    iv = spark.createDataFrame([("c", 5, 15, 2.0), ("c", 15, 21, 4.0)], "chrom string, start long, end long, value double")
    got = {(r["binsize"], r["bin"]): r for r in R.bin_intervals(iv, [10, 100]).collect()}
    assert got[10, 0]["amean"] == 2 and got[10, 1]["amean"] == 3 and got[10, 2]["min"] == 4
    assert math.isclose(got[100, 0]["amean"], (10 * 2 + 6 * 4) / 16) and got[100, 0]["median"] == 2
    over = spark.createDataFrame([("c", 0, 10, 2.0, 0), ("c", 5, 15, 4.0, 1), ("c", 20, 30, 1.0, 2)], "chrom string, start long, end long, value double, seq long")
    cut = sorted((r["start"], r["end"], r["value"]) for r in R.disjoint(over).collect())
    assert cut == [(0, 5, 2.0), (5, 10, 3.0), (10, 15, 4.0), (20, 30, 1.0)]
    with pytest.raises(ValueError):
        R.bin_intervals(iv, [10], ("mode",))


def test_replicates(spark):
    files = spark.createDataFrame([("e", "a", "1"), ("e", "b", "1, 2"), ("f", "c", "1"), ("f", "d", "2")], "exp string, file string, replicates string")
    assert sorted(r["file"] for r in R.choose_replicates(files, ["exp"]).collect()) == ["b", "c", "d"]


def test_navigation(spark):
    meta = spark.createDataFrame([("a", 10, 5, 5), ("b", 10, 3, 3), ("c", 10, 9, 9), ("a", 20, 3, 3)], "map string, binsize long, nx long, ny long")
    assert N.smallest_map(meta).first()["map"] == "b"
    assert {r["map"]: r["binsize"] for r in N.level_for(meta, 2000, 10).collect()} == {"a": 20, "b": 10, "c": 10}
    assert [r["map"] for r in N.common_maps(meta, meta.where("map <> 'b'")).orderBy("rank").collect()] == ["a", "c"]
    with pytest.raises(N.MapNotFound):
        N.require(meta, "z")
    with pytest.raises(N.ResolutionNotFound):
        N.require(meta, "b", 20)
    assert C.window_of(95, 5, 10, 8) == (0, 8) and C.square_window(7, 12, 10) == (5, 10)
