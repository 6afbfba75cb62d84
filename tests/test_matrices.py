"""Vectors that stay in Spark, tiled products and inverses, swept intervals, exact quantiles."""

import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binweave.functions.quantiles import quantile
from binweave.operators import cells as C
from binweave.operators import markov as M
from binweave.operators import normalise as NM
from binweave.operators import packed as P
from binweave.operators import stats as S
from binweave.operators import structure as T
from binweave.operators import tiles as TL
from binweave.operators import tracks as R
from binweave.operators import vectors as V


def dense(cells, n, value="v", name="m"):
    out = np.zeros((n, n))
    for r in cells.where(F.col("map") == name).collect():
        out[r["i"], r["j"]] = r[value]
    return out


def above(plan):
    """The lines of a physical plan without those of cached tables."""
    lines, deep = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if deep is not None and depth > deep:
            continue
        deep = depth if "InMemoryTableScan" in line else None
        lines.append(line)
    return lines


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_products_move_no_cells(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rnd = np.random.default_rng(1)
        a = np.where(rnd.random((30, 30)) < 0.4, rnd.random((30, 30)), 0)
        m = V.Matrix(C.from_matrix(spark, a, "m", 5))
        x = V.State(m.bins().withColumn("x", F.col("i").cast("double")))
        got = m.times(x.rows, F.col("x") + 1)
        lines = above(got._jdf.queryExecution().executedPlan().toString())
        at = [k for k, line in enumerate(lines) if "InMemoryTableScan" in line]
        depth = lambda k: len(lines[k]) - len(lines[k].lstrip(" :+-"))
        for k in at:  # nothing between the cells and their join is shuffled or sorted
            up = k
            while "Join" not in lines[up]:
                parent = next(j for j in range(up - 1, -1, -1) if depth(j) < depth(up))
                assert "Exchange" not in lines[parent] and "Sort " not in lines[parent]
                up = parent
        assert len(at) == 1
        vector = np.array([k + 1.0 if a[k].any() else 0 for k in range(30)])
        want = a @ vector
        assert {r["i"]: round(r["s"], 9) for r in got.collect()} == {k: round(want[k], 9) for k in range(30) if (a[k] * vector).any()}
        m.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_driver_gets_no_vector():
    for module in (NM, M, V, TL):
        assert "toPandas" not in inspect.getsource(module) and "toArrow" not in inspect.getsource(module)


def test_balancing_of_maps_that_end_apart(spark):
    rnd = np.random.default_rng(2)
    a, b = rnd.random((9, 9)) + 0.1, np.diag([1.0, 4.0, 9.0]) + 0.01
    a = a + a.T
    both = C.from_matrix(spark, a, "a", 1).unionByName(C.from_matrix(spark, b, "b", 1)).unionByName(C.from_matrix(spark, np.eye(4), "one", 1))
    got = NM.balance(both)
    for name, n in (("a", 9), ("b", 3), ("one", 4)):
        assert np.allclose(dense(got, n, name=name).sum(axis=1), 1, atol=1e-10)
    assert NM.balance(both.where("false")).count() == 0
    bias = {r["map"]: r["b"] for r in NM.correction_bias(both, 1e-3, 6).where("i = 0").collect()}
    assert bias.keys() == {"a", "b", "one"} and bias["one"] == pytest.approx(1)
    assert NM.correction_bias(both.where("false")).count() == 0
    assert M.stationary(both.where("false")).count() == 0


@pytest.mark.parametrize("n,side", [(5, 8), (21, 8), (16, 8)])
def test_tiles(spark, n, side):
    rnd = np.random.default_rng(n)
    a = np.where(rnd.random((n, n)) < 0.5, rnd.normal(size=(n, n)), 0)
    b = rnd.normal(size=(n, n))
    b[:, -1] = 1
    both = C.from_matrix(spark, a, "m", 7).unionByName(C.from_matrix(spark, b, "other", 7))
    swap = C.from_matrix(spark, b, "m", 7).unionByName(C.from_matrix(spark, a, "other", 7))
    got = TL.cells_of(TL.product(TL.tiles(both, "v", side), TL.tiles(swap, "v", side)))
    assert np.allclose(dense(got, n), a @ b) and np.allclose(dense(got, n, name="other"), b @ a)
    p = both.withColumnRenamed("v", "p")
    assert np.allclose(dense(M.power(p, 5, side), n, "p"), np.linalg.matrix_power(a, 5))
    assert TL.cells_of(TL.tiles(both.where("false"), "v", side)).count() == 0


@pytest.mark.parametrize("n,side", [(5, 8), (19, 8)])
def test_negative_powers(spark, n, side):
    rnd = np.random.default_rng(n)
    a = rnd.normal(size=(n, n)) + 2 * np.eye(n)
    # bins 2 and n have neither rows nor columns
    wide = np.insert(np.insert(a, 2, 0, axis=0), 2, 0, axis=1)
    p = C.from_matrix(spark, wide, "m", 7).withColumnRenamed("v", "p")
    inner = np.linalg.inv(a)
    want = np.insert(np.insert(inner, 2, 0, axis=0), 2, 0, axis=1)
    assert np.allclose(dense(M.power(p, -1, side), n + 1, "p"), want, atol=1e-8)
    assert np.allclose(dense(M.power(p, -3, side), n + 1, "p"), np.insert(np.insert(np.linalg.matrix_power(inner, 3), 2, 0, axis=0), 2, 0, axis=1), atol=1e-6)


def test_singular_maps_are_refused(spark, monkeypatch):
    monkeypatch.setattr(TL.inverse, "__defaults__", ("v", 8, 12))
    a = np.arange(9.0).reshape(3, 3) + 1
    with pytest.raises(ValueError, match="no inverse: bad"):
        TL.inverse(C.from_matrix(spark, a, "bad", 7).unionByName(C.from_matrix(spark, np.eye(3), "good", 7)))
    # a row without its column
    with pytest.raises(ValueError, match="no inverse"):
        TL.inverse(C.from_matrix(spark, np.array([[1.0, 0.0], [1.0, 0.0]]), "m", 7))


def plain_disjoint(rows, method):
    out = []
    for chrom in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == chrom]
        cuts = sorted({x for r in mine for x in r[1:3]})
        for a, b in zip(cuts, cuts[1:]):
            here = [r[3] for r in sorted(mine, key=lambda r: r[4]) if r[1] <= a and r[2] >= b and r[1] < r[2]]
            if not here:
                continue
            if method == "mean":
                v = here[0]
                for x in here[1:]:
                    v = x if v == 0 else v if x == 0 else (v + x) / 2
            else:
                kept = here if method == "max" else [x for x in here if x != 0]
                v = {"max": max, "min": min}[method](kept) if kept else None
            out.append((chrom, a, b, None if v is None else round(v, 9)))
    return sorted(out)


@pytest.mark.parametrize("method", ["mean", "max", "min"])
@pytest.mark.parametrize("kind", ["chains", "all overlap", "one start"])
def test_disjoint_in_parts(spark, monkeypatch, method, kind):
    monkeypatch.setattr(R, "CUTS", 16)
    rnd, rows = random.Random(kind), []
    for k in range(250):
        a, length = rnd.randrange(3000), rnd.choice([1, 5, 60, 900])
        start, end = {"chains": (a, a + length), "all overlap": (a // 3, 1000 + a), "one start": (10, 11 + a)}[kind]
        rows.append((rnd.choice("xy"), start, end, rnd.choice([0.0, 1.0, 2.5, -2.5, rnd.random()]), k))
    rows += [("x", 5, 5, 1.0, 900), (None, 1, 9, 1.0, 901), ("z", 0, 10, 0.0, 902), ("z", 20, 30, 3.0, 903)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, value double, seq long").repartition(5)
    got = sorted((r["chrom"], r["start"], r["end"], None if r["value"] is None else round(r["value"], 9)) for r in R.disjoint(df, method).collect())
    assert got == plain_disjoint(rows, method)
    assert R.disjoint(df.where("false"), method).count() == 0


def test_no_part_gets_all_pieces(spark, monkeypatch):
    """Of intervals that all overlap a part gets those that begin or end in it, and a few nodes."""
    monkeypatch.setattr(R, "CUTS", 64)
    sizes, keep = [], R.sweep_of
    seen = spark.sparkContext.accumulator(0)

    def counted(sweep):
        def run(cuts, pieces):
            seen.add(len(pieces))
            return sweep(cuts, pieces)

        return keep(run)

    monkeypatch.setattr(R, "sweep_of", counted)
    for n in (500, 2000):
        before = seen.value
        df = spark.range(n).selectExpr("'x' AS chrom", "id AS start", "100000 + id * 7 % 9973 AS end", "cast(id * 31 % 101 AS double) AS value", "id AS seq")
        assert R.disjoint(df, "max").count() >= n
        sizes.append((seen.value - before) / n)
    assert sizes[1] < 1.3 * sizes[0] < 4


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.95, 1.0])
def test_quantiles(spark, q):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.0, 2.0, rnd.gauss(0, 1e9)])) for _ in range(3000)] + [("one", 4.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r["quantile"] for r in quantile(df, ["k"], F.col("v"), q).collect()}
    want = {k: np.quantile([v for x, v in rows if x == k and v is not None], q) for k in ("a", "b", None, "one")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert quantile(df, [], F.col("v"), q).first()["quantile"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], q), rel=1e-12)
    assert quantile(df.where("false"), ["k"], F.col("v"), q).count() == 0 and quantile(df.where("v IS NULL"), [], F.col("v"), q).count() == 0


def test_rectangular_maps_have_no_distances(spark):
    wide = C.from_matrix(spark, np.ones((2, 3)), "wide", 5)
    square = C.from_matrix(spark, np.ones((3, 3)), "square", 5)
    for kind in ("o/e", "o-e"):
        assert NM.over_expected(square, kind=kind).count() == (9 if kind == "o/e" else 0)
        with pytest.raises(Exception, match="map wide is rectangular"):
            NM.over_expected(square.unionByName(wide), kind=kind).collect()


@pytest.mark.parametrize("passes,side", [(1, 8), (3, 8), (3, 4), (5, 4)])
def test_smoothing_over_tiles(spark, passes, side):
    rnd = np.random.default_rng(passes)
    a = np.where(rnd.random((21, 21)) < 0.2, rnd.random((21, 21)), 0)
    a[20, 0] = 1
    want = a
    for _ in range(passes):
        wide, ones = np.pad(want, 1), np.pad(np.ones_like(a), 1)
        box = lambda x: sum(x[p : p + 21, q : q + 21] for p in range(3) for q in range(3))
        want = box(wide) / box(ones)
    both = C.from_matrix(spark, a, "m", 7).unionByName(C.from_matrix(spark, np.eye(3), "small", 7))
    got = T.smooth(both, passes, side)
    assert np.allclose(dense(got, 21), want) and dense(got, 3, name="small").all()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert passes > side or plan.count("REPARTITION_BY_COL") == 1
    assert T.smooth(both, 0, side).count() == both.count() and T.smooth(both.where("false"), 1, side).count() == 0


def test_blocks_meet_those_with_common_columns(spark):
    """Packed rows go to the pairs of blocks that share columns, not to all pairs."""
    n, side = 40, 8
    a = np.kron(np.eye(n), np.arange(1.0, side * side + 1).reshape(side, side) ** 2 % 17 + 1)
    held = S.stored(C.from_matrix(spark, a, "m", 5), side, side)
    cuts, sharing = S._sharing(held)
    assert cuts.count() == held.count() == n and held.join(sharing, [*C.KEY, "bj"]).select(F.explode("others")).count() == n
    got = {(r["i1"], r["i2"]): r["corr"] for r in S.correlation_matrix(C.from_matrix(spark, a, "m", 5)).collect()}
    want = np.corrcoef(a[:side, :side])
    assert len(got) == n * side * (side - 1) // 2 and all(i // side == j // side and np.isclose(c, want[i % side, j % side]) for (i, j), c in got.items())
    assert S.correlation_matrix(C.from_matrix(spark, np.ones((9, 9)), "m", 5)).agg(F.min("corr"), F.max("corr")).first() == (0.0, 0.0)


def test_packed_cells(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 5)
    rnd = np.random.default_rng(3)
    a = np.where(rnd.random((30, 30)) < 0.4, rnd.normal(size=(30, 30)), 0)
    got, rows = np.zeros((30, 30)), P.packed(C.from_matrix(spark, a, "m", 5), 7, 4).collect()
    for r in rows:
        i, j, v = P.cells_in(r["n"], pa.scalar(bytes(r["data"])))
        got[i + 7 * r["bi"], j + 4 * r["bj"]] += v
    assert np.array_equal(got, a) and sum(r["n"] for r in rows) == (a != 0).sum()
