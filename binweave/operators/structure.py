"""Compartments, smoothing and helpers for domains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import tiles
from .cells import KEY, shape
from .vectors import Matrix

#: Vectors of the subspace that is iterated for the first principal component, and rounds.
VECTORS, ROUNDS = 4, 40
#: Bins per side of a map that Ward's clustering, which needs all distances at once, takes.
WARD_SIDE = 4096


def orient(labels: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Signs have no canon: the bin with the largest row sum (the first of equals) is positive."""
    sums = cells.groupBy(*KEY, "i").agg(F.sum("v").alias("r"))
    top = labels.join(sums, [*KEY, "i"]).groupBy(*KEY).agg(F.max_by(value, F.struct("r", (-F.col("i")).alias("k"))).alias("__top"))
    return labels.join(top, list(KEY)).select(*KEY, "i", (F.col(value) * F.when(F.col("__top") < 0, -1).otherwise(1)).alias(value))


def compartments(cells: DataFrame, method: str = "PCA", tol: float = 1e-9) -> DataFrame:
    """(map, binsize, i, score) of every map and level at once: the first principal component
    of the rows, or -1 / +1 by two means or by Ward's clustering in two. Bins without cells
    have no score; absent cells are 0. Cells stay as they are and are joined with vectors of
    one number per bin; no row is made dense, except by Ward's clustering, which takes one
    map in a task and refuses maps of over WARD_SIDE bins."""
    cells = written(cells.select(*KEY, "i", "j", "v"), "cells")
    if method == "PCA":
        out = first_component(cells, tol)
    elif method == "k-means":
        out = two_means(cells)
    elif method == "hierarchical":
        sides = shape(cells).agg(F.max(F.greatest("nx", "ny"))).first()[0] or 0
        if sides > WARD_SIDE:
            raise ValueError(f"hierarchical clustering takes maps of {WARD_SIDE} bins per side; use PCA or k-means")
        out = cells.groupBy(*KEY).applyInPandas(_ward, "map string, binsize long, i long, score double")
    else:
        raise ValueError(f"unknown method {method}: PCA, k-means or hierarchical")
    return orient(out, cells, "score")


def _small(spark, matrices: dict[tuple, np.ndarray], names: list[str]) -> DataFrame:
    """Rows (map, binsize, names...) of a few numbers for each map."""
    rows = [(*k, *map(float, m.ravel())) for k, m in matrices.items()]
    return F.broadcast(spark.createDataFrame(rows, "map string, binsize long, " + ", ".join(f"{n} double" for n in names)))


def first_component(cells: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Scores of the rows on their first principal component: subspace iteration on the rows
    less the column means. Each half step is a product of the packed cells with a table of
    VECTORS numbers per bin; the driver gets a VECTORS x VECTORS matrix for each map."""
    spark, n = cells.sparkSession, VECTORS
    v, y = [f"v{k}" for k in range(n)], [f"y{k}" for k in range(n)]
    pairs = [(a, b) for a in range(n) for b in range(a + 1)]
    rows = cells.groupBy(*KEY).agg(F.countDistinct("i").alias("rows"))
    mean = cells.groupBy(*KEY, "j").agg(F.sum("v").alias("s")).join(rows, list(KEY)).select(*KEY, "j", (F.col("s") / F.col("rows")).alias("mean"))
    start = [(F.pmod(F.xxhash64(*KEY, "j", F.lit(k)), F.lit(1 << 20)) / (1 << 20) - 0.5).alias(c) for k, c in enumerate(v)]
    right = written(mean.select(*KEY, "j", "mean", *start), "vectors")

    def gram(df: DataFrame, names: list[str]) -> dict[tuple, np.ndarray]:
        sums = [F.sum(F.col(names[a]) * F.col(names[b])).alias(f"g{a}_{b}") for a, b in pairs]
        out = {}
        for r in df.groupBy(*KEY).agg(*sums).collect():  # a few numbers for each map
            m = np.zeros((n, n))
            for a, b in pairs:
                m[a, b] = m[b, a] = r[f"g{a}_{b}"] or 0.0
            out[r["map"], r["binsize"]] = m
        return out

    def turned(df: DataFrame, names: list[str], by: dict[tuple, np.ndarray], keep: list[str], to: list[str]) -> DataFrame:
        """The table's vectors times a small matrix for each map."""
        flat = [f"m{a}_{b}" for a in range(n) for b in range(len(to))]
        each = [sum((F.col(names[a]) * F.col(f"m{a}_{b}") for a in range(n)), F.lit(0.0)).alias(c) for b, c in enumerate(to)]
        return df.join(_small(spark, by, flat), list(KEY)).select(*KEY, *keep, *each)

    across, down = Matrix(cells), Matrix(cells, turned=True)
    last: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        # an orthonormal basis; directions that vanish become 0
        basis = {}
        for key, g in gram(right, v).items():
            w, u = np.linalg.eigh(g)
            basis[key] = u @ np.diag([1 / np.sqrt(x) if x > 1e-12 * max(w.max(), 1e-300) else 0.0 for x in w])
        right = written(turned(right, v, basis, ["j", "mean"], v), "vectors")
        centre = right.groupBy(*KEY).agg(*[F.sum(F.col("mean") * F.col(c)).alias(f"c_{c}") for c in v])
        left = across.products(right.withColumnRenamed("j", "i"), **{f"s_{c}": F.col(c) for c in v})
        left = written(left.join(centre, list(KEY)).select(*KEY, "i", *[(F.col(f"s_{a}") - F.col(f"c_{a}")).alias(b) for a, b in zip(v, y)]), "vectors")
        spread = gram(left, y)
        top = {k: float(np.linalg.eigvalsh(g)[-1]) for k, g in spread.items()}
        if all(abs(top[k] - last.get(k, 0.0)) <= tol * top[k] for k in top):
            break
        last = top
        total = left.groupBy(*KEY).agg(*[F.sum(c).alias(f"t_{c}") for c in y])
        back = down.products(left, **{f"s_{c}": F.col(c) for c in y}).withColumnRenamed("i", "j")
        back = back.join(right.select(*KEY, "j", "mean"), [*KEY, "j"]).join(total, list(KEY))
        right = written(back.select(*KEY, "j", "mean", *[(F.col(f"s_{b}") - F.col("mean") * F.col(f"t_{b}")).alias(a) for a, b in zip(v, y)]), "vectors")
    across.close(), down.close()
    main = {k: np.linalg.eigh(g)[1][:, -1:] for k, g in spread.items()}
    return turned(left, y, main, ["i"], ["score"])


def two_means(cells: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows in two clusters by Lloyd's steps. They start from the row of largest norm and the
    one farthest from it (the first of equals); a step is two products of the packed cells
    with a pair of numbers per bin, and it ends when no row moves."""
    across, down = Matrix(cells), Matrix(cells, turned=True)
    of_j = lambda df: df.withColumnRenamed("j", "i")
    norms = written(cells.groupBy(*KEY, "i").agg(F.sum(F.col("v") * F.col("v")).alias("norm")), "norms")
    first = lambda c: F.max_by("i", F.struct(F.col(c), (-F.col("i")).alias("k")))
    a = norms.groupBy(*KEY).agg(first("norm").alias("a"))
    row = cells.join(a, list(KEY)).where("i = a").select(*KEY, "j", F.col("v").alias("w0"))
    dots = across.products(of_j(row), dot=F.col("w0"))
    far = norms.join(dots, [*KEY, "i"], "left").withColumn("d", F.col("norm") - 2 * F.coalesce("dot", F.lit(0.0)))
    b = far.groupBy(*KEY).agg(first("d").alias("b"))
    other = cells.join(b, list(KEY)).where("i = b").select(*KEY, "j", F.col("v").alias("w1"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    centres = written(row.join(other, [*KEY, "j"], "full").select(*KEY, "j", zero("w0"), zero("w1")), "centres")
    labels = None
    for _ in range(rounds):
        size = centres.groupBy(*KEY).agg(*[F.sum(F.col(f"w{k}") * F.col(f"w{k}")).alias(f"n{k}") for k in (0, 1)])
        dots = across.products(of_j(centres), d0=F.col("w0"), d1=F.col("w1"))
        near = norms.join(dots, [*KEY, "i"], "left").join(size, list(KEY))
        distance = [F.col(f"n{k}") - 2 * F.coalesce(f"d{k}", F.lit(0.0)) for k in (0, 1)]
        new = written(near.select(*KEY, "i", F.when(distance[0] <= distance[1], 0).otherwise(1).alias("c")), "labels")
        if labels is not None and new.exceptAll(labels).isEmpty():
            break
        labels = new
        held = labels.groupBy(*KEY).agg(*[F.count_if(F.col("c") == k).alias(f"k{k}") for k in (0, 1)])
        sums = down.products(labels, **{f"s{k}": F.when(F.col("c") == k, 1.0).otherwise(0.0) for k in (0, 1)}).withColumnRenamed("i", "j")
        centres = written(sums.join(held, list(KEY)).select(*KEY, "j", *[F.coalesce(F.col(f"s{k}") / F.nullif(F.col(f"k{k}"), F.lit(0)), F.lit(0.0)).alias(f"w{k}") for k in (0, 1)]), "centres")
    across.close(), down.close()
    return new.select(*KEY, "i", F.when(F.col("c") == 0, -1.0).otherwise(1.0).alias("score"))


def _ward(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ward's clustering of one map's rows into two: nearest pairs by the Lance-Williams
    update of squared distances. A map's side bounds the work."""
    bins = np.unique(pdf["i"])
    n = len(bins)
    x = np.zeros((n, int(max(pdf["i"].max(), pdf["j"].max())) + 1))
    x[np.searchsorted(bins, pdf["i"]), pdf["j"]] = pdf["v"]
    sq = (x * x).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    size, label, left = np.ones(n), np.arange(n), n
    while left > 2:
        a, b = np.unravel_index(np.argmin(d), d.shape)
        s = size + size[a] + size[b]
        new = ((size + size[a]) * d[a] + (size + size[b]) * d[b] - size * d[a, b]) / s
        d[a, :] = d[:, a] = new
        d[b, :] = d[:, b] = np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == label[b]] = label[a]
        label[label == b] = a
        left -= 1
    return pd.DataFrame({"map": pdf["map"].iloc[0], "binsize": pdf["binsize"].iloc[0], "i": bins, "score": np.where(label == label[0], 1.0, -1.0)})


def correct_peaks(scores: DataFrame, cells: DataFrame, factor: float = 1.0) -> DataFrame:
    """A bin whose median contact with the bins of the other sign exceeds ``factor`` times
    that with its own changes sign. Medians are over all bins of a sign: absent cells count
    as zeros, by their number. Groups are those before any change."""
    sign = scores.select(*KEY, "i", F.signum("score").alias("s"))
    of_j = sign.select(*KEY, F.col("i").alias("j"), F.col("s").alias("t")).where("t <> 0")
    held = cells.join(sign.select(*KEY, "i"), [*KEY, "i"], "left_semi").join(of_j, [*KEY, "j"]).select(*KEY, "i", "t", "v", F.lit(1).cast("long").alias("n"))
    sizes = of_j.groupBy(*KEY, "t").agg(F.count("*").alias("bins"))
    every = sign.select(*KEY, "i").join(sizes, list(KEY)).join(held.groupBy(*KEY, "i", "t").agg(F.count("*").alias("k")), [*KEY, "i", "t"], "left")
    zeros = every.select(*KEY, "i", "t", F.lit(0.0).alias("v"), (F.col("bins") - F.coalesce("k", F.lit(0))).alias("n"))
    m = held.unionByName(zeros).groupBy(*KEY, "i", "t").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m"))
    m = m.groupBy(*KEY, "i").agg(F.max(F.when(F.col("t") > 0, F.col("m"))).alias("positive"), F.max(F.when(F.col("t") < 0, F.col("m"))).alias("negative"))
    own, other = (F.when(F.col("score") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("positive", "negative"), ("negative", "positive")))
    flip = F.coalesce((F.col("score") != 0) & (other > factor * own), F.lit(False))
    return scores.join(m, [*KEY, "i"], "left").select(*KEY, "i", F.when(flip, -F.col("score")).otherwise(F.col("score")).alias("score"))


def smooth(cells: DataFrame, passes: int = 1, side: int = tiles.SIDE) -> DataFrame:
    """3 x 3 mean, zeros counted, windows cut at the edges. All passes go over dense tiles with a
    margin of as many bins, so that there is one exchange; more passes than a tile has bins go
    in several."""
    while passes > 0:
        some = min(passes, side)
        passes -= some
        cells = tiles.over_halos(cells, _box_means(some), some, side=side)
        cells = written(cells, "smooth") if passes else cells
    return cells


def _box_means(passes: int):
    """A function for over_halos: so many passes of 3 x 3 means."""

    def run(square: np.ndarray, i: int, j: int, n: int) -> np.ndarray:
        rows, columns = i + np.arange(len(square)), j + np.arange(len(square))
        span = lambda at: np.where((at >= 0) & (at < n), np.minimum(at + 2, n) - np.maximum(at - 1, 0), np.inf)
        count = np.multiply.outer(span(rows), span(columns))  # outside the map all becomes 0
        for _ in range(passes):
            wide = np.pad(square, 1)
            across = wide[:, :-2] + wide[:, 1:-1] + wide[:, 2:]
            square = (across[:-2] + across[1:-1] + across[2:]) / count
        return square

    return run


def off_diagonal_peaks(peaks: DataFrame, distance: int = 4) -> DataFrame:
    """Peaks (i, j) above the diagonal and more than ``distance`` bins from it."""
    return peaks.where(F.col("j") - F.col("i") > distance)


#: Bins by which boxes are near each other, and cells of a box's corner that don't count.
NEAR = 4


def box_scores(boxes: DataFrame, cells: DataFrame, factor: float = 1.0) -> DataFrame:
    """Score of each box (map, binsize, a, b): -factor times the mean natural logarithm of the
    cells of the row and the column behind it, (b + 1, a) to (b + 1, b) and (a, b + 1) to
    (b, b + 1), without those within NEAR bins of the corner. Zero cells make it infinite; a
    box of NEAR bins or fewer, or one that ends where the map does, has none (null)."""
    side = shape(cells).select(*KEY, F.greatest("nx", "ny").alias("__n"))
    names = [c for c in boxes.columns if c not in KEY]
    edge = lambda at, along: cells.where("v > 0").select(*KEY, (F.col(at) - 1).alias("b"), F.col(along).alias("__k"), F.ln("v").alias("__l"))
    on_edge = (F.col("__k") >= F.col("a")) & (F.col("__k") <= F.col("b") - NEAR)
    both = edge("j", "i").unionByName(edge("i", "j"))
    found = boxes.join(both, [*KEY, "b"]).where(on_edge).groupBy(*KEY, "a", "b").agg(F.count("*").alias("__held"), F.sum("__l").alias("__sum"))
    rows = boxes.join(side, list(KEY)).join(found, [*KEY, "a", "b"], "left")
    cells_of = 2 * (F.col("b") - NEAR - F.col("a") + 1)
    score = F.when((cells_of <= 0) | (F.col("b") + 1 >= F.col("__n")), None).when(F.coalesce("__held", F.lit(0)) < cells_of, factor * float("inf")).otherwise(-factor * F.col("__sum") / F.col("__held"))
    return rows.select(*KEY, *names, score.alias("score"))


def near_boxes(boxes: DataFrame, near: float = 0.05) -> DataFrame:
    """Pairs (map, binsize, x, y), x < y, of numbered boxes (a, b, score, id) whose starts or
    whose ends lie within NEAR bins and whose scores differ by at most ``near``."""
    shift = F.explode(F.sequence(F.lit(-NEAR), F.lit(NEAR))).alias("__shift")
    left = boxes.where("score IS NOT NULL").select(*KEY, F.col("id").alias("x"), "a", "b", F.col("score").alias("s"))
    right = boxes.where("score IS NOT NULL").select(*KEY, F.col("id").alias("y"), "a", "b", F.col("score").alias("t"))
    by = lambda c: left.select(*KEY, c, "x", "s", shift).select(*KEY, (F.col(c) + F.col("__shift")).alias(c), "x", "s").join(right, [*KEY, c]).where((F.col("x") < F.col("y")) & (F.abs(F.col("s") - F.col("t")) <= near)).select(*KEY, "x", "y")
    return by("a").unionByName(by("b")).distinct()


def suppress_overlaps(boxes: DataFrame, near: float = 0.05, order: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Boxes (a, b, score) in order: each is held against the boxes before it that are left and
    near it, of nearly its score (see near_boxes), in order; a smaller one of these goes,
    and at the first that isn't smaller the box itself goes. Boxes without a score go. Only
    boxes that such pairs join, directly or through others, meet in a task."""
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order, "a", "b"))
    boxes = written(boxes.where("score IS NOT NULL").withColumn("id", number.cast("long")), "boxes")
    pairs = written(near_boxes(boxes, near), "near")
    group = _groups(pairs)
    later = pairs.groupBy(*KEY, F.col("y").alias("id")).agg(F.array_sort(F.collect_list("x")).alias("before"))
    rows = boxes.join(group, [*KEY, "id"], "left").join(later, [*KEY, "id"], "left")
    rows = rows.withColumn("group", F.coalesce("group", "id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        size = dict(zip(pdf["id"], pdf["b"] - pdf["a"]))
        left = set()
        for box, before in zip(pdf["id"], pdf["before"]):
            left.add(box)
            for other in before if before is not None else ():
                if other in left:
                    if size[box] > size[other]:
                        left.remove(other)
                    else:
                        left.remove(box)
                        break
        return pdf[pdf["id"].isin(left)][names]

    names = [f.name for f in boxes.schema if f.name != "id"]
    return rows.groupBy(*KEY, "group").applyInPandas(run, boxes.drop("id").schema)


def _groups(pairs: DataFrame) -> DataFrame:
    """Rows (map, binsize, id, group): the least id that pairs reach. Labels take the least
    label of their neighbours, then the label of their label, until none moves."""
    both = pairs.select(*KEY, F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select(*KEY, "p.x", "p.y")
    edges = written(both, "edges")
    labels = written(edges.groupBy(*KEY, F.col("x").alias("id")).agg(F.least("x", F.min("y")).alias("group")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "y"), [*KEY, "y"]).groupBy(*KEY, F.col("x").alias("id")).agg(F.min("group").alias("least"))
        new = labels.join(near, [*KEY, "id"]).select(*KEY, "id", F.least("group", "least").alias("group"), (F.col("least") < F.col("group")).alias("moved"))
        new = written(new, "labels")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        jump = new.select(*KEY, F.col("id").alias("group"), F.col("group").alias("next"))
        labels = written(new.select(*KEY, "id", "group").join(jump, [*KEY, "group"]).select(*KEY, "id", F.col("next").alias("group")), "labels")
