"""Normalisers: coverage, distance expectation, iterative correction, Knight-Ruiz.

The iterative ones keep the cells where they are and iterate on tables of one row per bin
(``vectors``): a sweep is one join of the cells with such a vector and one sum per row, for all
maps at once. The driver gets sums and limits, a few numbers for each map.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantile
from ..functions.tables import dropped, written
from .cells import CELL, KEY
from .vectors import Matrix, State, merged, picked


def row_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY, "i").agg(F.sum("v").alias("r"))


def coverage(cells: DataFrame, square_root: bool = False, bins: DataFrame | None = None) -> DataFrame:
    """Vanilla coverage: v / (r_i r_j), or v / sqrt(r_i r_j), r being row sums over all
    cells. Cells of bins without data are blanked."""
    r = row_sums(cells)
    both = cells.join(r, [*KEY, "i"]).join(r.select(*KEY, F.col("i").alias("j"), F.col("r").alias("c")), [*KEY, "j"])
    d = F.col("r") * F.col("c")
    out = both.select(*KEY, "i", "j", (F.col("v") / (F.sqrt(d) if square_root else d)).alias("v"))
    if bins is None:
        return out
    from .masks import drop_missing

    return drop_missing(out, bins)


def by_distance(cells: DataFrame, stats: str = "median", outliers: float | None = None, pool: bool = False) -> DataFrame:
    """Mean or median of the non-zero cells of each diagonal; with ``pool`` over all maps.
    outliers: values whose robust z-score is above it don't count."""
    keys = ["binsize"] if pool else [*KEY]
    rows = cells.where("v <> 0").select(*KEY, F.abs(F.col("i") - F.col("j")).alias("d"), "v")
    if outliers is not None:
        from .stats import drop_outliers

        rows = drop_outliers(rows, [*keys, "d"], outliers)
    if pool and stats == "median":
        return quantile(rows, [*keys, "d"], F.col("v"), 0.5, "expected")
    # a map's diagonal has no more values than bins
    how = F.median("v") if stats == "median" else F.avg("v")
    return rows.groupBy(*keys, "d").agg(how.alias("expected"))


def over_expected(cells: DataFrame, stats: str = "median", kind: str = "o/e") -> DataFrame:
    """Median (or mean) contact frequency scaling. o/e: v over its diagonal's value; o-e: v
    less that, 1 where it is below 0, zero cells stay zero. A diagonal whose expectation is
    0 passes unchanged. Only symmetric maps have distances; others are refused."""
    how = F.median("v") if stats == "median" else F.avg("v")
    found = cells.where("v <> 0").groupBy(*KEY, F.abs(F.col("i") - F.col("j")).alias("d")).agg(how.alias("expected"), F.max("i").alias("__i"), F.max("j").alias("__j"))
    # a window over a map's diagonals, no more than its bins
    every = Window.partitionBy(*KEY)
    uneven = F.max("__i").over(every) != F.max("__j").over(every)
    refused = F.raise_error(F.concat(F.lit("map "), F.coalesce("map", F.lit("null")), F.lit(" is rectangular: it has no distances")))
    expected = found.withColumn("__uneven", uneven).select(*KEY, "d", F.when(F.col("__uneven"), refused.cast("double")).otherwise(F.col("expected")).alias("expected"))
    both = cells.where("v <> 0").withColumn("d", F.abs(F.col("i") - F.col("j"))).join(expected, [*KEY, "d"], "left")
    if kind == "o/e":
        v = F.col("v") / F.col("expected")
    else:
        v = F.when(F.col("v") - F.col("expected") < 0, 1.0).otherwise(F.col("v") - F.col("expected"))
    v = F.when(F.coalesce(F.col("expected"), F.lit(0.0)) == 0, F.col("v")).otherwise(v)
    return both.select(*KEY, "i", "j", v.alias("v")).where("v <> 0")


def correction_bias(cells: DataFrame, tol: float = 1e-4, iterations: int = 500) -> DataFrame:
    """Iterative correction: the bias B of each bin, for which v / (B_i B_j) has even row
    sums and the original total. A sweep: s = row sums of the corrected map, d = s over the
    mean of its non-zero entries, B times d, rescaled to the total. It ends when the
    L1 change of B is below tol, tested after the sweep, or after iterations + 2 sweeps.
    A sweep is one product: its row sums also give the total after the sweep before, and with
    it that sweep's scale."""
    a = Matrix(cells)
    state = State(a.bins().withColumn("b", F.lit(1.0)))
    rows, b, s = state.rows, F.col("b"), F.col("s")
    total: dict[tuple, float] = {}
    moving, finished = None, []
    for left in range(iterations + 2, -1, -1):
        state.write(merged(rows, a.times(rows, 1 / b)).withColumn("s", s / b))
        sums = state.scalars(now=F.sum("s"), mean=F.avg(F.when(s != 0, s)))
        moving = set(sums) if moving is None else moving
        numbers = {}
        for k, of in sums.items():
            # the scale of the sweep before; row sums change by its square
            first = total.setdefault(k, of["now"])
            numbers[k] = {"scale": math.sqrt(of["now"] / first) if first else 1.0, "mean": of["mean"] or 0.0}
        # a map at rest, or after the last sweep, has its scale and is done
        done = [k for k in sums if k not in moving or not left]
        if done:
            finished.append(written(state.given(numbers, picked(state.rows, done)).select(*KEY, "i", (b * F.col("scale")).alias("b")), "bias"))
        if len(done) == len(sums):
            break
        ratio = F.when((F.col("mean") == 0) | (s == 0), 1.0).otherwise(s / F.col("mean"))
        held = state.given(numbers, picked(state.rows, done, inside=False)).withColumn("was", b * F.col("scale"))
        rows = held.select(*KEY, "i", (F.col("was") * ratio).alias("b"))
        change = state.scalars(held, change=F.sum(F.abs(F.col("was") * (ratio - 1))))
        moving -= {k for k, of in change.items() if of["change"] < tol}
    a.close()
    dropped(state.rows)
    out = finished[0] if finished else cells.select(*KEY, "i", F.lit(1.0).alias("b")).where("false")
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def divide(cells: DataFrame, bias: DataFrame) -> DataFrame:
    """v / (b_i b_j)."""
    both = cells.join(bias, [*KEY, "i"]).join(bias.select(*KEY, F.col("i").alias("j"), F.col("b").alias("c")), [*KEY, "j"])
    return both.select(*KEY, "i", "j", (F.col("v") / (F.col("b") * F.col("c"))).alias("v"))


def correct(cells: DataFrame, tol: float = 1e-4, iterations: int = 500) -> DataFrame:
    """The iteratively corrected map."""
    return divide(cells, correction_bias(cells, tol, iterations)).select(*CELL)


def balancing_vector(cells: DataFrame, tol: float = 1e-12, delta: float = 0.1, most: float = 3.0, rounds: int = 300) -> DataFrame:
    """Knight-Ruiz: x > 0 for which x_i v_ij x_j has row sums 1. Newton's method on
    x * (A x) = 1; each step solves (diag(Ax / x) + A) w = 1 / x - A x approximately by
    conjugate gradients with the diagonal as preconditioner, in the scaled variable
    y = w / x, and stays within [delta, most] of the last x (Knight and Ruiz, 2013).

    x, v = x * (A x), y, the residual q and the direction p are columns of one table. A step of
    the inner loop is two jobs: the product, written with all it is made of, and the sums that
    the next step needs. Maps that are done are left out of the products."""
    a = Matrix(cells)
    x, v, y, q, p, w = map(F.col, "xvyqpw")
    ones = a.bins().withColumn("x", F.lit(1.0))
    state = State(merged(ones, a.times(ones, x)).select(*KEY, "i", "x", F.col("s").alias("v")))
    norms = {k: of["n"] for k, of in state.scalars(n=F.sum((1 - v) * (1 - v))).items()}
    eta = dict.fromkeys(norms, 0.1)
    open_maps = {k for k in norms if norms[k] > tol * tol}
    for _ in range(rounds):
        if not open_maps:
            break
        rows = state.rows.select(*KEY, "i", "x", "v", F.lit(1.0).alias("y"), (1 - v).alias("q"), ((1 - v) / v).alias("p"))
        rho = {k: of["rho"] for k, of in state.scalars(rows, rho=F.sum(q * p)).items()}
        rows = state.given({k: {"rho": r} for k, r in rho.items()}, rows)
        goal = {k: max(eta[k] ** 2 * norms[k], tol * tol) for k in open_maps}
        active = {k for k in open_maps if rho[k] > 0}
        while active:
            some = len(active) < len(norms)
            mine = picked(rows, active) if some else rows
            state.write(merged(rows, a.times(mine, x * p)).withColumn("w", x * F.col("s") + v * p).drop("s"))
            mine = picked(state.rows, active) if some else state.rows
            # the step's length is a map's number
            mine = mine.join(F.broadcast(mine.groupBy(*KEY).agg(F.sum(p * w).alias("pw"))), list(KEY)).withColumn("alpha", F.col("rho") / F.col("pw"))
            step, r = F.col("alpha") * p, q - F.col("alpha") * w
            room = F.min(F.when(step < 0, (delta - y) / step))
            top = F.min(F.when(step > 0, (most - y) / step))
            found = state.scalars(mine, alpha=F.max("alpha"), low=F.min(y + step), high=F.max(y + step), rho=F.sum(r * r / v), room=room, top=top)
            numbers = {k: {"go": 0.0, "alpha": 0.0, "beta": 0.0, "rho": rho[k]} for k in norms}
            for k, of in found.items():
                if of["low"] <= delta or of["high"] >= most:
                    # stop at the wall
                    numbers[k]["go"] = of["alpha"] * max(0.0, min(1.0, *(of[c] for c in ("room", "top") if of[c] is not None)))
                    active.discard(k)
                    continue
                numbers[k] |= {"go": of["alpha"], "alpha": of["alpha"], "beta": of["rho"] / rho[k], "rho": of["rho"]}
                rho[k] = of["rho"]
                if of["rho"] <= goal[k]:
                    active.discard(k)
            held = state.given(numbers, state.rows.drop("rho")).withColumn("y", y + F.col("go") * p).withColumn("q", r)
            rows = held.select(*KEY, "i", "x", "v", "y", "q", (q / v + F.col("beta") * p).alias("p"), "rho")
        rows = rows.select(*KEY, "i", (x * y).alias("x"))  # y is 1 where a map is done
        state.write(merged(rows, a.times(rows, x)).select(*KEY, "i", "x", (x * F.col("s")).alias("v")))
        found = state.scalars(n=F.sum((1 - v) * (1 - v)))
        for k in list(open_maps):
            last, norms[k] = norms[k], found[k]["n"]
            new = 0.9 * norms[k] / last if last else 0.1
            if 0.9 * eta[k] ** 2 > 0.1:
                new = max(new, 0.9 * eta[k] ** 2)
            eta[k] = max(min(new, 0.1), 0.5 * tol / math.sqrt(norms[k]) if norms[k] else 0.1)
            if norms[k] <= tol * tol:
                open_maps.discard(k)
    a.close()
    return state.rows.select(*KEY, "i", (1 / x).alias("b"))


def balance(cells: DataFrame, tol: float = 1e-12, **options) -> DataFrame:
    """The Knight-Ruiz balanced map."""
    return divide(cells, balancing_vector(cells, tol, **options)).select(*CELL)
