"""Registered queries of the contact-map engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resolution import binsize_of, natural_key, resolution_of
from ..functions.tables import shared_path, written
from ..operators import cells as C
from ..operators import coarsen as Z
from ..operators import markov as M
from ..operators import masks as K
from ..operators import navigation as N
from ..operators import normalise as NM
from ..operators import stats as S
from ..operators import structure as T
from ..operators import tracks as R
from ..sources import container as K_
from ..sources import text as X
from .domain import SQL_CELLS, SQL_TRACK, cells, signal, table, upper

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = SQL_CELLS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"
        return f

    return add


def track_query(sql: str):
    return query(sql, SQL_TRACK)


def one(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("map") == name)


def rounded(df: DataFrame, digits: int = 9, column: str = "v", scale=None) -> DataFrame:
    return df.withColumn(column, F.round(F.col(column) if scale is None else F.col(column) * scale, digits))


# -- cells and views


@query("SELECT * FROM cells")
def cm_cells(spark, d):
    return cells(spark, d)


@query("SELECT * FROM cells WHERE j >= i")
def cm_upper(spark, d):
    return upper(spark, d)


@query("SELECT * FROM cells WHERE j <= i AND v <> 0")
def cm_coo_export(spark, d):
    return cells(spark, d).where("j <= i AND v <> 0")


@query("SELECT * FROM cells WHERE map = 'F' AND i BETWEEN 5 AND 14 AND j BETWEEN 10 AND 24")
def cm_viewport(spark, d):
    return C.viewport(cells(spark, d), "F", (5, 15), (10, 25))


@query("SELECT * FROM cells WHERE map = 'O' AND i = 3 AND j = 7")
def cm_point(spark, d):
    return C.point(cells(spark, d), "O", 3, 7)


@query("SELECT map, binsize, max(i) + 1 AS nx, max(j) + 1 AS ny, min(v) FILTER (WHERE v <> 0) AS minvalue, max(v) AS maxvalue FROM cells GROUP BY 1, 2")
def cm_meta_minmax(spark, d):
    return C.meta(cells(spark, d))


@query("SELECT map, max(i) + 1 AS side, row_number() OVER (ORDER BY map)::INT AS rank FROM cells GROUP BY map")
def cm_map_list(spark, d):
    return N.map_names(C.meta(cells(spark, d)))


@query("SELECT map, max(i) + 1 AS side FROM cells GROUP BY map ORDER BY 2, 1 LIMIT 1")
def cm_smallest_map(spark, d):
    return N.smallest_map(C.meta(cells(spark, d)))


@query("SELECT map, row_number() OVER (ORDER BY map)::INT AS rank FROM (SELECT map FROM cells INTERSECT SELECT map FROM cells WHERE v > 1760)")
def cm_common_maps(spark, d):
    c = cells(spark, d)
    return N.common_maps(c, C.threshold(c, 1760))


@query("SELECT map, 50::BIGINT AS binsize, unnest(range(0, n)) AS i, unnest(range(0, n)) * 50 AS tick FROM size")
def cm_ticks(spark, d):
    return C.ticks(cells(spark, d))


@query("SELECT r.binsize, resolution, parsed FROM (VALUES (50::BIGINT, '50b', 50::BIGINT), (100, '100b', 100), (1600, '1.6kb', 1600)) r(binsize, resolution, parsed) WHERE EXISTS (SELECT 1 FROM cells)")
def cm_resolutions(spark, d):
    # the bin sizes that levels 1, 2 and 32 of the map have
    sizes = cells(spark, d).select("binsize").distinct().select(F.explode(F.array(F.col("binsize"), F.col("binsize") * 2, F.col("binsize") * 32)).alias("binsize"))
    out = sizes.withColumn("resolution", resolution_of(F.col("binsize")))
    return out.withColumn("parsed", binsize_of(F.col("resolution")))


@query("SELECT name, row_number() OVER (ORDER BY CAST(substr(name, 4) AS INT))::INT AS rank FROM (SELECT DISTINCT source AS name FROM documents)", "z AS (SELECT 1)")
def cm_natural_sort(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return names.withColumn("rank", F.row_number().over(Window.orderBy(natural_key(F.col("name")))))


@query("""SELECT chrom AS map, min(d) FILTER (WHERE d > 0) AS binsize FROM (SELECT o_orderstatus AS chrom, abs(o_custkey - lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)) AS d FROM orders) GROUP BY 1""")
def cm_binsize_infer(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("map"), F.col("o_custkey").alias("pos"), F.col("o_orderkey").alias("seq"))
    return C.infer_binsize(o, "pos", "seq")


@query("""SELECT map, 50::BIGINT AS binsize, least(b1, b2) AS i, greatest(b1, b2) AS j, round(list_reduce(list(q ORDER BY l_orderkey, l_linenumber, q), lambda a, x: CASE WHEN a = 0 THEN x ELSE (a + x) / 2 END), 6) AS v
  FROM (SELECT l_orderkey, l_linenumber, o_orderstatus AS map, CAST(floor(l_partkey / 50.0) AS BIGINT) AS b1, CAST(floor(l_suppkey * 10 / 50.0) AS BIGINT) AS b2, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1, 2, 3, 4""")
def cm_dup_fold(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("map"))
    l = table(spark, d, "lineitem").join(o, "l_orderkey")  # noqa: E741
    rows = l.select("map", F.col("l_partkey").alias("pos_i"), (F.col("l_suppkey") * 10).alias("pos_j"), F.col("l_quantity").alias("value"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return rounded(C.bin_contacts(rows, 50).where("i <= j"), 6)


@query("SELECT * FROM cells WHERE v > 800 AND v < 1200")
def cm_threshold(spark, d):
    return C.threshold(cells(spark, d), 800, 1200)


@query("SELECT * FROM cells WHERE j - i = 2")
def cm_diagonal(spark, d):
    return C.diagonal(cells(spark, d), 2)


@query("SELECT map, binsize, i, j, v * pow(10.0, greatest(0, -floor(log10(m)) - 1) + 1) AS v FROM cells JOIN (SELECT map, min(v) AS m FROM cells GROUP BY 1) USING (map)")
def cm_scale_up(spark, d):
    return C.scale_up(cells(spark, d))


@query("SELECT map, binsize, i, j, round(log10(v), 9) AS v, round(f, 9) AS fill FROM cells JOIN (SELECT map, min(log10(v)) - (max(log10(v)) - min(log10(v))) / 99 AS f FROM cells GROUP BY 1) USING (map)")
def cm_log10(spark, d):
    return rounded(rounded(C.log10_map(cells(spark, d))), column="fill")


@query("SELECT map, binsize, i, j, round(log2(v), 9) AS v FROM cells")
def cm_log2(spark, d):
    return rounded(C.log2_map(cells(spark, d)))


@query("SELECT map, binsize, i, j, round((v - a) / (b - a), 9) AS v FROM cells JOIN (SELECT map, min(v) AS a, max(v) AS b FROM cells GROUP BY 1) USING (map)")
def cm_rescale(spark, d):
    return rounded(C.rescale(cells(spark, d)))


@query("SELECT map, 50::BIGINT AS binsize, k::INT AS step, round(pow(2, log2(a) + (log2(b) - log2(a)) * k / 9), 6) AS v FROM (SELECT map, min(v) AS a, max(v) AS b FROM cells GROUP BY 1), range(0, 10) t(k)")
def cm_colour_steps(spark, d):
    return rounded(C.colour_steps(C.meta(cells(spark, d)), 10, "log"), 6)


# -- coarser maps


def _coarse(level, how):
    return f"SELECT map, {50 * level}::BIGINT AS binsize, CAST(ceil(i / {level}.0) AS BIGINT) AS i, CAST(ceil(j / {level}.0) AS BIGINT) AS j, {how} AS v FROM cells WHERE i > 0 AND j > 0 GROUP BY 1, 3, 4"


@query(_coarse(2, "sum(v)"))
def cm_coarsen_sum(spark, d):
    return Z.coarsen(cells(spark, d), 2)


@query(_coarse(2, "max(v)"))
def cm_coarsen_max(spark, d):
    return Z.coarsen(cells(spark, d), 2, "max")


@query(_coarse(4, "sum(v)"))
def cm_coarsen_l4(spark, d):
    return Z.coarsen(cells(spark, d), 4)


@query("SELECT map, 100::BIGINT AS binsize, ci AS i, cj AS j, round(s / (least(2, n - 1 - (ci - 1) * 2) * 2), 9) AS v FROM (SELECT map, CAST(ceil(i / 2.0) AS BIGINT) AS ci, CAST(ceil(j / 2.0) AS BIGINT) AS cj, sum(v) AS s FROM cells WHERE i > 0 AND j > 0 GROUP BY 1, 2, 3) JOIN size USING (map)")
def cm_coarsen_mean(spark, d):
    return rounded(Z.coarsen(cells(spark, d), 2, "mean"))


_UNION = " UNION ALL ".join(f"SELECT map, binsize, i, j, v FROM l{k}" for k in range(8))
_LEVEL = "SELECT map, binsize * 2, CAST(ceil(i / 2.0) AS BIGINT) AS i, CAST(ceil(j / 2.0) AS BIGINT) AS j, sum(v) AS v, CAST(ceil((n - 1) / 2.0) AS BIGINT) + 1 AS n FROM {0} WHERE i > 0 AND j > 0 AND n > 12 GROUP BY 1, 2, 3, 4, n"


@query(", l0 AS (SELECT cells.*, n FROM cells JOIN size USING (map)), " + ", ".join(f"l{k} AS MATERIALIZED (SELECT * FROM ({_LEVEL.format(f'l{k - 1}')}) t(map, binsize, i, j, v, n))" for k in range(1, 8)) + " " + _UNION)
def cm_pyramid(spark, d):
    return Z.pyramid(written(cells(spark, d), "cells"), "sum", 12)


@query("SELECT map, 50::BIGINT AS base, 150::BIGINT AS target FROM (SELECT DISTINCT map FROM cells)")
def cm_resolution_pick(spark, d):
    meta = cells(spark, d).select("map", "binsize").distinct()
    stored = meta.unionByName(meta.withColumn("binsize", F.col("binsize") * 2)).unionByName(meta.withColumn("binsize", F.col("binsize") * 4))
    return Z.base_resolution(stored, 150)


@query("SELECT map, b.binsize, finer, coarser, resolution FROM (SELECT DISTINCT map FROM cells), (VALUES (50::BIGINT, 0::BIGINT, 100::BIGINT, '50b'), (100, 50, 200, '100b'), (200, 100, 0, '200b')) b(binsize, finer, coarser, resolution)")
def cm_levels(spark, d):
    meta = cells(spark, d).select("map", "binsize").distinct()
    levels = meta.unionByName(meta.withColumn("binsize", F.col("binsize") * 2)).unionByName(meta.withColumn("binsize", F.col("binsize") * 4))
    return N.neighbours(levels).fillna(0)


# -- bins without data

_AXIS = "ax AS (SELECT map, n, unnest(range(0, n)) AS i FROM size), zc AS (SELECT ax.map, ax.i, ax.n, count(c.j) AS held, coalesce(bool_or(c.i = c.j), false) AS diag FROM ax LEFT JOIN {0} c ON c.map = ax.map AND c.i = ax.i GROUP BY 1, 2, 3)"


def sparse(spark, d):
    """Cells that aren't well below their map's mean: a map with gaps."""
    c = written(cells(spark, d), "cells")
    mean = c.groupBy("map").agg((0.9 * F.avg("v")).alias("least"))
    return c.join(mean, "map").where("v > least").select(*C.CELL)


_SPARSE = ", sp AS (SELECT cells.* FROM cells JOIN (SELECT map, 0.9 * avg(v) AS least FROM cells GROUP BY 1) m ON m.map = cells.map WHERE v > least), size2 AS (SELECT map, greatest(max(i), max(j)) + 1 AS n FROM sp GROUP BY map), ax AS (SELECT map, n, unnest(range(0, n)) AS i FROM size2), zc AS (SELECT ax.map, ax.i, ax.n, count(c.j) AS held, coalesce(bool_or(c.i = c.j), false) AS diag FROM ax LEFT JOIN sp c ON c.map = ax.map AND c.i = ax.i GROUP BY 1, 2, 3) "


@query(_SPARSE + "SELECT map, 50::BIGINT AS binsize, i, held = 0 AS no_data FROM zc")
def cm_nodata(spark, d):
    return K.missing_bins(sparse(spark, d))


@query(_SPARSE + "SELECT map, 50::BIGINT AS binsize, i, held = 0 OR NOT diag AS no_data FROM zc")
def cm_nodata_diag(spark, d):
    return K.missing_bins(sparse(spark, d), by_diagonal=True)


@query(_SPARSE + ", z AS (SELECT *, CASE WHEN held = 0 THEN 0 ELSE n - held END AS zeros FROM zc), p AS (SELECT map, quantile_cont(zeros, 0.9) FILTER (WHERE zeros <> 0) AS cut, count(*) FILTER (WHERE zeros = 0) AS none FROM z GROUP BY 1) SELECT map, 50::BIGINT AS binsize, i, held = 0 OR coalesce(zeros - none >= cut, false) AS no_data FROM z JOIN p USING (map)".replace(", z AS", ", z AS", 1))
def cm_nodata_percentile(spark, d):
    return K.missing_bins(sparse(spark, d), percentile=0.9)


@query(_SPARSE + "SELECT map, 50::BIGINT AS binsize, i, held = 0 OR (n - held) / n >= 0.5 AS no_data FROM zc")
def cm_nodata_occupancy(spark, d):
    return K.missing_bins(sparse(spark, d), occupancy=0.5)


@query(_SPARSE + ", ok AS (SELECT map, i FROM zc WHERE (n - held) / n < 0.5 AND held > 0) SELECT sp.* FROM sp JOIN ok a ON a.map = sp.map AND a.i = sp.i JOIN ok b ON b.map = sp.map AND b.i = sp.j")
def cm_drop_missing(spark, d):
    c = sparse(spark, d)
    return K.drop_missing(c, K.missing_bins(c, occupancy=0.5))


# -- normalisers

_R = ", r AS (SELECT map, i, sum(v) AS r FROM cells GROUP BY 1, 2) "


@query(_R + "SELECT c.map, binsize, c.i, c.j, round(v / (a.r * b.r) * 1e6, 6) AS v FROM cells c JOIN r a ON a.map = c.map AND a.i = c.i JOIN r b ON b.map = c.map AND b.i = c.j")
def cm_vc(spark, d):
    return rounded(NM.coverage(cells(spark, d)), 6, scale=1e6)


@query(_R + "SELECT c.map, binsize, c.i, c.j, round(v / sqrt(a.r * b.r), 9) AS v FROM cells c JOIN r a ON a.map = c.map AND a.i = c.i JOIN r b ON b.map = c.map AND b.i = c.j")
def cm_vc_sqrt(spark, d):
    return rounded(NM.coverage(cells(spark, d), True))


@query("SELECT map, binsize, i, sum(v) AS r FROM cells GROUP BY 1, 2, 3")
def cm_row_sums(spark, d):
    return NM.row_sums(cells(spark, d))


@query("SELECT map, binsize, abs(i - j) AS d, median(v) AS expected FROM cells GROUP BY 1, 2, 3")
def cm_distance_median(spark, d):
    return NM.by_distance(cells(spark, d))


@query("SELECT map, binsize, abs(i - j) AS d, round(avg(v), 9) AS expected FROM cells GROUP BY 1, 2, 3")
def cm_distance_mean(spark, d):
    return rounded(NM.by_distance(cells(spark, d), "mean"), column="expected")


@query("SELECT binsize, abs(i - j) AS d, median(v) AS expected FROM cells GROUP BY 1, 2")
def cm_distance_pooled(spark, d):
    return NM.by_distance(cells(spark, d), pool=True)


_OUT = ", k AS (SELECT map, binsize, i, j, abs(i - j) AS d, v FROM cells), m AS (SELECT map, d, median(v) AS m FROM k GROUP BY 1, 2), s AS (SELECT k.*, m.m, median(abs(v - m.m)) OVER (PARTITION BY k.map, k.d) AS mad FROM k JOIN m ON m.map = k.map AND m.d = k.d), t AS (SELECT * FROM s WHERE mad = 0 OR 0.6745 * abs(v - m) / mad <= 3.5) "


@query(_OUT + "SELECT map, binsize, d, round(avg(v), 9) AS expected FROM t GROUP BY 1, 2, 3")
def cm_distance_no_outliers(spark, d):
    return rounded(NM.by_distance(cells(spark, d), "mean", 3.5), column="expected")


_EXPECTED = ", e AS (SELECT map, abs(i - j) AS d, median(v) AS m FROM cells GROUP BY 1, 2) "


@query(_EXPECTED + "SELECT c.map, binsize, i, j, round(v / m, 9) AS v FROM cells c JOIN e ON e.map = c.map AND e.d = abs(i - j)")
def cm_mcfs_oe(spark, d):
    return rounded(NM.over_expected(cells(spark, d)))


@query(_EXPECTED + "SELECT * FROM (SELECT c.map, binsize, i, j, CASE WHEN v - m < 0 THEN 1.0 ELSE v - m END AS v FROM cells c JOIN e ON e.map = c.map AND e.d = abs(i - j)) WHERE v <> 0")
def cm_mcfs_o_minus_e(spark, d):
    return NM.over_expected(cells(spark, d), kind="o-e")


def _sweep(k):
    b, s = f"b{k - 1}", f"s{k}"
    return f""", {s} AS MATERIALIZED (SELECT c.map, c.i, sum(v / (x.b * y.b)) AS s FROM cells c JOIN {b} x ON x.map = c.map AND x.i = c.i JOIN {b} y ON y.map = c.map AND y.i = c.j GROUP BY 1, 2),
d{k} AS MATERIALIZED (SELECT {s}.map, {s}.i, x.b * CASE WHEN s = 0 THEN 1 ELSE s / avg(s) FILTER (WHERE s <> 0) OVER (PARTITION BY {s}.map) END AS b FROM {s} JOIN {b} x ON x.map = {s}.map AND x.i = {s}.i),
t{k} AS MATERIALIZED (SELECT c.map, sum(v / (x.b * y.b)) AS t FROM cells c JOIN d{k} x ON x.map = c.map AND x.i = c.i JOIN d{k} y ON y.map = c.map AND y.i = c.j GROUP BY 1),
b{k} AS MATERIALIZED (SELECT d{k}.map, i, b * sqrt(t / w) AS b FROM d{k} JOIN t{k} ON t{k}.map = d{k}.map JOIN whole ON whole.map = d{k}.map)"""


_IC = ", whole AS (SELECT map, sum(v) AS w FROM cells GROUP BY 1), b0 AS (SELECT DISTINCT map, i, 1.0::DOUBLE AS b FROM cells)" + "".join(_sweep(k) for k in (1, 2, 3))


@query(_IC + " SELECT map, 50::BIGINT AS binsize, i, round(b, 6) AS b FROM b3")
def cm_ic_bias(spark, d):
    # three sweeps: the rule stops after iterations + 2
    return rounded(NM.correction_bias(cells(spark, d), 0.0, 1), 6, "b")


@query(_IC + " SELECT c.map, binsize, c.i, c.j, round(v / (x.b * y.b), 6) AS v FROM cells c JOIN b3 x ON x.map = c.map AND x.i = c.i JOIN b3 y ON y.map = c.map AND y.i = c.j")
def cm_ic_k(spark, d):
    return rounded(NM.correct(cells(spark, d), 0.0, 1), 6)


@query()
def cm_kr(spark, d):
    return rounded(NM.balance(cells(spark, d)), 9)


@query("SELECT map, 50::BIGINT AS binsize, i, 1.0::DOUBLE AS total FROM (SELECT DISTINCT map, i FROM cells)")
def cm_kr_row_sums(spark, d):
    return rounded(NM.row_sums(NM.balance(cells(spark, d))).withColumnRenamed("r", "total"), 9, "total")


# -- correlations

_PAIR = ", fo AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0.0) AS a, coalesce(b.v, 0.0) AS b FROM (SELECT * FROM cells WHERE map = 'F') a FULL JOIN (SELECT * FROM cells WHERE map = 'O') b ON a.i = b.i AND a.j = b.j), lim AS (SELECT min(v) FILTER (WHERE map = 'F') AS la, min(v) FILTER (WHERE map = 'O') AS lb, max(i) FILTER (WHERE map = 'F') + 1 AS na, max(i) FILTER (WHERE map = 'O') + 1 AS nb FROM cells), pr AS (SELECT i, j, a, b FROM fo, lim WHERE j - i > 1 AND i < least(na, nb) AND j < least(na, nb) AND (a >= la OR b >= lb)) "


def _fo(spark, d):
    c = cells(spark, d)
    return one(c, "F"), one(c, "O")


@query(_PAIR + "SELECT round(corr(a, b), 9) AS corr, count(*) AS n FROM pr")
def cm_corr_pearson(spark, d):
    return rounded(S.correlate(*_fo(spark, d)), column="corr")


@query(_PAIR + "SELECT round(corr(x, y), 9) AS corr, count(*) AS n FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM pr)")
def cm_corr_spearman(spark, d):
    return rounded(S.correlate(*_fo(spark, d), kind="spearman"), column="corr")


@query(", q AS (SELECT quantile_cont(v, 0.2) FILTER (WHERE map = 'F') AS la, quantile_cont(v, 0.2) FILTER (WHERE map = 'O') AS lb FROM cells) SELECT round(corr(a.v, b.v), 9) AS corr, count(*) AS n FROM cells a JOIN cells b ON a.map = 'F' AND b.map = 'O' AND a.i = b.i AND a.j = b.j, q WHERE a.j - a.i > 1 AND (a.v > la OR b.v > lb)")
def cm_corr_cutoff(spark, d):
    return rounded(S.correlate(*_fo(spark, d), cutoff=20.0), column="corr")


@query("SELECT a.map AS map, round(corr(a.v, b.v), 9) AS corr, count(*) AS n FROM cells a JOIN (SELECT map, i, j, v / (1 + i + j) AS v FROM cells) b USING (map, i, j) WHERE j - i > 1 GROUP BY 1")
def cm_corr_container(spark, d):
    c = cells(spark, d)
    return rounded(S.correlate(c, c.withColumn("v", F.col("v") / (1 + F.col("i") + F.col("j"))), on=("map",)), column="corr")


@query(_PAIR + ", w AS (SELECT unnest(range(0, (SELECT least(na, nb) - 10 FROM lim), 2)) AS s) SELECT s AS start, (s + 5.0) * 50 AS centre, round(CASE WHEN count(*) > 10 THEN coalesce(corr(a, b), 0) ELSE 0 END, 9) AS corr FROM pr JOIN w ON i >= s AND i < s + 10 AND j >= s AND j < s + 10 GROUP BY 1")
def cm_corr_block(spark, d):
    return rounded(S.correlate_blocks(*_fo(spark, d), 10, 2, binsize=50), column="corr")


@query(", ix AS (SELECT i.x AS i, j.x AS j FROM (SELECT unnest(range(0, (SELECT min(n) FROM size WHERE map IN ('F', 'O')))) AS x) i, (SELECT unnest(range(0, (SELECT min(n) FROM size WHERE map IN ('F', 'O')))) AS x) j), z AS (SELECT ix.i, ix.j, coalesce(a.v, 0.0) AS a, coalesce(b.v, 0.0) AS b FROM ix LEFT JOIN (SELECT * FROM cells WHERE map = 'F') a USING (i, j) LEFT JOIN (SELECT * FROM cells WHERE map = 'O') b USING (i, j)) SELECT i, count(*) AS n, round(corr(a, b), 9) AS corr FROM z WHERE a <> (SELECT min(v) FROM cells WHERE map = 'F') AND b <> (SELECT min(v) FROM cells WHERE map = 'O') GROUP BY 1")
def cm_corr_binwise(spark, d):
    return rounded(S.correlate_bins(*_fo(spark, d)), column="corr")


_COV = ", cv AS (SELECT a.map, a.i AS i1, b.i AS i2, covar_pop(a.v, b.v) AS cov FROM {0} a JOIN {0} b ON a.map = b.map AND a.j = b.j AND a.i >= b.i GROUP BY 1, 2, 3 HAVING count(*) > 3) "


@query(_COV.format("cells") + "SELECT map, 50::BIGINT AS binsize, i1, i2, round(cov, 6) AS cov FROM cv")
def cm_covmat(spark, d):
    return rounded(S.covariance_matrix(cells(spark, d)), 6, "cov")


@query(_COV.format("cells") + ", va AS (SELECT map, i, var_pop(v) AS x FROM cells GROUP BY 1, 2) SELECT cv.map, 50::BIGINT AS binsize, i1, i2, round(cov / sqrt(a.x * b.x), 6) AS corr FROM cv JOIN va a ON a.map = cv.map AND a.i = i1 JOIN va b ON b.map = cv.map AND b.i = i2 WHERE i1 > i2")
def cm_corrmat(spark, d):
    return rounded(S.correlation_matrix(cells(spark, d)), 6, "corr")


@query(", lg AS MATERIALIZED (SELECT map, binsize, i, j, log10(v) AS v FROM cells WHERE log10(v) <> 0)" + _COV.format("lg") + ", va AS (SELECT map, i, var_pop(v) AS x FROM lg GROUP BY 1, 2) SELECT cv.map, 50::BIGINT AS binsize, i1, i2, round(cov / sqrt(a.x * b.x), 6) AS corr FROM cv JOIN va a ON a.map = cv.map AND a.i = i1 JOIN va b ON b.map = cv.map AND b.i = i2 WHERE i1 > i2")
def cm_corrmat_log(spark, d):
    logs = cells(spark, d).where("v > 0").withColumn("v", F.log10("v"))
    return rounded(S.correlation_matrix(logs, mask=0.0), 6, "corr")


@query("SELECT a.map, 50::BIGINT AS binsize, a.i AS i1, b.i AS i2, round(corr(a.v, b.v), 6) AS corr FROM cells a JOIN cells b ON a.map = b.map AND a.j = b.j AND a.i > b.i GROUP BY 1, 3, 4 HAVING count(*) > 3")
def cm_corrmat_pairwise(spark, d):
    return rounded(S.correlation_matrix(cells(spark, d), pairwise=True), 6, "corr")


# -- Markov chains

_P = ", p AS MATERIALIZED (SELECT map, i, j, v / sum(v) OVER (PARTITION BY map, i) AS p FROM cells), fl AS (SELECT map, min(p) AS f FROM p GROUP BY 1), w0 AS (SELECT map, unnest(range(0, n)) AS i, 1.0 / n AS w FROM size) "


@query(_P + "SELECT p.map, 50::BIGINT AS binsize, i, j, round(p, 9) AS p, round(f, 9) AS fill FROM p JOIN fl ON fl.map = p.map")
def cm_transition(spark, d):
    return rounded(rounded(M.with_fill(M.transition(cells(spark, d))), column="p"), column="fill")


@query(_P + "".join(f", w{k} AS MATERIALIZED (SELECT w.map, p.j AS i, sum(p.p * w.w) AS w FROM p JOIN w{k - 1} w ON w.map = p.map AND w.i = p.i GROUP BY 1, 2)" for k in (1, 2, 3)) + " SELECT map, 50::BIGINT AS binsize, i, round(w, 9) AS w FROM w3")
def cm_stationary_k(spark, d):
    c = cells(spark, d)
    p, w = M.transition(c), M.start(c)
    for _ in range(3):
        w = M.step(p, w)
    return rounded(w, column="w")


@query()
def cm_stationary(spark, d):
    return rounded(M.stationary(cells(spark, d)), column="w")


@query(_P + "SELECT a.map, 50::BIGINT AS binsize, a.i, b.j, round(sum(a.p * b.p), 9) AS p FROM p a JOIN p b ON a.map = b.map AND a.j = b.i GROUP BY 1, 3, 4")
def cm_matpow2(spark, d):
    return rounded(M.power(M.transition(cells(spark, d)), 2), column="p")


def _discounted(spark, d):
    """The identity less half the transition matrix, which has an inverse for every map."""
    p = written(M.transition(cells(spark, d)), "transition")
    rows = p.select("map", "binsize", "i", "j", (F.col("p") / -2).alias("p")).unionByName(M.power(p, 0))
    return rows.groupBy("map", "binsize", "i", "j").agg(F.sum("p").alias("p"))


@query("SELECT DISTINCT map, binsize, i, i AS j, 1.0::DOUBLE AS p FROM cells")
def cm_inverse(spark, d):
    m = written(_discounted(spark, d), "matrix")
    return rounded(M.multiply(m, M.power(m, -1)), column="p").where("p <> 0")


@query(_P + ", q AS (SELECT p.map, p.i, sum(p) AS s FROM p GROUP BY 1, 2) SELECT map, 50::BIGINT AS binsize, i, round(2 * s, 9) AS p FROM q")
def cm_inverse_row_sums(spark, d):
    return rounded(M.power(_discounted(spark, d), -1).groupBy("map", "binsize", "i").agg(F.sum("p").alias("p")), column="p")


@query(_P + ", p2 AS MATERIALIZED (SELECT a.map, a.i, b.j, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.map = b.map AND a.j = b.i GROUP BY 1, 2, 3) SELECT a.map, 50::BIGINT AS binsize, a.i, b.j, round(sum(a.p * b.p), 9) AS p FROM p2 a JOIN p2 b ON a.map = b.map AND a.j = b.i GROUP BY 1, 3, 4")
def cm_matpow4(spark, d):
    return rounded(M.power(M.transition(cells(spark, d)), 4), column="p")


# -- structure


@query(", o AS (SELECT a.x AS da, b.x AS db FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x)), sm AS (SELECT c.map, c.i + da AS i, c.j + db AS j, sum(v) AS s FROM cells c, o GROUP BY 1, 2, 3) SELECT sm.map, 50::BIGINT AS binsize, i, j, round(s / ((least(i + 2, n) - greatest(i - 1, 0)) * (least(j + 2, n) - greatest(j - 1, 0))), 9) AS v FROM sm JOIN size ON size.map = sm.map WHERE i BETWEEN 0 AND n - 1 AND j BETWEEN 0 AND n - 1")
def cm_smooth(spark, d):
    return rounded(T.smooth(cells(spark, d)))


@query()
def cm_compartment_pca_sign(spark, d):
    return T.compartments(cells(spark, d)).select("map", "i", F.signum("score").cast("int").alias("side"))


@query()
def cm_compartment_kmeans(spark, d):
    return T.compartments(cells(spark, d), "k-means").select("map", "i", F.col("score").cast("int").alias("side"))


@query(""", sg AS (SELECT DISTINCT map, i, CASE WHEN i % 3 = 0 THEN -1.0 ELSE 1.0 END AS s FROM cells),
dn AS (SELECT a.map, a.i, a.s, b.s AS t, coalesce(c.v, 0.0) AS v FROM sg a JOIN sg b ON a.map = b.map LEFT JOIN cells c ON c.map = a.map AND c.i = a.i AND c.j = b.i),
pm AS (SELECT map, i, s, median(v) FILTER (WHERE t > 0) AS pos, median(v) FILTER (WHERE t < 0) AS neg FROM dn GROUP BY 1, 2, 3)
SELECT map, 50::BIGINT AS binsize, i, CAST(CASE WHEN (s < 0 AND pos > neg) OR (s > 0 AND neg > pos) THEN -s ELSE s END AS DOUBLE) AS score FROM pm""")
def cm_peak_correct(spark, d):
    c = cells(spark, d)
    scores = c.select(*C.KEY, "i").distinct().withColumn("score", F.when(F.col("i") % 3 == 0, -1.0).otherwise(1.0))
    return T.correct_peaks(scores, c)


@query("SELECT * FROM cells WHERE j - i > 4 AND v > 1200")
def tad_diag_filter(spark, d):
    return T.off_diagonal_peaks(cells(spark, d).where("v > 1200"))


@query(""", bx AS (SELECT map, i AS a, j AS b, n FROM cells JOIN size USING (map) WHERE j - i BETWEEN 5 AND 8),
eg AS (SELECT bx.map, a, b, count(*) AS held, sum(ln(v)) AS l FROM bx JOIN cells c ON c.map = bx.map AND v > 0 AND ((c.j = b + 1 AND c.i BETWEEN a AND b - 4) OR (c.i = b + 1 AND c.j BETWEEN a AND b - 4)) GROUP BY 1, 2, 3)
SELECT bx.map, 50::BIGINT AS binsize, bx.a, bx.b, CASE WHEN bx.b + 1 >= n THEN NULL WHEN coalesce(held, 0) < 2 * (bx.b - 3 - bx.a) THEN 'Infinity'::DOUBLE ELSE round(-l / held, 9) END AS score
FROM bx LEFT JOIN eg ON eg.map = bx.map AND eg.a = bx.a AND eg.b = bx.b""")
def tad_box_scores(spark, d):
    c = cells(spark, d)
    boxes = c.where("j - i BETWEEN 5 AND 8").select(*C.KEY, F.col("i").alias("a"), F.col("j").alias("b"))
    return rounded(T.box_scores(boxes, c), column="score")


@query()
def tad_suppress(spark, d):
    c = cells(spark, d)
    boxes = c.where("j - i BETWEEN 5 AND 8").select(*C.KEY, F.col("i").alias("a"), F.col("j").alias("b"))
    return rounded(T.suppress_overlaps(T.box_scores(boxes, c)), column="score")


# -- tracks

_AGG = {"min": "min(value)", "max": "max(value)", "amean": "avg(value)", "hmean": "count(*) / sum(1 / value)", "gmean": "exp(avg(ln(value)))", "median": "median(value)"}


def _track(method):
    def f(spark, d):
        return rounded(R.bin_track(signal(spark, d), 10, (method,)), column=method)

    f.__name__ = f"trk_bins_{method}"
    track_query(f"SELECT chrom, bin, round({_AGG[method]}, 9) AS {method} FROM sig GROUP BY 1, 2")(f)


for _m in R.METHODS:
    _track(_m)


@track_query("SELECT chrom, bin, " + ", ".join(f"round({a}, 9) AS {m}" for m, a in _AGG.items()) + " FROM sig GROUP BY 1, 2")
def trk_bins(spark, d):
    out = R.bin_track(signal(spark, d), 10)
    for m in R.METHODS:
        out = rounded(out, column=m)
    return out


_LONG = ", t AS MATERIALIZED (SELECT chrom, bin, max(value) AS v FROM sig GROUP BY 1, 2) "


def _long(spark, d):
    return R.long_form(R.bin_track(signal(spark, d), 10, ("max",)), 10, ("max",))


def _down(method, agg):
    def f(spark, d):
        return rounded(Z.coarsen_track(_long(spark, d), 3, method), 6)

    f.__name__ = f"trk_downsample_{method}"
    SQL[f.__name__] = f"WITH {SQL_TRACK}{_LONG} SELECT chrom, 30::BIGINT AS binsize, 'max' AS name, CAST(floor(bin / 3.0) AS BIGINT) AS bin, round({agg}(v), 6) AS v FROM t GROUP BY 1, 4"
    QUERIES[f.__name__] = f


for _m, _a in (("max", "max"), ("sum", "sum"), ("mean", "avg")):
    _down(_m, _a)


def _combine(method, sql):
    def f(spark, d):
        rows = signal(spark, d).select("chrom", F.floor(F.col("pos") / 10).cast("long").alias("bin"), "value", "seq")
        return rounded(R.combine(rows, method), 6)

    f.__name__ = f"trk_combine_{method}"
    QUERIES[f.__name__] = f
    SQL[f.__name__] = f"WITH {SQL_TRACK} SELECT chrom, bin, round({sql}, 6) AS v FROM sig GROUP BY 1, 2"


for _m, _a in (("max", "max(value)"), ("min", "min(value)"), ("mean", "list_reduce(list(value ORDER BY seq), lambda a, x: (a + x) / 2)")):
    _combine(_m, _a)


def _sql_long(sql):
    return f"WITH {SQL_TRACK}{_LONG} {sql}"


def trk_percentile95(spark, d):
    return rounded(R.percentile(_long(spark, d)), 6, "limit")


def trk_pos_neg_split(spark, d):
    return R.signs(_long(spark, d).withColumn("v", F.col("v") - 450))


def trk_outliers(spark, d):
    return S.drop_outliers(_long(spark, d), ["chrom"], 2.0)


def trk_chrom_sizes(spark, d):
    return R.chromosome_sizes(signal(spark, d).select("chrom", (F.col("pos") + 1).alias("end")))


for _f, _s in (
    (trk_percentile95, "SELECT chrom, 10::BIGINT AS binsize, 'max' AS name, round(quantile_cont(v, 0.95), 6) AS \"limit\" FROM t GROUP BY 1"),
    (trk_pos_neg_split, "SELECT chrom, 10::BIGINT AS binsize, 'max' AS name, bin, least(v - 450, 0.0) AS negative, greatest(v - 450, 0.0) AS positive FROM t WHERE v <> 450"),
    (trk_outliers, ", m AS (SELECT chrom, median(v) AS m FROM t GROUP BY 1), s AS (SELECT t.*, m, median(abs(v - m)) OVER (PARTITION BY t.chrom) AS mad FROM t JOIN m ON m.chrom = t.chrom) SELECT chrom, 10::BIGINT AS binsize, 'max' AS name, bin, v FROM s WHERE mad = 0 OR 0.6745 * abs(v - m) / mad <= 2.0"),
    (trk_chrom_sizes, "SELECT event_type AS chrom, max(user_id + 1) AS size FROM events GROUP BY 1"),
):
    QUERIES[_f.__name__] = _f
    SQL[_f.__name__] = _sql_long(_s).replace("GROUP BY 1, 2)  ,", "GROUP BY 1, 2),")


@query("SELECT chrom, b AS binsize, bin, round(sum(w * value) / sum(w), 6) AS amean, max(value) AS max FROM (SELECT o_orderpriority AS chrom, o_custkey % 1000 * 100 AS s, o_custkey % 1000 * 100 + 40 AS e, min(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) iv, (VALUES (100::BIGINT), (250)) r(b), LATERAL (SELECT unnest(range(CAST(floor(s / b) AS BIGINT), CAST(floor((e - 1) / b) AS BIGINT) + 1)) AS bin), LATERAL (SELECT least(e, (bin + 1) * b) - greatest(s, bin * b) AS w) GROUP BY 1, 2, 3", "z AS (SELECT 1)")
def trk_intervals(spark, d):
    start = F.col("o_custkey") % 1000 * 100
    iv = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("chrom"), start.alias("start"), (start + 40).alias("end")).agg(F.min("o_totalprice").alias("value"))
    return rounded(R.bin_intervals(iv, [100, 250], ("amean", "max")), 6, "amean")


_COVER = "iv AS (SELECT event_type AS chrom, user_id * 3 % 1000 AS s, 1000 + user_id * 7 % 977 AS e, round(value, 6) AS value, event_id AS seq FROM events), ct AS (SELECT DISTINCT chrom, s AS x FROM iv UNION SELECT DISTINCT chrom, e FROM iv), sg AS (SELECT chrom, x AS s, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS e FROM ct)"


def _covering(spark, d):
    """An interval for each event, all of a chromosome with a place in common."""
    user, e = F.col("user_id"), table(spark, d, "events")
    return e.select(F.col("event_type").alias("chrom"), (user * 3 % 1000).alias("start"), (1000 + user * 7 % 977).alias("end"), F.round("value", 6).alias("value"), F.col("event_id").alias("seq"))


def _disjoint(method, sql):
    def f(spark, d):
        return rounded(R.disjoint(_covering(spark, d), method), 6, "value")

    f.__name__ = f"trk_disjoint_{method}"
    QUERIES[f.__name__] = f
    SQL[f.__name__] = f"WITH {_COVER} SELECT sg.chrom, sg.s AS start, sg.e AS \"end\", round({sql}, 6) AS value FROM sg JOIN iv ON iv.chrom = sg.chrom AND iv.s <= sg.s AND iv.e >= sg.e GROUP BY 1, 2, 3"


for _m, _a in (("max", "max(value)"), ("min", "min(value) FILTER (WHERE value <> 0)"), ("mean", "list_reduce(list(value ORDER BY seq), lambda a, x: CASE WHEN a = 0 THEN x WHEN x = 0 THEN a ELSE (a + x) / 2 END)")):
    _disjoint(_m, _a)


# -- sources: the tables' rows, written in a format below the shared folder and read again


def put_lines(rows: DataFrame, name: str, *by: str, compression: str | None = None) -> str:
    """Text files of column value; those of each value of ``by`` in a folder of its own."""
    path = shared_path(rows.sparkSession, name)
    rows.select("value", *by).write.partitionBy(*by).text(path, compression) if by else rows.select("value").write.text(path, compression)
    return path


def maps_of(df: DataFrame) -> list[str]:
    return sorted(r["map"] for r in df.select("map").distinct().collect())  # names only


def joined_text(*parts, by: str = " "):
    return F.concat_ws(by, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


@query("SELECT * FROM cells")
def src_coo(spark, d):
    c = written(upper(spark, d), "cells")
    path = put_lines(c.select("map", joined_text(F.col("i") * 50, F.col("j") * 50, F.col("v"))), "coo", "map")
    return X.coo_list(spark, [(f"{path}/map={m}", m) for m in maps_of(c)], resolution="50b")


@query("SELECT map, 1000::BIGINT AS binsize, i, j, v FROM cells")
def src_coo_index(spark, d):
    c = written(upper(spark, d), "cells")
    path = put_lines(c.select("map", joined_text(F.col("j"), F.col("i"), F.col("v"), by="\t")), "coo", "map")
    return X.coo_list(spark, [(f"{path}/map={m}", m) for m in maps_of(c)], resolution="1kb", coordinate="index")


@query("SELECT * FROM cells")
def src_paired_coo(spark, d):
    at = lambda c: (F.col("map"), F.col(c) * 50 - 15, F.col(c) * 50)
    path = put_lines(upper(spark, d).select(joined_text(*at("i"), *at("j"), F.col("v"), by="\t")), "paircoo")
    return X.paired_coo(spark, path, 50)


@query("SELECT 'chr' || map AS map, binsize, i, j, v FROM cells")
def src_matrix_file(spark, d):
    c = written(cells(spark, d), "cells")
    # a header for each map, with as many entries as it has bins, as the format asks for
    bins = c.select("map", "i").distinct().select("map", "i", F.concat_ws("-", "map", F.col("i") * 50).alias("x"))
    bins = written(bins.withColumn("k", F.row_number().over(Window.partitionBy("map").orderBy("x")) - 1), "bins")
    head = bins.groupBy("map").agg(F.array_join(F.array_sort(F.collect_list("x")), "\t").alias("head"), F.count("*").cast("int").alias("n"))
    # a row's cells by place, each behind as many zeros as there are between it and the one before
    held = c.join(bins.select("map", F.col("i").alias("j"), "k"), ["map", "j"]).groupBy("map", "i").agg(F.array_sort(F.collect_list(F.struct("k", F.col("v").cast("string").alias("v")))).alias("s"))
    after = lambda k: F.coalesce(F.get("s", k - 1)["k"], F.lit(-1))
    value = F.array_join(F.transform("s", lambda x, k: F.concat(F.repeat(F.lit("0\t"), x["k"] - after(k) - 1), x["v"])), "\t")
    rest = F.repeat(F.lit("\t0"), F.col("n") - 1 - F.element_at("s", -1)["k"])
    body = held.join(head.select("map", "n"), "map").select(joined_text(F.lit("row"), F.concat_ws("-", "map", F.col("i") * 50), F.concat(value, rest), by="\t"))
    first = head.select(joined_text(F.lit("HiCMatrix"), F.lit("Regions"), F.col("head"), by="\t"))
    return X.homer(spark, put_lines(first.unionByName(body), "homer", compression="gzip"), 50)


@query("SELECT 'chr' || map AS map, binsize, i + 1 AS i, j + 1 AS j, v FROM cells")
def src_bins_and_contacts(spark, d):
    c = written(upper(spark, d), "cells")
    names = c.select("map").distinct().withColumn("k", F.row_number().over(Window.orderBy("map")))  # one row per map
    bins = C.axis(C.mirror(c)).select("map", "i").join(names, "map").select("map", "i", (F.col("k") * 1_000_000 + F.col("i")).alias("cbin"))
    bins = written(bins, "bins")
    one = put_lines(bins.select(joined_text(F.col("cbin"), F.col("map"), F.col("i") * 50, F.col("i") * 50 + 50, F.lit(1), by="\t")), "bins")
    ends = lambda x, n: bins.select("map", F.col("i").alias(x), F.col("cbin").alias(n))
    both = c.join(ends("i", "b1"), ["map", "i"]).join(ends("j", "b2"), ["map", "j"])
    two = put_lines(both.select(joined_text(F.col("b1"), F.col("b2"), F.lit(1.5), F.col("v"), by="\t")), "contacts")
    return X.bins_and_contacts(spark, one, two)


def intervals(spark, d):
    """Disjoint intervals of ten bases: a user's first event of each kind."""
    first = signal(spark, d).where("value > 0").groupBy("chrom", "pos").agg(F.min_by("value", "seq").alias("value"))
    return first.select("chrom", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + 10).alias("end"), "value")


_IV = "iv AS (SELECT event_type AS chrom, user_id * 10 AS start, user_id * 10 + 10 AS \"end\", arg_min(value, event_id) AS value FROM events WHERE value > 0 GROUP BY 1, 2) "


@query("SELECT * FROM iv", _IV)
def src_bed(spark, d):
    rows = intervals(spark, d)
    path = put_lines(rows.select(joined_text(F.col("chrom"), F.col("start"), F.col("end"), F.lit("name"), F.lit(0), F.lit("."), F.col("value"), by="\t")), "bed")
    return X.bed(spark, path).drop("seq")


def sections(rows: DataFrame, head: Callable, line: Callable, gaps: bool = True) -> DataFrame:
    """Lines of a format in which a head says what the lines behind it are about: some of a
    chromosome's rows make a section, so a chromosome isn't one task's. Without gaps a section
    ends where the next interval doesn't follow at once."""

    def run(batches):
        last = None
        for pdf in batches:
            out = []
            for chrom, start, end, value in zip(pdf["chrom"], pdf["start"], pdf["end"], pdf["value"]):
                if last is None or chrom != last[0] or not (gaps or start == last[1]):
                    out.append(head(chrom, start))
                last = chrom, end
                out.append(line(chrom, start, end, value))
            yield pd.DataFrame({"value": out})

    return rows.repartition("chrom", F.floor(F.col("start") / 400)).sortWithinPartitions("chrom", "start").mapInPandas(run, "value string")


@query("SELECT * FROM iv", _IV)
def src_wig_variable(spark, d):
    lines = sections(intervals(spark, d), lambda c, s: f"variableStep chrom={c} span=10", lambda c, s, e, v: f"{s + 1} {v!r}")
    return X.wig(spark, put_lines(lines, "wig")).drop("seq")


@query("SELECT * FROM iv", _IV)
def src_wig_fixed(spark, d):
    lines = sections(intervals(spark, d), lambda c, s: f"fixedStep chrom={c} start={s + 1} step=10 span=10", lambda c, s, e, v: f"{v!r}", gaps=False)
    return X.wig(spark, put_lines(lines, "wig")).drop("seq")


@query("SELECT * FROM iv", _IV)
def src_wig_bedgraph(spark, d):
    lines = sections(intervals(spark, d), lambda c, s: f"#bedGraph section {c}:{s}-", lambda c, s, e, v: f"{c}\t{s}\t{e}\t{v!r}")
    return X.wig(spark, put_lines(lines, "wig")).drop("seq")


@query("SELECT chrom, 10::BIGINT AS binsize, 'text' AS name, start // 10 AS bin, value AS v FROM iv", _IV)
def src_text_track(spark, d):
    rows = written(intervals(spark, d), "intervals")
    path = put_lines(rows.select("chrom", joined_text(F.col("start"), F.col("value"))), "track", "chrom")
    out = None
    for r in rows.select("chrom").distinct().orderBy("chrom").collect():  # names only
        one = X.text_track(spark, f"{path}/chrom={r['chrom']}", r["chrom"], 10, check=False)
        out = one if out is None else out.unionByName(one)
    return out


# -- the container and what works on it

_PYRAMID = SQL["cm_pyramid"].removesuffix(_UNION)
_UP = f"{_PYRAMID}, up AS (SELECT * FROM ({_UNION}))"


def stored(spark, d, stop: int = 12) -> str:
    """A container of the maps with their pyramids."""
    path = shared_path(spark, "container")
    K_.add_map(cells(spark, d), path, stop=stop)
    return path


def raw(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@raw(f"{_UP} SELECT * FROM up")
def cont_maps(spark, d):
    return K_.read_cells(spark, stored(spark, d))


@raw(f"{_UP} SELECT map, binsize, max(i) + 1 AS nx, max(j) + 1 AS ny, min(v) AS minvalue, max(v) AS maxvalue FROM up GROUP BY 1, 2")
def cont_meta(spark, d):
    return K_.read_meta(spark, stored(spark, d)).select(*C.KEY, "nx", "ny", "minvalue", "maxvalue")


@raw(f"{_UP} SELECT * FROM up WHERE map = 'O' AND binsize = 100")
def cont_load(spark, d):
    return K_.load_map(spark, stored(spark, d), "O", 100)


@raw(f"{_UP} SELECT * FROM up")
def cont_recompress(spark, d):
    target = shared_path(spark, "container")
    K_.recompress(spark, stored(spark, d), target, "gzip")
    return K_.read_cells(spark, target)


@raw(f"{_PYRAMID}, l3x AS (SELECT map, 150::BIGINT AS binsize, CAST(ceil(i / 3.0) AS BIGINT) AS i, CAST(ceil(j / 3.0) AS BIGINT) AS j, sum(v) AS v FROM cells WHERE i > 0 AND j > 0 GROUP BY 1, 3, 4) SELECT * FROM l3x")
def cont_coarsen(spark, d):
    path = stored(spark, d)
    K_.coarsen_stored(spark, path, 150)
    return K_.read_cells(spark, path, binsize=150)


@raw(SQL["cm_coo_export"].replace("SELECT * FROM cells WHERE", "SELECT i, j, v FROM cells WHERE map = 'F' AND"))
def cont_export(spark, d):
    out = shared_path(spark, "export")
    K_.export_coo(K_.load_map(spark, stored(spark, d), "F"), out)
    return spark.read.schema("i long, j long, v double").csv(out, sep="\t")


def normalised(method: str, **options):
    def f(spark, d):
        target = shared_path(spark, "container")
        K_.normalise_container(spark, stored(spark, d), target, method, **options)
        return rounded(K_.read_cells(spark, target), 6, scale=1e6 if method == "vc" else None)

    return f


_UP_R = f"{_UP}, r AS (SELECT map, binsize, i, sum(v) AS r FROM up GROUP BY 1, 2, 3)"
for _f, _name, _sql in (
    (normalised("vc"), "cont_vc", f"{_UP_R} SELECT c.map, c.binsize, c.i, c.j, round(v / (a.r * b.r) * 1e6, 6) AS v FROM up c JOIN r a ON a.map = c.map AND a.binsize = c.binsize AND a.i = c.i JOIN r b ON b.map = c.map AND b.binsize = c.binsize AND b.i = c.j"),
    (normalised("mcfs", vmin=20.0), "cont_mcfs", f"{_UP}, e AS (SELECT map, binsize, abs(i - j) AS d, median(v) AS m FROM up WHERE v > 20 GROUP BY 1, 2, 3) SELECT c.map, c.binsize, i, j, round(v / m, 6) AS v FROM up c JOIN e ON e.map = c.map AND e.binsize = c.binsize AND e.d = abs(i - j) WHERE v > 20"),
    (normalised("ic", tol=0.0, iterations=1, stop=10**9), "cont_ic", SQL["cm_ic_k"]),
):
    _f.__name__ = _name
    raw(_sql)(_f)


@raw(f"{_UP}, f AS (SELECT map, binsize FROM up GROUP BY 1, 2 HAVING binsize = 50) SELECT f.map, f.binsize, i, 1.0::DOUBLE AS total FROM f JOIN (SELECT DISTINCT map, i FROM cells) USING (map)")
def cont_kr_row_sums(spark, d):
    target = shared_path(spark, "container")
    K_.normalise_container(spark, stored(spark, d), target, "kr")
    return rounded(NM.row_sums(K_.read_cells(spark, target, binsize=50)).withColumnRenamed("r", "total"), 9, "total")


_COV_UP = ", cv AS (SELECT a.map, a.binsize, a.i AS i1, b.i AS i2, covar_pop(a.v, b.v) AS cov FROM up a JOIN up b ON a.map = b.map AND a.binsize = b.binsize AND a.j = b.j AND a.i > b.i WHERE a.binsize >= 100 GROUP BY 1, 2, 3, 4 HAVING count(*) > 3), va AS (SELECT map, binsize, i, var_pop(v) AS x FROM up GROUP BY 1, 2, 3), cr AS (SELECT cv.map, cv.binsize, i1, i2, round(cov / sqrt(a.x * b.x), 4) AS v FROM cv JOIN va a ON a.map = cv.map AND a.binsize = cv.binsize AND a.i = i1 JOIN va b ON b.map = cv.map AND b.binsize = cv.binsize AND b.i = i2 WHERE a.x * b.x > 0)"


@raw(f"{_UP}{_COV_UP} SELECT map, binsize, i1 AS i, i2 AS j, v FROM cr WHERE v <> 0 UNION ALL SELECT map, binsize, i2, i1, v FROM cr WHERE v <> 0")
def cont_correlations(spark, d):
    # the finest level is in cm_corrmat
    source, coarse, target = stored(spark, d), shared_path(spark, "container"), shared_path(spark, "container")
    K_.write_cells(K_.read_cells(spark, source).where("binsize >= 100"), coarse)
    K_.correlate_container(spark, coarse, target)
    return K_.read_cells(spark, target)


@raw(f"{_UP} SELECT map, binsize, i, j, round(v / sum(v) OVER (PARTITION BY map, binsize, i), 9) AS v FROM up WHERE binsize >= 100")
def cont_transition(spark, d):
    target = shared_path(spark, "container")
    K_.transition_container(spark, stored(spark, d), target, 100)
    return rounded(K_.read_cells(spark, target))


@raw("")
def cont_stationary(spark, d):
    chain = shared_path(spark, "container")
    K_.transition_container(spark, stored(spark, d), chain, 50)
    return rounded(K_.stationary_container(spark, chain, shared_path(spark, "tracks"), 50, least=10))


@raw("")
def cont_compartments(spark, d):
    return rounded(K_.compartment_container(spark, stored(spark, d), shared_path(spark, "tracks"), 50, "k-means", 1.0))


SQL.pop("cont_stationary"), SQL.pop("cont_compartments")

_LEVELS = "".join(
    f" UNION ALL SELECT map, binsize * {b}, '{n}', CAST(ceil(i / {b}.0) AS BIGINT), round({a}(w), 9) FROM w WHERE i > 0 AND {'true' if p is None else f'ceil((n - 1) / {p}.0) + 1 >= 10'} GROUP BY map, binsize, 4"
    for n, a in (("maximum", "max"), ("average", "avg"), ("sum", "sum"))
    for p, b in zip((None, 2, 4, 5, 8, 10, 16, 20, 32), (2, 4, 5, 8, 10, 16, 20, 32, 64))
)


@query(", w AS (SELECT map, binsize, i, n, sum(v) / 1000 AS w FROM cells JOIN size USING (map) GROUP BY 1, 2, 3, 4) SELECT map AS chrom, binsize, name, i AS bin, round(w, 9) AS v FROM w, (VALUES ('maximum'), ('average'), ('sum')) t(name)" + _LEVELS)
def cont_distribution_levels(spark, d):
    w = NM.row_sums(cells(spark, d)).select(*C.KEY, "i", (F.col("r") / 1000).alias("w"))
    return rounded(K_.distribution_levels(w, 10))


@track_query(_LONG.strip() + " SELECT chrom, 10::BIGINT AS binsize, 'max' AS name, bin, v FROM t")
def cont_track(spark, d):
    path = shared_path(spark, "tracks")
    K_.write_track(_long(spark, d), path)
    return K_.read_track(spark, path)


def cont_blocks(spark, d):
    out = shared_path(spark, "blocks")
    K_.write_blocks(S.correlate_blocks(*_fo(spark, d), 10, 2, binsize=50), out)
    return rounded(spark.read.schema("centre double, corr double").csv(out, sep="\t"), column="corr")


QUERIES["cont_blocks"] = cont_blocks
SQL["cont_blocks"] = f"SELECT centre, corr FROM ({SQL['cm_corr_block']}) WHERE corr <> 0"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
