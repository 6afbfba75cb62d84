"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

from binweave.operators.structure import box_scores
from binweave.plans import catalogue
from binweave.plans.domain import cells

from .conftest import same
from .test_operators import sequential

WITHOUT_SQL = ["cm_kr", "cm_stationary", "cm_compartment_pca_sign", "cm_compartment_kmeans", "tad_suppress", "cont_stationary", "cont_compartments"]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    same(catalogue.queries()[name](spark, data).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df())


def test_those_without_sql():
    assert sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())) == sorted(WITHOUT_SQL)


def test_suppress_takes_all_boxes(spark, data):
    c = cells(spark, data)
    boxes = c.where("j - i BETWEEN 5 AND 8").select("map", "binsize", c["i"].alias("a"), c["j"].alias("b"))
    rows = [r for r in box_scores(boxes, c).collect() if r["score"] is not None]
    kept = []
    for name in {r["map"] for r in rows}:
        mine = sorted((r["a"], r["b"], r["score"]) for r in rows if r["map"] == name)
        kept += [(name, a, b) for a, b, _ in sequential(mine)]
    got = catalogue.queries()["tad_suppress"](spark, data).collect()
    assert sorted((r["map"], r["a"], r["b"]) for r in got) == sorted(kept)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
