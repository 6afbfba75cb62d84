"""Contact maps and tracks of the order tables.

A contact is two parts in one order, its weight the first line's quantity, its map the
order's status; part keys are positions in bins of 50. A track's chromosome is the event
type, its bin the user by tens, its value the event's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import mirror

BINSIZE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper triangles. Orders are joined after the pairs' own key, so all three joins share
    one partitioning by order."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    b = lambda c: F.floor(F.col(c) / BINSIZE).cast("long")
    a = l.select("l_orderkey", F.col("l_linenumber").alias("n1"), b("l_partkey").alias("b1"), F.col("l_quantity").alias("q"))
    c = l.select("l_orderkey", F.col("l_linenumber").alias("n2"), b("l_partkey").alias("b2"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("map"))
    both = a.join(o, "l_orderkey").join(c, "l_orderkey").where("n1 < n2")
    both = both.groupBy("map", F.least("b1", "b2").alias("i"), F.greatest("b1", "b2").alias("j")).agg(F.sum("q").alias("v"))
    return both.select("map", F.lit(BINSIZE).cast("long").alias("binsize"), "i", "j", "v")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror(upper(spark, sf_dir))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, value, seq)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), F.col("user_id").alias("pos"), "value", F.col("event_id").alias("seq"))


SQL_CELLS = """contacts AS (SELECT o.o_orderstatus AS map,
    CAST(floor(least(a.l_partkey, b.l_partkey) / 50.0) AS BIGINT) AS i,
    CAST(floor(greatest(a.l_partkey, b.l_partkey) / 50.0) AS BIGINT) AS j, sum(a.l_quantity) AS v
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
  JOIN orders o ON o.o_orderkey = a.l_orderkey GROUP BY 1, 2, 3),
cells AS MATERIALIZED (SELECT map, 50::BIGINT AS binsize, i, j, v FROM contacts UNION ALL SELECT map, 50, j, i, v FROM contacts WHERE i <> j),
size AS (SELECT map, max(i) + 1 AS n FROM cells GROUP BY map)"""

SQL_TRACK = """sig AS (SELECT event_type AS chrom, CAST(floor(user_id / 10.0) AS BIGINT) AS bin, value, event_id AS seq FROM events WHERE value > 0)"""
