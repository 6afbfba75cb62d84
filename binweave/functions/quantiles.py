"""Exact quantiles of groups of any size.

``percentile`` and ``median`` of Spark keep a group's distinct values in one task. Here equal
values are counted before they are shuffled, the counts are ranged by (group, value) and
written; the totals of the ranges are a histogram of each group that says in which range a
rank lies, and only that range is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import before_range, in_ranges, null_safe


def quantile(rows: DataFrame, keys: list[str], value: Column, q: float, name: str = "quantile") -> DataFrame:
    """Rows (keys, name): the value at share q of each group's order, between two values in
    proportion, as ``percentile`` gives it. Nulls don't count; a group without values is absent;
    a null key is a key; without keys there is one row, or none without values."""
    held = rows.select(*keys, value.cast("double").alias("__v")).where("__v IS NOT NULL")
    counts = in_ranges(held.groupBy(*keys, "__v").agg(F.count("*").alias("__c")), keys, ["__v"])
    sizes = counts.groupBy(*keys, "__range").agg(F.sum("__c").alias("__size"))
    totals = sizes.groupBy(*keys).agg(((F.sum("__size") - 1) * F.lit(float(q))).alias("__at"))
    ranges = null_safe(sizes, before_range(counts, keys, F.sum("__c"), F.sum), [*keys, "__range"])
    ranges = null_safe(ranges, totals, keys) if keys else ranges.crossJoin(F.broadcast(totals))  # one row
    before = F.coalesce("before", F.lit(0))
    # the ranges, two at most, that hold the values on both sides of the place
    ranges = ranges.where((before <= F.ceil("__at")) & (before + F.col("__size") > F.floor("__at")))
    ranges = ranges.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__range").alias("__r"), before.alias("__before"), "__at")
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    near = counts.join(ranges, same)
    order = Window.partitionBy("__range", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__to", F.col("__before") + F.sum("__c").over(order))
    here = lambda place: F.max(F.when((F.col("__to") - F.col("__c") <= place) & (place < F.col("__to")), F.col("__v")))
    low, high = F.floor("__at"), F.ceil("__at")
    found = near.groupBy(*keys).agg(here(low).alias("__a"), here(high).alias("__b"), F.max(F.col("__at") - low).alias("__f"))
    mixed = F.when(F.col("__f") == 0, F.col("__a")).otherwise(F.col("__a") * (1 - F.col("__f")) + F.col("__b") * F.col("__f"))
    out = found.select(*keys, mixed.alias(name))
    return out if keys else out.where(F.col(name).isNotNull())
