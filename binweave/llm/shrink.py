"""Empirical Bayes shrinkage of site rates: beta priors fitted by moments.

A site (host, path) has n documents whose evidence, numbers in 0 to 1 such as failures or
probabilities, adds up to s, the squares to q. Rates s / n differ by what sites are and by
chance; the noise within sites, about m (1 - m) / n for yes and no, is taken out before
the spread of the rates tells how much weight the prior has:

    sigma2 = (sum q - sum s^2 / n) / (N - sites)
    tau2 = (sum s^2 / n - sum S^2 / N - (sites - parents) sigma2) / (N - sum n^2 / N)
    weight = sigma2 / tau2

with S and N the sums over a site's parent. Of yes and no evidence sigma2 / tau2 is the sum
of the beta prior's two parameters. A corpus of sparse sites that differ by no more than
chance gives the largest weight, so that they are drawn to the prior wholly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights, in documents, that a prior has at least and at most.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1e6


def prior_weight(sites: DataFrame, n: str, s: str, q: str, parent: list[str] | tuple[str, ...] = ()) -> float:
    """The weight of the sites' common prior, whose mean is the parent's rate. One row comes
    to the driver. Without two sites of one parent, or without a site of two documents,
    nothing tells sites apart, and the weight is the largest."""
    square = F.col(s) * F.col(s) / F.col(n)
    per = sites.groupBy(*parent).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"), F.sum(s).alias("s"), F.sum(q).alias("q"), F.sum(square).alias("b")
    )
    within, between = F.sum("q") - F.sum("b"), F.sum("b") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    k, total, free, spread, within, between = per.agg(F.sum("k"), F.sum("n"), F.sum("k") - F.count("*"), F.sum("n") - F.sum(F.col("n2") / F.col("n")), within, between).first()
    if not total or total <= k or free <= 0 or spread <= 0:
        return MOST_WEIGHT
    sigma2 = max(0.0, within) / (total - k)
    tau2 = (between - free * sigma2) / spread
    return MOST_WEIGHT if tau2 * MOST_WEIGHT <= sigma2 else min(MOST_WEIGHT, max(LEAST_WEIGHT, sigma2 / tau2))


def posterior(s: Column, n: Column, mean: Column, weight: float) -> Column:
    """The posterior mean of a site's rate."""
    return (s + mean * F.lit(weight)) / (n + F.lit(weight))
