"""Empirical beta priors by the method of moments, over a grouped table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments_prior(groups: DataFrame, s: str, n: str, low: float = 2.0, high: float = 1000.0, center: Column | None = None) -> tuple[float, float]:
    """Mean rate and strength (alpha + beta) of the beta prior of rates s/n.

    The variance between groups is the weighted variance of the rates (around
    ``center`` if given) less what binomial sampling explains.  The strength is
    held in ``low..high``; without groups or variance it is ``high``.  One row
    comes to the driver.
    """
    mean = groups.agg(F.sum(s).alias("s"), F.sum(n).alias("n"), F.count("*").alias("g")).first()
    if not mean["n"]:
        return 0.5, high
    mu = mean["s"] / mean["n"]
    around = center if center is not None else F.lit(mu)
    spread = groups.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - around, 2)).alias("v")).first()["v"] / mean["n"]
    between = spread - mu * (1 - mu) * mean["g"] / mean["n"]
    if between <= 0:
        return mu, high
    return mu, min(high, max(low, mu * (1 - mu) / between - 1))
