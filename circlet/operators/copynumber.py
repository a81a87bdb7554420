"""Copy number against covariates, and the mode of a distribution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_negative_binomial(bins: DataFrame, covariates: list[str], alpha: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients of a log-link negative binomial regression of n (alpha 0: Poisson).

    Each step of iterative weighting is one aggregation to the normal
    equations, whose size is that of the covariates.
    """
    names = ["_one", *covariates]
    rows = bins.withColumn("_one", F.lit(1.0))
    k = len(names)
    beta = np.zeros(k)
    beta[0] = math.log(max(rows.agg(F.avg("n")).first()[0] or 1.0, 1e-9))
    for _ in range(steps):
        eta = sum((F.col(c) * float(b) for c, b in zip(names, beta)), F.lit(0.0))
        mu = F.exp(eta)
        w = mu / (1 + alpha * mu)
        z = eta + (F.col("n") - mu) / mu
        sums = rows.agg(*[F.sum(w * F.col(a) * F.col(b)).alias(f"a{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i], *[F.sum(w * F.col(a) * z).alias(f"b{i}") for i, a in enumerate(names)]).first()
        left = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype="f8")
        new = np.linalg.solve(left, np.array([sums[f"b{i}"] for i in range(k)], dtype="f8"))
        change = np.abs(new - beta).max()
        beta = new
        if change < 1e-8:
            break
    return beta


def normalise(bins: DataFrame, covariates: list[str], alpha: float = 1.0) -> DataFrame:
    """bins with n over its bias: fitted over the median fitted, held to [1/5, 5], plus one; cn is twice that over its mode (mean if the mode is 0)."""
    beta = fit_negative_binomial(bins, covariates, alpha)
    fitted = bins.withColumn("_f", F.exp(sum((F.col(c) * float(b) for c, b in zip(covariates, beta[1:])), F.lit(float(beta[0])))))
    middle = fitted.agg(F.median("_f").alias("_m"))
    out = fitted.crossJoin(F.broadcast(middle)).withColumn("factor", F.least(F.lit(5.0), F.greatest(F.lit(0.2), F.col("_f") / F.col("_m"))))
    out = out.withColumn("n_norm", F.bround(F.col("n") / F.col("factor"), 4) + 1).drop("_f", "_m")
    row = mode(out, "n_norm").first()
    top = row["mode"] if row and row["mode"] else out.agg(F.avg("n_norm")).first()[0]
    return out.withColumn("cn", 2 * F.col("n_norm") / F.lit(top))


def mode(df: DataFrame, value: str, points: int = 500) -> DataFrame:
    """One row: the top of a Gaussian kernel density (Scott's width) on points from 0 to the 99th percentile.

    Values are counted first, so the density is summed over distinct values.
    """
    sums = df.agg(F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"), F.percentile(value, 0.99).alias("_top"))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_k"))
    grid = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")).select((F.col("_i") * F.col("_top") / (points - 1)).alias("_g"), (F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h"))
    near = counts.crossJoin(F.broadcast(grid))
    u = F.try_divide(F.col("_g") - F.col(value), F.col("_h"))
    dense = near.groupBy("_g").agg(F.sum(F.col("_k") * F.exp(-0.5 * u * u)).alias("_d"))
    return dense.agg(F.max_by("_g", F.struct("_d", -F.col("_g"))).alias("mode"))
