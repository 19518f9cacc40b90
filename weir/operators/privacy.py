"""SELECT WITH DIFFERENTIAL_PRIVACY: bounded contributions, Laplace noise, thresholded groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def laplace(scale: float, seed: int | None = None) -> Column:
    """Noise of a Laplace distribution."""
    u = (F.rand(seed) if seed is not None else F.rand()) - 0.5
    return -F.signum(u) * F.log1p(-2 * F.abs(u) * (1 - 1e-15)) * scale


def dp_aggregate(df: DataFrame, keys: list[str], unit: str, *, epsilon: float, delta: float, max_groups: int = 1, count: str | None = None, total: tuple[str, str, float, float] | None = None, mean: tuple[str, str, float, float] | None = None, seed: int | None = None) -> DataFrame:
    """Noisy COUNT, SUM and AVG by group.

    ``total`` and ``mean`` are (name, column, low, high), bounds of one unit's
    sum in a group. Rows are first added up per unit and group; of a unit's
    groups ``max_groups`` are kept at random; a group stays if its noisy number
    of units passes the threshold that delta sets.
    """
    parts = 1 + sum(x is not None for x in (count, total, mean)) + (mean is not None)
    eps = epsilon / parts
    aggs = [F.count("*").alias("_n")]
    for kind in (total, mean):
        if kind:
            aggs.append(F.sum(kind[1]).cast("double").alias(f"_s_{kind[0]}"))
    each = df.groupBy(unit, *keys).agg(*aggs)
    pick = F.row_number().over(Window.partitionBy(unit).orderBy(F.rand(seed) if seed is not None else F.rand()))
    kept = each.withColumn("_r", pick).where(F.col("_r") <= max_groups)
    noise = lambda scale, k: laplace(scale * max_groups / eps, None if seed is None else seed + k)
    out = [(F.count("*") + 0.0).alias("_units")]
    if count:
        out.append((F.sum(F.least("_n", F.lit(1))) + 0.0).alias("_c"))
    for kind in (total, mean):
        if kind:
            low, high = F.lit(float(kind[2])), F.lit(float(kind[3]))
            out.append(F.sum(F.least(F.greatest(F.col(f"_s_{kind[0]}"), low), high)).alias(f"_t_{kind[0]}"))
    groups = kept.groupBy(*keys).agg(*out)
    groups = groups.withColumn("_units", F.col("_units") + noise(1.0, 1))
    share = 1 - (1 - delta) ** (1 / max_groups)
    threshold = 1 + max_groups / eps * (math.log(1 / (2 * share)) if share <= 0.5 else -math.log(2 * (1 - share)))
    groups = groups.where(F.col("_units") >= threshold)
    cols = []
    if count:
        cols.append(F.round(F.col("_c") + noise(1.0, 2)).cast("long").alias(count))
    if total:
        cols.append((F.col(f"_t_{total[0]}") + noise(max(abs(total[2]), abs(total[3])), 3)).alias(total[0]))
    if mean:
        cols.append(((F.col(f"_t_{mean[0]}") + noise(max(abs(mean[2]), abs(mean[3])), 4)) / F.greatest(F.lit(1.0), F.col("_units"))).alias(mean[0]))
    return groups.select(*keys, *cols)
