"""Contingency tests and regression diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small, safe_ratio
from gradus.operators.quantiles import exact_quantiles


def contingency_cells(df: DataFrame, a: str, b: str, max_values: int = 10_000) -> DataFrame:
    """(a, b, observed, expected) for every combination; ``b`` may have ``max_values`` values. The rows are reduced to counts first;
    margins and the grid of combinations come from the counts."""
    counts = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rows = counts.groupBy(a).agg(F.sum("n").alias("row_total"), F.map_from_entries(F.collect_list(F.struct(b, "n"))).alias("seen"))
    columns = {r[b]: r["t"] for r in collect_small(counts.groupBy(b).agg(F.sum("n").alias("t")), max_values)}
    total = sum(columns.values())
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias(b), F.lit(t).alias("column_total")) for k, t in sorted(columns.items())]))
    cells = rows.select(a, "row_total", "seen", grid.alias("c")).select(a, "row_total", "seen", "c.*")
    return cells.select(
        a, b, F.coalesce(F.try_element_at("seen", F.col(b)), F.lit(0)).cast("bigint").alias("observed"),
        (F.col("row_total").cast("double") * F.col("column_total") / F.lit(total)).alias("expected"),
    )


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution by the incomplete gamma series or continued fraction."""
    if x <= 0:
        return 1.0
    s, z = dof / 2.0, x / 2.0
    front = math.exp(-z + s * math.log(z) - math.lgamma(s))
    if z < s + 1:
        term = total = 1.0 / s
        i = s
        while abs(term) > abs(total) * 1e-16:
            i += 1
            term *= z / i
            total += term
        return max(0.0, 1.0 - total * front)
    b = z + 1 - s
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, dof, p_value). A 2 x 2 table uses the continuity correction."""
    cells = contingency_cells(df, a, b)
    gap = F.abs(F.col("observed") - F.col("expected"))
    plain = F.sum(gap * gap / F.col("expected")).alias("plain")
    less = gap - F.least(F.lit(0.5), gap)
    corrected = F.sum(less * less / F.col("expected")).alias("corrected")
    row = cells.agg(plain, corrected, F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c")).first()
    dof = (row["r"] - 1) * (row["c"] - 1)
    stat = row["corrected"] if dof == 1 else row["plain"]
    p = chi2_sf(stat, dof) if dof else 1.0
    return df.sparkSession.createDataFrame([(stat, dof, p)], "statistic double, dof int, p_value double")


def standardized_residuals(df: DataFrame, a: str, b: str) -> DataFrame:
    """(observed - expected) / sqrt(expected) per cell."""
    return contingency_cells(df, a, b).withColumn("residual", (F.col("observed") - F.col("expected")) / F.sqrt("expected"))


def linear_score(x: Sequence[str], beta: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(x, beta):
        out = out + F.col(c) * F.lit(float(w))
    return out


def glm_residuals(df: DataFrame, x: Sequence[str], y: str, beta: Sequence[float], intercept: float) -> DataFrame:
    """Adds fitted, resid_response, resid_pearson and sqrt_abs_pearson of a logit model."""
    mu = 1.0 / (1.0 + F.exp(-linear_score(x, beta, intercept)))
    staged = df.withColumn("fitted", mu).withColumn("resid_response", F.col(y) - F.col("fitted"))
    spread = F.sqrt(F.col("fitted") * (1.0 - F.col("fitted")))
    staged = staged.withColumn("resid_pearson", safe_ratio(F.col("resid_response"), spread))
    return staged.withColumn("sqrt_abs_pearson", F.sqrt(F.abs("resid_pearson")))


def glm_influence(df: DataFrame, x: Sequence[str], y: str, beta: Sequence[float], intercept: float) -> DataFrame:
    """Adds leverage, internally studentized residual and Cook's distance.

    X'WX is one aggregate of p(p+1)/2 sums; its inverse enters the row
    expression as literals.
    """
    staged = glm_residuals(df, x, y, beta, intercept).withColumn("__w", F.col("fitted") * (1.0 - F.col("fitted")))
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    p = len(terms)
    sums = staged.agg(*[F.sum(F.col("__w") * terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = sums[f"m{i}_{j}"]
    inv = np.linalg.inv(m)
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            quad = quad + terms[i] * terms[j] * F.lit(float(inv[i, j]))
    staged = staged.withColumn("leverage", F.col("__w") * quad).drop("__w")
    staged = staged.withColumn("studentized", F.col("resid_pearson") / F.sqrt(1.0 - F.col("leverage")))
    cook = F.col("resid_pearson") * F.col("resid_pearson") * F.col("leverage") / (p * (1.0 - F.col("leverage")) * (1.0 - F.col("leverage")))
    return staged.withColumn("cooks_distance", cook)


def normal_grid(points: int) -> list[tuple[float, float]]:
    """(probability, standard normal quantile) at (i - 0.5) / points."""
    return [((i - 0.5) / points, NormalDist().inv_cdf((i - 0.5) / points)) for i in range(1, points + 1)]


def qq_points(df: DataFrame, col: str, points: int = 99) -> DataFrame:
    """Sample quantiles against normal quantiles on a fixed grid, so the result does not grow with the rows."""
    grid = normal_grid(points)
    sample = exact_quantiles(df, [col], [g[0] for g in grid])[col]
    rows = [(g[0], g[1], s) for g, s in zip(grid, sample)]
    return df.sparkSession.createDataFrame(rows, "p double, theoretical double, sample double")
