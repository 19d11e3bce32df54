"""Counts, descriptive statistics and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import collect_small, join_dimension, safe_ratio
from gradus.operators.quantiles import exact_quantiles


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Count, share and percent per value. The rows are aggregated once; the one-row total comes from the same counts."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__total"))))
    return both.withColumn("share", safe_ratio(F.col("n"), F.col("__total"))).withColumn("percent", F.col("share") * 100).drop("__total")


def value_counts_all_categoricals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (column, value, n) over several columns in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.*").groupBy("column", "value").agg(F.count("*").alias("n"))


def group_mean(df: DataFrame, key: str, y: str, name: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(y).alias(name))


def group_mean_std_count(df: DataFrame, key: str, y: str) -> DataFrame:
    """Mean, sample standard deviation (0 for a single row) and count."""
    return df.groupBy(key).agg(
        F.avg(y).alias("mean"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"),
        F.count(y).alias("n"),
    )


def global_mean_std(df: DataFrame, y: str, valid: Column) -> DataFrame:
    """Mean and sample std over valid rows; without any, mean and population std of all."""
    yes = F.when(valid, F.col(y))
    agg = df.agg(
        F.avg(yes).alias("m1"), F.stddev_samp(yes).alias("s1"), F.count(yes).alias("k"),
        F.avg(y).alias("m2"), F.stddev_pop(y).alias("s2"),
    )
    some = F.col("k") > 0
    return agg.select(
        F.when(some, F.col("m1")).otherwise(F.col("m2")).alias("mean"),
        F.when(some, F.col("s1")).otherwise(F.col("s2")).alias("std"),
    )


def group_count_multi(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: count, nulls, mean, std, min, quartiles, max."""
    stats = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    ).first()
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [
        (c, stats[c]["count"], stats[c]["nulls"], stats[c]["mean"], stats[c]["std"], stats[c]["min"], *quartiles[c], stats[c]["max"])
        for c in cols
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count bigint, nulls bigint, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double",
    )


def min_date(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min_date"))


def zero_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, lambda c: F.count_if(F.col(c) == 0), "n_zero")


def null_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, lambda c: F.count_if(F.col(c).isNull()), "n_null")


def null_ratio(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, lambda c: F.avg(F.col(c).isNull().cast("double")), "null_ratio")


def per_column(df: DataFrame, cols: Sequence[str], measure, name: str) -> DataFrame:
    """One aggregate pass, then one row per column."""
    wide = df.agg(*[measure(c).alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias(name)) for i, c in enumerate(cols)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def crosstab(df: DataFrame, a: str, b: str, max_values: int = 10_000) -> DataFrame:
    """Contingency table, absent cells 0. ``b`` must have few values."""
    values = sorted(r[0] for r in collect_small(df.filter(F.col(b).isNotNull()).select(b).distinct(), max_values))
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(str(v)) for v in values])


def cluster_profile(df: DataFrame, cluster: str, y: str) -> DataFrame:
    """Size of each cluster, count and percent of each class in it."""
    cells = df.groupBy(cluster, y).agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy(cluster))
    return cells.withColumn("cluster_size", size).withColumn("percent", F.col("n") * 100.0 / F.col("cluster_size"))


def cluster_mean_distance(df: DataFrame, cluster: str, dist: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.avg(dist).alias("mean_distance"), F.count("*").alias("n"))


def class_outlier_rate(df: DataFrame, y: str, flag: str) -> DataFrame:
    """Flagged rows, total and percent per class and for all rows (class null)."""
    grouped = df.rollup(y).agg(
        F.count_if(F.col(flag)).alias("n_outliers"), F.count("*").alias("n"), F.grouping(y).alias("is_total")
    )
    return grouped.withColumn("percent", F.col("n_outliers") * 100.0 / F.col("n"))


def column_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_column(df, cols, lambda c: F.var_pop(c), "variance")


def column_percentiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    found = exact_quantiles(df, cols, qs)
    rows = [(c, float(q), v) for c in cols for q, v in zip(qs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def vector_moments(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, sum, mean, population variance, min, max per vector position (and group).

    One explode with map-side combining: what is shuffled is positions x groups per task.
    """
    long = df.select(*by, F.posexplode(vec).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg(
        F.count("*").alias("rows"),
        F.count("x").alias("n"),
        F.sum("x").alias("total"),
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("var_pop"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair i < j, over rows where both are present.

    All moments come from one aggregate pass; a constant column gives null.
    """
    cols = list(cols)
    wide, out = [], []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            both = F.col(cols[i]).isNotNull() & F.col(cols[j]).isNotNull()
            a = F.when(both, F.col(cols[i]).cast("double"))
            b = F.when(both, F.col(cols[j]).cast("double"))
            tag = f"{i}_{j}"
            wide += [
                F.covar_pop(a, b).alias(f"c{tag}"),
                F.stddev_pop(a).alias(f"a{tag}"),
                F.stddev_pop(b).alias(f"b{tag}"),
            ]
            value = safe_ratio(F.col(f"c{tag}"), F.col(f"a{tag}") * F.col(f"b{tag}"))
            out.append(
                F.struct(
                    F.lit(i).alias("i"), F.lit(j).alias("j"),
                    F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), value.alias("corr"),
                )
            )
    return df.agg(*wide).select(F.explode(F.array(*out)).alias("p")).select("p.*")


def corr_matrix(df: DataFrame, cols: Sequence[str], absolute: bool = False) -> DataFrame:
    """Full symmetric matrix in long form (a, b, corr); the diagonal is 1."""
    pairs = corr_pairs(df, cols)
    value = F.abs("corr") if absolute else F.col("corr")
    upper = pairs.select("a", "b", value.alias("corr"))
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, corr double")
    return upper.unionByName(lower).unionByName(diagonal)


def vector_corr_pairs(df: DataFrame, vec: str, names: Sequence[str]) -> DataFrame:
    """Correlation of the positions of a complete vector column, pairs i < j.

    One distributed Gramian pass; only the p x p matrix reaches the driver.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(df.select(array_to_vector(vec).alias("v")), "v").first()[0].toArray()
    p = m.shape[0]
    rows = [
        (i, j, names[i], names[j], None if m[i, j] != m[i, j] else float(m[i, j]))
        for i in range(p) for j in range(i + 1, p)
    ]
    return df.sparkSession.createDataFrame(rows, "i int, j int, a string, b string, corr double")


def score_summary(results: DataFrame, score: str, fit_time: str) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_iterations"),
        F.sum(fit_time).alias("total_fit_time"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
    )


def confidence_summary(df: DataFrame, probs: str) -> DataFrame:
    """Mean, median, min and max of the largest class probability."""
    conf = df.select(F.array_max(probs).alias("conf"))
    median = exact_quantiles(conf, ["conf"], [0.5])["conf"][0]
    return conf.agg(
        F.avg("conf").alias("mean"), F.lit(median).alias("median"), F.min("conf").alias("min"), F.max("conf").alias("max")
    )


def majority_baseline(df: DataFrame, y: str) -> DataFrame:
    """Most frequent class (smallest on ties) and its share of the rows."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by(y, F.struct("n", (-F.col(y)).alias("o"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.select("label", "n", safe_ratio(F.col("n"), F.col("total")).alias("accuracy"))


def histogram(df: DataFrame, col: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows per equal-width bin; the last bin includes the upper edge."""
    if low is None or high is None:
        low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint, left_edge double")
    width = (high - low) / bins or 1.0
    x = F.col(col).cast("double")
    place = F.least(F.floor((x - low) / F.lit(width)).cast("int"), F.lit(bins - 1))
    inside = df.filter(x.between(low, high))
    return inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).withColumn(
        "left_edge", F.col("bin") * F.lit(width) + F.lit(low)
    )


def group_rare(df: DataFrame, col: str, min_count: int, other: str = "Other") -> DataFrame:
    """Values seen fewer than ``min_count`` times become ``other``."""
    common = df.groupBy(col).count().filter(F.col("count") >= min_count).select(col, F.lit(True).alias("__common"))
    joined = join_dimension(df, common, col, "left")
    return joined.withColumn(
        col, F.when(F.col("__common") | F.col(col).isNull(), F.col(col)).otherwise(F.lit(other))
    ).drop("__common")


def target_distribution(df: DataFrame, y: str) -> DataFrame:
    """Class -> count as one map."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(y, "n")))).alias("distribution"))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
