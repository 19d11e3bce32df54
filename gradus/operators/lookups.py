"""Join-shaped operators: dimension lookups, statistics joined back, semi and anti joins, alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.bounds import join_dimension
from gradus.functions.scalars import STATE_MEAN_SALARY


def state_salary(spark: SparkSession, table: Mapping[str, int] = STATE_MEAN_SALARY) -> DataFrame:
    """The state dimension as a table."""
    return spark.createDataFrame(list(table.items()), "job_state string, mean_salary int")


def lookup_join(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join with a dimension; missing keys give null."""
    return join_dimension(df, dim, key, "left")


def lookup_join_default(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Left join; missing and null keys take the unweighted mean of the dimension values."""
    default = dim.agg(F.avg(value)).first()[0]
    joined = lookup_join(df, dim, key)
    return joined.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(default)))


def group_stat_join(df: DataFrame, key: str, y: str, name: str) -> DataFrame:
    """Mean of ``y`` per key mapped back to the rows."""
    stats = df.groupBy(key).agg(F.avg(y).alias(name))
    return join_dimension(df, stats, key, "left")


def outer_align_stats(tables: Sequence[DataFrame], key: str, fill: float) -> DataFrame:
    """Statistics tables side by side on the key; absent values take ``fill``."""
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), tables)
    numbers = [c for c in joined.columns if c != key]
    return joined.fillna(fill, subset=numbers)


def semi_join_inliers(df: DataFrame, flags: DataFrame, key: str, flag: str = "is_outlier") -> DataFrame:
    """Rows whose key is not flagged. Only the flagged keys (few) travel."""
    flagged = flags.filter(F.col(flag)).select(key)
    return join_dimension(df, flagged, key, "left_anti")


def anti_join_ids(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(id, kind): ids that are missing from ``got`` and ids that are extra in it."""
    e, g = expected.select(key).distinct(), got.select(key).distinct()
    missing = e.join(g, key, "left_anti").withColumn("kind", F.lit("missing"))
    extra = g.join(e, key, "left_anti").withColumn("kind", F.lit("extra"))
    return missing.unionByName(extra)


def align_predictions(files: Mapping[str, DataFrame], key: str, label: str) -> DataFrame:
    """Several prediction files side by side, matched by id; ids absent from a file are dropped.

    All joins share the key, so each file is shuffled once and never again.
    """
    names = list(files)
    if len(set(names)) != len(names):
        raise ValueError("prediction files need unique names")
    renamed = [files[n].select(key, F.col(label).alias(n)) for n in names]
    return reduce(lambda a, b: a.join(b, key), renamed).select(key, *names)


def anti_join_values(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``left`` that ``right`` never has."""
    return left.select(col).distinct().join(right.select(col).distinct(), col, "left_anti")
