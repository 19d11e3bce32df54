"""Row numbers, ranks, folds and running values without one-partition windows.

A plain ``Window.partitionBy(key)`` puts all rows of a key in one task. Here a
large input is first cut into chunks of bounded size along the ordering; rows
are handled inside (key, chunk), and a small chunk summary carries totals from
chunk to chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import ONE_TASK_ROWS, join_dimension, null_safe_join
from gradus.session import checkpointed


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str, offset: int = 0, max_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Dense 0-based numbers over a total order (the last order column must break ties).

    Small inputs use one window. Larger ones are range-sorted over the cluster
    and checkpointed, which fixes the partition layout; the number of a row is
    its place in its partition plus the sizes of the partitions before it.
    """
    if df.count() <= max_rows:
        w = Window.orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint") + F.lit(offset - 1).cast("bigint"))
    placed = checkpointed(df.orderBy(*order)).withColumn("__m", F.monotonically_increasing_id())
    placed = placed.withColumn("__p", F.shiftrightunsigned("__m", 33)).withColumn(
        "__r", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select(
        "__p",
        (F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .cast("bigint")
        .alias("__before"),
    )
    numbered = join_dimension(placed, before, "__p", "inner", max_rows)
    return numbered.withColumn(name, F.col("__r") + F.col("__before") + F.lit(offset)).drop(
        "__m", "__p", "__r", "__n", "__before"
    )


def with_chunks(df: DataFrame, order: Sequence[str], max_rows: int = ONE_TASK_ROWS, name: str = "__chunk") -> DataFrame:
    """Cut a table along a total order into chunks of about ``max_rows`` rows; null sorts first.

    The chunks are the ranges of a distributed sort, so any sortable type will
    do, and equal first values are told apart by the later columns.
    """
    pieces = math.ceil(df.count() / max_rows)
    if pieces <= 1:
        return df.withColumn(name, F.lit(0))
    return checkpointed(df.repartitionByRange(pieces, *order).withColumn(name, F.spark_partition_id()))


def running_max(
    df: DataFrame, key: str, order_col: str, tie: str, value: str, name: str, max_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Cumulative maximum of ``value`` per key in the order (order_col, tie); null keys are one key, null order values come first."""
    cut = with_chunks(df, [order_col, tie], max_rows)
    tops = cut.groupBy(key, "__chunk").agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "__chunk", F.max("__top").over(earlier).alias("__carry"))
    inside = Window.partitionBy(key, "__chunk").orderBy(order_col, tie)
    best = F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = join_dimension(cut.withColumn("__best", best), carried, [key, "__chunk"], null_safe=True)
    return joined.withColumn(name, F.greatest("__best", "__carry")).drop("__chunk", "__best", "__carry")


def previous_value(
    df: DataFrame, key: str, order_col: str, tie: str, value: str, name: str, max_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """``value`` of the row before in the order (order_col, tie) of the key; null for the first."""
    cut = with_chunks(df, [order_col, tie], max_rows)
    ends = cut.groupBy(key, "__chunk").agg(F.max_by(F.struct(value), F.struct(order_col, tie)).alias("__end"))
    carried = ends.select(
        key, "__chunk", F.lag("__end").over(Window.partitionBy(key).orderBy("__chunk"))[value].alias("__carry")
    )
    inside = Window.partitionBy(key, "__chunk").orderBy(order_col, tie)
    lagged = cut.withColumn("__first", F.row_number().over(inside) == 1).withColumn(
        "__lag", F.lag(value).over(inside)
    )
    joined = join_dimension(lagged, carried, [key, "__chunk"], null_safe=True)
    return joined.withColumn(name, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag"))).drop(
        "__chunk", "__first", "__lag", "__carry"
    )


def competition_rank(
    df: DataFrame, key: str, score: str, name: str, max_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """1 + number of rows of the key with a higher score (ties share the minimum); a null score is below all others."""
    levels = df.groupBy(key, score).agg(F.count("*").alias("__n"))
    cut = with_chunks(levels, [score, key], max_rows)
    totals = cut.groupBy(key, "__chunk").agg(F.sum("__n").alias("__t"))
    higher = Window.partitionBy(key).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "__chunk", F.coalesce(F.sum("__t").over(higher), F.lit(0)).alias("__carry"))
    inside = Window.partitionBy(key, "__chunk").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_dimension(
        cut.withColumn("__above", F.coalesce(F.sum("__n").over(inside), F.lit(0))), carried, [key, "__chunk"], null_safe=True
    )
    ranks = placed.select(key, score, (F.lit(1) + F.col("__above") + F.col("__carry")).cast("bigint").alias(name))
    return null_safe_join(df, ranks, [key, score])


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], counted: str, name: str, max_rows: int) -> DataFrame:
    """Sum of ``counted`` over the rows before each row inside its key."""
    cut = with_chunks(df, order, max_rows)
    totals = cut.groupBy(*keys, "__chunk").agg(F.sum(counted).alias("__t"))
    lower = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__chunk", F.coalesce(F.sum("__t").over(lower), F.lit(0)).alias("__carry"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("__r", F.coalesce(F.sum(counted).over(inside), F.lit(0)))
    joined = join_dimension(ranked, carried, [*keys, "__chunk"], null_safe=True)
    return joined.withColumn(name, F.col("__r") + F.col("__carry")).drop("__chunk", "__r", "__carry")


def hash_order(seed: int, id_col: str) -> Column:
    """A reproducible pseudo-random order of the ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def shuffled_rank(
    df: DataFrame, id_col: str, seed: int, name: str, strata: str | None = None, max_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """0-based position of each row in the hash order, per stratum.

    Rows are ranked inside (stratum, hash prefix) and shifted by the sizes of
    the smaller prefixes, so a stratum with a third of all rows is spread over
    all prefixes.
    """
    digits = max(1, math.ceil(math.log(max(1, df.count() / max_rows), 16)) + 1)
    group = F.coalesce(F.col(strata).cast("string"), F.lit("\u0000")) if strata else F.lit("")
    hashed = df.withColumn("__h", hash_order(seed, id_col)).withColumn("__s", group).withColumn("__b", F.substring("__h", 1, digits))
    sizes = hashed.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    lower = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__s", "__b", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__shift"))
    # the join keys are the window's partitioning, so a shuffle join would not move the rows again
    inside = Window.partitionBy("__s", "__b").orderBy("__h", id_col)
    joined = join_dimension(hashed.withColumn("__r", F.row_number().over(inside)), shifts, ["__s", "__b"], "inner")
    return joined.withColumn(name, (F.col("__r") - 1 + F.col("__shift")).cast("bigint")).drop(
        "__h", "__s", "__b", "__r", "__shift"
    )
