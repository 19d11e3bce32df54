"""Places of rows in their group, by one distributed sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import stored


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place`` (0-based, along ``order``, null first) and ``size`` of their ``group``, which mustn't be null.

    Rows are sorted by ranges of (group, order) over the cluster and written,
    so a group of any share of all rows lies in as many tasks as it needs; a
    summary per (group, task) has the rows before. Rows that are equal in
    ``order`` come in any order, and may lie in several tasks.
    """
    marked = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [group, *order, "__tie"]
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__task", F.shiftright("__at", 33))
    spans = placed.groupBy(group, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)  # a row per task that has some of the group
    earlier = F.sum("__n").over(whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(group, "__task", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("size"))
    return placed.join(spans, [group, "__task"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift")
