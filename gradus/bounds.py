"""Size checks that guard every collect and every broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: rows a side may have before it is no longer broadcast
BROADCAST_ROWS = 100_000
#: rows one window partition or one collected table may have
ONE_TASK_ROWS = 1_000_000


class TooManyRows(ValueError):
    """A table expected to be small went over its row limit."""


def collect_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> list[Row]:
    """Collect a table that must be small; raise instead of flooding the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyRows(f"more than {max_rows} rows in a table that must stay small")
    return rows


def collected_or_none(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> list[Row] | None:
    """The rows of ``df`` when there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def join_dimension(
    facts: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "left", max_rows: int = BROADCAST_ROWS, null_safe: bool = False
) -> DataFrame:
    """Join a large table with one that is usually small.

    The dimension is evaluated once. Up to ``max_rows`` it is broadcast, so the
    facts are not shuffled; beyond that the join is left to the optimizer
    (sort-merge with adaptive skew handling). With ``null_safe`` a null key
    equals a null key.
    """
    rows = collected_or_none(dim, max_rows)
    other = dim if rows is None else F.broadcast(facts.sparkSession.createDataFrame(rows, dim.schema))
    return null_safe_join(facts, other, on, how) if null_safe else facts.join(other, on, how)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet each other; the keys of the left side stay."""
    keys = [on] if isinstance(on, str) else list(on)
    renamed = right.select(*[F.col(c).alias(f"__key_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__key_{k}" for k in keys])


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero or null (ANSI mode would raise)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
