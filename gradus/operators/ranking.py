"""Ranking, running values, top-n and small cumulative tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.operators.aggregates import corr_pairs
from gradus.operators.ordering import competition_rank, previous_value, running_max


def running_best(history: DataFrame, run: str, order: str, tie: str, score: str, name: str = "best_so_far") -> DataFrame:
    return running_max(history, run, order, tie, score, name)


def cumulative_share(variances: DataFrame, index: str, value: str, target: float = 0.9) -> DataFrame:
    """Share and cumulative share of a short indexed list, and the first index at or above ``target``.

    The list has one row per component, so it is small whatever the data size.
    """
    rows = sorted(collect_small(variances.select(index, value)), key=lambda r: r[0])
    total = sum(r[1] for r in rows)
    out, acc = [], 0.0
    for r in rows:
        acc += r[1]
        out.append([r[0], r[1] / total, acc / total])
    first = next((r[0] for r in out if r[2] >= target), None)
    kind = variances.schema[index].dataType.simpleString()
    return variances.sparkSession.createDataFrame(
        [(*r, first) for r in out], f"{index} {kind}, share double, cumulative double, first_at_target {kind}"
    )


def top_n(df: DataFrame, n: int, score: str, tie: str, by: str | None = None) -> DataFrame:
    """Best rows by score, overall or per group, with their position.

    Per group the row limit is applied in every task before the shuffle, so a
    hot group ships n rows per task.
    """
    order = [F.desc(score), F.asc(tie)]
    if by is None:
        top = df.orderBy(*order).limit(n)
        return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def rank_results(results: DataFrame, run: str, score: str, name: str = "rank_test_score") -> DataFrame:
    return competition_rank(results, run, score, name)


def best_iteration(history: DataFrame, run: str, order: str, score: str, std: str) -> DataFrame:
    """Per run: best iteration (first on ties), its score and std, improvement over the first iteration."""
    first_best = F.struct(F.col(score), (-F.col(order)).alias("o"))
    return history.groupBy(run).agg(
        F.max_by(order, first_best).alias("best_iteration"),
        F.max(score).alias("best_score"),
        F.max_by(std, first_best).alias("best_std"),
        (F.max(score) - F.min_by(score, order)).alias("improvement"),
    )


def iteration_duration(history: DataFrame, run: str, ts: str, tie: str, name: str = "duration") -> DataFrame:
    """Seconds since the previous callback of the run, 0 for the first."""
    prev = previous_value(history, run, ts, tie, ts, "__prev")
    seconds = (
        F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__prev").cast("timestamp"))
    ) / F.lit(1e6)
    return prev.withColumn(name, F.coalesce(seconds, F.lit(0.0))).drop("__prev")


def next_run_index(names: DataFrame, col: str) -> DataFrame:
    """1 + the largest index in names that end in ``_run<digits>``; 1 when there is none."""
    digits = F.regexp_extract(col, r"_run(\d+)$", 1)
    return names.agg((F.coalesce(F.max(digits.try_cast("int")), F.lit(0)) + 1).alias("next_index"))


def latest_run(runs: DataFrame, path: str, end_time: str) -> DataFrame:
    """Path of the newest run (largest path on ties)."""
    return runs.agg(F.max_by(path, F.struct(end_time, path)).alias("path"), F.max(end_time).alias("end_time"))


def topk_long_abs(wide: DataFrame, key: str, n: int) -> DataFrame:
    """Wide coefficient table to (feature, class, coefficient), largest absolute values first."""
    classes = [c for c in wide.columns if c != key]
    return topk_abs(wide.unpivot([key], classes, "class", "coefficient"), key, n)


def topk_abs(long: DataFrame, key: str, n: int) -> DataFrame:
    """Of (feature, class, coefficient), the rows with the largest absolute values first."""
    return long.withColumn("abs_coef", F.abs("coefficient")).orderBy(F.desc("abs_coef"), key, "class").limit(n)


def top_corr_pairs(df: DataFrame, cols: Sequence[str], n: int, mirrored: bool = False) -> DataFrame:
    """Highest correlations between different columns, each unordered pair once."""
    pairs = corr_pairs(df, cols).filter(F.col("corr").isNotNull()).select("a", "b", "corr")
    if mirrored:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return pairs.orderBy(F.desc("corr"), "a", "b").limit(n)


def top_importance(importances: DataFrame, n: int) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def sort_rows(df: DataFrame, *cols) -> DataFrame:
    """Total order over the cluster: a range-partitioned sort."""
    return df.orderBy(*cols)


def dedup_pairs(pairs: DataFrame, a: str, b: str, unordered: bool = False) -> DataFrame:
    """One row per (a, b); with ``unordered`` mirrors count as the same pair."""
    if unordered:
        pairs = pairs.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
        return pairs.dropDuplicates(["__lo", "__hi"]).drop("__lo", "__hi")
    return pairs.dropDuplicates([a, b])


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of both tables on the columns they share."""
    shared = [c for c in train.columns if c in set(test.columns)]
    return train.select(*shared).unionByName(test.select(*shared))


def concat_vertical(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def except_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)
