"""Prediction tables: build, summarise, validate, compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small, safe_ratio
from gradus.functions.scalars import ORDINAL_CODES, ordinal_decode
from gradus.operators.lookups import align_predictions, anti_join_ids

LABELS = tuple(ORDINAL_CODES)


def make_predictions_table(df: DataFrame, key: str, pred: str, label: str = "salary_category", expected: int | None = None) -> DataFrame:
    """(key, label) with decoded labels; wrong row count or unknown labels raise."""
    numeric = df.schema[pred].dataType.typeName() not in ("string",)
    text = ordinal_decode(F.col(pred).cast("int")) if numeric else F.col(pred)
    out = df.select(key, text.alias(label))
    checks = out.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(label).isin(*LABELS), F.lit(False))).alias("bad")).first()
    if expected is not None and checks["n"] != expected:
        raise ValueError(f"length mismatch: {checks['n']} predictions, {expected} ids")
    if checks["bad"]:
        raise ValueError(f"{checks['bad']} invalid predictions")
    return out


def prediction_summary(df: DataFrame, label: str, classes: Sequence[str] = LABELS) -> DataFrame:
    """Count and percent per class in fixed order, absent classes 0."""
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias(label), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)])
    return wide.select("total", F.explode(cells).alias("c")).select(
        "c.*", "total", (safe_ratio(F.col("c.n"), F.col("total")) * 100).alias("percent")
    )


def validate_predictions(
    df: DataFrame, reference: DataFrame | None = None, key: str = "id", label: str = "salary_category", classes: Sequence[str] = LABELS
) -> DataFrame:
    """(check, n) for every violated rule; an empty result means a valid file."""
    spark = df.sparkSession
    missing = [c for c in (key, label) if c not in df.columns]
    found: list[tuple[str, int]] = [(f"missing column {c}", 1) for c in missing]
    present = [c for c in (key, label) if c in df.columns]
    exprs = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in df.columns]
    if label in present:
        exprs.append(F.count_if(~F.coalesce(F.col(label).isin(*classes), F.lit(False))).alias("invalid category"))
    row = df.agg(*exprs).first().asDict()
    found += [(k, v) for k, v in row.items() if v]
    if reference is not None and key in present:
        for r in collect_small(anti_join_ids(reference, df, key).groupBy("kind").count()):
            found.append((f"{r['kind']} ids", r["count"]))
    return spark.createDataFrame(sorted(found), "check string, n bigint")


def agreement(files: Mapping[str, DataFrame], key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Aligned table with ``all_agree`` and the overall rate."""
    names = list(files)
    aligned = align_predictions(files, key, label)
    same = F.size(F.array_distinct(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]))) == 1
    flagged = aligned.withColumn("all_agree", same)
    rate = flagged.agg(
        F.count("*").alias("n"), F.count_if("all_agree").alias("n_agree"),
    ).withColumn("percent", safe_ratio(F.col("n_agree"), F.col("n")) * 100)
    return flagged, rate


def disagreements(flagged: DataFrame, key: str, n: int = 10) -> DataFrame:
    return flagged.filter(~F.col("all_agree")).orderBy(key).limit(n)


def pairwise_agreement(files: Mapping[str, DataFrame], key: str, label: str) -> DataFrame:
    """Agreement percent of every pair of files, from one aligned pass (no self-join)."""
    names = list(files)
    aligned = align_predictions(files, key, label)
    pairs = list(combinations(names, 2))
    wide = aligned.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(a) == F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("n_agree")) for i, (a, b) in enumerate(pairs)])
    return wide.select("n", F.explode(cells).alias("c")).select(
        "c.*", "n", (safe_ratio(F.col("c.n_agree"), F.col("n")) * 100).alias("percent")
    )
