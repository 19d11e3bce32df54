"""Reading and writing tables, row ids, target split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.operators.ordering import global_row_number


def scan_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    required: Sequence[str] = (),
    fmt: str | None = None,
) -> DataFrame:
    """CSV (with header) or Parquet; fails when required columns are missing.

    CSV needs an explicit schema: inference would read the whole input twice.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        df = reader.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    else:
        df = (reader.schema(schema) if schema is not None else reader).parquet(path)
    return require_columns(df, required)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_slice(df: DataFrame, n_cols: int, n_rows: int, order: str) -> DataFrame:
    """First columns and first rows by an ordering column."""
    first = df.columns[:n_cols]
    keep = first if order in first else [*first, order]
    return df.select(*keep).orderBy(order).limit(n_rows).select(*first)


def assign_row_ids(df: DataFrame, order: str | Sequence[str], offset: int = 0, name: str = "row_id") -> DataFrame:
    """0-based ids in the given total order, starting at ``offset``."""
    order = [order] if isinstance(order, str) else list(order)
    return global_row_number(df, [F.col(c) for c in order], name, offset)


def split_features_target(df: DataFrame, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(key, target)


def write_predictions(df: DataFrame, path: str, key: str = "id", label: str = "salary_category") -> str:
    """Two-column CSV with header; one file per partition."""
    df.select(key, label).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_predictions(spark: SparkSession, path: str, key: str = "id", label: str = "salary_category") -> DataFrame:
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(label, T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
