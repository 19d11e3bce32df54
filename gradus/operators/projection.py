"""Projections, filters, casts and fills."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.bounds import join_dimension
from gradus.functions import arrays, scalars
from gradus.functions.schema import FeatureSchema
from gradus.operators.ordering import global_row_number
from gradus.sources.tables import require_columns


def select_features(df: DataFrame, schema: FeatureSchema, keep: Sequence[str] = ()) -> DataFrame:
    """The known feature columns in their fixed order (plus key or target columns in ``keep``)."""
    require_columns(df, schema.features)
    return df.select(*keep, *schema.features)


def clean_features(df: DataFrame, schema: FeatureSchema, keep: Sequence[str] = ()) -> DataFrame:
    """Selection, zero-to-null of the block and typed dates in one projection."""
    selected = select_features(df, schema, keep)
    changed = {c: scalars.parse_year_month(F.col(c)) for c in schema.date if selected.schema[c].dataType == T.StringType()}
    if schema.packed:
        changed[schema.packed] = arrays.zero_to_null_array(F.col(schema.packed))
    else:
        changed.update({c: scalars.zero_to_null(F.col(c)) for c in schema.block})
    return selected.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in selected.columns])


def pack_block(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Many double columns to one array column, so later plans stay narrow."""
    others = [c for c in df.columns if c not in set(cols)]
    return df.select(*others, F.array(*[F.col(c).cast("double") for c in cols]).alias(name))


def unpack_block(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    others = [c for c in df.columns if c != col]
    return df.select(*others, *[F.get(col, F.lit(i)).alias(n) for i, n in enumerate(names)])


def columns_by_pattern(df: DataFrame, pattern: str | None = None, dtype: str | None = None) -> list[str]:
    """Names that match a regex (searched anywhere) and a type class."""
    kinds = {
        "numeric": lambda t: isinstance(t, T.NumericType),
        "categorical": lambda t: isinstance(t, T.StringType),
        "boolean": lambda t: isinstance(t, T.BooleanType),
        None: lambda t: True,
    }
    return [
        f.name for f in df.schema.fields if kinds[dtype](f.dataType) and (not pattern or re.search(pattern, f.name))
    ]


def select_by_pattern(df: DataFrame, pattern: str | None = None, dtype: str | None = None, keep: Sequence[str] = ()):
    found = [c for c in columns_by_pattern(df, pattern, dtype) if c not in keep]
    return df.select(*keep, *found)


def label_table(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Codes 0..k-1 of the sorted distinct non-null values."""
    return global_row_number(df.select(col).filter(F.col(col).isNotNull()).distinct(), [F.col(col)], name)


def label_encode_alpha(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    return join_dimension(df, label_table(df, col, name), col, "left")


def label_decode(df: DataFrame, code_col: str, table: DataFrame, code: str = "code") -> DataFrame:
    return join_dimension(df, table.withColumnRenamed(code, code_col), code_col, "left")


def cast_types(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Casts by column; booleans without an entry become integers."""
    out = []
    for f in df.schema.fields:
        if f.name in casts:
            out.append(F.col(f.name).cast(casts[f.name]).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.col(f.name).cast("int").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def fill_null_const(df: DataFrame, value, cols: Sequence[str]) -> DataFrame:
    return df.fillna(value, subset=list(cols))


def drop_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == value)


def valid_vector_rows(df: DataFrame, vec: str, rule: str = "first") -> DataFrame:
    """Rows with a usable vector: first element present, or any element present."""
    return df.filter(vector_is_valid(vec, rule))


def vector_is_valid(vec: str, rule: str = "first"):
    if rule == "first":
        ok = F.get(vec, F.lit(0)).isNotNull()
    elif rule == "any":
        ok = F.exists(vec, lambda x: x.isNotNull())
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.coalesce(ok, F.lit(False))


def drop_column(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def prefix_columns(df: DataFrame, steps: dict[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Columns renamed ``<step>__<col>`` in step order; everything else is dropped."""
    return df.select(*keep, *[F.col(c).alias(f"{step}__{c}") for step, cols in steps.items() for c in cols])
