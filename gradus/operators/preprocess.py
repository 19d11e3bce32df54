"""The clustered preprocessing chain: the description block becomes a few cluster features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.schema import FeatureSchema
from gradus.operators.clustering import (
    ClusterFeatures,
    apply_cluster_onehot,
    apply_cluster_probabilities,
    fit_cluster_features,
)
from gradus.operators.features import (
    Categories,
    ColumnStats,
    DateStats,
    _grouped,
    fit_categories,
    fit_columns,
    fit_dates,
    measured_columns,
)
from gradus.operators.projection import clean_features, columns_by_pattern

@dataclass(frozen=True)
class ClusteredParams:
    dates: DateStats
    titles: Categories
    clusters: ClusterFeatures
    soft: bool
    fills: ColumnStats
    scaled: tuple[str, ...]
    columns: tuple[str, ...]


def _features(cleaned: DataFrame, schema: FeatureSchema, dim: DataFrame, dates, titles, clusters, soft: bool, keep) -> DataFrame:
    grouped = _grouped(cleaned, schema, dim, dates, titles, keep)
    add = apply_cluster_probabilities if soft else apply_cluster_onehot
    return add(grouped, clusters, "jobdesc", "jobdesc_cluster__job_cluster").drop("jobdesc")


def fit_clustered(
    df: DataFrame, schema: FeatureSchema, dim: DataFrame, block_dim: int, k: int, soft: bool = True, min_count: int = 10,
    restarts: int = 1, seed: int = 42, cluster_rows: DataFrame | None = None,
) -> ClusteredParams:
    """Parameters from training rows. ``cluster_rows`` (for example training and
    scoring rows together) replaces them in the cluster fit only."""
    cleaned = clean_features(df, schema).persist()
    dates = fit_dates(cleaned, schema.date[0])
    titles = fit_categories(cleaned, "job_title", min_count)
    source = cleaned if cluster_rows is None else clean_features(cluster_rows, schema)
    clusters = fit_cluster_features(source, schema.packed, block_dim, k, restarts, seed)
    wide = _features(cleaned, schema, dim, dates, titles, clusters, soft, ())
    columns = columns_by_pattern(wide, None, "numeric")
    # indicator columns are never null and never scaled: no statistics needed
    numeric = [c for c in columns if not c.startswith("title__")]
    raw = fit_columns(wide, numeric)
    shrunk = {c: raw.std_pop[c] * (raw.present[c] / raw.rows) ** 0.5 if raw.rows else 0.0 for c in numeric}
    fills = ColumnStats(raw.mean, shrunk, raw.std_samp, raw.low, raw.high, raw.empty, raw.rows, raw.present)
    cleaned.unpersist()
    # what is added to the grouped columns are distances and shares of clusters
    measured = measured_columns(schema) | (set(wide.columns) - set(_grouped(cleaned, schema, dim, dates, titles, ()).columns))
    return ClusteredParams(dates, titles, clusters, soft, fills, tuple(c for c in columns if c in measured), tuple(columns))


def apply_clustered(df: DataFrame, schema: FeatureSchema, params: ClusteredParams, dim: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Clean, group, add cluster features, impute, scale; no nulls remain in the features."""
    wide = _features(clean_features(df, schema, keep), schema, dim, params.dates, params.titles, params.clusters, params.soft, keep)
    out = []
    for c in params.columns:
        if c not in params.fills.mean:
            out.append(F.col(f"`{c}`"))
            continue
        filled = F.coalesce(F.col(f"`{c}`"), F.lit(params.fills.mean[c]))
        if c in params.scaled:
            filled = (filled - F.lit(params.fills.mean[c])) / F.lit(params.fills.std_pop[c] or 1.0)
        out.append(filled.alias(c))
    return wide.select(*keep, *out)


def preprocess_clustered(df: DataFrame, schema: FeatureSchema, dim: DataFrame, block_dim: int, k: int, keep: Sequence[str] = (), **opts) -> DataFrame:
    return apply_clustered(df, schema, fit_clustered(df, schema, dim, block_dim, k, **opts), dim, keep)


def as_vector(df: DataFrame, cols: Sequence[str], keep: Sequence[str], name: str = "x") -> DataFrame:
    """Named feature columns as one array column."""
    return df.select(*keep, F.array(*[F.col(f"`{c}`") for c in cols]).alias(name))
