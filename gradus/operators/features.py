"""Feature engineering: ``fit_*`` reads the data once and returns small parameters,
``apply_*`` is a projection with those parameters as literals (or a small lookup),
so the same transform runs on batch and on streaming input."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small, join_dimension, safe_ratio
from gradus.functions import arrays, scalars
from gradus.functions.schema import FeatureSchema
from gradus.operators.aggregates import vector_moments
from gradus.operators.projection import clean_features, columns_by_pattern
from gradus.session import checkpointed

MAX_CATEGORIES = 1_000


# --- column statistics ------------------------------------------------------

@dataclass(frozen=True)
class ColumnStats:
    """Per-column scalars of one fit."""

    mean: dict[str, float]
    std_pop: dict[str, float] = field(default_factory=dict)
    std_samp: dict[str, float | None] = field(default_factory=dict)
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)
    #: columns without any value; their fill is 0.0
    empty: tuple[str, ...] = ()
    rows: int = 0
    present: dict[str, int] = field(default_factory=dict)


def fit_columns(df: DataFrame, cols: Sequence[str]) -> ColumnStats:
    """All scalars of all columns in one aggregate job."""
    row = df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"), F.stddev_pop(c).alias("sp"), F.stddev_samp(c).alias("ss"),
                F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count(c).alias("n"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ],
        F.count("*").alias("rows"),
    ).first()
    stats = {c: row[f"s{i}"] for i, c in enumerate(cols)}
    known = {c: s for c, s in stats.items() if s["mean"] is not None}
    return ColumnStats(
        mean={c: s["mean"] if c in known else 0.0 for c, s in stats.items()},
        std_pop={c: s["sp"] if c in known else 0.0 for c, s in stats.items()},
        std_samp={c: s["ss"] for c, s in stats.items()},
        low={c: s["low"] for c, s in known.items()},
        high={c: s["high"] for c, s in known.items()},
        empty=tuple(c for c in cols if c not in known),
        rows=row["rows"],
        present={c: s["n"] for c, s in stats.items()},
    )


def replace_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Same column order, some columns replaced, new ones at the end: one projection."""
    out = [exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns]
    out += [e.alias(c) for c, e in exprs.items() if c not in df.columns]
    return df.select(*out)


def apply_impute_mean(df: DataFrame, stats: ColumnStats, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: F.coalesce(F.col(c).cast("double"), F.lit(stats.mean[c])) for c in cols})


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column mean for nulls; a column without any value becomes 0.0."""
    return apply_impute_mean(df, fit_columns(df, cols), cols)


def apply_standardize(df: DataFrame, stats: ColumnStats, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    return replace_columns(df, {c: (F.col(c) - F.lit(stats.mean[c])) / F.lit(stats.std_pop[c] or 1.0) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_standardize(df, fit_columns(df, cols), cols)


def zscore_sample(df: DataFrame, col: str, name: str) -> DataFrame:
    """(x - mean) / sample std; null when the std is zero or undefined."""
    s = fit_columns(df, [col])
    return df.withColumn(name, safe_ratio(F.col(col) - F.lit(s.mean[col]), F.lit(s.std_samp[col])))


def apply_minmax(df: DataFrame, stats: ColumnStats, cols: Sequence[str]) -> DataFrame:
    """To [0, 1] by the fitted range; a constant column becomes 0."""
    def scaled(c):
        width = stats.high.get(c, 0.0) - stats.low.get(c, 0.0)
        return (F.col(c) - F.lit(stats.low.get(c, 0.0))) / F.lit(width or 1.0)

    return replace_columns(df, {c: scaled(c) for c in cols})


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_minmax(df, fit_columns(df, cols), cols)


# --- categories -------------------------------------------------------------

@dataclass(frozen=True)
class Categories:
    """Values with a column of their own, and the table (``value``) of the rare ones, which share a column."""

    col: str
    frequent: tuple
    rare: DataFrame | None = None


def fit_categories(df: DataFrame, col: str, min_count: int = 1, max_columns: int = MAX_CATEGORIES) -> Categories:
    """Sorted categories with at least ``min_count`` rows; null is a category of its own (last).

    Only these are collected, as each makes a column (``max_columns`` at most);
    the rare ones may be any number and stay a table.
    """
    counts = df.groupBy(F.col(col).alias("value")).count()
    rows = collect_small(counts.filter(F.col("count") >= min_count).select("value"), max_columns)
    ordered = sorted((r["value"] for r in rows), key=lambda v: (v is None, v if v is not None else ""))
    if min_count <= 1:
        return Categories(col, tuple(ordered))
    rare = checkpointed(counts.filter(F.col("count") < min_count).select("value"))  # read again by every apply
    return Categories(col, tuple(ordered), None if rare.isEmpty() else rare)


def apply_one_hot(df: DataFrame, cats: Categories, drop: bool = True) -> DataFrame:
    """0/1 columns ``<col>_<value>``, rare ones in one column; unseen values give all zeros."""
    c = F.col(cats.col)
    hot = [F.when(c.eqNullSafe(F.lit(v)), 1.0).otherwise(0.0).alias(f"{cats.col}_{v}") for v in cats.frequent]
    keep = [k for k in df.columns if not (drop and k == cats.col)]
    if cats.rare is not None:
        rare = cats.rare.select(F.col("value").alias(cats.col), F.lit(True).alias("__rare"))
        df = join_dimension(df, rare, cats.col, null_safe=True)
        hot.append(F.when(F.col("__rare"), 1.0).otherwise(0.0).alias(f"{cats.col}_infrequent_sklearn"))
    return df.select(*keep, *hot)


def one_hot_min_freq(df: DataFrame, col: str, min_count: int = 10) -> DataFrame:
    return apply_one_hot(df, fit_categories(df, col, min_count))


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = apply_one_hot(df, fit_categories(df, c))
    return df


# --- dates, state, flag -----------------------------------------------------

@dataclass(frozen=True)
class DateStats:
    first: datetime.date
    months: dict[int, tuple[float, float]] = field(default_factory=dict)
    mean: float | None = None
    std: float | None = None


def fit_dates(df: DataFrame, date: str, y: str | None = None) -> DateStats:
    """Earliest month and, with a target, its mean and sample std per month of the year.

    One job; at most 13 grouped rows are collected and combined to the totals.
    """
    month = F.month(date).alias("m")
    if y is None:
        first = df.agg(F.min(date)).first()[0]
        return DateStats(first or datetime.date.today())
    usable = df.select(month, F.col(date).alias("d"), F.col(y).cast("double").alias("y"))
    rows = usable.groupBy("m").agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.var_pop("y").alias("var"),
        F.count("y").alias("n"), F.min("d").alias("first"),
    ).collect()
    dated = [r for r in rows if r["m"] is not None]
    months = {r["m"]: (r["mean"], r["std"] or 0.0) for r in dated}
    first = min((r["first"] for r in dated), default=datetime.date.today())
    pool = [r for r in (dated or rows) if r["n"]]
    n = sum(r["n"] for r in pool)
    if not n:
        return DateStats(first, months)
    mean = sum(r["n"] * r["mean"] for r in pool) / n
    spread = sum(r["n"] * (r["var"] + (r["mean"] - mean) ** 2) for r in pool)
    free = n - 1 if dated else n
    std = (spread / free) ** 0.5 if free > 0 else None
    return DateStats(first, months, mean, std)


def apply_dates(df: DataFrame, stats: DateStats, date: str, with_target: bool = False) -> DataFrame:
    """months_since_first and, on request, month_of_year with its target statistics."""
    d = F.col(date)
    new = {"months_since_first": scalars.months_since(d, F.lit(stats.first))}
    if with_target:
        m = F.month(d)
        new["month_of_year"] = m
        for name, i, fallback in (("month_target_mean", 0, stats.mean), ("month_target_std", 1, stats.std)):
            default = F.lit(fallback).cast("double")
            by_month = {k: v[i] for k, v in stats.months.items()}
            new[name] = scalars.case_map(m, by_month, default) if by_month else default
    return replace_columns(df, new)


def date_features(df: DataFrame, date: str) -> DataFrame:
    return apply_dates(df, fit_dates(df, date), date)


def month_target_encode(df: DataFrame, date: str, y: str) -> DataFrame:
    return apply_dates(df, fit_dates(df, date, y), date, with_target=True)


def state_and_flag_features(df: DataFrame, dim: DataFrame, state: str = "job_state", flag: str = "feature_1") -> DataFrame:
    """State replaced by its mean salary, flag by membership in {B, C}."""
    joined = join_dimension(df, dim, state, "left")
    exprs = {state: F.col("mean_salary").cast("double"), flag: scalars.binarize_in_set(F.col(flag), ("B", "C"))}
    return replace_columns(joined, exprs).select(*df.columns)


# --- polynomial -------------------------------------------------------------

def monomials(cols: Sequence[str], degree: int, interaction_only: bool, bias: bool) -> list[tuple[str, ...]]:
    pick = combinations if interaction_only else combinations_with_replacement
    first = 0 if bias else 1
    return [m for d in range(first, degree + 1) for m in pick(cols, d)]


def monomial_name(m: Sequence[str]) -> str:
    if not m:
        return "1"
    powers = {c: list(m).count(c) for c in dict.fromkeys(m)}
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())


def polynomial_features(
    df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False,
    bias: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """All monomials up to ``degree`` as named columns, in one projection."""
    out = []
    for m in monomials(list(cols), degree, interaction_only, bias):
        value = F.lit(1.0)
        for i, c in enumerate(m):
            value = F.col(c).cast("double") if i == 0 else value * F.col(c).cast("double")
        out.append(value.alias(monomial_name(m)))
    return df.select(*keep, *out)


# --- vector blocks ----------------------------------------------------------

@dataclass(frozen=True)
class BlockStats:
    """Per-position fill and scale of a vector block."""

    mean: tuple[float, ...]
    scaled_mean: tuple[float, ...]
    scale: tuple[float, ...]


def fit_block(df: DataFrame, vec: str, dim: int) -> BlockStats:
    """Imputation means and the mean and population std after imputation.

    Filling with the mean leaves the mean unchanged and shrinks the variance by
    the share of present values, so one pass gives both fits.
    """
    rows = {r["pos"]: r for r in collect_small(vector_moments(df, vec))}
    mean, scale = [], []
    for i in range(dim):
        r = rows.get(i)
        if r is None or r["mean"] is None:
            mean.append(0.0)
            scale.append(1.0)
            continue
        mean.append(r["mean"])
        var = r["var_pop"] * r["n"] / r["rows"]
        scale.append(var ** 0.5 if var > 0 else 1.0)
    return BlockStats(tuple(mean), tuple(mean), tuple(scale))


def apply_block(df: DataFrame, stats: BlockStats, vec: str, name: str) -> DataFrame:
    """Impute and standardise a block in one array expression."""
    filled = arrays.fill_array(F.col(vec), stats.mean)
    return df.withColumn(name, arrays.scale_array(filled, stats.scaled_mean, stats.scale))


# --- pipelines --------------------------------------------------------------

@dataclass(frozen=True)
class FlatParams:
    dates: DateStats
    titles: Categories
    fills: ColumnStats
    scaled: tuple[str, ...]
    block: BlockStats | None = None


def _grouped(df: DataFrame, schema: FeatureSchema, dim: DataFrame, dates: DateStats, titles: Categories, keep) -> DataFrame:
    """Feature groups named ``<step>__<column>``."""
    staged = state_and_flag_features(df, dim)
    staged = apply_dates(staged, dates, schema.date[0])
    staged = apply_one_hot(staged, titles)
    hot = [c for c in staged.columns if c.startswith("job_title_")]
    cols = [F.col("job_state").alias("js_f1__job_state"), F.col("feature_1").cast("double").alias("js_f1__feature_1")]
    cols += [F.col(f"`{c}`").alias(f"title__{c}") for c in hot]
    cols += [F.col("months_since_first").cast("double").alias("date__months_since_first")]
    cols += [F.col(c).cast("double").alias(f"bools__{c}") for c in schema.boolean]
    cols += [F.col(c).cast("double").alias(f"quants__{c}") for c in schema.quantitative]
    cols += [F.col(c).alias(f"jobdesc__{c}") for c in schema.block]
    if schema.packed:
        cols.append(F.col(schema.packed).alias("jobdesc"))
    return staged.select(*keep, *cols)


def measured_columns(schema: FeatureSchema) -> set[str]:
    """The grouped columns that measure something and so are scaled: salaries of states, months, quantities and the block; indicators are not."""
    return {"js_f1__job_state", "date__months_since_first", *(f"quants__{c}" for c in schema.quantitative), *(f"jobdesc__{c}" for c in schema.block)}


def fit_flat(
    df: DataFrame, schema: FeatureSchema, dim: DataFrame, block_dim: int = 0, min_count: int = 10,
    extra: DataFrame | None = None,
) -> FlatParams:
    """Parameters of the flat pipeline from raw (uncleaned) rows."""
    cleaned = clean_features(df, schema) if extra is None else extra
    dates = fit_dates(cleaned, schema.date[0])
    titles = fit_categories(cleaned, "job_title", min_count)
    grouped = _grouped(cleaned, schema, dim, dates, titles, ())
    # indicator columns are never null and never scaled: no statistics needed
    numeric = [c for c in columns_by_pattern(grouped, None, "numeric") if not c.startswith("title__")]
    raw = fit_columns(grouped, numeric)
    # the scaler sees imputed columns: same mean, variance shrunk by the share present
    shrunk = {c: raw.std_pop[c] * (raw.present[c] / raw.rows) ** 0.5 if raw.rows else 0.0 for c in numeric}
    fills = ColumnStats(raw.mean, shrunk, raw.std_samp, raw.low, raw.high, raw.empty)
    scaled = tuple(c for c in columns_by_pattern(grouped, None, "numeric") if c in measured_columns(schema))
    block = fit_block(grouped, "jobdesc", block_dim) if schema.packed else None
    return FlatParams(dates, titles, fills, scaled, block)


def apply_flat(
    df: DataFrame, schema: FeatureSchema, params: FlatParams, dim: DataFrame, keep: Sequence[str] = (), cleaned: bool = False
) -> DataFrame:
    """Clean, group, impute and scale; the result has no nulls."""
    base = df if cleaned else clean_features(df, schema, keep)
    grouped = _grouped(base, schema, dim, params.dates, params.titles, keep)
    exprs = {}
    for c in params.fills.mean:
        filled = F.coalesce(F.col(f"`{c}`"), F.lit(params.fills.mean[c]))
        if c in params.scaled:
            filled = (filled - F.lit(params.fills.mean[c])) / F.lit(params.fills.std_pop[c] or 1.0)
        exprs[c] = filled
    out = [exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in grouped.columns]
    if params.block is not None:
        fixed = arrays.scale_array(
            arrays.fill_array(F.col("jobdesc"), params.block.mean), params.block.scaled_mean, params.block.scale
        )
        out = [o for o, c in zip(out, grouped.columns) if c != "jobdesc"] + [fixed.alias("jobdesc")]
    return grouped.select(*out)


def preprocess_flat(df: DataFrame, schema: FeatureSchema, dim: DataFrame, keep: Sequence[str] = (), block_dim: int = 0, min_count: int = 10):
    return apply_flat(df, schema, fit_flat(df, schema, dim, block_dim, min_count), dim, keep)
