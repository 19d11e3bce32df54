"""Scalar column expressions: dates, encodings, elementwise maths, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered target classes and their codes.
ORDINAL_CODES = {"Low": 0, "Medium": 1, "High": 2}

# Mean salary per US state, from the highest to the lowest.
STATE_MEAN_SALARY = {
    "NH": 97046, "MA": 94651, "OR": 94286, "PA": 93864, "NY": 93391,
    "MD": 92244, "WV": 90701, "TX": 89407, "VT": 89074, "NV": 88635,
    "CA": 87957, "ND": 87795, "VA": 86648, "ME": 86128, "WI": 85718,
    "DE": 85112, "NM": 84814, "KS": 84508, "OK": 84153, "WA": 83605,
    "AZ": 83199, "TN": 82354, "ID": 82316, "MS": 80873, "AR": 79907,
    "KY": 78545, "SC": 78256, "WY": 77540, "UT": 77455, "AL": 76867,
    "RI": 76628, "GA": 76574, "IL": 76205, "MN": 75504, "MT": 75309,
    "NJ": 74480, "IN": 73188, "IA": 72526, "CT": 72447, "NC": 71590,
    "CO": 71342, "MO": 70645, "FL": 70393, "OH": 68590, "HI": 67412,
    "LA": 67027, "AK": 65498, "NE": 65123, "SD": 62823, "MI": 61400,
}


def parse_year_month(col: Column) -> Column:
    """``YYYY/MM`` to the first day of the month; anything else is null."""
    return F.try_to_timestamp(col, F.lit("yyyy/MM")).cast("date")


def parse_date_lenient(col: Column, formats: Sequence[str] = ("yyyy/MM/dd", "yyyy-MM-dd", "yyyy/MM", "yyyy-MM")) -> Column:
    """First format that reads the text; null when none does. ``dates.fit_date_layouts`` finds the layouts of a column by itself."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]).cast("date")


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def months_since(date: Column, ref: Column) -> Column:
    """Whole calendar months from ``ref`` to ``date``; may be negative, null-safe."""
    return month_index(date) - month_index(ref)


def month_of_year(date: Column) -> Column:
    return F.month(date)


def binarize_in_set(col: Column, members: Sequence) -> Column:
    """1 for members, 0 for everything else including null."""
    return F.coalesce(col.isin(*members), F.lit(False)).cast("int")


def binary_target(col: Column, value) -> Column:
    """1 where the label equals ``value``; null labels count as not equal."""
    return F.coalesce(col == value, F.lit(False)).cast("int")


def case_map(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Literal lookup as one CASE expression; unmapped values take ``default`` (null)."""
    items = list(mapping.items())
    expr = F.when(col == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col == k, F.lit(v))
    return expr.otherwise(default if default is not None else F.lit(None))


def ordinal_encode(col: Column, codes: Mapping[str, int] = ORDINAL_CODES) -> Column:
    return case_map(col, codes).cast("int")


def ordinal_decode(col: Column, codes: Mapping[str, int] = ORDINAL_CODES) -> Column:
    return case_map(col, {v: k for k, v in codes.items()})


def zero_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(0).cast("double"))


def elementwise(col: Column, fn: str, digits: int = 0) -> Column:
    """abs, sqrt, exp, log10 or round; values outside the domain give null."""
    x = col.cast("double")
    return {
        "abs": lambda: F.abs(x),
        "sqrt": lambda: F.when(x >= 0, F.sqrt(x)),
        "exp": lambda: F.exp(x),
        "log10": lambda: F.when(x > 0, F.log10(x)),
        "round": lambda: F.round(x, digits),
    }[fn]()


def short_param_name(col: Column) -> Column:
    """Text after the last double underscore."""
    return F.element_at(F.split(col, "__"), -1)


def format_param(name: Column, value: Column) -> Column:
    """``name=value``: whole numbers and text as they are, other numbers with six decimals."""
    number = value.try_cast("double")
    is_real = number.isNotNull() & value.rlike(r"[.eE]")
    return F.concat(short_param_name(name), F.lit("="), F.when(is_real, F.format_string("%.6f", number)).otherwise(value))
