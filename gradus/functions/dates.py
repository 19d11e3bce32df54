"""Dates in texts of unknown layout: the layout of each text from its tokens, the order of day and month from the whole column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: token patterns of a text without its time of day, in the order they are tried; C is yyyyMMdd, Y a year, N a short number, A a month's name
LAYOUTS = ("Y-N-N", "Y-N", "N-N-Y", "N-Y", "A-N-Y", "N-A-Y", "A-Y", "Y-A-N", "Y-A", "C", "Y")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_TIME = r"(?i)[T ]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*([ap]m)?\s*(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})?$"
_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_TOKEN = r"[0-9]+|[A-Za-z]+"


def date_tokens(text: Column) -> Column:
    """The numbers and words of a date text, lower-cased, without weekday and time of day."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), _TIME, ""), _WEEKDAY, "")
    plain = F.regexp_replace(plain, r"(?i)([0-9])(st|nd|rd|th)\b", "$1")
    # anything but separators between tokens makes the text unreadable
    clean = plain.rlike(r"^[0-9A-Za-z]+((\s*[,./-]\s*|\s+)[0-9A-Za-z]+)*$")
    return F.when(clean, F.regexp_extract_all(F.lower(plain), F.lit(f"({_TOKEN})"), F.lit(1)))


def _kind(token: Column) -> Column:
    size, digits = F.length(token), token.rlike("^[0-9]+$")
    month = F.substring(token, 1, 3).isin(*MONTHS) & (size >= 3) & ~digits
    return F.when(digits & (size == 8), "C").when(digits & (size == 4), "Y").when(digits & (size <= 2), "N").when(month, "A").otherwise("?")


def date_layout(tokens: Column) -> Column:
    """The layout of the tokens, null when it is none of ``LAYOUTS``."""
    found = F.array_join(F.transform(tokens, _kind), "-")
    return F.when(found.isin(*LAYOUTS), found)


def _month(token: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(token, 1, 3)).cast("int")


def _parsed(tokens: Column, layout: Column, day_first: bool) -> Column:
    token = lambda i: F.get(tokens, F.lit(i))
    number = lambda i: token(i).try_cast("int")
    day, month = (0, 1) if day_first else (1, 0)
    one = F.lit(1)
    forms = {
        "Y-N-N": (number(0), number(1), number(2)), "Y-N": (number(0), number(1), one), "N-N-Y": (number(2), number(month), number(day)),
        "N-Y": (number(1), number(0), one), "A-N-Y": (number(2), _month(token(0)), number(1)), "N-A-Y": (number(2), _month(token(1)), number(0)),
        "A-Y": (number(1), _month(token(0)), one), "Y-A-N": (number(0), _month(token(1)), number(2)), "Y-A": (number(0), _month(token(1)), one),
        "C": tuple(F.substring(token(0), a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2))), "Y": (number(0), one, one),
    }
    text = F.lit(None).cast("string")
    for name, (y, m, d) in forms.items():
        text = F.when(layout == name, F.format_string("%04d-%02d-%02d", y, m, d)).otherwise(text)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


@dataclass(frozen=True)
class DateLayouts:
    """``counts``: texts per layout; ``unread``: texts that no layout reads, or that name no day of the calendar."""

    day_first: bool
    counts: dict[str, int]
    texts: int
    unread: int

    def parse(self, text: Column) -> Column:
        """The date of a text; a missing month or day is the first, anything unread is null."""
        tokens = date_tokens(text)
        return _parsed(tokens, date_layout(tokens), self.day_first)


def fit_date_layouts(df: DataFrame, col: str) -> DateLayouts:
    """Reads a column once and settles what its texts leave open.

    In number-number-year the day comes first when more texts have a first
    number beyond 12 than a second one; otherwise the month does.
    """
    text = F.col(col).cast("string")
    tokens = date_tokens(text)
    read = df.select(text.alias("text"), tokens.alias("tokens")).withColumn("layout", date_layout(F.col("tokens")))
    layout = F.col("layout")
    number = lambda i: F.get("tokens", F.lit(i)).try_cast("int")
    open_ = layout == "N-N-Y"
    row = read.agg(
        F.count("text").alias("texts"), *[F.count_if(layout == name).alias(name) for name in LAYOUTS],
        F.count_if(open_ & (number(0) > 12)).alias("day_first"), F.count_if(open_ & (number(1) > 12)).alias("month_first"),
        *[F.count(_parsed(F.col("tokens"), layout, first)).alias(f"read_{first}") for first in (False, True)],
    ).first()
    day_first = row["day_first"] > row["month_first"]
    return DateLayouts(day_first, {name: row[name] for name in LAYOUTS if row[name]}, row["texts"], row["texts"] - row[f"read_{day_first}"])


def layout_report(df: DataFrame, col: str) -> DataFrame:
    """(layout, texts, read): how many texts of the column have each layout, and how many of them are dates; the layout is null where none fits."""
    fit = fit_date_layouts(df, col)
    text = F.col(col).cast("string")
    read = df.filter(text.isNotNull()).select(date_layout(date_tokens(text)).alias("layout"), fit.parse(text).alias("date"))
    return read.groupBy("layout").agg(F.count("*").alias("texts"), F.count("date").alias("read"))
