"""Small tables with all the odd cases, and the tables of the smallest scale factor."""

import random

import pytest
from brute import words

SMALL = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, fp int, token string, n int, kept boolean, unit double"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, copies, near copies, a repeated row, null ids, sources with ties and null."""
    rng = random.Random(4)
    base = words(rng, 300)
    near = base.replace(base.split()[150], "changed", 1)
    long = words(rng, 20_000)
    texts = [None, "", " \t\n ", base, base, near, base.upper(), "one", "two words", long, long + " more", "Ünïcode ÄÖÜ \U0001F600 " + words(rng, 40), words(rng, 60), words(rng, 60), "x" * 5000, base]
    rows = [(i, t, "en", ["a", "b", None, ""][i % 4], len(t or ""), i, "r", 7, "t", 1, True, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, base, "en", "a", 1, 0, "r", 7, "t", 1, True, 0.5))
    rows.append((None, "only here", "en", "b", 1, 0, "r", 7, "t", 1, True, 0.5))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, FIELDS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"], r["source"]) for r in small.select("doc_id", "text", "source").collect()]
