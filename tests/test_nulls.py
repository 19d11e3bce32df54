"""No row may vanish: null keys, null order values, null scores, one order value for all, with small and large chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.operators import aggregates, evaluation, features, ordering, quality, quantiles

SIZES = (40, 10**6)


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        key = None if i % 5 == 0 else ("hot" if i % 2 else f"k{i % 7}")
        when = None if i % 11 == 0 else int(rng.integers(0, 40))
        score = None if i % 13 == 0 else float(rng.integers(0, 30))
        rows.append((i, key, when, score, "const", None))
    return rows, spark.createDataFrame(rows, "id int, key string, t int, score double, flat string, nil double").cache()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))


@pytest.mark.parametrize("max_rows", SIZES)
def test_running_max_keeps_all(gaps, max_rows):
    rows, df = gaps
    best, want = {}, {}
    for r in ordered(rows):
        seen = [x for x in (best.get(r[1]), r[3]) if x is not None]
        best[r[1]] = max(seen, default=None)
        want[r[0]] = best[r[1]]
    assert {r["id"]: r["b"] for r in ordering.running_max(df, "key", "t", "id", "score", "b", max_rows).collect()} == want


@pytest.mark.parametrize("max_rows", SIZES)
def test_previous_value_keeps_all(gaps, max_rows):
    rows, df = gaps
    last, want = {}, {}
    for r in ordered(rows):
        want[r[0]] = last.get(r[1])
        last[r[1]] = r[3]
    assert {r["id"]: r["p"] for r in ordering.previous_value(df, "key", "t", "id", "score", "p", max_rows).collect()} == want


@pytest.mark.parametrize("max_rows", SIZES)
def test_competition_rank_keeps_all(gaps, max_rows):
    rows, df = gaps
    low = lambda x: -1.0 if x is None else x
    want = {r[0]: 1 + sum(o[1] == r[1] and low(o[3]) > low(r[3]) for o in rows) for r in rows}
    assert {r["id"]: r["r"] for r in ordering.competition_rank(df, "key", "score", "r", max_rows).collect()} == want


@pytest.mark.parametrize("order", ["flat", "nil"])
def test_one_order_value_for_all_rows(gaps, order):
    _, df = gaps
    cut = ordering.with_chunks(df, [order, "id"], 40)
    sizes = [r["count"] for r in cut.groupBy("__chunk").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 200
    small = ordering.running_max(df, "key", order, "id", "score", "b", 40).select("id", "b")
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in ordering.running_max(df, "key", order, "id", "score", "b").select("id", "b").collect()}


def test_group_quantiles_of_null_and_heavy_keys(gaps):
    rows, df = gaps
    plain = {r["key"]: (r["a"], r["b"]) for r in quantiles.group_quantiles(df, "key", "score", [0.25, 0.9], ["a", "b"]).collect()}
    for limit in (5, 25):
        got = {r["key"]: (r["a"], r["b"]) for r in quantiles.group_quantiles(df, "key", "score", [0.25, 0.9], ["a", "b"], limit).collect()}
        assert got.keys() == plain.keys() and all(np.allclose(got[k], plain[k]) for k in plain)
    values = pd.Series([r[3] for r in rows if r[1] is None and r[3] is not None])
    assert np.allclose(plain[None], (values.quantile(0.25), values.quantile(0.9)))
    stats = evaluation.cv_score_stats(df.withColumn("score", F.when(F.col("key") != "k1", F.col("score")).otherwise(F.when(F.col("key").isNull(), F.col("score")))), "key", "score").collect()
    assert {r["key"] for r in stats} == {r[1] for r in rows}


def test_rows_without_a_cluster_stay(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [5.0, 5.0], None), (3, [9.0, 9.0], "b")], "id int, v array<double>, c string")
    got = {r["id"]: r["d"] for r in quality.with_centroid_distance(df, "v", "c", "d").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None, 3: 0.0}
    assert quality.davies_bouldin(df, "v", "c").first()["k"] == 2


def test_many_rare_categories_are_one_column(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") < 50, "often").when(F.col("id") < 70, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("c"))
    hot = features.one_hot_min_freq(df, "c", 10)
    assert hot.columns == ["id", "c_often", "c_None", "c_infrequent_sklearn"]
    sums = hot.agg(*[F.sum(c) for c in hot.columns[1:]]).first()
    assert tuple(sums) == (50.0, 20.0, 99_930.0)
    cats = features.fit_categories(df, "c", 10)
    unseen = features.apply_one_hot(spark.createDataFrame([("new",), ("v99",)], "c string"), cats).collect()
    assert [r["c_infrequent_sklearn"] for r in unseen] == [0.0, 1.0]


def test_shares_sum_to_one(gaps):
    _, df = gaps
    rows = aggregates.value_shares(df, "key").collect()
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-12 and sum(r["n"] for r in rows) == 600
