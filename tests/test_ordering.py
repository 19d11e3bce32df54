"""Chunked paths (tiny chunk sizes force them) against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.operators import evaluation, ordering


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(5)
    n = 2000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "run": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 20, n)),  # a third of the rows in run 0
        "t": rng.integers(0, 400, n),
        "score": rng.integers(0, 50, n) / 10.0,
    })
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("max_rows", [100, 10**6])
def test_running_max(events, max_rows):
    pdf, df = events
    got = ordering.running_max(df, "run", "t", "id", "score", "best", max_rows).toPandas().set_index("id")["best"]
    want = pdf.sort_values(["run", "t", "id"]).groupby("run")["score"].cummax()
    want.index = pdf.sort_values(["run", "t", "id"])["id"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("max_rows", [100, 10**6])
def test_previous_value(events, max_rows):
    pdf, df = events
    got = ordering.previous_value(df, "run", "t", "id", "t", "prev", max_rows).toPandas().set_index("id")["prev"].sort_index()
    s = pdf.sort_values(["run", "t", "id"])
    want = s.groupby("run")["t"].shift()
    want.index = s["id"]
    assert got.fillna(-1).astype(int).equals(want.sort_index().fillna(-1).astype(int).rename("prev"))


@pytest.mark.parametrize("max_rows", [10, 10**6])
def test_competition_rank(events, max_rows):
    pdf, df = events
    got = ordering.competition_rank(df, "run", "score", "r", max_rows).toPandas().set_index("id")["r"].sort_index()
    want = pdf.groupby("run")["score"].rank(method="min", ascending=False)
    assert (got.to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("max_rows", [100, 10**6])
def test_global_row_number(events, max_rows):
    pdf, df = events
    got = ordering.global_row_number(df, [F.col("t"), F.col("id")], "n", 5, max_rows).toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(5, 2005))
    assert got["id"].tolist() == pdf.sort_values(["t", "id"])["id"].tolist()


@pytest.mark.parametrize("max_rows", [50, 10**6])
def test_folds(events, max_rows):
    _, df = events
    ranked = ordering.shuffled_rank(df, "id", 1, "r", "run", max_rows).toPandas()
    assert all(sorted(g["r"]) == list(range(len(g))) for _, g in ranked.groupby("run"))
    assert sorted(ordering.shuffled_rank(df, "id", 1, "r", None, max_rows).toPandas()["r"]) == list(range(2000))


def test_rank_does_not_depend_on_chunking(events):
    _, df = events
    a = ordering.shuffled_rank(df, "id", 1, "r", "run", 50).toPandas().set_index("id")["r"].sort_index()
    b = ordering.shuffled_rank(df, "id", 1, "r", "run", 10**6).toPandas().set_index("id")["r"].sort_index()
    assert (a == b).all()


def test_stratified_folds_are_balanced(events):
    _, df = events
    out = evaluation.stratified_kfold(df, "id", "run", 5).groupBy("run", "fold").count().toPandas()
    sizes = out.groupby("run")["count"].agg(["min", "max", "size"])
    assert ((sizes["max"] - sizes["min"]) <= 1).all() or (sizes["size"] < 5).any()
    assert out["count"].sum() == 2000


def test_split_share(events):
    _, df = events
    parts = evaluation.train_test_split(df, "id", 0.2).groupBy("part").count().toPandas().set_index("part")["count"]
    assert parts["test"] == 400 and parts["train"] == 1600


def test_draws_are_reproducible():
    space = {"a": ("int", 1, 3), "b": ("real", 0.0, 1.0), "c": ("log", 1e-3, 1.0), "d": ("choice", ["x", "y"])}
    draws = [evaluation.draw_params(space, i) for i in range(200)]
    assert draws == [evaluation.draw_params(space, i) for i in range(200)]
    assert {d["a"] for d in draws} == {1, 2, 3} and {d["d"] for d in draws} == {"x", "y"}
    assert all(0 <= d["b"] < 1 and 1e-3 <= d["c"] < 1 for d in draws)


def test_largest_coefficients_of_many_segments(spark, tmp_path):
    from gradus.plans import queries

    rows = spark.range(1300).selectExpr("cast(id % 25 as int) c_nationkey", "concat('s', id) c_mktsegment", "cast(4500 + id as double) c_acctbal")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got = queries()["topk_long_abs"](spark, str(tmp_path)).collect()
    assert [r["class"] for r in got] == [f"s{i}" for i in range(1299, 1289, -1)]
