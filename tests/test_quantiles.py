import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators.quantiles import exact_quantiles, group_quantiles, slot

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "normal":
        x = rng.normal(size=5000)
    elif kind == "hot value":  # a third of the rows share one value
        x = np.where(np.arange(5001) % 3 == 0, 7.5, rng.normal(5, 3, 5001))
    elif kind == "few values":
        x = rng.integers(0, 5, 4000).astype(float)
    else:
        x = np.full(3000, 2.0)
    return x, spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 10, "x double")


@pytest.mark.parametrize("kind", ["normal", "hot value", "few values", "constant"])
@pytest.mark.parametrize("limits", [(50_000, 20_000), (0, 3), (0, 200)])
def test_matches_numpy(spark, kind, limits):
    x, df = frame(spark, kind)
    got = exact_quantiles(df, ["x"], QS, *limits)["x"]
    assert np.allclose(got, np.percentile(x, [100 * q for q in QS]), rtol=0, atol=1e-12)


def test_several_columns_and_empty(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"), F.lit(None).cast("double").alias("c"))
    got = exact_quantiles(df, ["a", "b", "c"], [0.5], 100, 50)
    assert got["a"] == [499.5] and got["b"] == [3.0] and got["c"] == [None]


def test_group_quantiles_heavy_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("k"), F.col("id").cast("double").alias("v"))
    rows = {r["k"]: (r["q1"], r["q2"]) for r in group_quantiles(df, "k", "v", [0.25, 0.5], ["q1", "q2"], max_distinct=1500).collect()}
    assert rows["hot"] == (499.75, 999.5) and rows["cold"] == (2249.75, 2499.5)


def test_slot(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 9.0)], "v double")
    assert [r[0] for r in df.select(slot(F.col("v"), [1.0, 2.0, 3.0])).collect()] == [0, 1, 2, 3, 6]
