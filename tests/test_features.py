"""Feature operators on deterministic fixtures: selection, zero handling, state and flag, months, shapes, no nulls."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.functions import arrays, scalars
from gradus.functions.schema import POSTINGS, FeatureSchema
from gradus.operators import aggregates, clustering, features, lookups, preprocess, projection
from gradus.sources import tables


def raw_rows(n, with_target=True):
    """Like the raw files: mostly zero description values, one all-zero column, a fixed pattern."""
    rng = np.random.default_rng(11)
    data = {
        "job_posted_date": ["2024/01", "2024/06", "bad", None, "2024/12"] * (n // 5),
        "job_title": ["Engineer"] * (n - 5) + ["Rare"] * 5,
        "feature_1": (["A", "B", "C", None] * n)[:n],
        "job_state": (["CA", "NY", "TX", "INVALID"] * n)[:n],
    }
    for i in (3, 4, 5, 6, 7, 8, 9, 11, 12):
        data[f"feature_{i}"] = rng.integers(0, 2, n)
    data["feature_2"] = rng.normal(size=n)
    data["feature_10"] = [None if i % 4 == 0 else float(i % 20) for i in range(n)]
    for i in range(1, 301):
        data[f"job_desc_{i:03d}"] = np.zeros(n) if i == 7 else (rng.random(n) < 0.1).astype(float)
    if with_target:
        data["salary_category"] = (["Low", "Medium", "High"] * n)[:n]
    return pd.DataFrame(data)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    raw_rows(50).to_csv(d / "train.csv", index=False)
    raw_rows(50, False).to_csv(d / "test.csv", index=False)
    return d


@pytest.fixture(scope="module")
def train(spark, files):
    df = tables.scan_table(spark, str(files / "train.csv"), POSTINGS.struct(), POSTINGS.features)
    return df.withColumn("id", F.monotonically_increasing_id()).cache()


def test_selection_and_dates(train):
    out = projection.clean_features(train, POSTINGS)
    assert out.columns == POSTINGS.features and len(out.columns) == 315
    assert out.schema["job_posted_date"].dataType.simpleString() == "date"


def test_zeros_become_null(train):
    out = projection.clean_features(train, POSTINGS)
    row = out.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in POSTINGS.block]).first()
    assert sum(row) == 0


def test_missing_column_is_named(train):
    with pytest.raises(ValueError, match="feature_2"):
        projection.select_features(train.drop("feature_2"), POSTINGS)


def test_state_and_flag(spark):
    df = spark.createDataFrame(
        [(0, "CA", "A"), (1, "NY", "B"), (2, "TX", "C"), (3, "INVALID", None)], "id int, job_state string, feature_1 string"
    )
    out = features.state_and_flag_features(df, lookups.state_salary(spark)).orderBy("id").collect()
    assert [r["job_state"] for r in out] == [87957, 93391, 89407, None] and [r["feature_1"] for r in out] == [0, 1, 1, 0]


def test_lookup_default_is_the_unweighted_mean(spark):
    df = spark.createDataFrame([("CA",), ("??",), (None,)], "job_state string")
    out = lookups.lookup_join_default(df, lookups.state_salary(spark), "job_state", "mean_salary").collect()
    mean = sum(scalars.STATE_MEAN_SALARY.values()) / 50
    assert sorted(r["mean_salary"] for r in out) == sorted([87957.0, mean, mean])


def test_months_since_first(spark):
    df = spark.createDataFrame([("2024/01",), ("2024/06",), ("2024/12",), (None,), ("bad",)], "t string")
    df = df.withColumn("d", scalars.parse_year_month(F.col("t")))
    assert [r[0] for r in features.date_features(df, "d").select("months_since_first").collect()] == [0, 5, 11, None, None]


def test_no_valid_date_falls_back_to_today(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "d date, y double")
    stats = features.fit_dates(df, "d", "y")
    assert stats.first == datetime.date.today() and stats.mean == 2.0 and stats.std == 1.0
    assert features.apply_dates(df, stats, "d", True).first()["month_target_mean"] == 2.0


def test_target_split_and_codes(train):
    x, y = tables.split_features_target(train, "salary_category", "id")
    assert "salary_category" not in x.columns and y.count() == 50
    codes = {r[0] for r in train.select(scalars.ordinal_encode(F.col("salary_category"))).collect()}
    assert codes == {0, 1, 2}


def test_flat_preprocessing_keeps_rows_and_has_no_nulls(spark, train):
    packed = projection.pack_block(train, POSTINGS.block, "job_desc")
    schema = FeatureSchema(block=(), packed="job_desc")
    out = features.preprocess_flat(packed, schema, lookups.state_salary(spark), keep=["id"], block_dim=300)
    wide = projection.unpack_block(out, "jobdesc", [f"jobdesc__{c}" for c in POSTINGS.block])
    assert wide.count() == 50
    row = wide.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in wide.columns]).first()
    assert sum(row) == 0
    assert wide.agg(F.max(F.abs("jobdesc__job_desc_007"))).first()[0] == 0.0  # the column without any value
    assert "title__job_title_infrequent_sklearn" in wide.columns


def test_clustered_preprocessing(spark, train):
    packed = projection.pack_block(train, POSTINGS.block, "job_desc")
    schema = FeatureSchema(block=(), packed="job_desc")
    dim = lookups.state_salary(spark)
    for soft, width in ((True, 4), (False, 3)):
        out = preprocess.preprocess_clustered(packed, schema, dim, 300, 3, keep=["id"], soft=soft)
        assert sum(c.startswith("jobdesc_cluster__") for c in out.columns) == width
        assert out.count() == 50 and sum(out.agg(*[F.count_if(F.col(c).isNull()) for c in out.columns]).first()) == 0


def test_cluster_probabilities(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(4 * (i % 3), 0.2, 8)]) for i in range(90)] + [(90, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    fit = clustering.fit_cluster_features(df, "v", 8, 3)
    out = clustering.apply_cluster_probabilities(df, fit, "v").toPandas().set_index("id")
    probs = out[[f"job_cluster_prob_{i}" for i in range(3)]]
    assert np.allclose(probs.sum(1), 1.0) and (probs >= 0).all().all()
    assert np.allclose(out.loc[90, list(out.columns[1:])].astype(float), out.loc[:89, list(out.columns[1:])].astype(float).mean())
    hard = clustering.apply_cluster_onehot(df, fit, "v").toPandas().set_index("id")
    assert hard.loc[90, "job_cluster_0"] == 1.0 and (hard[[f"job_cluster_{i}" for i in range(3)]].sum(1) == 1).all()


def test_standardise_constant_and_all_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    out = features.standardize(features.impute_mean(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    assert features.fit_columns(df, ["a", "c"]).empty == ("c",)


def test_one_hot_unseen_and_rare(spark):
    fit = features.fit_categories(spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)] * 3, "c string"), "c", 3)
    new = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "c string")
    out = [tuple(r) for r in features.apply_one_hot(new, fit).collect()]
    assert out == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)]


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out = features.polynomial_features(df, ["a", "b"], 2, bias=True).first().asDict()
    assert out == {"1": 1.0, "a": 2.0, "b": 3.0, "a^2": 4.0, "a b": 6.0, "b^2": 9.0}
    assert features.polynomial_features(df, ["a", "b"], 2, interaction_only=True).columns == ["a", "b", "a b"]


def test_ordinal_probabilities_cross_and_clip(spark):
    rows = [(0.9, 0.2), (0.2, 0.9), (0.5, 0.5), (1.0, 1.0), (0.0, 0.0), (0.6, 0.1)]
    df = spark.createDataFrame(rows, "c1 double, c2 double")
    p = [r[0] for r in df.select(arrays.ordinal_probabilities([F.col("c1"), F.col("c2")])).collect()]
    assert all(np.isclose(sum(r), 1) and min(r) >= 0 for r in p)
    assert np.allclose(p[1], [0.8 / 1.7, 0, 0.9 / 1.7]) and np.allclose(p[5], [0.4, 0.5, 0.1])


def test_pca_is_centred_and_orthogonal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 10
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    fit = clustering.fit_pca(df, "v", 4)
    z = np.array([r["pc"] for r in clustering.apply_pca(df, fit, "v").orderBy("id").collect()])
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.isclose(sum(fit.ratio), 1)
    assert np.allclose(np.cov(z, rowvar=False), np.diag(np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]), atol=1e-8)


def test_describe_and_group_rare(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    row = aggregates.describe(df, ["v"]).first()
    assert (row["count"], row["nulls"], row["q50"]) == (2, 1, 1.5)
    assert sorted(r["k"] for r in aggregates.group_rare(df, "k", 2).collect()) == ["Other", "a", "a"]
    assert sorted(r["k"] for r in aggregates.group_rare(df, "k", 1).collect()) == ["a", "a", "b"]


def test_empty_input(spark):
    df = spark.createDataFrame([], "id int, v double, k string")
    assert features.impute_mean(df, ["v"]).count() == 0
    assert aggregates.value_counts(df, "k").count() == 0
    assert aggregates.histogram(df, "v", 3).count() == 0
