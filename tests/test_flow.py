"""End-to-end training, scoring on a stream, and all SQL checks on the smallest tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradus.operators import lookups
from gradus.plans.learning import _small_chain
from gradus.plans.registry import Tables
from gradus.plans.standins import VECTOR_SCHEMA
from gradus.plans.training import ChainOptions, FittedChain, fit_chain, generate_predictions, train_best_model, training_rows
from gradus.streaming.scoring import score_stream
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


def test_train_then_score_a_stream(spark, tmp_path):
    rows = Tables(spark, SF).candidates.persist()
    dim = lookups.state_salary(spark)
    chain, summary = train_best_model(rows, VECTOR_SCHEMA, dim, _small_chain(outliers=False), folds=2)
    s = summary.first()
    # the cluster features hide most of the signal of this target, so only the bounds are checked
    assert s["n_rows"] == 500 and 0 < s["cv_accuracy"] <= 1 and s["train_accuracy"] > 1 / 3 and s["n_features"] > 1
    test = rows.drop("salary_category")
    table, errors = generate_predictions(chain, test, dim)
    assert table.count() == 500 and errors.count() == 0
    source = str(tmp_path / "in")
    test.repartition(3).write.parquet(source)
    score_stream(
        spark, source, test.schema, lambda d: chain.score(d, dim, ["id"]).select("id", "prediction"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = chain.score(test, dim, ["id"]).select("id", F.col("prediction").alias("b"))
    assert streamed.count() == 500 and streamed.join(batch, "id").filter("prediction != b").count() == 0


def test_best_model_is_trained_with_the_whole_settings(spark, monkeypatch):
    from gradus.plans import learning

    asked = []
    monkeypatch.setattr(learning, "train_best_model", lambda df, schema, dim, opts, **more: asked.append((df.count(), opts, more)) or (None, df))
    entry.queries()["train_best_model"](spark, SF)
    (rows, opts, more), plain = asked[0], ChainOptions()
    assert rows == 500 and dict(opts.model) == {"trees": 800, "depth": 10, "rate": 0.005, "subsample": 0.8, "columns": 0.7}
    assert opts == replace(plain, block_dim=64) and opts.selection_trees == 100 and opts.outliers and more.get("folds", 10) == 10


def test_other_selectors_learners_and_products(spark, tmp_path):
    rows = Tables(spark, SF).candidates.persist()
    dim = lookups.state_salary(spark)
    opts = _small_chain(outliers=False, selector="anova", keep_share=6, learner="logistic", model={"c": 1.0, "max_iter": 20}, degree=2)
    kept, _, _ = training_rows(rows, VECTOR_SCHEMA, dim, opts)
    chain = fit_chain(kept, VECTOR_SCHEMA, dim, "y", opts, cluster_rows=rows)
    assert len(chain.positions) == 6 and chain.model.models[0].numFeatures == 6 + 21
    scored = chain.score(rows, dim, ["id"])
    chain.save(spark, str(tmp_path / "c"))
    again = FittedChain.load(spark, str(tmp_path / "c")).score(rows, dim, ["id"]).select("id", F.col("prediction").alias("b"))
    assert scored.join(again, "id").filter("prediction = b").count() == 500


@pytest.fixture(scope="module")
def con():
    return duck(SF)


SLOW = {"impute_knn", "select_mutual_info_neighbour"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_sql_agrees(spark, con, name):
    issue = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert issue is None or issue == "empty on both sides", issue
