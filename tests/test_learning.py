"""Outlier detectors, selectors, models and flows on planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import diagnostics, evaluation, models, ordinal, outliers, predictions, selection, tracking


@pytest.fixture(scope="module")
def planted(spark):
    """1,000 normal rows and 20 far ones."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1000, 5)), rng.normal(size=(20, 5)) + rng.choice([-9, 9], size=(20, 5))])
    return spark.createDataFrame([(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)], "id bigint, v array<double>, y int").cache()


@pytest.fixture(scope="module")
def ordered(spark):
    """Classes are bins of a noisy linear score."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1000, 4))
    s = x @ np.array([1.5, -1.0, 0.0, 0.5]) + rng.logistic(size=1000) * 0.7
    y = np.digitize(s, [-1.0, 1.0])
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, v array<double>, y int")
    return x, y, models.with_features(df, "v", "y").cache()


def found(df):
    flagged = {r["id"] for r in df.filter("is_outlier").select("id").collect()}
    return len([i for i in flagged if i >= 1000]), len(flagged)


def test_outlier_models_find_planted_rows(planted):
    for out in (
        outliers.outlier_isolation_forest(planted, "id", "v", 0.02),
        outliers.outlier_elliptic(planted, "id", "v", 0.02),
        outliers.outlier_ensemble(planted, "id", "v", 0.02),
    ):
        hits, flagged = found(out)
        assert hits >= 18 and flagged <= 25


def test_robust_covariance_beyond_its_sample(planted):
    mean, cov = outliers.fit_robust_covariance(planted, "id", "v", sample_rows=300)
    assert np.abs(mean).max() < 0.3 and np.diag(cov).max() < 2.0


def test_remove_outliers_only_when_training(planted):
    flags = planted.select("id", (F.col("id") >= 1000).alias("is_outlier"))
    assert outliers.remove_outliers(planted, flags, "id").count() == 1000
    assert outliers.remove_outliers(planted, flags, "id", training=False).count() == 1020


def test_supervised_outliers(planted):
    out = outliers.outlier_supervised(planted, "id", "v", "y", 0.02, folds=2, trees=5)
    assert out.count() == 1020 and found(out)[0] >= 15


def test_selectors_prefer_informative_columns(ordered):
    _, _, df = ordered
    names = ["a", "b", "noise", "d"]
    for table in (
        selection.select_anova(df, "v", "y", names, 2), selection.select_mutual_info(df, "v", "y", names, 2),
        selection.select_tree_importance(df, "v", "y", names, 2, trees=20), selection.select_rfe(df, "v", "y", names, 2, trees=10, step=0.3),
    ):
        assert {r["feature"] for r in table.filter("selected").collect()} == {"a", "b"}
    l1 = {r["feature"]: r["score"] for r in selection.select_l1(df, "v", "y", names, 3, c=0.1).collect()}
    assert min(l1, key=l1.get) == "noise"
    voted = selection.select_vote([selection.select_anova(df, "v", "y", names, 2), selection.select_mutual_info(df, "v", "y", names, 2)], 2, 4)
    assert {r["feature"] for r in voted.filter("selected").collect()} == {"a", "b"}


def test_selection_size():
    assert [selection.selection_size(k, 8) for k in ("auto", 0.5, 1.0, 20)] == [8, 4, 1, 8]
    assert selection.selection_size("auto", 300) == 150


def test_ordinal_ensembles(spark, ordered, tmp_path):
    _, y, df = ordered
    for model in (
        ordinal.ordinal_classifier(df, models.logistic_regression(1000), "y"),
        ordinal.boosted_ordinal(df, "y", trees=5, depth=3, rate=0.3, subsample=1.0),
        ordinal.boosted_one_vs_rest(df, "y", trees=5, depth=3, rate=0.3, subsample=1.0),
    ):
        out = model.transform(df).select("y", "prediction", "probability").collect()
        assert np.mean([r["y"] == r["prediction"] for r in out]) > 0.6
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 and min(r["probability"]) >= 0 for r in out)
    imp = model.importances(spark, list("abcd")).filter("threshold = -1").collect()
    assert len(imp) == 4
    model.save(spark, str(tmp_path / "m"))
    again = ordinal.BinaryEnsemble.load(spark, str(tmp_path / "m")).transform(df)
    a = [tuple(r["probability"]) for r in model.transform(df).orderBy("id").collect()]
    assert a == [tuple(r["probability"]) for r in again.orderBy("id").collect()]


def test_ordinal_edge_cases(ordered):
    _, _, df = ordered
    with pytest.raises(ValueError, match="probabilities"):
        from pyspark.ml.classification import LinearSVC

        ordinal.ordinal_classifier(df, LinearSVC(), "y")
    two = ordinal.ordinal_classifier(df.filter("y < 2"), models.logistic_regression(500), "y")
    assert len(two.models) == 1 and two.transform(df).select("prediction").distinct().count() == 2
    absent = ordinal.fit_binary_ensemble(df, models.logistic_regression(1000), "y", classes=[0, 1, 2, 3])
    assert absent.models[2] == 0.0
    probs = absent.transform(df).select("probability").first()[0]
    assert len(probs) == 4 and probs[3] == 0.0
    back = ordinal.ordinal_classifier(df, models.logistic_regression(1000), "y", reverse=True)
    same = ordinal.ordinal_classifier(df, models.logistic_regression(1000), "y")
    joined = back.transform(df).select("id", F.col("prediction").alias("p")).join(same.transform(df).select("id", "prediction"), "id")
    assert joined.filter("p != prediction").count() < 20


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_proportional_odds_is_a_maximum(ordered, link):
    x, y, df = ordered
    model = ordinal.fit_proportional_odds(df, "v", "y", 4, link)
    beta, cuts = np.array(model.beta), np.array(model.cuts)
    assert (np.diff(cuts) > 0).all() and beta[0] > 0.5 > abs(beta[2]) and beta[1] < -0.3

    def loss(b, c):
        return ordinal._odds_terms(x, y, b, c, link)[0]

    base = loss(beta, cuts)
    assert np.isclose(base, model.loss)
    for i in range(4):
        for step in (-1e-2, 1e-2):
            assert loss(beta + step * np.eye(4)[i], cuts) > base
    out = ordinal.apply_threshold_model(df, model, "v").select("y", "prediction").collect()
    assert np.mean([r["y"] == r["prediction"] for r in out]) > 0.6


def test_immediate_threshold_gradient(ordered):
    x, y, df = ordered
    model = ordinal.fit_immediate_threshold(df, "v", "y", 4, 1.0)
    g = ordinal._immediate_terms(x, y, np.array(model.beta), np.array(model.cuts), "logit")[1:7]
    g[2:] += np.array(model.beta)
    assert np.abs(g).max() < 1e-3


def test_binary_logit_matches_newton(spark, ordered):
    x, y, df = ordered
    rows = df.select(F.get("v", F.lit(0)).alias("x"), (F.col("y") == 2).cast("int").alias("h"))
    table = {r["term"]: r for r in models.glm_table(models.binary_logit_glm(rows, ["x"], "h"), ["x"], spark).collect()}
    a = np.column_stack([np.ones(1000), x[:, 0]])
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ b))
        h = a.T @ (a * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, a.T @ ((y == 2) - p))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    assert np.allclose([table["intercept"]["coefficient"], table["x"]["coefficient"]], b, atol=1e-5)
    assert np.allclose([table["intercept"]["std_error"], table["x"]["std_error"]], se, rtol=1e-4)
    infl = diagnostics.glm_influence(rows, ["x"], "h", [b[1]], b[0]).agg(F.sum("leverage"), F.max("cooks_distance")).first()
    assert np.isclose(infl[0], 2.0, atol=1e-9) and infl[1] > 0


def test_multinomial_summary(ordered):
    _, _, df = ordered
    rows = {(r["class"], r["term"]): r for r in models.multinomial_logit_summary(df.select("v", "y"), "v", "y", list("abcd")).collect()}
    assert len(rows) == 10 and rows[(2, "a")]["p_value"] < 1e-6 < rows[(2, "c")]["p_value"]


def test_kernels(ordered):
    _, _, df = ordered
    for kernel in ("linear", "rbf", "poly"):
        out = models.svm(df.select("id", "v", "y"), "v", "y", kernel, gamma=0.2, rff=80, max_iter=20)(df.select("id", "v", "y"))
        assert evaluation.accuracy(out, "y", "prediction").first()["accuracy"] > 0.55


def test_search_and_cross_validation(ordered):
    _, _, df = ordered
    folded = evaluation.stratified_kfold(df, "id", "y", 3)
    run = evaluation.estimator_fit_predict(models.logistic_regression(1000), ["id", "y", "fold", "prediction"])
    scores = evaluation.cross_val_score(folded, run, 3, "y").collect()
    assert sorted(r["fold"] for r in scores) == [0, 1, 2] and sum(r["n"] for r in scores) == 1000
    results = evaluation.param_search(
        folded, lambda p: evaluation.estimator_fit_predict(models.logistic_regression(1000, "l2", p["c"]), ["id", "y", "fold", "prediction"]),
        {"c": ("log", 1e-4, 10.0)}, 3, 3, "y",
    )
    assert results.count() == 3 and results.filter("is_best").count() >= 1
    grid = evaluation.experiment_grid(df.sparkSession, [{"name": "ok"}, {"name": "bad"}], lambda c: 0.5 if c["name"] == "ok" else 1 / 0)
    rows = {r["name"]: r for r in grid.collect()}
    assert rows["ok"]["is_best"] and "ZeroDivisionError" in rows["bad"]["error"]


def test_chi2(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "z")] * 5, "p string, q string")
    r = diagnostics.chi2_contingency(df, "p", "q").first()
    assert np.isclose(r["statistic"], 34.3611111, atol=1) and r["dof"] == 2 and r["p_value"] < 1e-5
    assert np.isclose(diagnostics.chi2_sf(3.841458820694124, 1), 0.05) and np.isclose(diagnostics.chi2_sf(18.307038053275146, 10), 0.05)


def test_prediction_files(spark):
    ok = spark.createDataFrame([(i, i % 3) for i in range(9)], "id bigint, p int")
    table = predictions.make_predictions_table(ok, "id", "p", expected=9)
    assert predictions.validate_predictions(table, ok).count() == 0
    with pytest.raises(ValueError, match="length"):
        predictions.make_predictions_table(ok, "id", "p", expected=8)
    with pytest.raises(ValueError, match="invalid"):
        predictions.make_predictions_table(ok.withColumn("p", F.lit(7)), "id", "p")
    broken = spark.createDataFrame([(1, "Low"), (99, None), (3, "Hi")], "id bigint, salary_category string")
    checks = {r["check"]: r["n"] for r in predictions.validate_predictions(broken, ok).collect()}
    assert checks == {"null salary_category": 1, "invalid category": 2, "missing ids": 7, "extra ids": 1}
    assert predictions.validate_predictions(broken.drop("salary_category"), ok).filter("check like 'missing column%'").count() == 1
    shuffled = table.orderBy(F.desc("id"))
    _, rate = predictions.agreement({"a": table, "b": shuffled}, "id", "salary_category")
    assert rate.first()["percent"] == 100.0
    with pytest.raises(ValueError, match="unique"):
        from gradus.operators.lookups import align_predictions

        class Twice(dict):
            def __iter__(self):
                return iter(["a", "a"])

        align_predictions(Twice(a=table), "id", "salary_category")


def test_run_tracking(spark, tmp_path):
    results = spark.createDataFrame(
        [(i, {"model__depth": str(i)}, 0.5 + i / 100, 0.1, 1.0, 1) for i in range(8)],
        "draw int, params map<string,string>, mean_test_score double, std_test_score double, mean_fit_time double, rank_test_score int",
    )
    path = str(tmp_path / "runs")
    run = tracking.run_record(
        results, "boosted", 2, "s", "e", {"method": "vote", "contamination": "auto", "n_outliers": 3, "n": 60}, (57, 9), {0: 20, 1: 37}, {"k": "v"}
    )
    tracking.write_run(run, path)
    unfinished = spark.createDataFrame([("broken", 1, None, None)], "run_name string, run_index int, best_score double, best_params map<string,string>")
    tracking.write_run(unfinished, path)
    rows = tracking.runs_summary(tracking.read_runs(spark, path)).collect()
    assert [r["run_index"] for r in rows] == [1, 2] and rows[0]["best_depth"] is None and rows[1]["best_depth"] == "7"
    back = tracking.read_runs(spark, path).filter("run_index = 2").first()
    assert len(back["top_results"]) == 5 and back["outlier_info"]["outlier_percentage"] == 5.0
    it = str(tmp_path / "iterations")
    for i in (1, 2):
        tracking.log_iteration(spark, it, "boosted", 2, i, {"a__b": 1.5}, 0.5)
    assert tracking.read_iterations(spark, it).count() == 2
