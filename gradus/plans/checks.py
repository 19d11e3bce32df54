"""Checks of fitted models that SQL can state: a query ``<op>_check`` runs the operator's own query and counts
the rows that keep an invariant; its SQL counts the rows of the input."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import arrays
from gradus.operators import clustering, models, ordinal
from gradus.plans.registry import QUERIES, query
from gradus.plans.standins import DIM

CLASSES = 3


def result(t, name: str) -> DataFrame:
    return QUERIES[name](t.spark, t.dir)


def counted(name: str, rows: str, **good: Callable[[], Column]):
    """Registers ``name_check``: the rows, and those for which each condition holds (made when the query runs)."""
    extra = "".join(f", count(*) AS {k}" for k in good)

    @query(f"{name}_check", f"SELECT count(*) AS n{extra} FROM {rows}", ("coded",) if rows.startswith("coded") else ("blocks",))
    def _(t):
        held = [F.count_if(F.coalesce(c(), F.lit(False))).alias(k) for k, c in good.items()]
        return result(t, name).agg(F.count("*").alias("n"), *held)


def _shares() -> list[Column]:
    return [F.col(f"p{i}") for i in range(CLASSES)]


def _sums() -> Column:
    p = _shares()
    return (F.abs(p[0] + p[1] + p[2] - 1) < 1e-6) & (F.least(*p) >= -1e-9)


def _top() -> Column:
    return F.col("prediction") == arrays.argmax_class(F.array(*_shares()))


def _in_classes(col: str) -> Callable[[], Column]:
    return lambda: F.col(col).isin(0, 1, 2)


for _name in ("ordinal_classifier", "boosted_ordinal", "boosted_multiclass", "random_forest", "logistic_regression", "mlp_classifier", "save_model", "load_model"):
    counted(_name, "blocks", sums=_sums, top=_top)
counted("proportional_odds", "coded, (VALUES (1), (2)) AS links(k)", sums=_sums, top=_top)
counted("ordinal_immediate_threshold", "blocks", known=_in_classes("prediction"))
counted("mlp_ordinal", "blocks", known=_in_classes("prediction"), cum=lambda: (F.col("cum_0") >= F.col("cum_1")) & F.col("cum_0").between(0, 1) & F.col("cum_1").between(0, 1))
counted("left_out_votes", "blocks", sums=_sums, known=_in_classes("prediction"))
counted("svm", "blocks, (VALUES (1), (2), (3)) AS kernels(k)", known=_in_classes("prediction"))
counted("predict", "blocks")
for _name in ("outlier_isolation_forest", "outlier_elliptic", "outlier_vote", "outlier_supervised"):
    counted(_name, "blocks", flagged=lambda: F.col("is_outlier").isNotNull())
counted(
    "cross_val_predict", "blocks", fold_known=_in_classes("fold"), known=_in_classes("prediction"),
    sure=lambda: F.col("confidence").between(1 / CLASSES - 1e-9, 1 + 1e-9),
)
for _name in ("kmeans", "kmeans_on_pca", "hierarchical_clusters", "gaussian_mixture", "spectral_clusters", "minibatch_kmeans"):
    counted(_name, "blocks", known=_in_classes("cluster"))


@query("kmeans_fit_check", "SELECT count(*) AS n, count(*) AS nearest, true AS inertia_is_the_sum, true AS centres_are_means FROM blocks", ("blocks",))
def _(t):
    """Every row on its nearest centre, the inertia is the sum of squared distances, and the centres are means."""
    rows = t.blocks.select("id", "vec").persist()
    fit = clustering.fit_kmeans(rows, "vec", 3, 2, max_iter=300)
    placed = clustering.assign_nearest(rows, "vec", fit.centers, dist="d").persist()
    every = F.array(*[arrays.l2_norm(F.zip_with("vec", F.array(*map(F.lit, c)), lambda x, m: x - m)) for c in fit.centers])
    out = placed.agg(F.count("*").alias("n"), F.count_if(F.abs(F.array_min(every) - F.col("d")) < 1e-9).alias("nearest"), F.sum(F.col("d") * F.col("d")).alias("ss")).first()
    means = {r["cluster"]: np.array([r[f"m{i}"] for i in range(DIM)]) for r in placed.groupBy("cluster").agg(*[F.avg(F.get("vec", F.lit(i))).alias(f"m{i}") for i in range(DIM)]).collect()}
    moved = max(float(np.abs(means[c] - np.array(fit.centers[c])).max()) for c in means)
    placed.unpersist()
    rows.unpersist()
    row = (out["n"], out["nearest"], abs(out["ss"] - fit.inertia) < 1e-6 * max(1.0, fit.inertia), moved < 1e-2)
    return t.spark.createDataFrame([row], "n bigint, nearest bigint, inertia_is_the_sum boolean, centres_are_means boolean")


@query("pca_fit_check", "SELECT true AS orthonormal, true AS shares_fall, CAST(2 AS INTEGER) AS components")
def _(t):
    """Components are orthonormal, and their variance shares fall and stay within one."""
    fit = clustering.fit_pca(t.blocks, "vec", 2)
    w, ratio = np.array(fit.components), np.array(fit.ratio)
    w = w if w.shape[0] == 2 else w.T
    row = (bool(np.allclose(w @ w.T, np.eye(2), atol=1e-6)), bool((np.diff(ratio) <= 1e-9).all() and 0 <= ratio.sum() <= 1 + 1e-9), len(ratio))
    return t.spark.createDataFrame([row], "orthonormal boolean, shares_fall boolean, components int")


@query("saved_model_check", "SELECT count(*) AS n, count(*) AS equal FROM blocks", ("blocks",))
def _(t):
    """The saved ensemble predicts what the fitted one does."""
    from gradus.plans.evaluations import scratch

    data = models.with_features(t.blocks.select("id", "vec", "y"), "vec", "y")
    fitted = ordinal.ordinal_classifier(data, models.random_forest(5, 3), "y")
    path = scratch(t, "model")
    fitted.save(t.spark, path)
    before = fitted.transform(data).select("id", F.col("prediction").alias("a"), F.col("probability").alias("pa"))
    after = ordinal.BinaryEnsemble.load(t.spark, path).transform(data).select("id", F.col("prediction").alias("b"), F.col("probability").alias("pb"))
    same = (F.col("a") == F.col("b")) & (F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) < 1e-9)
    return before.join(after, "id").agg(F.count("*").alias("n"), F.count_if(same).alias("equal"))


@query("cross_val_score_check", "SELECT CAST(3 AS BIGINT) AS folds, true AS in_range")
def _(t):
    scores = result(t, "cross_val_score")
    fold = "fold" if "fold" in scores.columns else scores.columns[0]
    number = [f.name for f in scores.schema.fields if f.dataType.typeName() == "double"]
    return scores.filter(F.col(fold).isNotNull()).agg(F.countDistinct(fold).alias("folds"), F.bool_and(F.greatest(*number, F.lit(0.0)) <= 1).alias("in_range"))


@query("saved_chain_check", "SELECT count(*) AS n, count(*) AS equal FROM blocks", ("blocks",))
def _(t):
    """The whole fitted chain, saved and loaded, scores like the fitted one."""
    from gradus.operators import lookups
    from gradus.plans.evaluations import scratch
    from gradus.plans.learning import _small_chain
    from gradus.plans.standins import VECTOR_SCHEMA
    from gradus.plans.training import FittedChain, fit_chain, training_rows

    dim = lookups.state_salary(t.spark)
    opts = _small_chain(outliers=False)
    kept, _, _ = training_rows(t.candidates, VECTOR_SCHEMA, dim, opts)
    chain = fit_chain(kept, VECTOR_SCHEMA, dim, "y", opts)
    path = scratch(t, "chain")
    chain.save(t.spark, path)
    rows = t.candidates.drop("salary_category")
    before = chain.score(rows, dim, ["id"]).select("id", F.col("prediction").alias("a"), F.col("probability").alias("pa"))
    after = FittedChain.load(t.spark, path).score(rows, dim, ["id"]).select("id", F.col("prediction").alias("b"), F.col("probability").alias("pb"))
    near = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) < 1e-9
    return before.join(after, "id").agg(F.count("*").alias("n"), F.count_if((F.col("a") == F.col("b")) & near).alias("equal"))


def _majority(rows: DataFrame) -> float:
    """The share of the most frequent class, which a constant model reaches."""
    counts = [r["count"] for r in rows.groupBy("y").count().collect()]
    return max(counts) / sum(counts)


def _accuracy(rows: DataFrame) -> float:
    return rows.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


@query("boosted_multiclass_fit_check", "SELECT true AS loss_falls, true AS beats_majority, true AS beats_one_vs_rest")
def _(t):
    """The training loss falls every round; on held-out rows the fit beats a constant, and its log-loss is below that of one machine per class, both on all rows and features."""
    from gradus.operators.evaluation import train_test_split

    parts = train_test_split(t.blocks.select("id", "vec", "y"), "id", 0.3, "y").persist()
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    same = {"depth": 4, "rate": 0.3, "subsample": 1.0, "columns": 1.0}
    model = ordinal.boosted_multiclass(train, "id", "vec", "y", DIM, rounds=10, l1=0.1, bins=32, **same)
    names = F.array(*[F.lit(c) for c in model.classes])
    loss = lambda p: -F.log(F.greatest(F.get(p, F.array_position(names, F.col("y")).cast("int") - 1), F.lit(1e-15)))
    own = model.transform(test, "vec").withColumn("loss", loss("probability"))
    mean, hits = own.agg(F.avg("loss"), F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()
    rest = ordinal.boosted_one_vs_rest(models.with_features(train, "vec", "y"), "y", trees=10, **same)
    other = rest.transform(models.with_features(test, "vec", "y")).withColumn("loss", loss("probability")).agg(F.avg("loss")).first()[0]
    row = (all(b < a for a, b in zip(model.losses, model.losses[1:])), hits > _majority(test), mean < other)
    return t.spark.createDataFrame([row], "loss_falls boolean, beats_majority boolean, beats_one_vs_rest boolean")


@query("holdout_estimate_forest_check", "SELECT count(*) AS n, true AS beats_majority, true AS share_is_one_over_e FROM blocks", ("blocks",))
def _(t):
    """Left-out rows are about 1 / e of all in every tree, every row has votes, and these beat a constant."""
    row = result(t, "holdout_estimate_forest").first()
    return t.spark.createDataFrame(
        [(row["n"], row["accuracy"] > _majority(t.blocks), bool(abs(row["left_out"] - np.exp(-1)) < 0.02))], "n bigint, beats_majority boolean, share_is_one_over_e boolean"
    )


@query("mlp_ordinal_fit_check", "SELECT true AS beats_majority")
def _(t):
    rows = result(t, "mlp_ordinal")
    return t.spark.createDataFrame([(_accuracy(rows) > _majority(rows) + 0.1,)], "beats_majority boolean")


@query("logistic_regression_cv_check", "SELECT CAST(10 AS INTEGER) AS penalties, true AS gradients_vanish, true AS beats_majority, CAST(1 AS INTEGER) AS best")
def _(t):
    """Every fit of the path is at its optimum."""
    from gradus.plans.learning import _path

    path = _path(t)
    best = sum(c == path.best for c in path.cs)
    row = (len(path.cs), bool(path.gradients.max() < 1e-3), bool(path.scores.mean(1).max() > _majority(t.blocks)), best)
    return t.spark.createDataFrame([row], "penalties int, gradients_vanish boolean, beats_majority boolean, best int")


@query(
    "ward_merges_check",
    """WITH long AS (SELECT unnest(range(1, 65)) AS pos, vec FROM blocks), v AS (SELECT var_pop(vec[pos]) * count(*) AS ss FROM long GROUP BY pos)
    SELECT (SELECT count(DISTINCT vec) - 1 FROM blocks) AS merges, true AS heights_rise, round(sum(ss), 6) AS squares, (SELECT count(*) FROM blocks) AS last_size FROM v""",
    ("blocks",),
)
def _(t):
    """Heights never fall, and the merges together remove all squared deviations of the table."""
    from pyspark.sql import Window

    m = result(t, "ward_merges").withColumn("before", F.lag("height").over(Window.orderBy("step")))  # at most as many rows as summaries
    return m.agg(
        F.count("*").alias("merges"), F.bool_and(F.col("height") >= F.coalesce("before", F.lit(0.0)) - 1e-9).alias("heights_rise"),
        F.round(F.sum(F.col("height") * F.col("height") / 2), 6).alias("squares"), F.max("size").alias("last_size"),
    )


@query("outlier_elliptic_fit_check", "SELECT count(*) AS planted, count(*) AS flagged FROM blocks WHERE id % 40 = 0", ("blocks",))
def _(t):
    """Rows moved far away are flagged among all."""
    from gradus.operators import outliers

    moved = t.blocks.select("id", F.when(F.col("id") % 40 == 0, F.transform("vec", lambda x: x + 2.0)).otherwise(F.col("vec")).alias("vec"))
    flags = outliers.outlier_elliptic(moved, "id", "vec", 0.05)
    return flags.filter("id % 40 = 0").agg(F.count("*").alias("planted"), F.count_if("is_outlier").alias("flagged"))


@query("halving_search_check", "SELECT * FROM (VALUES (0, 9, 3, 0), (1, 3, 1, 0), (2, 1, 0, 1)) AS v(rung, draws, survivors, best)")
def _(t):
    """Nine, three and one draw; the survivors are those of the next rung, the last rung has the best."""
    rows = result(t, "halving_search").persist()
    after = rows.select((F.col("rung") - 1).alias("rung"), "draw", F.lit(True).alias("seen"))
    kept = rows.join(after, ["rung", "draw"], "left")
    return kept.groupBy("rung").agg(
        F.count("*").cast("int").alias("draws"), F.count_if(F.col("survives") & F.coalesce("seen", F.lit(False))).cast("int").alias("survivors"), F.count_if("is_best").cast("int").alias("best")
    )
