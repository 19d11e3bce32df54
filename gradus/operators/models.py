"""Spark ML learners with the tuned options of the trials, and weights, prediction and summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.functions.scalars import case_map, ordinal_decode
from gradus.operators.sums import distributed_sum


def with_features(df: DataFrame, vec: str, y: str | None = None, name: str = "features", label: str = "label") -> DataFrame:
    out = df.withColumn(name, array_to_vector(vec))
    return out.withColumn(label, F.col(y).cast("double")) if y else out


def predicted(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keys with the predicted class and the probability row as an array."""
    return df.select(*keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))


def random_forest(trees: int = 100, depth: int = 8, min_leaf: int = 1, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)


def logistic_regression(n: int, penalty: str = "l2", c: float = 1.0, max_iter: int = 100):
    """Multinomial logistic; C is turned into Spark's per-row penalty 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(
        family="multinomial", elasticNetParam=1.0 if penalty == "l1" else 0.0, regParam=1.0 / (c * n), maxIter=max_iter
    )


def logistic_regression_cv(df: DataFrame, vec: str, y: str, fold: str, dim: int, cs: Sequence[float] | None = None, **opts):
    """The :class:`~gradus.operators.logit_path.LogitPath` over ten penalties from 1e-4 to 1e4, or the given ones."""
    from gradus.operators.logit_path import fit_logit_path

    return fit_logit_path(df, vec, y, fold, dim, [10.0 ** (-4 + 8 * i / 9) for i in range(10)] if cs is None else cs, **opts)


def coefficient_table(model, names: Sequence[str], classes: Sequence, spark) -> DataFrame:
    """Wide (feature, one column per class) coefficients of a multinomial model."""
    m = model.coefficientMatrix.toArray()
    rows = [(n, *[float(m[c, i]) for c in range(m.shape[0])]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"`{c}` double" for c in classes))


def multinomial_logit_summary(df: DataFrame, vec: str, y: str, names: Sequence[str], max_iter: int = 100) -> DataFrame:
    """(class, term, coefficient, std_error, z, p_value) against the first class, unpenalised.

    Standard errors come from the Fisher information, a sum over rows whose size
    is set by the number of parameters.
    """
    data = with_features(df, vec, y).select(F.col(vec).alias("x"), "features", "label").persist()
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(family="multinomial", regParam=0.0, maxIter=max_iter, tol=1e-10).fit(data)
    w = np.column_stack([model.interceptVector.toArray(), model.coefficientMatrix.toArray()])
    w = w - w[0]
    k, q = w.shape
    m = (k - 1) * q

    def part(batch: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([np.ones(len(batch["x"])), batch["x"]])
        s = x @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        info = np.zeros((m, m))
        for a in range(1, k):
            for b in range(1, k):
                weight = p[:, a] * ((a == b) - p[:, b])
                info[(a - 1) * q : a * q, (b - 1) * q : b * q] = x.T @ (x * weight[:, None])
        return info.ravel()

    info = distributed_sum(data, ["x"], part, m * m).reshape(m, m)
    data.unpersist()
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info, hermitian=True)), 0.0)).reshape(k - 1, q)
    terms = ["intercept", *names]
    rows = []
    for c in range(1, k):
        for j, term in enumerate(terms):
            z = float(w[c, j] / se[c - 1, j]) if se[c - 1, j] > 0 else None
            rows.append((c, term, float(w[c, j]), float(se[c - 1, j]), z, None if z is None else math.erfc(abs(z) / math.sqrt(2))))
    return df.sparkSession.createDataFrame(rows, "class int, term string, coefficient double, std_error double, z double, p_value double")


def binary_logit_glm(df: DataFrame, x: Sequence[str], y: str):
    """Fitted binomial model with a logit link and an intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=list(x), outputCol="features").transform(df.dropna(subset=[*x, y])).withColumn(
        "label", F.col(y).cast("double")
    )
    return GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50).fit(data)


def glm_table(model, x: Sequence[str], spark) -> DataFrame:
    s = model.summary
    values = [*model.coefficients.toArray(), model.intercept]
    rows = [
        (t, float(v), float(e), float(z), float(p))
        for t, v, e, z, p in zip([*x, "intercept"], values, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double, z double, p_value double")


def fitted_curve(spark, intercept: float, slope: float, low: float, high: float, points: int = 200) -> DataFrame:
    """Probability along an even grid of one feature."""
    x = F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))
    return spark.range(points).select(x.alias("x")).withColumn("p", 1.0 / (1.0 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("x")))))


def svm(train: DataFrame, vec: str, y: str, kernel: str = "linear", c: float = 1.0, gamma: float = 1.0, rff: int = 200, max_iter: int = 50, seed: int = 42):
    """One-vs-rest support vectors; returns a function that adds ``prediction`` to a table.

    The radial kernel is approximated with random Fourier features, the
    polynomial one by degree-2 expansion; both then use the linear learner.
    """
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import PolynomialExpansion

    from gradus.operators.clustering import linear_map

    dim = len(train.select(vec).first()[0])
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=math.sqrt(2 * gamma), size=(rff, dim))
    shift = rng.uniform(0, 2 * math.pi, size=rff)

    def expand(df: DataFrame) -> DataFrame:
        if kernel == "linear":
            return df.withColumn("__f", array_to_vector(vec))
        if kernel == "poly":
            return PolynomialExpansion(degree=2, inputCol="__v", outputCol="__f").transform(
                df.withColumn("__v", array_to_vector(vec))
            ).drop("__v")
        if kernel == "rbf":
            scale = math.sqrt(2.0 / rff)
            z = F.transform(linear_map(df, vec, weights, shift), lambda v: F.cos(v) * scale)
            return df.withColumn("__f", array_to_vector(z))
        raise ValueError(f"unknown kernel {kernel!r}")

    data = expand(train).select("__f", F.col(y).cast("double").alias("__y")).persist()
    learner = LinearSVC(featuresCol="__f", labelCol="__y", regParam=1.0 / (c * data.count()), maxIter=max_iter)
    model = OneVsRest(classifier=learner, featuresCol="__f", labelCol="__y", parallelism=4).fit(data)
    data.unpersist()

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(expand(df))
        return out.withColumn("prediction", F.col("prediction").cast("int")).drop("__f", "rawPrediction")

    return predict


def mlp_classifier(dim: int, classes: int, hidden: Sequence[int] = (32,), max_iter: int = 60, seed: int = 42):
    """Feed-forward net with a softmax output."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=[dim, *hidden, classes], maxIter=max_iter, seed=seed)


def class_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Balanced weights n / (k n_class) as literals from one small aggregate."""
    sizes = {r[y]: r["count"] for r in collect_small(df.groupBy(y).count()) if r[y] is not None}
    n, k = sum(sizes.values()), len(sizes)
    return df.withColumn(name, case_map(F.col(y), {c: n / (k * m) for c, m in sizes.items()}).cast("double"))


def predict(model, df: DataFrame, key: str, label: str = "salary_category") -> DataFrame:
    """Text labels for unlabelled rows."""
    return model.transform(df).select(key, ordinal_decode(F.col("prediction").cast("int")).alias(label))
