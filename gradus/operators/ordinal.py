"""Ordinal and one-vs-rest classifiers built from binary Spark ML learners, and threshold models."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.functions import arrays
from gradus.operators.sums import distributed_sum

PARALLEL_FITS = 4


def ordinal_targets(df: DataFrame, y: str, classes: Sequence, prefix: str = "above_") -> DataFrame:
    """k - 1 columns: 1 when the class ranks above the i-th class of the given order."""
    rank = F.lit(None).cast("int")
    for i, c in enumerate(classes):
        rank = F.when(F.col(y) == F.lit(c), i).otherwise(rank)
    return df.select("*", *[(rank > i).cast("int").alias(f"{prefix}{i}") for i in range(len(classes) - 1)])


@dataclass(frozen=True)
class BinaryEnsemble:
    """Fitted binary models, or a constant probability where a subproblem has one class only."""

    kind: str
    classes: tuple
    models: tuple
    features: str

    def transform(self, df: DataFrame, probability: str = "probability", prediction: str = "prediction") -> DataFrame:
        """Adds class probabilities (array) and the predicted class."""
        out, drop, cols = df, [], []
        for i, m in enumerate(self.models):
            if isinstance(m, float):
                cols.append(F.lit(m))
                continue
            out = m.transform(out)
            drop += [f"__raw{i}", f"__prob{i}", f"__pred{i}"]
            cols.append(F.get(vector_to_array(f"__prob{i}"), F.lit(1)))
        if self.kind == "ovr":
            probs = arrays.clip_renormalize(F.array(*cols))
        else:
            probs = arrays.ordinal_probabilities(cols)
        out = out.withColumn(probability, probs).drop(*drop)
        codes = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn(prediction, F.get(codes, arrays.argmax_class(F.col(probability))))

    def cumulative(self, df: DataFrame, prefix: str = "cum_") -> DataFrame:
        """Adds P(y > class i) columns (ordinal ensembles)."""
        out, drop = df, []
        for i, m in enumerate(self.models):
            if isinstance(m, float):
                out = out.withColumn(f"{prefix}{i}", F.lit(m))
                continue
            out = m.transform(out).withColumn(f"{prefix}{i}", F.get(vector_to_array(f"__prob{i}"), F.lit(1)))
            drop += [f"__raw{i}", f"__prob{i}", f"__pred{i}"]
        return out.drop(*drop)

    def importances(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """(threshold, feature, importance) per binary model plus the mean with threshold -1."""
        found = [
            (i, [float(v) for v in m.featureImportances.toArray()]) for i, m in enumerate(self.models) if hasattr(m, "featureImportances")
        ]
        if not found:
            raise AttributeError("the base learner has no feature importances")
        rows = [(i, n, v) for i, vals in found for n, v in zip(names, vals)]
        rows += [(-1, n, sum(vals[j] for _, vals in found) / len(found)) for j, n in enumerate(names)]
        return spark.createDataFrame(rows, "threshold int, feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {
            "kind": self.kind, "classes": list(self.classes), "features": self.features,
            "constants": {str(i): m for i, m in enumerate(self.models) if isinstance(m, float)}, "n": len(self.models),
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        for i, m in enumerate(self.models):
            if not isinstance(m, float):
                PipelineModel(stages=[m]).write().overwrite().save(f"{path}/model_{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BinaryEnsemble:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        models = tuple(
            meta["constants"][str(i)] if str(i) in meta["constants"] else PipelineModel.load(f"{path}/model_{i}").stages[0]
            for i in range(meta["n"])
        )
        return BinaryEnsemble(meta["kind"], tuple(meta["classes"]), models, meta["features"])


def fit_binary_ensemble(df: DataFrame, base, y: str, features: str = "features", classes: Sequence | None = None, kind: str = "ordinal") -> BinaryEnsemble:
    """One binary fit per threshold (ordinal) or per class (ovr), a few at a time over one persisted input.

    With two classes a single binary model is fitted. The base learner must
    give probabilities.
    """
    if not base.hasParam("probabilityCol"):
        raise ValueError(f"{type(base).__name__} gives no class probabilities")
    data = df.select(features, y).persist()
    sizes = {r[y]: r["count"] for r in collect_small(data.groupBy(y).count())}
    order = list(classes) if classes is not None else sorted(sizes)
    if len(order) < 2:
        raise ValueError("need at least two classes")
    jobs = range(len(order)) if kind == "ovr" and len(order) > 2 else range(len(order) - 1)
    total = sum(sizes.values())

    def one(i: int) -> Model | float:
        members = [order[i]] if kind == "ovr" and len(order) > 2 else order[i + 1 :]
        positive = sum(sizes.get(c, 0) for c in members)
        if positive in (0, total):
            return float(positive > 0)
        labelled = data.withColumn("__t", F.col(y).isin(*members).cast("double"))
        learner = base.copy({
            base.getParam("featuresCol"): features, base.getParam("labelCol"): "__t", base.getParam("rawPredictionCol"): f"__raw{i}",
            base.getParam("probabilityCol"): f"__prob{i}", base.getParam("predictionCol"): f"__pred{i}",
        })
        return learner.fit(labelled)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        models = tuple(pool.map(one, jobs))
    data.unpersist()
    return BinaryEnsemble("ordinal" if len(order) == 2 else kind, tuple(order), models, features)


def ordinal_classifier(df: DataFrame, base, y: str, features: str = "features", reverse: bool = False) -> BinaryEnsemble:
    """Frank and Hall: one model per threshold of the (optionally reversed) class order."""
    order = sorted(r[0] for r in collect_small(df.select(y).distinct()))
    return fit_binary_ensemble(df, base, y, features, order[::-1] if reverse else order)


def boosted_trees(trees: int = 800, depth: int = 10, rate: float = 0.005, subsample: float = 0.8, columns: float = 0.7, min_gain: float = 0.0, seed: int = 42):
    """Gradient-boosted binary trees. Leaf penalties have no counterpart in Spark; ``min_gain`` stands for the split penalty."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=str(columns),
        minInfoGain=min_gain, seed=seed,
    )


def boosted_ordinal(df: DataFrame, y: str, features: str = "features", **params) -> BinaryEnsemble:
    return ordinal_classifier(df, boosted_trees(**params), y, features)


def boosted_one_vs_rest(df: DataFrame, y: str, features: str = "features", **params) -> BinaryEnsemble:
    """One boosted model per class, probabilities normalised over the classes."""
    return fit_binary_ensemble(df, boosted_trees(**params), y, features, kind="ovr")


def boosted_multiclass(df: DataFrame, id_col: str, vec: str, y: str, dim: int, **params):
    """One machine over all classes with softmax losses and leaf penalties: :func:`gradus.operators.trees.fit_boosted_classes`."""
    from gradus.operators.trees import fit_boosted_classes

    return fit_boosted_classes(df, id_col, vec, y, dim, **params)


def mlp_ordinal(df: DataFrame, id_col: str, vec: str, y: str, dim: int, **params):
    """One net with k - 1 sigmoid outputs: :func:`gradus.operators.ordinal_net.fit_ordinal_net`."""
    from gradus.operators.ordinal_net import fit_ordinal_net

    return fit_ordinal_net(df, id_col, vec, y, dim, **params)


# --- threshold models -------------------------------------------------------

@dataclass(frozen=True)
class ThresholdModel:
    """score = x . beta, class by increasing cut points."""

    beta: tuple[float, ...]
    cuts: tuple[float, ...]
    link: str
    loss: float
    rounds: int


def _cdf(z: np.ndarray, link: str) -> np.ndarray:
    if link == "logit":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    if link == "probit":
        return 0.5 * _erfc(-z / math.sqrt(2.0))
    raise ValueError(f"unknown link {link!r}")


_erfc = np.vectorize(math.erfc, otypes=[float])


def _pdf(z: np.ndarray, link: str) -> np.ndarray:
    if link == "logit":
        p = _cdf(z, link)
        return p * (1 - p)
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _pack(grad: np.ndarray, info: np.ndarray, loss: float) -> np.ndarray:
    return np.concatenate([[loss], grad, info.ravel()])


def _odds_terms(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cuts: np.ndarray, link: str) -> np.ndarray:
    """Negative log-likelihood, its gradient and the expected information of a batch; parameters (cuts, beta)."""
    n, k = len(x), len(cuts) + 1
    m = len(cuts) + len(beta)
    s = x @ beta
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    F_, f_ = np.zeros((n, k + 1)), np.zeros((n, k + 1))
    F_[:, k] = 1.0
    for j in range(1, k):
        z = edges[j] - s
        F_[:, j], f_[:, j] = _cdf(z, link), _pdf(z, link)
    grad, info, loss = np.zeros(m), np.zeros((m, m)), 0.0
    for c in range(k):
        p = np.maximum(F_[:, c + 1] - F_[:, c], 1e-12)
        jac = np.zeros((n, m))
        if c < k - 1:
            jac[:, c] += f_[:, c + 1]
        if c > 0:
            jac[:, c - 1] -= f_[:, c]
        jac[:, len(cuts):] = -(f_[:, c + 1] - f_[:, c])[:, None] * x
        mine = y == c
        loss -= np.log(p[mine]).sum()
        grad -= (jac[mine] / p[mine, None]).sum(0)
        info += jac.T @ (jac / p[:, None])
    return _pack(grad, info, loss)


def _immediate_terms(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cuts: np.ndarray, link: str) -> np.ndarray:
    """Immediate-threshold logistic loss, gradient and Hessian of a batch; parameters (cuts, beta)."""
    t, m = len(cuts), len(cuts) + len(beta)
    s = x @ beta
    grad, info, loss = np.zeros(m), np.zeros((m, m)), 0.0
    for side in ("lower", "upper"):
        rows = y > 0 if side == "lower" else y < t
        if not rows.any():
            continue
        cut = y[rows] - 1 if side == "lower" else y[rows]
        sign = 1.0 if side == "lower" else -1.0
        z = sign * (s[rows] - cuts[cut])
        jac = np.zeros((rows.sum(), m))
        jac[np.arange(len(cut)), cut] = -sign
        jac[:, t:] = sign * x[rows]
        p = _cdf(-z, "logit")
        loss += np.logaddexp(0.0, -z).sum()
        grad += -(jac * p[:, None]).sum(0)
        info += jac.T @ (jac * (p * (1 - p))[:, None])
    return _pack(grad, info, loss)


def _fit_thresholds(df: DataFrame, vec: str, y: str, dim: int, terms, link: str, alpha: float, max_rounds: int) -> ThresholdModel:
    """Damped Newton steps; every evaluation is one distributed sum, parameters live on the driver."""
    data = df.select(F.col(vec).alias("x"), F.col(y).cast("int").alias("y")).persist()
    counts = sorted((r["y"], r["count"]) for r in collect_small(data.groupBy("y").count()))
    n, k = sum(c for _, c in counts), counts[-1][0] + 1
    below = np.cumsum([dict(counts).get(c, 0) for c in range(k)])[:-1] / n
    below = np.clip(below, 1e-4, 1 - 1e-4)
    if link == "probit":
        cuts = np.array([NormalDist().inv_cdf(float(b)) for b in below])
    else:
        cuts = np.log(below / (1 - below))
    cuts = cuts + 1e-6 * np.arange(len(cuts))
    beta = np.zeros(dim)
    m = len(cuts) + dim

    def evaluate(b, c):
        def part(batch: dict[str, np.ndarray]) -> np.ndarray:
            return terms(batch["x"], batch["y"], b, c, link)

        out = distributed_sum(data, ["x", "y"], part, 1 + m + m * m)
        loss, grad, info = out[0], out[1 : 1 + m], out[1 + m :].reshape(m, m)
        penalty = np.concatenate([np.zeros(len(c)), np.full(dim, alpha)])
        return loss + 0.5 * alpha * float(b @ b), grad + penalty * np.concatenate([c, b]), info + np.diag(penalty)

    loss, grad, info = evaluate(beta, cuts)
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        step = np.linalg.solve(info + 1e-9 * np.eye(m), grad)
        scale, moved = 1.0, False
        while scale > 1e-4:
            new_cuts, new_beta = cuts - scale * step[: len(cuts)], beta - scale * step[len(cuts) :]
            if (np.diff(new_cuts) > 0).all():
                tried = evaluate(new_beta, new_cuts)
                if tried[0] <= loss + 1e-12 * abs(loss):
                    moved = True
                    break
            scale /= 2
        if not moved:
            break
        change = loss - tried[0]
        cuts, beta, (loss, grad, info) = new_cuts, new_beta, tried
        if change < 1e-9 * max(1.0, abs(loss)):
            break
    data.unpersist()
    return ThresholdModel(tuple(map(float, beta)), tuple(map(float, cuts)), link, float(loss), rounds)


def fit_proportional_odds(df: DataFrame, vec: str, y: str, dim: int, link: str = "logit", max_rounds: int = 25) -> ThresholdModel:
    """P(y <= j) = F(cut_j - x.beta), F logistic or normal."""
    return _fit_thresholds(df, vec, y, dim, _odds_terms, link, 0.0, max_rounds)


def fit_immediate_threshold(df: DataFrame, vec: str, y: str, dim: int, alpha: float = 1.0, max_rounds: int = 25) -> ThresholdModel:
    """Immediate-threshold ordinal logistic with an L2 penalty on the weights."""
    return _fit_thresholds(df, vec, y, dim, _immediate_terms, "logit", alpha, max_rounds)


def apply_threshold_model(df: DataFrame, model: ThresholdModel, vec: str, probability: str = "probability", prediction: str = "prediction") -> DataFrame:
    """Class probabilities (differences of neighbouring cumulative ones) and the most probable class."""
    from gradus.operators.clustering import dot

    staged = df.withColumn("__s", dot(F.col(vec), model.beta))
    above = []
    for c in model.cuts:
        z = F.lit(c) - F.col("__s")
        below = 1.0 / (1.0 + F.exp(-z)) if model.link == "logit" else normal_cdf(z)
        above.append(1.0 - below)
    staged = staged.withColumn(probability, arrays.ordinal_probabilities(above)).drop("__s")
    return staged.withColumn(prediction, arrays.argmax_class(F.col(probability)))


def apply_threshold_cuts(df: DataFrame, model: ThresholdModel, vec: str, prediction: str = "prediction") -> DataFrame:
    """Class = number of cut points below the score (the immediate-threshold decision)."""
    from gradus.operators.clustering import dot

    s = dot(F.col(vec), model.beta)
    total = F.lit(0)
    for c in model.cuts:
        total = total + (s > F.lit(c)).cast("int")
    return df.withColumn(prediction, total)


def normal_cdf(z):
    """Standard normal distribution function, error below 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    # The published polynomial coefficients.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + p * x)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))
