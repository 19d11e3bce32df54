"""Multinomial logistic regression over all penalties and folds at once.

The models share every pass over the rows: a batch is multiplied with the
parameters of all models, a row counts for the models whose fold it isn't in.
Each model has its own limited-memory quasi-Newton state on the driver and
stops on its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.operators.sums import distributed_sum

MEMORY = 8


def _probabilities(z: np.ndarray) -> np.ndarray:
    """Softmax over the last axis."""
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _directions(grad: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """The two-loop recursion for all models; pairs without curvature count for nothing."""
    q, alphas = grad.copy(), []
    rhos = []
    for s, t in zip(steps, turns):
        curve = (s * t).sum(1)
        rhos.append(np.where(curve > 1e-12, 1.0 / np.where(curve > 1e-12, curve, 1.0), 0.0))
    for s, t, rho in reversed(list(zip(steps, turns, rhos))):
        a = rho * (s * q).sum(1)
        q -= a[:, None] * t
        alphas.append(a)
    if steps:
        curve, length = (steps[-1] * turns[-1]).sum(1), (turns[-1] ** 2).sum(1)
        q *= np.where((curve > 1e-12) & (length > 0), curve / np.where(length > 0, length, 1.0), 1.0)[:, None]
    for s, t, rho, a in zip(steps, turns, rhos, reversed(alphas)):
        q += s * (a - rho * (t * q).sum(1))[:, None]
    return -q


@dataclass(frozen=True)
class LogitPath:
    """``weights``: (penalty, fold, class, feature and intercept), of standardised features; the last fold is the fit on all rows."""

    classes: tuple
    cs: tuple[float, ...]
    folds: tuple
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    gradients: np.ndarray
    scores: np.ndarray
    passes: int

    @property
    def best(self) -> float:
        """The penalty with the best mean accuracy, the stronger one of equals."""
        means = self.scores.mean(1)
        return min(c for c, m in zip(self.cs, means) if m >= means.max() - 1e-12)

    def score_table(self, spark) -> DataFrame:
        """(c, mean_score, std_score, is_best)."""
        rows = [(float(c), float(s.mean()), float(s.std()), c == self.best) for c, s in zip(self.cs, self.scores)]
        return spark.createDataFrame(rows, "c double, mean_score double, std_score double, is_best boolean")

    def coefficients(self, spark, names: Sequence[str], c: float | None = None) -> DataFrame:
        """(feature, class, coefficient) of the fit on all rows in the units of the features, with the intercept."""
        w = self.weights[self.cs.index(self.best if c is None else c), -1]
        plain = w[:, :-1] / self.scale
        offset = w[:, -1] - plain @ self.mean
        rows = [(n, k, float(v)) for k, line in zip(self.classes, plain) for n, v in zip(names, line)]
        rows += [("(intercept)", k, float(v)) for k, v in zip(self.classes, offset - offset.mean())]
        kind = "int" if isinstance(self.classes[0], int) else "string"
        return spark.createDataFrame(rows, f"feature string, class {kind}, coefficient double")


def fit_logit_path(
    df: DataFrame, vec: str, y: str, fold: str, dim: int, cs: Sequence[float], max_passes: int = 150, tol: float = 1e-5
) -> LogitPath:
    """Ridge-penalised fits for every C of ``cs`` (penalty |w|^2 / (2 C n)) and every left-out fold, and on all rows.

    Each pass over the rows gives loss and gradient of all models; a model
    halves its step where the loss doesn't fall enough. Vectors must be
    complete; intercepts aren't penalised; features are standardised for the fit.
    """
    from gradus.operators.aggregates import vector_moments

    rows = df.filter(F.col(y).isNotNull())
    classes = tuple(sorted(r[0] for r in collect_small(rows.select(y).distinct())))
    sizes = {r[0]: r["count"] for r in collect_small(rows.groupBy(fold).count())}
    folds = tuple(sorted(sizes))
    moments = sorted(collect_small(vector_moments(rows, vec).select("pos", "mean", "var_pop")), key=lambda r: r["pos"])
    mean, scale = np.array([r["mean"] for r in moments]), np.sqrt([r["var_pop"] for r in moments])
    scale = np.where(scale > 0, scale, 1.0)
    k, width, n_folds = len(classes), dim + 1, len(folds) + 1
    at = lambda names, c: F.array_position(F.array(*[F.lit(v) for v in names]), F.col(c)).cast("int") - 1
    data = rows.select(F.col(vec).alias("x"), at(classes, y).alias("y"), at(folds, fold).alias("f")).persist()
    total = sum(sizes.values())
    n = np.array([total - sizes[f] for f in folds] + [total], float)
    models = [(c, j) for c in cs for j in range(n_folds)]
    left_out = np.array([j for _, j in models])
    rows_of = n[left_out]
    penalty = 1.0 / (np.array([c for c, _ in models]) * rows_of)
    mask = np.ones((k, width))
    mask[:, -1] = 0.0
    m, size = len(models), k * width

    def evaluate(w: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean penalised loss and gradient of the live models."""
        held = np.flatnonzero(live)
        flat = w[held].reshape(len(held), k, width)

        def part(batch: dict[str, np.ndarray]) -> np.ndarray:
            loss, grad = np.zeros(len(held)), np.zeros((len(held), k, width))
            for s in range(0, len(batch["y"]), 4096):  # rows x models x classes stays small
                x = np.column_stack([(batch["x"][s : s + 4096] - mean) / scale, np.ones(len(batch["y"][s : s + 4096]))])
                yy, ff = batch["y"][s : s + 4096], batch["f"][s : s + 4096]
                z = (x @ flat.reshape(-1, width).T).reshape(len(x), len(held), k)
                counts = (ff[:, None] != left_out[held][None, :]).astype(float)
                top = z.max(2)
                norm = np.log(np.exp(z - top[:, :, None]).sum(2)) + top
                own = np.take_along_axis(z, np.broadcast_to(yy[:, None, None], (len(x), len(held), 1)), 2)[:, :, 0]
                loss += ((norm - own) * counts).sum(0)
                back = np.exp(z - norm[:, :, None])
                back[np.arange(len(x)), :, yy] -= 1.0
                back *= counts[:, :, None]
                grad += (back.reshape(len(x), -1).T @ x).reshape(len(held), k, width)
            return np.concatenate([loss, grad.ravel()])

        out = distributed_sum(data, ["x", "y", "f"], part, len(held) * (1 + size))
        loss = out[: len(held)] / rows_of[held] + 0.5 * penalty[held] * ((flat * mask) ** 2).sum((1, 2))
        grad = out[len(held) :].reshape(len(held), size) / rows_of[held][:, None] + penalty[held][:, None] * (flat * mask).reshape(len(held), size)
        return loss, grad

    w = np.zeros((m, size))
    live = np.ones(m, bool)
    loss, grad = evaluate(w, live)
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    passes, scale_of = 1, np.ones(m)
    way = _directions(grad, steps, turns)
    way /= np.maximum(1.0, np.linalg.norm(way, axis=1))[:, None]
    while passes < max_passes and live.any():
        tried = w + scale_of[:, None] * way
        new_loss, new_grad = loss.copy(), grad.copy()
        new_loss[live], new_grad[live] = evaluate(tried, live)
        passes += 1
        slope = (grad * way).sum(1)
        good = live & (new_loss <= loss + 1e-4 * scale_of * slope + 1e-13)
        step, turn = np.where(good[:, None], tried - w, 0.0), np.where(good[:, None], new_grad - grad, 0.0)
        w, loss, grad = np.where(good[:, None], tried, w), np.where(good, new_loss, loss), np.where(good[:, None], new_grad, grad)
        live &= np.abs(grad).max(1) > tol
        live &= good | (scale_of > 1e-8)
        if good.any():
            steps, turns = [*steps, step][-MEMORY:], [*turns, turn][-MEMORY:]
            fresh = _directions(grad, steps, turns)
            way = np.where(good[:, None], fresh, way)
        scale_of = np.where(good, 1.0, scale_of / 2)
    data_scores = _fold_scores(data, w.reshape(len(cs), n_folds, k, width), mean, scale, len(folds), sizes, folds)
    data.unpersist()
    shape = (len(cs), n_folds)
    return LogitPath(classes, tuple(map(float, cs)), folds, w.reshape(*shape, k, width), mean, scale, np.abs(grad).max(1).reshape(shape), data_scores, passes)


def _fold_scores(data: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, n_folds: int, sizes: dict, folds: tuple) -> np.ndarray:
    """(penalty, fold) accuracy of each model on the fold that it left out."""
    n_cs, _, k, width = w.shape

    def part(batch: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([(batch["x"] - mean) / scale, np.ones(len(batch["y"]))])
        hits = np.zeros((n_cs, n_folds))
        for j in range(n_folds):
            own = batch["f"] == j
            z = np.einsum("nw,ckw->cnk", x[own], w[:, j])
            hits[:, j] = (z.argmax(2) == batch["y"][own][None, :]).sum(1)
        return hits.ravel()

    hits = distributed_sum(data, ["x", "y", "f"], part, n_cs * n_folds).reshape(n_cs, n_folds)
    return hits / np.array([sizes[f] for f in folds])[None, :]
