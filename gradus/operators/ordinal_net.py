"""A feed-forward net for ordered classes: shared layers and k - 1 sigmoid outputs for P(y > class i).

The outputs read one score against increasing cut points, so they fall with i
for every row. Gradients are sums over the rows, added up in tasks; the
parameters, a few thousand numbers, live on the driver (Adam). Batches and
dropout masks follow from row hashes, so a fit can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.operators.blocks import matrix
from gradus.operators.sums import distributed_sum


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _uniform(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """(rows, salts) numbers in [0, 1) from row hashes."""
    x = hashes.view(np.uint64)[:, None] ^ salts[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


@dataclass(frozen=True)
class Shape:
    """Sizes of the net; its parameters are one vector: weights and offsets per layer, score weights, first cut, steps of the cuts."""

    dim: int
    hidden: tuple[int, ...]
    classes: int

    @property
    def size(self) -> int:
        widths = (self.dim, *self.hidden)
        return sum(a * b + b for a, b in zip(widths, widths[1:])) + widths[-1] + self.classes - 1

    def parts(self, w: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        widths, at, layers = (self.dim, *self.hidden), 0, []
        for a, b in zip(widths, widths[1:]):
            layers.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return layers, w[at : at + widths[-1]], w[at + widths[-1] :]

    def start(self, seed: int) -> np.ndarray:
        rng, widths, out = np.random.default_rng(seed), (self.dim, *self.hidden), []
        for a, b in zip(widths, widths[1:]):
            out += [rng.normal(0.0, (2.0 / a) ** 0.5, a * b), np.zeros(b)]
        return np.concatenate([*out, rng.normal(0.0, widths[-1] ** -0.5, widths[-1]), [-0.5], np.zeros(self.classes - 2)])

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0.0, raw[1:]))])

    def cumulative(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        layers, out, raw = self.parts(w)
        for weights, offset in layers:
            x = np.maximum(x @ weights + offset, 0.0)
        return _sigmoid((x @ out)[:, None] - self.cuts(raw)[None, :])

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, masks: Sequence[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
        """Summed binary log-loss of all outputs; ``masks`` scale the units of the hidden layers."""
        layers, out, raw = self.parts(w)
        seen, gates = [x], []
        for i, (weights, offset) in enumerate(layers):
            z = seen[-1] @ weights + offset
            gate = (z > 0).astype(float)
            if masks is not None:
                gate *= masks[i]
            gates.append(gate)
            seen.append(z * gate)
        cuts = self.cuts(raw)
        logit = (seen[-1] @ out)[:, None] - cuts[None, :]
        above = (y[:, None] > np.arange(self.classes - 1)[None, :]).astype(float)
        loss = float((np.logaddexp(0.0, logit) - above * logit).sum())
        back = _sigmoid(logit) - above
        score, by_cut = back.sum(1), -back.sum(0)
        steps = np.cumsum(by_cut[::-1])[::-1]  # a step moves all cuts behind it
        tail = [seen[-1].T @ score, np.concatenate([[steps[0]], steps[1:] * _sigmoid(raw[1:])])]
        delta, grads = score[:, None] * out[None, :], []
        for i in range(len(layers) - 1, -1, -1):
            delta = delta * gates[i]
            grads = [(seen[i].T @ delta).ravel(), delta.sum(0), *grads]
            delta = delta @ layers[i][0].T
        return loss, np.concatenate([*grads, *tail])


@dataclass(frozen=True)
class OrdinalNet:
    classes: tuple
    shape: Shape
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    losses: tuple[float, ...]

    def cumulative(self, df: DataFrame, vec: str, prefix: str = "cum_") -> DataFrame:
        """Adds P(y > class i); decode with ``threshold_decode``."""
        net = self

        @F.pandas_udf("array<double>")
        def outputs(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(net.shape.cumulative(net.weights, (matrix(v) - net.mean) / net.scale)))

        out = df.withColumn("__cum", outputs(vec))
        return out.select(*df.columns, *[F.get("__cum", F.lit(i)).alias(f"{prefix}{i}") for i in range(self.shape.classes - 1)])


def fit_ordinal_net(
    df: DataFrame, id_col: str, vec: str, y: str, dim: int, hidden: Sequence[int] = (16,), epochs: int = 60, batches: int = 1, rate: float = 0.03,
    dropout: float = 0.0, l2: float = 0.0, seed: int = 42,
) -> OrdinalNet:
    """Adam steps on the mean loss; with ``batches`` over one, each epoch passes that many disjoint parts of the rows, dealt by hash.

    ``losses`` has the mean loss before each step. Vectors must be complete;
    rows without a class are left out. Two classes give one output.
    """
    from gradus.operators.aggregates import vector_moments

    rows = df.filter(F.col(y).isNotNull())
    classes = tuple(sorted(r[0] for r in collect_small(rows.select(y).distinct())))
    moments = sorted(collect_small(vector_moments(rows, vec).select("pos", "mean", "var_pop")), key=lambda r: r["pos"])
    mean = np.array([r["mean"] for r in moments])
    scale = np.sqrt([r["var_pop"] for r in moments])
    scale = np.where(scale > 0, scale, 1.0)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)).cast("int") - 1
    hashed = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    data = rows.select(F.col(vec).alias("x"), code.alias("y"), hashed.alias("h"), F.pmod(hashed, F.lit(batches)).alias("part")).persist()
    shape = Shape(dim, tuple(hidden), max(len(classes), 2))
    w = shape.start(seed)
    first, second, losses, step = np.zeros_like(w), np.zeros_like(w), [], 0
    for epoch in range(epochs):
        for b in range(batches):
            step += 1

            def part(batch: dict[str, np.ndarray], w=w, epoch=epoch, b=b) -> np.ndarray:
                x = (batch["x"] - mean) / scale
                masks = None
                if dropout:
                    salts = np.random.default_rng([seed, epoch, b]).integers(0, 2**63, sum(shape.hidden)).astype(np.uint64)
                    kept = (_uniform(batch["h"], salts) >= dropout) / (1.0 - dropout)
                    masks = np.split(kept, np.cumsum(shape.hidden)[:-1], axis=1)
                loss, grad = shape.loss_and_gradient(w, x, batch["y"], masks)
                return np.concatenate([[len(x), loss], grad])

            here = data.filter(F.col("part") == b) if batches > 1 else data
            out = distributed_sum(here, ["x", "y", "h"], part, 2 + shape.size)
            if not out[0]:
                continue
            losses.append(out[1] / out[0])
            grad = out[2:] / out[0] + l2 * w
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    data.unpersist()
    return OrdinalNet(classes, shape, w, mean, scale, tuple(losses))
