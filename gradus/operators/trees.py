"""Histogram trees grown level by level: softmax boosting with leaf penalties, and bagged forests that know their left-out rows.

Features are cut into at most 256 bins once. Per level, tasks add up channels
(gradient and curvature, or class weights) per (tree, node, feature, bin); the
sums meet in one shuffle, and running sums over the bins give the gain of
every split there. The driver receives one best split per node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.operators.sums import column_array
from gradus.session import checkpointed

#: numbers that one task may hold for the histograms of a level; trees are grown in groups that fit
HISTOGRAM_NUMBERS = 8_000_000
#: parallel random numbers from one 64-bit row hash
_MIX = 0x9E3779B97F4A7C15


def bin_edges(df: DataFrame, vec: str, dim: int, bins: int) -> np.ndarray:
    """(dim, bins - 2) edges at even quantiles of a sketch; a value goes left of an edge if it isn't above it. The last bin is for nulls."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    row = df.agg(*[F.percentile_approx(F.get(vec, F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(dim)]).first()
    return np.array([row[i] if row[i] is not None else [0.0] * (bins - 2) for i in range(dim)], dtype=float)


def bin_codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of every element; missing ones are in a bin of their own behind all others."""
    coded = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    return np.where(np.isnan(x), edges.shape[1] + 1, coded).astype(np.int16)


def binned(df: DataFrame, id_col: str, vec: str, edges: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``hash`` (of the id) and ``bins``, the bin of every feature."""
    kept = df.select(*keep, F.xxhash64(F.lit(31), F.col(id_col).cast("string")).alias("hash"), F.col(vec).cast("array<double>").alias("__v"))
    dim = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = column_array(batch.column(batch.num_columns - 1)) if batch.num_rows else np.zeros((0, dim))
            coded = bin_codes(x, edges)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(coded.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*batch.schema.names[:-1], "bins"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", bins array<smallint>"
    return kept.mapInArrow(run, schema)


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2 i + 1 and 2 i + 2; ``feature`` is -1 at a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: dict[int, np.ndarray] = field(default_factory=dict)  # channels of a node

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(size, -1, np.int32), np.zeros(size, np.int16)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node of each row so far."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(feature, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def leaf_table(self, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """Per node ``of`` its channels."""
        out = np.zeros((len(self.feature), width))
        for node, channels in self.value.items():
            out[node] = of(channels)
        return out


#: batch of columns -> (rows, trees, channels)
Channels = Callable[[dict[str, np.ndarray]], np.ndarray]
#: running and remaining channel sums -> gain, null where the split isn't allowed
Gain = Callable[[list[Column], list[Column]], Column]


def _level_sums(rows: DataFrame, cols: Sequence[str], trees: Sequence[Tree], open_nodes: list[dict[int, int]], channels: Channels, n_channels: int, dim: int, bins: int) -> DataFrame:
    """(tree, node, feature, bin, c0, c1, ...): the channel sums of every task, for the open nodes of every tree."""
    names = [*cols, "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(o) * dim * bins, n_channels)) for o in open_nodes]
        for batch in batches:
            if not batch.num_rows:
                continue
            data = {c: column_array(batch.column(i)) for i, c in enumerate(names)}
            coded, values = data["bins"].astype(np.int64), channels(data)
            for t, (tree, places) in enumerate(zip(trees, open_nodes)):
                if not places:
                    continue
                slot = np.full(len(tree.feature), -1, np.int64)
                slot[list(places)] = list(places.values())
                at = slot[tree.nodes(coded)]
                used = (at >= 0) & (values[:, t] != 0).any(1)
                cell = ((at[used][:, None] * dim + np.arange(dim)[None, :]) * bins + coded[used]).ravel()
                for c in range(n_channels):
                    sums[t][:, c] += np.bincount(cell, np.repeat(values[used, t, c], dim), len(sums[t]))
        for t, places in enumerate(open_nodes):
            if not places:
                continue
            full = np.flatnonzero((sums[t] != 0).any(1))
            node = np.array(list(places))[full // (dim * bins)]
            columns = [np.full(len(full), t, np.int32), node.astype(np.int32), (full // bins % dim).astype(np.int32), (full % bins).astype(np.int32), *sums[t][full].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "feature", "bin", *[f"c{c}" for c in range(n_channels)]])

    schema = "tree int, node int, feature int, bin int, " + ", ".join(f"c{c} double" for c in range(n_channels))
    return rows.select(*names).mapInArrow(run, schema)


def _best_splits(sums: DataFrame, n_channels: int, gain: Gain, allowed: Column) -> DataFrame:
    """(tree, node, all, best): the channel sums of each node and its best split, null if none is allowed."""
    cs = [f"c{c}" for c in range(n_channels)]
    total = sums.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in cs])
    own = Window.partitionBy("tree", "node", "feature")  # at most a row per bin
    running = own.orderBy("bin")
    cut = total.select(
        "tree", "node", "feature", "bin", *[F.sum(c).over(running).alias(f"l{c}") for c in cs], *[F.sum(c).over(own).alias(f"a{c}") for c in cs],
        F.lead("bin").over(running).isNotNull().alias("inner"),
    )
    left, every = [F.col(f"l{c}") for c in cs], [F.col(f"a{c}") for c in cs]
    worth = F.when(F.col("inner") & allowed, gain(left, [a - b for a, b in zip(every, left)]))
    cut = cut.withColumn("gain", worth)
    split = F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.array(*left).alias("left")))
    return cut.groupBy("tree", "node").agg(F.max(split).alias("best"), F.max_by(F.array(*every), -F.col("feature")).alias("all"))


def grow(
    rows: DataFrame, cols: Sequence[str], n_trees: int, depth: int, channels: Channels, n_channels: int, dim: int, bins: int,
    gain: Gain, least_gain: float = 0.0, allowed: Column | None = None,
) -> list[Tree]:
    """Trees over the ``bins`` of ``rows``; ``channels`` weighs every row for every tree. One job per level."""
    trees = [Tree(depth) for _ in range(n_trees)]
    open_nodes: list[dict[int, int]] = [{0: 0} for _ in trees]
    for level in range(max(depth, 1)):
        start, found = 0, []
        while start < n_trees:  # as many trees at once as one task's histograms may have
            stop, numbers = start, 0
            while stop < n_trees and (stop == start or numbers + len(open_nodes[stop]) * dim * bins * n_channels <= HISTOGRAM_NUMBERS):
                numbers += len(open_nodes[stop]) * dim * bins * n_channels
                stop += 1
            part = slice(start, stop)
            if any(open_nodes[part]):
                sums = _level_sums(rows, cols, trees[part], open_nodes[part], (lambda d, p=part: channels(d)[:, p]), n_channels, dim, bins)
                sums = sums.withColumn("tree", F.col("tree") + start)
                best = _best_splits(sums, n_channels, gain, F.lit(True) if allowed is None else allowed)
                found += collect_small(best, 1_000_000)  # a row per open node
            start = stop
        opened: list[dict[int, int]] = [{} for _ in trees]
        for row in found:
            tree, node, every = trees[row["tree"]], row["node"], np.array(row["all"])
            tree.value.setdefault(node, every)
            best = row["best"]
            if depth and best is not None and best["gain"] > least_gain:
                left = np.array(best["left"])
                tree.feature[node], tree.bin[node] = -best["f"], -best["b"]
                tree.value[2 * node + 1], tree.value[2 * node + 2] = left, every - left
                opened[row["tree"]].update({2 * node + 1: 0, 2 * node + 2: 0})
        open_nodes = [{node: i for i, node in enumerate(sorted(o))} for o in opened]
        if not any(open_nodes) or level == depth - 1:
            break
    return trees


# --- softmax boosting -------------------------------------------------------


def _soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class BoostedClasses:
    """``rounds``: per round one tree per class with its leaf steps; ``losses``: the log-loss before every round and after the last."""

    classes: tuple
    edges: np.ndarray
    base: np.ndarray
    rounds: tuple[tuple[tuple[Tree, np.ndarray], ...], ...]
    losses: tuple[float, ...]

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for k, (tree, steps) in enumerate(trees):
                out[:, k] += steps[tree.nodes(bins)]
        return out

    def transform(self, df: DataFrame, vec: str) -> DataFrame:
        """``df`` with ``probability`` (an array in the order of ``classes``) and ``prediction``, the smallest class with the largest."""
        edges, margins = self.edges, self.margins
        classes = self.classes

        @F.pandas_udf("array<double>")
        def probabilities(v):
            import pandas as pd

            if not len(v):
                return pd.Series([], dtype=object)
            x = np.array([[np.nan if e is None else e for e in row] for row in v], dtype=float)
            return pd.Series(list(softmax(margins(bin_codes(x, edges)))))

        scored = df.withColumn("probability", probabilities(vec))
        return scored.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("probability", F.array_max("probability")).cast("int")))


def fit_boosted_classes(
    df: DataFrame, id_col: str, vec: str, y: str, dim: int, rounds: int = 800, depth: int = 10, rate: float = 0.005, subsample: float = 0.8, columns: float = 0.7,
    l1: float = 0.0, l2: float = 1.0, min_gain: float = 0.0, min_weight: float = 1.0, bins: int = 64, seed: int = 42,
) -> BoostedClasses:
    """One boosting machine over all classes: softmax gradients and curvatures per round, one tree per class.

    A leaf's step is -soft(G, l1) / (H + l2) times ``rate``; a split must gain
    more than ``min_gain`` and leave ``min_weight`` of curvature on both sides.
    Rows are drawn per round by the hash of their ids, features per round by
    the seed; results don't depend on the partitioning but for the rounding of
    sums. Rows without a class are left out, a null feature goes right.
    """
    rows = df.filter(F.col(y).isNotNull())
    counts = {r[0]: r["count"] for r in collect_small(rows.groupBy(y).count())}
    classes = tuple(sorted(counts))
    k, n = len(classes), sum(counts.values())
    edges = bin_edges(rows, vec, dim, bins)
    base = np.log([counts[c] / n for c in classes])
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)).cast("int") - 1
    state = binned(rows.withColumn("__code", code), id_col, vec, edges, ["__code"]).withColumn("margin", F.array(*[F.lit(float(b)) for b in base]))
    state = checkpointed(state)
    grown, losses = [], []

    def score(g: Column, h: Column) -> Column:
        shrunk = F.greatest(F.abs(g) - l1, F.lit(0.0))
        return shrunk * shrunk / (h + l2)

    def gain(left: list[Column], right: list[Column]) -> Column:
        (gl, hl), (gr, hr) = left, right
        return F.when((hl >= min_weight) & (hr >= min_weight), 0.5 * (score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr)))

    for r in range(rounds):
        salt = np.uint64((seed * 1_000_003 + r) * _MIX % 2**64)

        def channels(data: dict[str, np.ndarray], salt=salt) -> np.ndarray:
            p = softmax(data["margin"])
            g = p.copy()
            g[np.arange(len(p)), data["__code"]] -= 1.0
            mixed = (data["hash"].view(np.uint64) ^ salt) * np.uint64(_MIX)
            drawn = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)).astype(float) / 2.0**53 < subsample
            return np.stack([g, p * (1 - p)], 2) * drawn[:, None, None]

        take = max(1, round(columns * dim))
        picked = np.random.default_rng([seed, r]).permutation(dim)[:take].tolist()
        trees = grow(state, ["__code", "margin", "hash"], k, depth, channels, 2, dim, bins, gain, min_gain, F.col("feature").isin(picked) if take < dim else None)
        stepped = tuple((t, t.leaf_table(lambda c: -rate * _soft(c[:1], l1) / (c[1] + l2), 1)[:, 0]) for t in trees)
        grown.append(stepped)

        def update(batches: Iterator[pa.RecordBatch], stepped=stepped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    margin = column_array(batch.column("margin")).copy()
                    coded = column_array(batch.column("bins"))
                    for c, (tree, steps) in enumerate(stepped):
                        margin[:, c] += steps[tree.nodes(coded)]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(margin) + 1, dtype=np.int32) * k), pa.array(margin.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("__code"), batch.column("hash"), batch.column("bins"), flat], names=["__code", "hash", "bins", "margin"])

        losses.append(_log_loss(state, n))
        state = checkpointed(state.mapInArrow(update, "__code int, hash long, bins array<smallint>, margin array<double>"))
    losses.append(_log_loss(state, n))
    return BoostedClasses(classes, edges, base, tuple(grown), tuple(losses))


def _log_loss(state: DataFrame, n: int) -> float:
    top = F.array_max("margin")
    norm = F.aggregate("margin", F.lit(0.0), lambda s, m: s + F.exp(m - top))
    return float(state.agg(F.sum(F.log(norm) + top - F.get("margin", F.col("__code")))).first()[0] or 0.0) / max(n, 1)


# --- bagged forest ----------------------------------------------------------


def bootstrap_weights(hashes: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows, trees) Poisson weights with mean one: how often a bootstrap of each tree drew the row; from the row's hash alone."""
    salts = np.array([(seed * 1_000_003 + t + 1) * _MIX % 2**64 for t in range(trees)], np.uint64)
    x = hashes.view(np.uint64)[:, None] ^ salts[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_POISSON, u.ravel(), "right").reshape(u.shape)


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(range(1, i + 1)) for i in range(16)])


@dataclass(frozen=True)
class BaggedForest:
    """Trees with the class weights of their nodes; ``rows`` has what each row needs for its left-out votes."""

    classes: tuple
    edges: np.ndarray
    trees: tuple[Tree, ...]
    seed: int
    rows: DataFrame
    id_col: str

    def left_out_votes(self) -> DataFrame:
        """(id, label, n_out, votes, prediction): the mean class shares over the trees that didn't draw the row; no votes if all did."""
        k, seed, count, id_col = len(self.classes), self.seed, len(self.trees), self.id_col
        shares = [(t, t.leaf_table(lambda c: c / max(c.sum(), 1e-300), k)) for t in self.trees]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                coded = column_array(batch.column("bins"))
                out = bootstrap_weights(column_array(batch.column("hash")), count, seed) == 0
                votes = np.zeros((len(coded), k))
                for t, (tree, table) in enumerate(shares):
                    votes += table[tree.nodes(coded)] * out[:, t : t + 1]
                n = out.sum(1)
                votes /= np.maximum(n, 1)[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1, dtype=np.int32) * k), pa.array(votes.ravel()))
                top = pa.array(votes.argmax(1).astype(np.int32), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("__code"), pa.array(n.astype(np.int32)), flat, top], names=[id_col, "__code", "n_out", "votes", "__top"])

        kind = self.rows.schema[self.id_col].dataType.simpleString()
        found = self.rows.select(self.id_col, "__code", "hash", "bins").mapInArrow(run, f"`{self.id_col}` {kind}, __code int, n_out int, votes array<double>, __top int")
        names = F.array(*[F.lit(c) for c in self.classes])
        return found.select(self.id_col, F.get(names, F.col("__code")).alias("label"), "n_out", "votes", F.get(names, F.col("__top")).alias("prediction"))


def fit_bagged_forest(
    df: DataFrame, id_col: str, vec: str, y: str, dim: int, trees: int = 50, depth: int = 5, min_leaf: int = 1, bins: int = 32, seed: int = 42
) -> BaggedForest:
    """A forest by Gini gain on Poisson bootstrap weights from row hashes, with the root of the features tried in every node."""
    rows = df.filter(F.col(y).isNotNull())
    classes = tuple(sorted(r[0] for r in collect_small(rows.select(y).distinct())))
    k = len(classes)
    edges = bin_edges(rows, vec, dim, bins)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)).cast("int") - 1
    state = checkpointed(binned(rows.withColumn("__code", code), id_col, vec, edges, [id_col, "__code"]))

    def channels(data: dict[str, np.ndarray]) -> np.ndarray:
        weights = bootstrap_weights(data["hash"], trees, seed)
        out = np.zeros((*weights.shape, k))
        out[np.arange(len(weights)), :, data["__code"]] = weights
        return out

    def gain(left: list[Column], right: list[Column]) -> Column:
        purity = lambda side: sum((c * c for c in side), F.lit(0.0)) / F.nullif(sum(side, F.lit(0.0)), F.lit(0.0))
        whole = [a + b for a, b in zip(left, right)]
        enough = (sum(left, F.lit(0.0)) >= min_leaf) & (sum(right, F.lit(0.0)) >= min_leaf)
        return F.when(enough, purity(left) + purity(right) - purity(whole))

    share = max(1, round(dim**0.5)) / dim
    tried = F.pmod(F.xxhash64(F.lit(seed), "tree", "node", "feature"), F.lit(1 << 20)) < int(share * (1 << 20))
    grown = grow(state, ["__code", "hash"], trees, depth, channels, k, dim, bins, gain, 1e-9, tried)
    return BaggedForest(classes, edges, tuple(grown), seed, state, id_col)
