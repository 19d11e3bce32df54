"""Clusterings over a vector column and the features derived from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.functions import arrays
from gradus.operators.features import BlockStats, fit_block
from gradus.operators.projection import valid_vector_rows, vector_is_valid


def as_features(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    return df.select(*keep, array_to_vector(vec).alias("features"))


@dataclass(frozen=True)
class KMeansFit:
    centers: tuple[tuple[float, ...], ...]
    inertia: float


def fit_kmeans(df: DataFrame, vec: str, k: int, restarts: int = 1, seed: int = 42, max_iter: int = 20) -> KMeansFit:
    """Parallel k-means; of several seeded restarts the one with the least inertia."""
    from pyspark.ml.clustering import KMeans

    data = as_features(df, vec).persist()
    best = None
    for r in range(restarts):
        try:
            model = KMeans(k=k, seed=seed + r, maxIter=max_iter).fit(data)
        except Py4JJavaError as e:
            # with many equal rows the parallel initialisation can find fewer than k starts, which the learner rejects
            if "ArrayIndexOutOfBounds" not in str(e):
                raise
            data.unpersist()
            return lloyd(df, vec, _distinct_starts(df, vec, k), max_iter)
        cost = float(model.summary.trainingCost)
        if best is None or cost < best.inertia:
            best = KMeansFit(tuple(tuple(map(float, c)) for c in model.clusterCenters()), cost)
    data.unpersist()
    return best


def _distinct_starts(df: DataFrame, vec: str, k: int) -> list[list[float]]:
    """Up to k different rows; the last one is repeated when there are fewer."""
    found = [r[0] for r in df.select(vec).distinct().orderBy(F.xxhash64(vec)).limit(k).collect()]
    return found + [found[-1]] * (k - len(found))


def lloyd(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], max_iter: int = 20) -> KMeansFit:
    """Plain k-means rounds: one assignment pass and one mean per (cluster, position) each; empty clusters stay."""
    cached = df.select(vec).persist()
    now = [list(map(float, c)) for c in centers]
    for _ in range(max_iter):
        placed = assign_nearest(cached, vec, now)
        sums = placed.select("cluster", F.posexplode(vec).alias("pos", "x")).groupBy("cluster", "pos").agg(
            F.sum("x").alias("s"), F.count("*").alias("n")
        )
        moved = [list(c) for c in now]
        for c, rows in _by_cluster(collect_small(sums, 1_000_000)).items():
            moved[c] = [r["s"] / r["n"] for r in rows]
        settled = all(abs(a - b) < 1e-9 for x, y in zip(now, moved) for a, b in zip(x, y))
        now = moved
        if settled:
            break
    cost = assign_nearest(cached, vec, now, dist="d").agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    cached.unpersist()
    return KMeansFit(tuple(map(tuple, now)), float(cost or 0.0))


def assign_nearest(df: DataFrame, vec: str, centers: Sequence[Sequence[float]], name: str = "cluster", dist: str | None = None) -> DataFrame:
    """Index of the nearest centre (first on ties) as an array expression."""
    out = df.withColumn("__d", arrays.center_distances(F.col(vec), centers))
    out = out.withColumn(name, arrays.nearest_index(F.col("__d")))
    if dist:
        out = out.withColumn(dist, arrays.min_distance(F.col("__d")))
    return out.drop("__d")


def kmeans(df: DataFrame, vec: str, k: int, restarts: int = 3, seed: int = 42) -> DataFrame:
    return assign_nearest(df, vec, fit_kmeans(df, vec, k, restarts, seed).centers, dist="center_distance")


def elbow_scan(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette_squared) per number of clusters."""
    from gradus.operators.quality import silhouette_squared

    cached = df.select(vec).persist()
    cached.count()

    def one(k: int):
        fit = fit_kmeans(cached, vec, k, seed=seed)
        placed = assign_nearest(cached, vec, fit.centers)
        return k, fit.inertia, silhouette_squared(placed, vec, "cluster").first()[0]

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(one, ks))
    cached.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette_squared double")


# --- principal components ---------------------------------------------------

@dataclass(frozen=True)
class PcaFit:
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    ratio: tuple[float, ...]


def fit_pca(df: DataFrame, vec: str, k: int) -> PcaFit:
    """Mean, principal directions and explained variance shares."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.stat import Summarizer

    data = as_features(df, vec).persist()
    mean = data.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    data.unpersist()
    pc = model.pc.toArray()
    return PcaFit(tuple(map(float, mean)), tuple(tuple(map(float, pc[:, i])) for i in range(k)), tuple(map(float, model.explainedVariance)))


def dot(vec: Column, weights: Sequence[float]) -> Column:
    """Weighted sum of the elements; short vectors become plain arithmetic."""
    if len(weights) <= 32:
        total = F.get(vec, F.lit(0)) * F.lit(float(weights[0]))
        for i, w in enumerate(weights[1:], 1):
            total = total + F.get(vec, F.lit(i)) * F.lit(float(w))
        return total
    fixed = arrays.vector_literal(weights)
    return F.aggregate(F.zip_with(vec, fixed, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)


def apply_pca(df: DataFrame, fit: PcaFit, vec: str, name: str = "pc") -> DataFrame:
    """Projection of the centred rows. The fit already holds the mean's projection, so
    centring is one subtraction per component. The vectorised product keeps a wide
    projection cheap."""
    shift = np.asarray(fit.components) @ np.asarray(fit.mean)
    return df.withColumn(name, linear_map(df, vec, np.asarray(fit.components), -shift))


def linear_map(df: DataFrame, vec: str, matrix: np.ndarray, offset: np.ndarray) -> Column:
    """matrix @ x + offset per row on Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast((matrix, offset))

    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        m, b = shared.value
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ m.T + b))

    return product(vec)


def pca_project(df: DataFrame, vec: str, k: int, name: str = "pc") -> DataFrame:
    return apply_pca(df, fit_pca(df, vec, k), vec, name)


def kmeans_on_pca(df: DataFrame, vec: str, k: int, components: int, seed: int = 42) -> DataFrame:
    projected = pca_project(df, vec, components).persist()
    return kmeans(projected, "pc", k, restarts=1, seed=seed)


# --- other algorithms -------------------------------------------------------

def hierarchical_clusters(df: DataFrame, vec: str, k: int, keep: Sequence[str], summaries: int | None = None) -> DataFrame:
    """Agglomerative clustering by Ward's criterion to k clusters; exact up to ``summaries`` distinct rows, beyond that over as many summaries."""
    from gradus.operators.ward import SUMMARIES, fit_ward

    return fit_ward(df, vec, summaries or SUMMARIES).apply(df.select(*keep, vec), vec, k)


def bisecting_clusters(df: DataFrame, vec: str, k: int, keep: Sequence[str], seed: int = 42) -> DataFrame:
    """Divisive (bisecting) clustering to k leaves."""
    from pyspark.ml.clustering import BisectingKMeans

    data = as_features(df, vec, *keep, vec).persist()
    model = BisectingKMeans(k=k, seed=seed).fit(data)
    return model.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def gaussian_mixture(df: DataFrame, vec: str, k: int, keep: Sequence[str], seed: int = 42, max_iter: int = 30) -> DataFrame:
    """Soft assignment: cluster and its responsibilities."""
    from pyspark.ml.clustering import GaussianMixture

    data = as_features(df, vec, *keep, vec).persist()
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(data)
    out = model.transform(data).withColumnRenamed("prediction", "cluster")
    return out.withColumn("responsibility", vector_to_array("probability")).drop("features", "probability")


def spectral_clusters(df: DataFrame, id_col: str, vec: str, k: int, neighbours: int = 10, max_iter: int = 20) -> DataFrame:
    """Power-iteration clustering of the nearest-neighbour graph."""
    from pyspark.ml.clustering import PowerIterationClustering

    from gradus.operators.neighbors import knn_join

    near = knn_join(df, df, id_col, vec, neighbours)
    edges = near.select(
        F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"),
        F.exp(-F.col("dist") * F.col("dist")).alias("weight"),
    ).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    model = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", weightCol="weight")
    return model.assignClusters(edges).select(F.col("id").alias(id_col), "cluster")


def minibatch_kmeans(df: DataFrame, id_col: str, vec: str, k: int, rounds: int = 10, batch: int = 1024, seed: int = 42) -> DataFrame:
    """Centres moved by the means of small hash samples with a count-based step (Sculley 2010), then one assignment pass."""
    from gradus.operators.outliers import hash_sample

    cached = df.persist()
    start = hash_sample(cached.select(id_col, vec), id_col, k, seed)
    centers = np.asarray([r[0] for r in start.select(vec).collect()], dtype=float)
    seen = np.zeros(len(centers))
    for r in range(rounds):
        sample = hash_sample(cached.select(id_col, vec), id_col, batch, seed + 1 + r)
        placed = assign_nearest(sample, vec, centers)
        moments = placed.select("cluster", F.posexplode(vec).alias("pos", "x")).groupBy("cluster", "pos").agg(
            F.sum("x").alias("s"), F.count("*").alias("n")
        )
        for c, rows in _by_cluster(collect_small(moments)).items():
            n = rows[0]["n"]
            mean = np.asarray([row["s"] / n for row in rows])
            seen[c] += n
            centers[c] += (n / seen[c]) * (mean - centers[c])
    return assign_nearest(cached, vec, centers)


def _by_cluster(rows):
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["pos"])):
        out.setdefault(r["cluster"], []).append(r)
    return out


def cluster_benchmark(
    df: DataFrame, id_col: str, vec: str, algorithms: dict[str, Callable[[DataFrame], DataFrame]], exact_silhouette: bool = True
) -> DataFrame:
    """One metric row per algorithm; a result with fewer than two clusters is skipped.

    The exact silhouettes of results that place every row come from one pass over the distances.
    """
    from gradus.operators import quality

    found, rows = [], []
    for name, run in algorithms.items():
        labelled = run(df).select(id_col, vec, "cluster").filter("cluster >= 0").persist()
        k = labelled.select("cluster").distinct().count()
        if k > 1:
            found.append((name, k, labelled))
        else:
            labelled.unpersist()
    shared = _shared_silhouettes(df, id_col, vec, found) if exact_silhouette else {}
    for name, k, labelled in found:
        if name in shared:
            sil = shared[name]
        elif exact_silhouette:
            sil = quality.silhouette(labelled, id_col, vec, "cluster").first()["silhouette"]
        else:
            sil = quality.silhouette_squared(labelled, vec, "cluster").first()[0]
        ch = quality.calinski_harabasz(labelled, vec, "cluster").first()["calinski_harabasz"]
        db = quality.davies_bouldin(labelled, vec, "cluster").first()["davies_bouldin"]
        rows.append((name, k, sil, ch, db))
        labelled.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "algorithm string, n_clusters int, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


def _shared_silhouettes(df: DataFrame, id_col: str, vec: str, found: list[tuple[str, int, DataFrame]]) -> dict[str, float | None]:
    """Silhouettes of the results with a cluster for every row, if there are several such and ids tell rows apart."""
    from gradus.operators import quality

    n, ids = df.agg(F.count("*"), F.count_distinct(id_col)).first()
    whole = [(name, labelled) for name, _, labelled in found if labelled.count() == n]
    if len(whole) < 2 or ids < n:
        return {}
    joined, labels = whole[0][1].select(id_col, vec, F.col("cluster").alias("__0")), ["__0"]
    for i, (_, labelled) in enumerate(whole[1:], 1):
        joined = joined.join(labelled.select(id_col, F.col("cluster").alias(f"__{i}")), id_col)
        labels.append(f"__{i}")
    joined = joined.persist()
    values = quality.silhouettes(joined, id_col, vec, labels)
    joined.unpersist()
    return {name: value for (name, _), value in zip(whole, values)}


# --- cluster features -------------------------------------------------------

@dataclass(frozen=True)
class ClusterFeatures:
    """Everything the soft features need: block scaling, centres, defaults for rows without a vector."""

    block: BlockStats
    centers: tuple[tuple[float, ...], ...]
    defaults: tuple[float, ...]
    rule: str


def _scaled(vec: str, block: BlockStats) -> Column:
    return arrays.scale_array(arrays.fill_array(F.col(vec), block.mean), block.scaled_mean, block.scale)


def fit_cluster_features(
    df: DataFrame, vec: str, dim: int, k: int, restarts: int = 3, seed: int = 42, rule: str = "first"
) -> ClusterFeatures:
    """Impute, scale and cluster the valid rows of the given table (zeros already null).

    Pass training rows only, or the union of training and scoring rows for the
    transductive variant.
    """
    valid = valid_vector_rows(df.select(vec), vec, rule).persist()
    block = fit_block(valid, vec, dim)
    scaled = valid.select(_scaled(vec, block).alias("v")).persist()
    if not scaled.head(1):
        raise ValueError("no valid rows for clustering")
    fit = fit_kmeans(scaled, "v", k, restarts, seed)
    soft = scaled.select(arrays.center_distances(F.col("v"), fit.centers).alias("d")).select(
        arrays.distance_softmax(F.col("d")).alias("p"), arrays.min_distance(F.col("d")).alias("m")
    )
    row = soft.agg(*[F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(k)], F.avg("m").alias("m")).first()
    scaled.unpersist()
    valid.unpersist()
    return ClusterFeatures(block, fit.centers, tuple(row[f"p{i}"] for i in range(k)) + (row["m"],), rule)


def apply_cluster_probabilities(df: DataFrame, fit: ClusterFeatures, vec: str, prefix: str = "job_cluster") -> DataFrame:
    """``<prefix>_prob_i`` and ``<prefix>_min_dist``; rows without a vector get the fitted means."""
    k = len(fit.centers)
    staged = df.withColumn("__ok", vector_is_valid(vec, fit.rule))
    staged = staged.withColumn("__d", arrays.center_distances(_scaled(vec, fit.block), fit.centers))
    staged = staged.withColumn("__p", arrays.distance_softmax(F.col("__d")))
    cols = [
        F.when(F.col("__ok"), F.get("__p", F.lit(i))).otherwise(F.lit(fit.defaults[i])).alias(f"{prefix}_prob_{i}")
        for i in range(k)
    ]
    cols.append(F.when(F.col("__ok"), F.array_min("__d")).otherwise(F.lit(fit.defaults[k])).alias(f"{prefix}_min_dist"))
    return staged.select(*df.columns, *cols)


def apply_cluster_onehot(df: DataFrame, fit: ClusterFeatures, vec: str, prefix: str = "job_cluster") -> DataFrame:
    """``<prefix>_i`` one-hot of the nearest centre; rows without a vector go to cluster 0."""
    d = arrays.center_distances(_scaled(vec, fit.block), fit.centers)
    place = F.when(vector_is_valid(vec, fit.rule), arrays.nearest_index(d)).otherwise(0)
    staged = df.withColumn("__c", place)
    cols = [(F.col("__c") == i).cast("double").alias(f"{prefix}_{i}") for i in range(len(fit.centers))]
    return staged.select(*df.columns, *cols)
