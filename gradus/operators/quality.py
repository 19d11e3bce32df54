"""Cluster quality: centroids, Calinski-Harabasz, Davies-Bouldin, silhouettes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small, join_dimension
from gradus.functions import arrays
from gradus.operators.blocks import row_slices

MAX_CLUSTERS = 10_000


def centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, n, center): position means re-packed, one row per cluster."""
    long = df.select(label, F.posexplode(vec).alias("pos", "x"))
    means = long.groupBy(label, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    packed = means.groupBy(label).agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("parts"), F.max("n").alias("n")
    )
    return packed.select(label, "n", F.transform("parts", lambda s: s["m"]).alias("center"))


def with_centroid_distance(df: DataFrame, vec: str, label: str, name: str) -> DataFrame:
    """Distance of each row to the centre of its own cluster; null for a row without one."""
    centers = centroids(df, vec, label).select(label, "center")
    joined = join_dimension(df, centers, label, "left", MAX_CLUSTERS)
    return joined.withColumn(name, arrays.l2_norm(F.zip_with(vec, "center", lambda x, c: x - c))).drop("center")


def cluster_stats(df: DataFrame, vec: str, label: str):
    """Per cluster: n, centre, sum of squared distances to it, mean distance to it (clusters x p numbers)."""
    df = df.filter(F.col(label).isNotNull())
    placed = with_centroid_distance(df, vec, label, "__d")
    rows = collect_small(
        placed.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("ss"), F.avg("__d").alias("s")),
        MAX_CLUSTERS,
    )
    centers = {r[label]: np.asarray(r["center"]) for r in collect_small(centroids(df, vec, label), MAX_CLUSTERS)}
    order = sorted(r[label] for r in rows)
    by = {r[label]: r for r in rows}
    return order, by, centers


def calinski_harabasz(df: DataFrame, vec: str, label: str) -> DataFrame:
    """[between / (k - 1)] / [within / (n - k)]; null for a single cluster."""
    order, by, centers = cluster_stats(df, vec, label)
    n, k = sum(by[c]["n"] for c in order), len(order)
    value = None
    if 1 < k < n:
        mean = sum(by[c]["n"] * centers[c] for c in order) / n
        between = sum(by[c]["n"] * float(((centers[c] - mean) ** 2).sum()) for c in order)
        within = sum(by[c]["ss"] for c in order)
        value = (between / (k - 1)) / (within / (n - k)) if within > 0 else 1.0
    return df.sparkSession.createDataFrame([(k, value)], "k int, calinski_harabasz double")


def davies_bouldin(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / distance of centres."""
    order, by, centers = cluster_stats(df, vec, label)
    k = len(order)
    value = None
    if k > 1:
        where, spread = np.stack([centers[c] for c in order]), np.array([by[c]["s"] for c in order])
        worst = np.zeros(k)
        for rows in row_slices(k, k):
            gap = np.sqrt(np.maximum(((where[rows, None, :] - where[None, :, :]) ** 2).sum(2), 0.0))
            ratio = np.divide(spread[rows, None] + spread[None, :], gap, out=np.zeros_like(gap), where=gap > 0)
            worst[rows] = ratio.max(1)
        value = float(worst.sum() / k)
    return df.sparkSession.createDataFrame([(k, value)], "k int, davies_bouldin double")


def _distance_sums(points: DataFrame, labels: list[str], block_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """(rep, k, other, total): the summed distances of a point to the rows of each cluster ``other`` of the ``k``-th label.

    ``points`` has rep, vec, w and the labels. All labels share the distances.
    """
    import pandas as pd

    from gradus.operators import blocks as B

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, x = B.matrix(left["vec"]), B.matrix(right["vec"])
        w = right["w"].to_numpy(dtype=float)
        groups, which = zip(*(np.unique(right[c].to_numpy(), return_inverse=True) for c in labels))
        starts = np.cumsum([0, *map(len, groups)])
        onehot = np.zeros((len(x), starts[-1]))
        for first, own in zip(starts, which):
            onehot[np.arange(len(x)), first + own] = w
        tiles = B.Tiles(q, x)
        total = np.zeros((len(q), starts[-1]))
        for s in B.row_slices(len(q), 1, B.TILE_ROWS):
            for at in range(0, len(x), B.TILE_COLS):
                d = tiles.squared(s, slice(at, at + B.TILE_COLS))
                r, c = np.divmod(np.flatnonzero(d <= 1e6 * tiles.slack), d.shape[1])  # tiny distances lose digits in the fast form
                np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                if len(r):
                    d[r, c] = B.pair_distances(q[s], r, x, c + at)
                total[s] += d @ onehot[at : at + B.TILE_COLS]
        k = np.repeat(np.arange(len(labels)), [len(g) for g in groups])
        return pd.DataFrame({
            "rep": np.repeat(left["rep"].to_numpy(), len(k)), "k": np.tile(k, len(q)), "other": np.tile(np.concatenate(groups), len(q)), "total": total.ravel(),
        })

    one = F.lit(0).alias("cell")
    found = B.blocked_join(
        points.select("rep", "vec", one), points.select(F.col("rep").alias("id"), "vec", *labels, "w", one), "rep", "id", sums,
        "rep bigint, k int, other bigint, total double", block_rows=block_rows, chunk_rows=chunk_rows,
    )
    return found.groupBy("rep", "k", "other").agg(F.sum("total").alias("total"))


def _scored(points: DataFrame, label: str, per: DataFrame) -> DataFrame:
    """(rep, a, b, s) from the summed distances to the clusters of ``label``."""
    sizes = points.groupBy(F.col(label).alias("other")).agg(F.sum("w").alias("size"))
    joined = join_dimension(per, sizes, "other", "inner", MAX_CLUSTERS).join(points.select("rep", F.col(label).alias("own")), "rep")
    same = F.col("other") == F.col("own")
    ab = joined.groupBy("rep").agg(
        F.max(F.when(same, F.col("total") / F.nullif(F.col("size") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"),
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    )
    return ab.withColumn("s", s)


def silhouette_rows(df: DataFrame, id_col: str, vec: str, label: str, block_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """(id, label, a, b, s) with Euclidean distances.

    The exact value needs every distance. Copies are collapsed to (vector,
    label, count) first; the rest is cut into bounded blocks whose tasks return
    one distance sum per (row, cluster), never pairs. Work still grows with the
    square of the distinct rows; :func:`silhouette_squared` is linear.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), F.col(label).cast("long").alias("label"))
    points = rows.groupBy("vec", "label").agg(F.min("id").alias("rep"), F.count("*").alias("w")).persist()
    per = _distance_sums(points, ["label"], block_rows, chunk_rows).drop("k")
    scored = points.select("vec", "label", "rep").join(_scored(points, "label", per), "rep").drop("rep")
    return rows.join(scored, ["vec", "label"]).select("id", "label", "a", "b", "s")


def silhouette(df: DataFrame, id_col: str, vec: str, label: str, **opts) -> DataFrame:
    """Mean silhouette over the rows; null for a single cluster."""
    return silhouette_rows(df, id_col, vec, label, **opts).agg(
        F.when(F.count_distinct("label") > 1, F.avg("s")).alias("silhouette"), F.count("*").alias("n")
    )


def silhouettes(df: DataFrame, id_col: str, vec: str, labels: list[str]) -> list[float | None]:
    """The mean silhouette of each label, as from :func:`silhouette`, from one pass over the distances; every row has all labels."""
    names = [f"label_{i}" for i in range(len(labels))]
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), *[F.col(c).cast("long").alias(n) for c, n in zip(labels, names)])
    points = rows.groupBy("vec", *names).agg(F.min("id").alias("rep"), F.count("*").alias("w")).persist()
    sums = _distance_sums(points, names).persist()
    out = []
    for i, name in enumerate(names):
        scored = _scored(points, name, sums.filter(F.col("k") == i).drop("k")).join(points.select("rep", "w", name), "rep")
        mean = F.sum(F.col("s") * F.col("w")) / F.sum("w")
        out.append(scored.agg(F.when(F.count_distinct(name) > 1, mean)).first()[0])
    sums.unpersist()
    points.unpersist()
    return out


def silhouette_squared(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Silhouette with squared distances: linear in the rows, from per-cluster sums."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = df.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("prediction"))
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(v)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette_squared double")
