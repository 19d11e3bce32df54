"""Outlier detectors. Each adds ``is_outlier`` (and ``score``) to a keyed table; nothing is removed here."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small, join_dimension, safe_ratio
from gradus.functions import arrays
from gradus.operators.features import fit_columns
from gradus.operators.quantiles import exact_quantiles

AUTO_CONTAMINATION = 0.05


def contamination_value(contamination: float | str) -> float:
    return AUTO_CONTAMINATION if contamination == "auto" else float(contamination)


def outlier_zscore(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Any column more than ``threshold`` population standard deviations from its mean."""
    s = fit_columns(df, cols)
    z = [F.abs(safe_ratio(F.col(c) - F.lit(s.mean[c]), F.lit(s.std_pop[c]))) for c in cols]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return df.withColumn("score", score).withColumn("is_outlier", F.coalesce(F.col("score") > threshold, F.lit(False)))


def outlier_iqr(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Any column outside its quartiles by more than ``multiplier`` interquartile ranges."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    flags: list[Column] = []
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        reach = multiplier * (q3 - q1)
        flags.append(F.coalesce((F.col(c) < q1 - reach) | (F.col(c) > q3 + reach), F.lit(False)))
    any_flag = reduce(lambda a, b: a | b, flags, F.lit(False))
    n_out = reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))
    return df.withColumn("score", n_out.cast("double")).withColumn("is_outlier", any_flag)


def flag_highest(df: DataFrame, score: str, contamination: float | str = "auto") -> DataFrame:
    """Flag rows strictly above the (1 - contamination) quantile of the score."""
    cut = exact_quantiles(df, [score], [1.0 - contamination_value(contamination)])[score][0]
    return df.withColumn("is_outlier", F.coalesce(F.col(score) > F.lit(cut), F.lit(False)))


# --- isolation forest -------------------------------------------------------

def hash_sample(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """``size`` rows in hash order. A hash threshold first cuts the candidates to a few times
    ``size``, so the final ordering handles few rows; the threshold and the order
    use one hash, so the sample follows one rule at every size of the table."""
    n = df.count()
    hashed = df.withColumn("__h", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 62)))
    cut = int((1 << 62) * min(1.0, (4.0 * size + 64) / max(1, n)))
    return hashed.filter(F.col("__h") < F.lit(cut)).orderBy("__h", id_col).limit(size).drop("__h")


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, leaf depth); feature -1 marks a leaf."""
    nodes: list = []
    todo = [(rows, 0, -1, False)]
    while todo:
        part, depth, parent, is_right = todo.pop()
        index = len(nodes)
        if parent >= 0:
            f, cut, left, right, d = nodes[parent]
            nodes[parent] = (f, cut, left if is_right else index, index if is_right else right, d)
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(part)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] <= cut
        nodes.append((f, cut, -1, -1, 0.0))
        todo.append((part[~goes_left], depth + 1, index, True))
        todo.append((part[goes_left], depth + 1, index, False))
    return nodes


def fit_isolation_forest(df: DataFrame, id_col: str, vec: str, trees: int = 100, rows_per_tree: int = 256, seed: int = 42) -> dict:
    """Trees grown in parallel tasks from a bounded hash sample (at most trees x rows_per_tree rows)."""
    spark = df.sparkSession
    pool = [r[0] for r in hash_sample(df.select(id_col, vec), id_col, trees * rows_per_tree, seed).select(vec).collect()]
    psi = min(rows_per_tree, len(pool))
    shared = spark.sparkContext.broadcast(np.asarray(pool, dtype=float))
    limit = math.ceil(math.log2(max(psi, 2)))

    def grow(batches):
        data = shared.value
        for pdf in batches:
            for tree in pdf["tree"]:
                rng = np.random.default_rng([seed, int(tree)])
                part = data[rng.choice(len(data), psi, replace=False)]
                nodes = _grow(part, limit, rng)
                yield pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"]).assign(
                    tree=int(tree), node=range(len(nodes))
                )

    schema = "feature int, cut double, left int, right int, depth double, tree int, node int"
    tasks = spark.range(0, trees, 1, min(trees, 8)).withColumnRenamed("id", "tree")
    nodes = tasks.mapInPandas(grow, schema).toPandas().sort_values(["tree", "node"])  # trees x 2 psi rows at most
    return {"trees": [g[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, g in nodes.groupby("tree")], "psi": psi}


def score_isolation_forest(df: DataFrame, forest: dict, vec: str, name: str = "score") -> DataFrame:
    """2^(-mean depth / c(psi)) per row, one vectorised pass over the Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        forest = shared.value
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 1))
        rows = np.arange(len(x))
        depth = np.zeros(len(x))
        for t in forest["trees"]:
            at = np.zeros(len(x), dtype=int)
            while True:
                feature = t[at, 0].astype(int)
                inner = feature >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(feature, 0)] <= t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(int), at)
            depth += t[at, 4]
        mean = depth / len(forest["trees"])
        return pd.Series(np.power(2.0, -mean / float(average_path(forest["psi"]))))

    return df.withColumn(name, score(vec))


def outlier_isolation_forest(
    df: DataFrame, id_col: str, vec: str, contamination: float | str = "auto", trees: int = 100, seed: int = 42
) -> DataFrame:
    forest = fit_isolation_forest(df, id_col, vec, trees, seed=seed)
    scored = score_isolation_forest(df, forest, vec).persist()
    return flag_highest(scored, "score", contamination)


# --- robust covariance ------------------------------------------------------

def _subset_fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    mean = rows.mean(axis=0)
    cov = np.cov(rows, rowvar=False, bias=True).reshape(len(mean), len(mean))
    return mean, cov, float(np.linalg.slogdet(cov)[1])


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(cov, hermitian=True)


def with_mahalanobis(df: DataFrame, vec: str, mean: np.ndarray, inv: np.ndarray, name: str) -> DataFrame:
    """Squared Mahalanobis distance per row; the p x p matrix travels as a broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(mean), np.asarray(inv)))

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        m, s = shared.value
        x = np.stack(v.to_numpy()).astype(float) - m if len(v) else np.zeros((0, len(m)))
        return pd.Series(np.einsum("ij,jk,ik->i", x, s, x, optimize=True))

    return df.withColumn(name, distance(vec))


def mean_and_cov(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of a vector column by tree aggregation in the JVM."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation, Summarizer

    v = df.select(array_to_vector(vec).alias("v")).persist()
    row = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    mean = row["mean"].toArray()
    std = np.sqrt(row["variance"].toArray() * (row["count"] - 1) / row["count"])
    corr = np.nan_to_num(Correlation.corr(v, "v").first()[0].toArray(), nan=0.0)
    v.unpersist()
    np.fill_diagonal(corr, 1.0)
    return mean, corr * np.outer(std, std)


def fit_robust_covariance(
    df: DataFrame, id_col: str, vec: str, starts: int = 30, sample_rows: int = 1500, rounds: int = 10, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """Fast minimum covariance determinant.

    Random starts are improved on a bounded sample, as the published algorithm
    does for large inputs; the best one is then improved by concentration steps
    over all rows, each a distance pass, an exact quantile and a covariance
    aggregate, until the determinant settles.
    """
    sample = np.asarray([r[0] for r in hash_sample(df.select(id_col, vec), id_col, sample_rows, seed).select(vec).collect()], dtype=float)
    n, p = sample.shape
    h = (n + p + 1) // 2
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        rows = sample[rng.choice(n, min(n, p + 1), replace=False)]
        last = math.inf
        for _ in range(rounds):
            mean, cov, det = _subset_fit(rows)
            x = sample - mean
            d = np.einsum("ij,jk,ik->i", x, _inverse(cov), x, optimize=True)
            rows = sample[np.argsort(d, kind="stable")[:h]]
            if math.isfinite(det) and abs(last - det) < 1e-9:
                break
            last = det
        mean, cov, det = _subset_fit(rows)
        if best is None or det < best[2]:
            best = (mean, cov, det)
    mean, cov, det = best
    total = df.count()
    if total <= n:
        return mean, cov
    share = ((total + p + 1) // 2) / total
    for _ in range(rounds):
        placed = with_mahalanobis(df.select(vec), vec, mean, _inverse(cov), "__d").persist()
        cut = exact_quantiles(placed, ["__d"], [share])["__d"][0]
        new_mean, new_cov = mean_and_cov(placed.filter(F.col("__d") <= cut), vec)
        placed.unpersist()
        new_det = float(np.linalg.slogdet(new_cov)[1])
        settled = abs(new_det - det) < 1e-6
        mean, cov, det = new_mean, new_cov, new_det
        if settled:
            break
    return mean, cov


def chi2_quantile(share: float, dof: float) -> float:
    """The value below which ``share`` of a chi-squared variable lies, by bisection."""
    from gradus.operators.diagnostics import chi2_sf

    low, high = 0.0, max(dof, 1.0)
    while 1 - chi2_sf(high, dof) < share:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_sf(mid, dof) < share else (low, mid)
    return (low + high) / 2


#: share of clean rows that the reweighting keeps
KEPT = 0.975


def reweighted_covariance(df: DataFrame, vec: str, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate from all rows that a robust one doesn't find far.

    The robust covariance is first scaled so that the median distance is that
    of a Gaussian. Rows within the 97.5 % distance then give mean and
    covariance, which is scaled for the tail that was cut off.
    """
    from gradus.operators.diagnostics import chi2_sf

    p = len(mean)
    placed = with_mahalanobis(df.select(vec), vec, mean, _inverse(cov), "__d").persist()
    median = exact_quantiles(placed, ["__d"], [0.5])["__d"][0]
    scale = median / chi2_quantile(0.5, p) if median else 1.0
    limit = chi2_quantile(KEPT, p)
    inner = placed.filter(F.col("__d") <= limit * scale)
    if inner.limit(p + 1).count() <= p:
        placed.unpersist()
        return mean, cov * scale
    mean, cov = mean_and_cov(inner, vec)
    placed.unpersist()
    return mean, cov * KEPT / (1 - chi2_sf(limit, p + 2))


def fit_elliptic(df: DataFrame, id_col: str, vec: str, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance by the minimum covariance determinant, made consistent and reweighted."""
    return reweighted_covariance(df, vec, *fit_robust_covariance(df, id_col, vec, seed=seed))


def outlier_elliptic(df: DataFrame, id_col: str, vec: str, contamination: float | str = "auto", seed: int = 42) -> DataFrame:
    """Squared Mahalanobis distance from the robust estimate; the farthest rows are flagged."""
    mean, cov = fit_elliptic(df, id_col, vec, seed)
    scored = with_mahalanobis(df, vec, mean, _inverse(cov), "score").persist()
    return flag_highest(scored, "score", contamination)


# --- combinations -----------------------------------------------------------

def outlier_vote(flags: DataFrame, cols: Sequence[str], need: int | None = None) -> DataFrame:
    """Flagged when a majority of the detector columns agree."""
    need = need if need is not None else len(cols) // 2 + 1
    votes = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in cols])
    return flags.withColumn("votes", votes).withColumn("is_outlier", F.col("votes") >= need)


def vector_zscore_flag(df: DataFrame, vec: str, name: str, threshold: float = 3.0) -> DataFrame:
    """Z-score rule over the positions of a vector column."""
    from gradus.operators.aggregates import vector_moments

    rows = sorted(collect_small(vector_moments(df, vec).select("pos", "mean", "var_pop")), key=lambda r: r["pos"])
    mean = arrays.vector_literal([r["mean"] for r in rows])
    wide = arrays.vector_literal([threshold * r["var_pop"] ** 0.5 for r in rows])
    excess = F.zip_with(
        F.zip_with(vec, mean, lambda x, m: F.abs(x - m)), wide, lambda d, w: F.coalesce((d > w) & (w > 0), F.lit(False))
    )
    return df.withColumn(name, F.exists(excess, lambda e: e))


def outlier_ensemble(df: DataFrame, id_col: str, vec: str, contamination: float | str = "auto", k: int = 20, seed: int = 42) -> DataFrame:
    """Isolation forest, local outlier factor and z-score; two of three decide."""
    from gradus.operators.neighbors import outlier_lof

    base = df.select(id_col, vec)
    forest = outlier_isolation_forest(base, id_col, vec, contamination, seed=seed).select(
        id_col, vec, F.col("is_outlier").alias("by_forest")
    )
    z = vector_zscore_flag(forest, vec, "by_zscore").drop(vec)
    lof = outlier_lof(base, id_col, vec, k, contamination).select(id_col, F.col("is_outlier").alias("by_lof"))
    return outlier_vote(z.join(lof, id_col), ["by_forest", "by_lof", "by_zscore"])


def outlier_supervised(
    df: DataFrame, id_col: str, vec: str, y: str, contamination: float | str = "auto", confidence: float = 0.8,
    folds: int = 5, trees: int = 100, depth: int = 8, seed: int = 42,
) -> DataFrame:
    """Wrong out-of-fold class with high confidence, or isolated among features and target together."""
    from gradus.operators.evaluation import cross_val_predict, estimator_fit_predict, stratified_kfold
    from gradus.operators.models import predicted, random_forest, with_features

    data = with_features(df.select(id_col, vec, y), vec, y)
    folded = stratified_kfold(data, id_col, y, folds, seed)
    run = estimator_fit_predict(random_forest(trees, depth, seed=seed), [id_col, y, "prediction", "probability"])
    out = predicted(cross_val_predict(folded, run, folds), [id_col, y])
    wrong = (F.col("prediction") != F.col(y)) & (F.array_max("probability") > confidence)
    errors = out.select(id_col, wrong.alias("confident_error"))
    joint = df.select(id_col, F.concat(vec, F.array(F.col(y).cast("double"))).alias("__v"))
    isolated = outlier_isolation_forest(joint, id_col, "__v", contamination, seed=seed).select(
        id_col, F.col("is_outlier").alias("isolated")
    )
    return errors.join(isolated, id_col).withColumn("is_outlier", F.col("confident_error") | F.col("isolated"))


def remove_outliers(df: DataFrame, flags: DataFrame, id_col: str, training: bool = True) -> DataFrame:
    """Inliers when training; scoring rows pass unchanged."""
    if not training:
        return df
    return join_dimension(df, outlier_ids(flags, id_col), id_col, "left_anti")


def outlier_ids(flags: DataFrame, id_col: str) -> DataFrame:
    return flags.filter(F.col("is_outlier")).select(id_col)


def outlier_report(flags: DataFrame, y: str, method: str, contamination: float | str = "auto") -> DataFrame:
    """Counts and percent per class and overall, with the detector settings."""
    from gradus.operators.aggregates import class_outlier_rate

    return class_outlier_rate(flags, y, "is_outlier").withColumn("method", F.lit(method)).withColumn(
        "contamination", F.lit(str(contamination))
    )
