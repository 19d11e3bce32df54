"""Metrics, folds, splits, cross-validation and parameter search."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.bounds import collect_small, null_safe_join, safe_ratio
from gradus.operators.ordering import shuffled_rank
from gradus.operators.quantiles import group_quantiles

PARALLEL_FITS = 4


# --- metrics ----------------------------------------------------------------

def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y: str, pred: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column per predicted class, all classes present."""
    dim = df.sparkSession.createDataFrame([(c,) for c in classes], f"{y} {df.schema[y].dataType.simpleString()}")
    cells = df.groupBy(y).agg(*[F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in classes])
    return dim.join(cells, y, "left").fillna(0, subset=[f"pred_{c}" for c in classes])


def per_class_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 (0 when undefined) and support per class, then their plain mean as class ``macro``."""
    cells = df.groupBy(y, pred).agg(F.count("*").alias("n"))
    sides = cells.select(F.col(y).alias("cls"), F.col("n").alias("real"), F.lit(0).alias("said"), F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(cells.select(F.col(pred).alias("cls"), F.lit(0).alias("real"), F.col("n").alias("said"), F.lit(0).alias("hit")))
    sums = sides.groupBy("cls").agg(F.sum("real").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    rows = sums.select(
        F.col("cls").cast("string").alias("cls"),
        F.coalesce(safe_ratio(F.col("hit"), F.col("said")), zero).alias("precision"),
        F.coalesce(safe_ratio(F.col("hit"), F.col("support")), zero).alias("recall"),
        F.coalesce(safe_ratio(2 * F.col("hit"), F.col("said") + F.col("support")), zero).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )
    macro = rows.agg(
        F.lit("macro").alias("cls"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"),
    )
    return rows.unionByName(macro)


def prediction_distribution(df: DataFrame, pred: str) -> DataFrame:
    from gradus.operators.aggregates import value_counts

    return value_counts(df, pred)


# --- folds ------------------------------------------------------------------

def kfold(df: DataFrame, id_col: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled folds whose sizes differ by at most one."""
    ranked = shuffled_rank(df, id_col, seed, "__rank")
    return ranked.withColumn(name, (F.col("__rank") % k).cast("int")).drop("__rank")


def stratified_kfold(df: DataFrame, id_col: str, y: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds in which the count of every class differs by at most one."""
    ranked = shuffled_rank(df, id_col, seed, "__rank", strata=y)
    return ranked.withColumn(name, (F.col("__rank") % k).cast("int")).drop("__rank")


def train_test_split(
    df: DataFrame, id_col: str, test_share: float = 0.2, stratify: str | None = None, seed: int = 42, name: str = "part"
) -> DataFrame:
    """``test`` for the first rows of the hash order (per class when stratified), else ``train``."""
    ranked = shuffled_rank(df, id_col, seed, "__rank", strata=stratify)
    keys = [stratify] if stratify else []
    sizes = collect_small(df.groupBy(*keys).agg(F.count("*").alias("n")))
    if stratify:
        limit = F.lit(0)
        for r in sizes:
            limit = F.when(F.col(stratify).eqNullSafe(F.lit(r[0])), F.lit(round(test_share * r["n"]))).otherwise(limit)
    else:
        limit = F.lit(math.ceil(test_share * sizes[0]["n"]))
    return ranked.withColumn(name, F.when(F.col("__rank") < limit, "test").otherwise("train")).drop("__rank")


# --- cross-validation -------------------------------------------------------

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def cross_val_predict(df: DataFrame, fit_predict: FitPredict, k: int, fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions: everything in ``fit_predict(train, held_out)`` is refitted per fold.

    Folds are independent Spark jobs, so a few are submitted at a time; the
    folded input is persisted once for all of them.
    """
    cached = df.persist()
    cached.count()

    def one(i: int) -> DataFrame:
        return fit_predict(cached.filter(F.col(fold) != i), cached.filter(F.col(fold) == i))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_val_score(df: DataFrame, fit_predict: FitPredict, k: int, y: str, pred: str = "prediction", fold: str = "fold") -> DataFrame:
    """(fold, accuracy, n): one row per fold from a single aggregation of the out-of-fold rows."""
    scored = cross_val_predict(df, fit_predict, k, fold)
    return scored.groupBy(fold).agg(
        F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n")
    )


def cross_val_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.count("*").alias("folds"))


def estimator_fit_predict(estimator: Estimator, keep: Sequence[str]) -> FitPredict:
    """Fit a Spark ML estimator (or pipeline) and keep the listed columns of its predictions."""

    def run(train: DataFrame, held_out: DataFrame) -> DataFrame:
        return estimator.fit(train).transform(held_out).select(*keep)

    return run


def holdout_estimate_forest(df: DataFrame, id_col: str, vec: str, y: str, dim: int, trees: int = 50, depth: int = 5, seed: int = 42, **opts) -> DataFrame:
    """(accuracy, n, left_out): out-of-bag accuracy of a bagged forest, the rows it is taken over, and the mean share of trees that left a row out."""
    from gradus.operators.trees import fit_bagged_forest

    votes = fit_bagged_forest(df, id_col, vec, y, dim, trees, depth, seed=seed, **opts).left_out_votes()
    return votes.agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("prediction").alias("n"), (F.avg("n_out") / trees).alias("left_out")
    )


# --- search -----------------------------------------------------------------

def unit_draw(seed: int, draw: int, name: str) -> float:
    """A reproducible number in [0, 1) from (seed, draw, name)."""
    digest = hashlib.md5(f"{seed}:{draw}:{name}".encode()).hexdigest()
    return int(digest[:13], 16) / float(1 << 52)


def draw_params(space: Mapping[str, tuple], draw: int, seed: int = 42) -> dict:
    """One configuration. Dimensions: ("int", a, b), ("real", a, b), ("log", a, b), ("choice", [..])."""
    out = {}
    for name, dim in space.items():
        u = unit_draw(seed, draw, name)
        if dim[0] == "int":
            out[name] = dim[1] + int(u * (dim[2] - dim[1] + 1))
        elif dim[0] == "real":
            out[name] = dim[1] + u * (dim[2] - dim[1])
        elif dim[0] == "log":
            out[name] = math.exp(math.log(dim[1]) + u * (math.log(dim[2]) - math.log(dim[1])))
        elif dim[0] == "choice":
            out[name] = dim[1][int(u * len(dim[1]))]
        else:
            raise ValueError(f"unknown dimension {dim[0]!r}")
    return out


RESULTS = (
    "draw int, params map<string,string>, mean_test_score double, std_test_score double, "
    "mean_fit_time double, rank_test_score int, is_best boolean"
)


def param_search(
    df: DataFrame, make_fit_predict: Callable[[dict], FitPredict], space: Mapping[str, tuple], n: int, k: int, y: str,
    pred: str = "prediction", fold: str = "fold", seed: int = 42,
) -> DataFrame:
    """Seeded random draws, each scored by cross-validation over the given fold column."""
    cached = df.persist()
    rows = []
    for draw in range(n):
        params = draw_params(space, draw, seed)
        started = time.time()
        scores = cross_val_summary(cross_val_score(cached, make_fit_predict(params), k, y, pred, fold)).first()
        rows.append((draw, {a: str(b) for a, b in params.items()}, scores["mean"], scores["std"], (time.time() - started) / k))
    cached.unpersist()
    done = []
    for r in rows:
        rank = 1 + sum(o[2] > r[2] for o in rows)
        done.append((*r, rank, rank == 1))
    return df.sparkSession.createDataFrame(done, RESULTS)


HALVING = (
    "rung int, share double, draw int, params map<string,string>, mean_test_score double, std_test_score double, survives boolean, is_best boolean"
)


def halving_search(
    df: DataFrame, make_fit_predict: Callable[[dict], FitPredict], space: Mapping[str, tuple], n: int, k: int, y: str, id_col: str,
    eta: int = 3, least_share: float | None = None, pred: str = "prediction", fold: str = "fold", seed: int = 42,
) -> DataFrame:
    """Successive halving over seeded draws: all are scored on a small share of the rows, the best 1 / ``eta`` go on to ``eta`` times as many.

    Shares are drawn by the hash of the id, each contains the one before, and
    the last is the whole table. ``least_share`` is the first one (by default
    one over the draws that drop out). A row per draw and rung; ``is_best`` is
    the best of the last rung. Equal scores keep the earlier draw.
    """
    rungs = 1
    while eta**rungs <= n:
        rungs += 1
    if least_share is not None:
        while rungs > 1 and eta ** -(rungs - 1) < least_share:
            rungs -= 1
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    placed = df.withColumn("__place", place).persist()
    alive, rows = [(d, draw_params(space, d, seed)) for d in range(n)], []
    for rung in range(rungs):
        share = float(eta) ** (rung - rungs + 1)
        part = (placed if rung == rungs - 1 else placed.filter(F.col("__place") < int(share * (1 << 30)))).drop("__place").persist()
        scored = []
        for draw, params in alive:
            got = cross_val_summary(cross_val_score(part, make_fit_predict(params), k, y, pred, fold)).first()
            scored.append((-(got["mean"] or 0.0), draw, params, got["mean"], got["std"]))
        part.unpersist()
        scored.sort(key=lambda r: r[:2])
        last = rung == rungs - 1
        kept = scored[: max(1, len(scored) // eta)]
        for i, (_, draw, params, mean, std) in enumerate(scored):
            rows.append((rung, share, draw, {a: str(b) for a, b in params.items()}, mean, std, not last and i < len(kept), last and i == 0))
        alive = [(draw, params) for _, draw, params, _, _ in kept]
    placed.unpersist()
    return df.sparkSession.createDataFrame(rows, HALVING)


def experiment_grid(spark: SparkSession, configs: Sequence[Mapping], run: Callable[[Mapping], float]) -> DataFrame:
    """Run each configuration, keep its score, mark the best; a failing one is recorded with its error."""
    rows = []
    for c in configs:
        try:
            rows.append((c["name"], float(run(c)), None))
        except Exception as e:  # noqa: BLE001  one bad configuration must not stop the others
            rows.append((c["name"], None, f"{type(e).__name__}: {e}"))
    best = max((r[1] for r in rows if r[1] is not None), default=None)
    return spark.createDataFrame(
        [(*r, r[1] is not None and r[1] == best) for r in rows], "name string, score double, error string, is_best boolean"
    )


# --- search diagnostics -----------------------------------------------------

def param_effect_numeric(results: DataFrame, params: Sequence[str], score: str) -> DataFrame:
    """Least-squares line of the score over each numeric parameter."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("x")) for p in params]))
    long = results.select(pairs.alias("p"), F.col(score).alias("s")).select("p.*", "s")
    return long.groupBy("param").agg(F.regr_slope("s", "x").alias("slope"), F.regr_intercept("s", "x").alias("intercept"))


def param_effect_categorical(results: DataFrame, param: str, score: str) -> DataFrame:
    return results.groupBy(param).agg(F.avg(score).alias("mean_score"))


def cv_score_stats(scores: DataFrame, model: str, score: str) -> DataFrame:
    """Mean, sample std and box-plot quartiles per model."""
    moments = scores.groupBy(model).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max")
    )
    quartiles = group_quantiles(scores, model, score, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return null_safe_join(moments, quartiles, model)


def training_curve(history: DataFrame, epoch: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per epoch in long form."""
    means = history.groupBy(epoch).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot([epoch], list(metrics), "metric", "value")
