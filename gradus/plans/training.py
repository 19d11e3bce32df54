"""End-to-end flows: train the best model, run experiments, score new rows."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.scalars import ordinal_decode, ordinal_encode
from gradus.functions.schema import FeatureSchema
from gradus.operators import evaluation, models, outliers, predictions, preprocess, selection
from gradus.operators.clustering import ClusterFeatures
from gradus.operators.features import BlockStats, Categories, ColumnStats, DateStats
from gradus.operators.ordinal import BinaryEnsemble, boosted_trees, ordinal_classifier
from gradus.session import checkpointed


@dataclass(frozen=True)
class FittedChain:
    """Preprocessing, selected positions and the ordinal model: all a scoring job needs."""

    schema: FeatureSchema
    params: preprocess.ClusteredParams
    positions: tuple[int, ...]
    model: BinaryEnsemble
    #: products of up to that many selected features are features too
    degree: int = 1

    def score(self, df: DataFrame, dim: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Adds ``prediction`` and ``probability``; rows only, so it also runs on a stream."""
        wide = preprocess.apply_clustered(df, self.schema, self.params, dim, keep)
        x = preprocess.as_vector(wide, [self.params.columns[i] for i in self.positions], keep)
        features = array_to_vector(products(F.col("x"), len(self.positions), self.degree))
        return self.model.transform(x.withColumn("features", features)).drop("features", "x")

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes schema, parameters, positions, the table of rare categories and the model below ``path``."""
        p, rare = self.params, self.params.titles.rare
        plain = asdict(replace(p, titles=replace(p.titles, rare=None)))
        plain["dates"] |= {"first": p.dates.first.isoformat(), "months": [[m, *v] for m, v in p.dates.months.items()]}
        meta = {"schema": asdict(self.schema), "params": plain, "positions": list(self.positions), "degree": self.degree, "rare": rare is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/chain")
        if rare is not None:
            rare.write.mode("overwrite").parquet(f"{path}/rare")
        self.model.save(spark, f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedChain:
        """What :meth:`save` wrote; scores like the fitted chain, in any later session."""
        meta = json.loads(spark.read.text(f"{path}/chain").first()[0])
        schema = FeatureSchema(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["schema"].items()})
        p = meta["params"]
        d, t, c = p["dates"], p["titles"], p["clusters"]
        params = preprocess.ClusteredParams(
            DateStats(datetime.date.fromisoformat(d["first"]), {m: (mean, std) for m, mean, std in d["months"]}, d["mean"], d["std"]),
            Categories(t["col"], tuple(t["frequent"]), spark.read.parquet(f"{path}/rare") if meta["rare"] else None),
            ClusterFeatures(BlockStats(*[tuple(c["block"][k]) for k in ("mean", "scaled_mean", "scale")]), tuple(map(tuple, c["centers"])), tuple(c["defaults"]), c["rule"]),
            p["soft"], ColumnStats(**{k: tuple(v) if k == "empty" else v for k, v in p["fills"].items()}), tuple(p["scaled"]), tuple(p["columns"]),
        )
        return FittedChain(schema, params, tuple(meta["positions"]), BinaryEnsemble.load(spark, f"{path}/model"), meta["degree"])


@dataclass(frozen=True)
class ChainOptions:
    """``selector`` and ``learner`` are names in ``SELECTORS`` and ``LEARNERS``; ``model`` has the learner's own settings."""

    clusters: int = 3
    restarts: int = 1
    block_dim: int = 300
    min_count: int = 10
    keep_share: float | int | str = 0.65
    selector: str = "trees"
    selection_trees: int = 100
    selection_depth: int = 5
    degree: int = 1
    learner: str = "boosted"
    # The best settings of the boosted trees.
    model: Mapping = (("trees", 800), ("depth", 10), ("rate", 0.005), ("subsample", 0.8), ("columns", 0.7))
    outliers: bool = True
    contamination: float | str = "auto"
    neighbours: int = 20


def _by_trees(x: DataFrame, y: str, names: list[str], opts: ChainOptions) -> DataFrame:
    return selection.select_tree_importance(x, "x", y, names, opts.keep_share, opts.selection_trees, opts.selection_depth)


#: (rows with vector "x", class, names, options) -> selection table; None keeps all features
SELECTORS: dict[str, Callable[[DataFrame, str, list[str], ChainOptions], DataFrame] | None] = {
    "trees": _by_trees,
    "anova": lambda x, y, names, opts: selection.select_anova(x, "x", y, names, opts.keep_share),
    "l1": lambda x, y, names, opts: selection.select_l1(x, "x", y, names, opts.keep_share),
    "variance": lambda x, y, names, opts: selection.select_variance(x, "x", names, 0.5),
    "none": None,
}

#: (rows, settings) -> binary learner for the thresholds of the ordered classes
LEARNERS: dict[str, Callable] = {
    "boosted": lambda n, **params: boosted_trees(**params),
    "forest": lambda n, **params: models.random_forest(**params),
    "logistic": lambda n, **params: models.logistic_regression(n, **params),
}


def products(x: Column, size: int, degree: int) -> Column:
    """The elements of an array and, up to ``degree``, their products with repetition."""
    if degree <= 1:
        return x
    every = [m for d in range(1, degree + 1) for m in combinations_with_replacement(range(size), d)]
    return F.array(*[reduce(lambda a, b: a * b, [F.get(x, F.lit(i)) for i in m]) for m in every])


def fit_chain(df: DataFrame, schema: FeatureSchema, dim: DataFrame, y: str, opts: ChainOptions, cluster_rows: DataFrame | None = None) -> FittedChain:
    """Preprocess, select, fit one learner per threshold; ``cluster_rows`` replace the rows in the cluster fit, say training and scoring rows together."""
    params = preprocess.fit_clustered(df, schema, dim, opts.block_dim, opts.clusters, min_count=opts.min_count, restarts=opts.restarts, cluster_rows=cluster_rows)
    wide = preprocess.apply_clustered(df, schema, params, dim, [y])
    x = preprocess.as_vector(wide, params.columns, [y]).persist()
    select = SELECTORS[opts.selector]
    positions = tuple(range(len(params.columns)))
    if select is not None:
        positions = tuple(selection.selected_positions(select(x, y, list(params.columns), opts), "rank"))
    chosen = F.array(*[F.get("x", F.lit(i)) for i in positions])
    data = x.select(y, chosen.alias("x")).select(y, array_to_vector(products(F.col("x"), len(positions), opts.degree)).alias("features"))
    model = ordinal_classifier(data, LEARNERS[opts.learner](x.count(), **dict(opts.model)), y, "features")
    x.unpersist()
    return FittedChain(schema, params, positions, model, opts.degree)


def drop_training_outliers(df: DataFrame, schema: FeatureSchema, dim: DataFrame, id_col: str, opts: ChainOptions):
    """(inliers of the raw rows, flags): two of three detectors on the preprocessed rows."""
    params = preprocess.fit_clustered(df, schema, dim, opts.block_dim, opts.clusters, min_count=opts.min_count)
    x = preprocess.as_vector(preprocess.apply_clustered(df, schema, params, dim, [id_col]), params.columns, [id_col]).persist()
    flags = checkpointed(
        outliers.outlier_ensemble(x, id_col, "x", opts.contamination, opts.neighbours).select(id_col, "is_outlier", "votes")
    )
    x.unpersist()
    return outliers.remove_outliers(df, flags, id_col), flags


def training_rows(df: DataFrame, schema: FeatureSchema, dim: DataFrame, opts: ChainOptions):
    """(coded rows without outliers, all rows, outliers): persisted once for every later fit."""
    coded = df.withColumn("y", ordinal_encode(F.col(schema.target))).drop(schema.target).persist()
    n = coded.count()
    if not opts.outliers:
        return coded, n, 0
    inliers, flags = drop_training_outliers(coded, schema, dim, schema.id, opts)
    return inliers.persist(), n, flags.filter("is_outlier").count()


def cross_validate_chain(kept: DataFrame, schema: FeatureSchema, dim: DataFrame, opts: ChainOptions, folds: int, seed: int = 42):
    """Mean and population std of the accuracy; the whole chain is refitted in every fold."""
    folded = evaluation.stratified_kfold(kept, schema.id, "y", folds, seed)

    def fit_predict(train: DataFrame, held_out: DataFrame) -> DataFrame:
        return fit_chain(train, schema, dim, "y", opts).score(held_out, dim, [schema.id, "y", "fold"])

    return evaluation.cross_val_summary(evaluation.cross_val_score(folded, fit_predict, folds, "y")).first()


def train_best_model(df: DataFrame, schema: FeatureSchema, dim: DataFrame, opts: ChainOptions, folds: int = 10, seed: int = 42):
    """(fitted chain, one-row summary). ``df`` has the id, the features and the text target."""
    kept, n, n_out = training_rows(df, schema, dim, opts)
    cv = cross_validate_chain(kept, schema, dim, opts, folds, seed)
    chain = fit_chain(kept, schema, dim, "y", opts)
    train_accuracy = evaluation.accuracy(chain.score(kept, dim, [schema.id, "y"]), "y", "prediction").first()["accuracy"]
    summary = df.sparkSession.createDataFrame(
        [(n, n_out, len(chain.positions), cv["mean"], cv["std"], folds, train_accuracy)],
        "n_rows bigint, n_outliers bigint, n_features int, cv_accuracy double, cv_std double, folds int, train_accuracy double",
    )
    return chain, summary


def generate_predictions(chain: FittedChain, test: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, label) for every scoring row and the list of violated checks (empty when valid)."""
    key, label = chain.schema.id, chain.schema.target
    scored = chain.score(test, dim, [key])
    table = scored.select(key, ordinal_decode(F.col("prediction").cast("int")).alias(label))
    return table, predictions.validate_predictions(table, test.select(key), key, label)


def run_experiments(df: DataFrame, schema: FeatureSchema, dim: DataFrame, configs: Mapping[str, ChainOptions], folds: int = 5) -> DataFrame:
    """Cross-validated score per named set-up, best one marked; a failing set-up is recorded and skipped."""
    names = [{"name": n} for n in configs]

    def run(c: Mapping) -> float:
        opts = configs[c["name"]]
        kept, _, _ = training_rows(df, schema, dim, opts)
        return cross_validate_chain(kept, schema, dim, opts, folds)["mean"]

    return evaluation.experiment_grid(df.sparkSession, names, run)
