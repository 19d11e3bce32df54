"""Metrics, folds, search diagnostics, run tables and prediction files."""

from __future__ import annotations


from pyspark.sql import functions as F

from gradus.operators import evaluation, predictions, tracking
from gradus.plans.registry import query
from gradus.plans.statistics import rounded
from gradus.session import shared_path

_SCORED = f"""scored AS (SELECT c.id, c.y, CASE by_price WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS pred
  FROM coded c JOIN predictors p ON c.id = p.id)"""


def _scored(t):
    from gradus.functions.scalars import ordinal_encode

    pred = t.predictors.select("id", ordinal_encode(F.col("by_price")).alias("pred"))
    return t.coded.select("id", "y").join(pred, "id")


@query("accuracy", f"WITH {_SCORED} SELECT round(avg(CAST(y = pred AS INTEGER)), 6) AS accuracy, count(*) AS n FROM scored", ("coded", "predictors"))
def _(t):
    return rounded(evaluation.accuracy(_scored(t), "y", "pred"), "accuracy")


@query(
    "confusion_matrix",
    f"""WITH {_SCORED} SELECT y, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
    count(*) FILTER (WHERE pred = 2) AS pred_2 FROM scored GROUP BY 1""",
    ("coded", "predictors"),
)
def _(t):
    return evaluation.confusion_matrix(_scored(t), "y", "pred", [0, 1, 2])


@query(
    "per_class_metrics",
    f"""WITH {_SCORED}, c AS (SELECT CAST(k AS VARCHAR) AS cls, count(*) FILTER (WHERE y = k AND pred = k) AS tp,
      count(*) FILTER (WHERE pred = k) AS said, count(*) FILTER (WHERE y = k) AS support FROM scored, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
    m AS (SELECT cls, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support FROM c)
    SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
    UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m""",
    ("coded", "predictors"),
)
def _(t):
    return rounded(evaluation.per_class_metrics(_scored(t), "y", "pred"), "precision", "recall", "f1")


@query(
    "kfold",
    "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM orders",
)
def _(t):
    return evaluation.kfold(t.orders.select("o_orderkey"), "o_orderkey", 10)


@query(
    "stratified_kfold",
    """SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id), id) - 1) % 5 AS INTEGER) AS fold FROM coded""",
    ("coded",),
)
def _(t):
    return evaluation.stratified_kfold(t.coded.select("id", "y"), "id", "y", 5)


@query(
    "train_test_split",
    """WITH r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id), id) - 1 AS rk, count(*) OVER (PARTITION BY y) AS n FROM coded)
    SELECT id, y, CASE WHEN rk < round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS part FROM r""",
    ("coded",),
)
def _(t):
    return evaluation.train_test_split(t.coded.select("id", "y"), "id", 0.2, "y")


@query(
    "param_effect",
    """SELECT 'std' AS param, round(regr_slope(score, std), 6) AS slope, round(regr_intercept(score, std), 6) AS intercept FROM history
    UNION ALL SELECT 'iteration', round(regr_slope(score, CAST(iteration AS DOUBLE)), 6), round(regr_intercept(score, CAST(iteration AS DOUBLE)), 6) FROM history""",
    ("history",),
)
def _(t):
    return rounded(evaluation.param_effect_numeric(t.history, ["std", "iteration"], "score"), "slope", "intercept")


@query("param_effect_categorical", "SELECT model, round(avg(score), 6) AS mean_score FROM history GROUP BY 1", ("history",))
def _(t):
    return rounded(evaluation.param_effect_categorical(t.history, "model", "score"), "mean_score")


@query(
    "cv_score_stats",
    """SELECT model, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max,
    round(quantile_cont(score, 0.25), 8) AS q25, round(quantile_cont(score, 0.5), 8) AS q50, round(quantile_cont(score, 0.75), 8) AS q75 FROM history GROUP BY 1""",
    ("history",),
)
def _(t):
    out = rounded(evaluation.cv_score_stats(t.history, "model", "score"), "mean", "std")
    return rounded(out, "q25", "q50", "q75", digits=8)


@query(
    "training_curve",
    """SELECT epoch, 'score' AS metric, round(avg(score), 6) AS value FROM (SELECT *, CAST(ts AS DATE) AS epoch FROM history) GROUP BY 1
    UNION ALL SELECT epoch, 'std', round(avg(std), 6) FROM (SELECT *, CAST(ts AS DATE) AS epoch FROM history) GROUP BY 1""",
    ("history",),
)
def _(t):
    h = t.history.withColumn("epoch", F.col("ts").cast("date"))
    return rounded(evaluation.training_curve(h, "epoch", ["score", "std"]), "value")


@query("prediction_distribution", "SELECT by_price, count(*) AS n FROM predictors GROUP BY 1", ("predictors",))
def _(t):
    return evaluation.prediction_distribution(t.predictors, "by_price")


# --- prediction files -------------------------------------------------------

@query(
    "make_predictions_table",
    """SELECT id, by_price AS salary_category FROM predictors""",
    ("predictors",),
)
def _(t):
    from gradus.functions.scalars import ordinal_encode

    p = t.predictors.select("id", ordinal_encode(F.col("by_price")).alias("pred"))
    return predictions.make_predictions_table(p, "id", "pred")


@query(
    "prediction_summary",
    """SELECT CAST(position AS INTEGER) AS position, cls AS by_price, count(by_price) AS n, (SELECT count(*) FROM predictors) AS total,
    round(100.0 * count(by_price) / (SELECT count(*) FROM predictors), 6) AS percent
    FROM (SELECT unnest([0, 1, 2, 3]) AS position, unnest(['Low', 'Medium', 'High', 'Top']) AS cls) LEFT JOIN predictors ON by_price = cls GROUP BY 1, 2""",
    ("predictors",),
)
def _(t):
    return rounded(predictions.prediction_summary(t.predictors, "by_price", ["Low", "Medium", "High", "Top"]), "percent")


def _broken(t):
    """Orders as predictions: labels of cheap orders missing, of dear ones misspelt, keys shifted by five."""
    price = F.col("o_totalprice")
    label = F.when(price < 20000, F.lit(None)).when(price > 480000, "Hgih").otherwise("Low")
    return t.orders.select((F.col("o_custkey") + 5).alias("id"), label.alias("salary_category"))


@query(
    "validate_predictions",
    """WITH f AS (SELECT o_custkey + 5 AS id, CASE WHEN o_totalprice < 20000 THEN NULL WHEN o_totalprice > 480000 THEN 'Hgih' ELSE 'Low' END AS l FROM orders),
    e AS (SELECT DISTINCT c_custkey AS id FROM customer), g AS (SELECT DISTINCT id FROM f)
    SELECT * FROM (SELECT 'null salary_category' AS "check", count(*) AS n FROM f WHERE l IS NULL
    UNION ALL SELECT 'invalid category', count(*) FROM f WHERE l IS NULL OR l NOT IN ('Low', 'Medium', 'High')
    UNION ALL SELECT 'missing ids', count(*) FROM e WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'extra ids', count(*) FROM g WHERE id NOT IN (SELECT id FROM e)) WHERE n > 0""",
)
def _(t):
    return predictions.validate_predictions(_broken(t), t.customer.select(F.col("c_custkey").alias("id")))


def _files(t):
    p = t.predictors
    return {c: p.select("id", F.col(c).alias("label")) for c in ("by_price", "by_status", "by_month")}


@query(
    "agreement",
    "SELECT id, by_price, by_status, by_month, by_price = by_status AND by_status = by_month AS all_agree FROM predictors",
    ("predictors",),
)
def _(t):
    return predictions.agreement(_files(t), "id", "label")[0]


@query(
    "agreement_rate",
    """SELECT count(*) AS n, count(*) FILTER (WHERE by_price = by_status AND by_status = by_month) AS n_agree,
    round(100.0 * count(*) FILTER (WHERE by_price = by_status AND by_status = by_month) / count(*), 6) AS percent FROM predictors""",
    ("predictors",),
)
def _(t):
    return rounded(predictions.agreement(_files(t), "id", "label")[1], "percent")


_PAIR = "SELECT '{0}' AS a, '{1}' AS b, count(*) FILTER (WHERE {0} = {1}) AS n_agree, count(*) AS n, round(100.0 * count(*) FILTER (WHERE {0} = {1}) / count(*), 6) AS percent FROM predictors"


@query(
    "pairwise_agreement",
    " UNION ALL ".join(_PAIR.format(a, b) for a, b in (("by_price", "by_status"), ("by_price", "by_month"), ("by_status", "by_month"))),
    ("predictors",),
)
def _(t):
    return rounded(predictions.pairwise_agreement(_files(t), "id", "label"), "percent")


@query("write_predictions", "SELECT id, by_price AS salary_category FROM predictors", ("predictors",))
def _(t):
    from gradus.sources.tables import read_predictions, write_predictions

    out = scratch(t, "predictions")
    write_predictions(t.predictors.select("id", F.col("by_price").alias("salary_category")), out)
    return read_predictions(t.spark, out)


def scratch(t, name: str) -> str:
    """A new path for files a query writes, in the folder that all executors share."""
    return shared_path(t.spark, name)


# --- runs -------------------------------------------------------------------

@query(
    "parse_run_json",
    "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events",
)
def _(t):
    return tracking.parse_run_json(t.events.select("event_id", "props"), "props", "k int")


def _runs(t):
    """One run record per user of the event table."""
    best = F.struct("score", (-F.col("iteration")).alias("o"))
    return t.history.groupBy("run_index").agg(
        F.max("score").alias("best_score"),
        F.map_from_arrays(
            F.array(F.lit("model__kind"), F.lit("model__std")),
            F.array(F.max_by("model", best), F.max_by("std", best).cast("string")),
        ).alias("best_params"),
        F.min("ts").cast("string").alias("start_time"), F.max("ts").cast("string").alias("end_time"),
        F.count("*").cast("int").alias("n"),
    )


@query(
    "flatten_params",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_index ORDER BY score DESC, iteration) AS k FROM history)
    SELECT run_index, model AS best_kind, CAST(std AS VARCHAR) AS best_std FROM r WHERE k = 1""",
    ("history",),
)
def _(t):
    return tracking.flatten_params(_runs(t), "run_index", "best_params")


@query(
    "runs_summary",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_index ORDER BY score DESC, iteration) AS k, count(*) OVER (PARTITION BY run_index) AS c FROM history)
    SELECT 'run' AS run_name, CAST(run_index AS INTEGER) AS run_index, score AS best_score, 0 AS n_iterations, model AS best_kind, CAST(std AS VARCHAR) AS best_std FROM r WHERE k = 1""",
    ("history",),
)
def _(t):
    runs = _runs(t).select(
        F.lit("run").alias("run_name"), F.col("run_index").cast("int").alias("run_index"), "start_time", "end_time", "best_score", "best_params"
    )
    out = scratch(t, "runs")
    tracking.write_run(runs, out)
    return tracking.runs_summary(tracking.read_runs(t.spark, out)).drop("start_time", "end_time", "file_path")


@query("read_runs", "SELECT user_id AS run_index, round(max(value) / 1000, 6) AS best_score FROM events GROUP BY 1")
def _(t):
    runs = _runs(t).select("run_index", "best_score").withColumn("run_name", F.lit("run"))
    out = scratch(t, "runs")
    tracking.write_run(runs, out)
    back = tracking.read_runs(t.spark, out)
    return back.select(F.col("run_index").cast("bigint").alias("run_index"), F.round("best_score", 6).alias("best_score"))
