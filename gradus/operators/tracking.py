"""Experiment tracking: iteration rows, run records, run summaries."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.bounds import collect_small

ITERATION = (
    "run_name string, run_index int, iteration int, params map<string,string>, score double, std double, "
    "duration double, timestamp string"
)

def run_schema() -> str:
    """DDL of one run record."""
    return (
        "run_name string, run_index int, start_time string, end_time string, best_score double, "
        "best_params map<string,string>, "
        "top_results array<struct<rank:int,score:double,std:double,params:map<string,string>,fit_time:double,score_time:double>>, "
        "cv_results_summary struct<n_iterations:int,total_fit_time:double,"
        "score_distribution:struct<min:double,max:double,mean:double,std:double>>, "
        "outlier_info struct<method:string,contamination:string,n_outliers:int,outlier_percentage:double>, "
        "data_info struct<train_shape:array<int>,target_distribution:map<string,int>>, "
        "diagnostics map<string,string>, "
        "iteration_history array<struct<iteration:int,params:map<string,string>,score:double,std:double,duration:double,timestamp:string>>"
    )


def log_iteration(
    spark: SparkSession, path: str, run_name: str, run_index: int, iteration: int, params: Mapping[str, object],
    score: float, std: float = 0.0, duration: float = 0.0, timestamp: str | None = None,
) -> str:
    """Append one row to the iterations table."""
    stamp = timestamp or datetime.datetime.now().isoformat()
    row = (run_name, run_index, iteration, {k: str(v) for k, v in params.items()}, float(score), float(std), float(duration), stamp)
    spark.createDataFrame([row], ITERATION).coalesce(1).write.mode("append").json(path)
    return path


def read_iterations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITERATION).json(path)


def run_record(
    results: DataFrame, run_name: str, run_index: int, start_time: str, end_time: str | None,
    outliers: Mapping | None = None, train_shape: tuple[int, int] | None = None,
    target_counts: Mapping | None = None, diagnostics: Mapping[str, str] | None = None,
) -> DataFrame:
    """One record per run from its search results: best, top five, score summary, settings."""
    summary = results.agg(
        F.max("mean_test_score").alias("best_score"),
        F.max_by("params", F.struct("mean_test_score", (-F.col("draw")).alias("o"))).alias("best_params"),
        F.struct(
            F.count("*").cast("int").alias("n_iterations"),
            F.sum("mean_fit_time").alias("total_fit_time"),
            F.struct(
                F.min("mean_test_score").alias("min"), F.max("mean_test_score").alias("max"),
                F.avg("mean_test_score").alias("mean"), F.stddev_samp("mean_test_score").alias("std"),
            ).alias("score_distribution"),
        ).alias("cv_results_summary"),
    ).first()
    top = collect_small(results.orderBy(F.desc("mean_test_score"), "draw").limit(5))
    best_five = [
        (r["rank_test_score"], r["mean_test_score"], r["std_test_score"], r["params"], r["mean_fit_time"], None) for r in top
    ]
    info = None
    if outliers:
        info = (outliers["method"], str(outliers["contamination"]), outliers["n_outliers"], 100.0 * outliers["n_outliers"] / outliers["n"])
    cv = summary["cv_results_summary"]
    row = (
        run_name, run_index, start_time, end_time, summary["best_score"], summary["best_params"], best_five,
        (cv["n_iterations"], cv["total_fit_time"], tuple(cv["score_distribution"])), info,
        (list(train_shape) if train_shape else None, {str(k): int(v) for k, v in target_counts.items()} if target_counts else None),
        dict(diagnostics) if diagnostics else None, None,
    )
    return results.sparkSession.createDataFrame([row], run_schema())


def write_run(run: DataFrame, path: str) -> str:
    run.write.mode("append").json(path)
    return path


def read_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All run records below a path with the file each came from."""
    runs = spark.read.schema(run_schema()).option("multiLine", multi_line).json(path)
    return runs.withColumn("file_path", F.input_file_name())


def parse_run_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON text to typed columns; broken text gives nulls."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.from_json(text, schema).alias("__r")).select(*others, "__r.*")


def flatten_params(runs: DataFrame, key: str, params: str, names: list[str] | None = None) -> DataFrame:
    """``best_<short name>`` columns from a params map; runs without params keep a row of nulls.

    Parameter names are a short list (collected once unless given), so this is a
    projection with map lookups rather than an explode and a pivot.
    """
    if names is None:
        names = sorted(r[0] for r in collect_small(runs.select(F.explode(F.map_keys(params)).alias("k")).distinct()))
    return runs.select(key, *[F.try_element_at(params, F.lit(n)).alias("best_" + n.split("__")[-1]) for n in names])


def runs_summary(runs: DataFrame) -> DataFrame:
    """One row per run with flattened best parameters, by run index; incomplete runs stay in."""
    names = sorted(r[0] for r in collect_small(runs.select(F.explode(F.map_keys("best_params")).alias("k")).distinct()))
    count = F.coalesce(F.size("iteration_history"), F.lit(0))
    flat = [F.try_element_at("best_params", F.lit(n)).alias("best_" + n.split("__")[-1]) for n in names]
    return runs.select(
        "run_name", "run_index", "best_score", "start_time", "end_time",
        F.when(count < 0, 0).otherwise(count).alias("n_iterations"), "file_path", *flat,
    ).orderBy("run_index")
