"""Scoring a stream of files with a fitted chain: transforms are row-wise, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def score_stream(
    spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
    sink: str, checkpoint: str, fmt: str = "parquet",
):
    """Run ``transform`` over all files now in ``source`` exactly once and append the rows to ``sink``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = (
        transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
