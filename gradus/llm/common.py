"""Helpers shared by the corpus operators: input columns, hot-key joins, stored tables, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.session import checkpointed

#: A key is hot from this share of all rows on; so at most ``HOT_SHARE`` keys are hot, however large the table.
HOT_SHARE = 1000


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that further columns of any name do no harm; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batches_of(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], rows: int = 512):
    """For ``mapInArrow``: applies ``fn`` to slices of at most ``rows`` rows, so that memory doesn't depend on the batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of documents hold at most ``rows`` rows; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (a local session without it gets its own)."""
    checkpointed(spark.range(0)) if not spark.sparkContext.getCheckpointDir() else None
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage of wide tables."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per key, whatever the share of the largest keys.

    ``size`` holds the number of rows of each key. Keys with over 1 / HOT_SHARE
    of all ``total`` rows are at most HOT_SHARE many; these are broadcast. Their
    rows leave the shuffle join under scattered keys, so no task gets them all.
    Rows with a null key keep nulls.
    """
    cols = [c for c in groups.columns if c != key]
    least = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > least).select(F.col(key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in cols])
    cold = groups.filter(F.col(size) <= least).select(F.col(key).alias("__ck"), F.lit(0).alias("__cs"), *[F.col(c).alias(f"__c_{c}") for c in cols])
    placed = rows.join(F.broadcast(hot), rows[key] == F.col("__hk"), "left")
    scatter = F.when(F.col("__hk").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int"))
    placed = placed.withColumn("__s", scatter)
    joined = placed.join(cold, (F.col(key) == F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__h_{c}", f"__c_{c}").alias(c) for c in cols])


#: dropped keys up to which they are broadcast to the scan of the documents
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, dropped: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` aren't the columns of ``dropped`` (nulls are equal); keeps the texts out of a shuffle if few are dropped."""
    dropped = checkpointed(dropped.toDF(*[f"__d{i}" for i in range(len(keys))]).distinct())
    few = dropped.count() <= BROADCAST_KEYS
    same = None
    for i, key in enumerate(keys):
        one = key.eqNullSafe(F.col(f"__d{i}"))
        same = one if same is None else same & one
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string: eight shifts per character."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, e: {step}), 4294967295)"
