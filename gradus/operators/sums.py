"""Sums of row contributions over the cluster: the inner loop of the maximum-likelihood fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small


def column_array(column: pa.Array) -> np.ndarray:
    """A numeric column as a vector, a list column of equal lengths as a matrix, without Python objects."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def distributed_sum(
    df: DataFrame, cols: Sequence[str], contribution: Callable[[dict[str, np.ndarray]], np.ndarray], size: int
) -> np.ndarray:
    """Sum over all batches of a fixed-length vector computed per Arrow batch.

    Each task adds up its own batches and ships ``size`` numbers, which are
    summed per index in a shuffle; the driver receives ``size`` rows.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += contribution({c: column_array(batch.column(i)) for i, c in enumerate(cols)})
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    parts = df.select(*cols).mapInArrow(run, "i int, v double")
    out = np.zeros(size)
    for r in collect_small(parts.groupBy("i").agg(F.sum("v").alias("v")), max(size, 1)):
        out[r["i"]] = r["v"]
    return out
