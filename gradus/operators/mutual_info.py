"""Nearest-neighbour mutual information between vector positions and a class (Ross 2014)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import ONE_TASK_ROWS, collect_small
from gradus.operators.ordering import running_rank


def digamma(n: Column) -> Column:
    """Digamma for n >= 1: shift the argument by six, then the asymptotic series."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * F.pow(x, F.lit(6)))
    return reduce(lambda acc, i: acc - F.lit(1.0) / (n.cast("double") + i), range(6), series)


def kth_same_class_distance(long: DataFrame, k: int, max_rows: int) -> DataFrame:
    """Adds the distance to the k-th nearest row of the same (pos, c).

    Rows are cut into blocks of consecutive ranks; each block also receives the
    k rows beyond either end, so every window is complete and bounded.
    """
    ranked = running_rank(long, ["pos", "c"], ["x", "id"], "one", "rank", max_rows).persist()
    size = max(max_rows, 4 * k)
    block, place = F.floor(F.col("rank") / size), F.col("rank") % size
    homes = F.array_compact(
        F.array(block, F.when(place < k, block - 1), F.when(place >= size - k, block + 1))
    )
    spread = ranked.withColumn("own", block).withColumn("block", F.explode(homes))
    w = Window.partitionBy("pos", "c", "block").orderBy("rank")
    x = F.col("x")
    spans = []
    for below in range(k + 1):
        far_left = F.lag("x", below).over(w) if below else x
        far_right = F.lead("x", k - below).over(w) if below < k else x
        by_left = (x - far_left) >= (far_right - x)
        d = F.when(by_left, x - far_left).otherwise(far_right - x)
        # the end that is a row keeps that row's value, so no rounding moves it across the bound
        span = F.struct(
            d.alias("d"), F.when(by_left, far_left).otherwise(x - d).alias("lo"), F.when(by_left, x + d).otherwise(far_right).alias("hi")
        )
        spans.append(F.when(far_left.isNotNull() & far_right.isNotNull(), span))
    nearest = F.array_min(F.array_compact(F.array(*spans)))
    out = spread.withColumn("reach", nearest).filter(F.col("block") == F.col("own"))
    return out.select("id", "pos", "c", "x", "reach.d", "reach.lo", "reach.hi")


def mutual_info_neighbour(
    df: DataFrame, id_col: str, vec: str, y: str, k: int = 3, max_rows: int = ONE_TASK_ROWS
) -> dict[int, float]:
    """psi(n) + psi(k) - mean psi(n_class) - mean psi(m), m = rows nearer than the k-th same-class row.

    Classes smaller than k + 1 rows use all their other rows (k = n_class - 1);
    single-row classes are left out. m comes from two ranks, counted in one
    sorted pass over values and radius ends.
    """
    sizes = {r[y]: r["count"] for r in collect_small(df.groupBy(y).count())}
    usable = [c for c, n in sizes.items() if n > 1]
    n = sum(sizes[c] for c in usable)
    long = df.filter(F.col(y).isin(usable)).select(
        F.col(id_col).alias("id"), F.col(y).alias("c"), F.posexplode(vec).alias("pos", "x")
    ).withColumn("one", F.lit(1))
    parts = [kth_same_class_distance(long.filter(F.col("c").isin([c for c in usable if sizes[c] > k])), k, max_rows)]
    for c in usable:
        if sizes[c] <= k:
            parts.append(kth_same_class_distance(long.filter(F.col("c") == c), sizes[c] - 1, max_rows))
    reach = reduce(DataFrame.unionByName, parts).persist()
    values = long.select("id", "pos", F.col("x").alias("v"), F.lit(1).alias("kind"), "one", F.lit(0).alias("sign"))
    # strictly nearer rows only: an upper end counts values below it, a lower end values up to it
    high = reach.select("id", "pos", F.col("hi").alias("v"), F.lit(0).alias("kind"), F.lit(0).alias("one"), F.lit(1).alias("sign"))
    low = reach.select("id", "pos", F.col("lo").alias("v"), F.lit(2).alias("kind"), F.lit(0).alias("one"), F.lit(-1).alias("sign"))
    counted = running_rank(values.unionByName(high).unionByName(low), ["pos"], ["v", "kind", "id"], "one", "before", max_rows)
    inside = counted.filter(F.col("sign") != 0).groupBy("pos", "id").agg(F.sum(F.col("sign") * F.col("before")).alias("m"))
    means = collect_small(inside.groupBy("pos").agg(F.avg(digamma(F.greatest(F.col("m"), F.lit(1)))).alias("psi_m")))
    small = df.sparkSession.createDataFrame([(n, min(k, sizes[c] - 1), sizes[c]) for c in usable], "n bigint, k bigint, size bigint")
    base = small.agg(
        (F.max(digamma(F.col("n"))) + F.sum(F.col("size") * digamma(F.col("k"))) / n
         - F.sum(F.col("size") * digamma(F.col("size"))) / n).alias("v")
    ).first()["v"]
    reach.unpersist()
    return {r["pos"]: max(0.0, base - r["psi_m"]) for r in means}
