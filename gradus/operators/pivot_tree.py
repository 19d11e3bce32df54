"""A pivot tree of one or two levels over vectors, so that cells keep a bounded size however many rows there are.

The first level has at most ``MAX_CELLS`` pivots, which travel by broadcast.
Where its cells hold more than ``CELL_ROWS`` rows, each is cut again by pivots
of its own; these stay a table and meet their rows in tasks of bounded size. A
query descends by the triangle inequality on both levels, so nothing is lost.
With ``probes`` it takes the nearest cells only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.operators import blocks as B
from gradus.session import checkpointed

#: rows a cell should have
CELL_ROWS = 1 << 16
#: rows of a first-level cell that one task places
PART_ROWS = 1 << 14
#: cells of a first-level cell; its pivots are in one task with a part of the rows
MAX_INNER = 4096


class PivotTree:
    """``placed``: the rows with ``top`` (first-level cell), ``cell`` (long) and ``cdist``, the distance to the cell's pivot."""

    def __init__(self, points: DataFrame, id_col: str, vec: str, cells: int | None = None, inner: int | None = None):
        """``cells`` and ``inner`` set the number of pivots of the first level and of each of its cells; by default they follow the rows."""
        self.vec, self.spark = vec, points.sparkSession
        n = points.count()
        self.pivots = B.pick_pivots(points, id_col, vec, cells or B.cell_count(n))
        self.one = len(self.pivots) == 1
        first = B.place(points, vec, self.pivots).persist()
        self.summary = B.summarise_cells(first, self.pivots)
        counts = self.summary.counts
        self.sizes = self.spark.createDataFrame([(t, int(c), min(inner or math.ceil(c / CELL_ROWS), MAX_INNER)) for t, c in enumerate(counts.tolist())], "top int, rows long, inner int")
        self.two = not self.one and (inner or counts.max(initial=0) > CELL_ROWS)
        first = first.withColumnRenamed("cell", "top")
        if not self.two:
            self.placed = first.withColumn("cell", F.col("top").cast("long"))
            return
        order = Window.partitionBy("top").orderBy(F.xxhash64(F.lit(19), F.col("pid")), F.col("pid"))
        ranked = first.select("top", F.col(id_col).alias("pid"), F.col(vec).alias("pivot")).withColumn("sub", F.row_number().over(order))
        # the sizes are at most MAX_CELLS short rows
        subs = ranked.filter(F.col("sub") <= MAX_INNER).join(F.broadcast(self.sizes), "top").filter("sub <= inner")
        self.subs = checkpointed(subs.select("top", (F.col("top").cast("long") * MAX_INNER + F.col("sub") - 1).alias("cell"), "pivot"))
        self.placed = self._nearest(first.drop("cdist"), id_col).persist()
        ranges = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cdist").alias("near"), F.max("cdist").alias("far"))
        self.cells = checkpointed(self.subs.join(ranges, "cell"))

    def release(self) -> None:
        """Drops the cached rows."""
        self.placed.unpersist()

    def _parts(self, df: DataFrame, side: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
        """Rows and per-cell tables under (top, part): a first-level cell is spread over as many tasks as its rows need."""
        counts = {r["top"]: r["count"] for r in collect_small(df.groupBy("top").count(), B.MAX_CELLS)}
        parts = F.broadcast(self.spark.createDataFrame([(t, max(1, -(-n // PART_ROWS))) for t, n in counts.items()], "top int, parts int"))
        rows = df.join(parts, "top").withColumn("part", F.pmod(F.xxhash64(F.lit(23), F.col(id_col)), F.col("parts")).cast("int")).drop("parts")
        copies = side.join(parts, "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return rows, copies.select(*[F.col(c).alias(c) for c in copies.columns])

    def _nearest(self, df: DataFrame, id_col: str) -> DataFrame:
        """Adds ``cell`` and ``cdist`` by the pivots of the row's first-level cell."""
        vec = self.vec
        rows, subs = self._parts(df, self.subs, id_col)
        names = rows.columns

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame()
            right = right.sort_values("cell")
            x, p = B.matrix(left[vec]), B.matrix(right["pivot"])
            at = np.concatenate([B.squared_distances(x[s], p).argmin(1) for s in B.row_slices(len(x), len(p))])
            return left[names].assign(cell=right["cell"].to_numpy()[at], cdist=B.exact_distance(x, p[at]))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell bigint, cdist double"
        return rows.groupBy("top", "part").cogroup(subs.groupBy("top", "part")).applyInPandas(run, schema).drop("part")

    def home(self, queries: DataFrame, qid: str) -> DataFrame:
        """``queries`` with the cell of their nearest pivots."""
        first = B.place(queries, self.vec, self.pivots).withColumnRenamed("cell", "top").drop("cdist")
        if not self.two:
            return first.withColumn("cell", F.col("top").cast("long")).drop("top")
        return self._nearest(first, qid).drop("top", "cdist")

    def reach(self, queries: DataFrame, qid: str, radius: Column, k: int = 0) -> DataFrame:
        """A row per (query, cell that can hold rows within ``radius``); a null radius covers the nearest ``k`` rows."""
        asked = queries.withColumn("__r", radius.cast("double"))
        first = B.candidate_cells(asked, self.vec, F.col("__r"), self.summary, k)
        if self.two:
            below = self._descend(first.select(qid, self.vec, "__r", F.explode("cells").alias("top")), qid, None)
            cells = below.groupBy(qid).agg(F.collect_list(F.col("cell")).alias("cells"))
            first = queries.join(cells, qid)
        # kept with a list of cells, so that a vector is written once; the copies are made on the way into the join
        listed = checkpointed(first.select(*queries.columns, F.col("cells").cast("array<long>").alias("cells")))
        return listed.withColumn("cell", F.explode("cells")).drop("cells")

    def _descend(self, first: DataFrame, qid: str, probes: int | None) -> DataFrame:
        """Rows under ``top`` to (query, cell, ``__d``) per cell below it: those within ``__r``, or the ``probes`` nearest; ``__d`` is the distance to the pivot."""
        vec = self.vec
        rows, cells = self._parts(first, self.cells, qid)

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame()
            right = right.sort_values("cell")
            x, p = B.matrix(left[vec]), B.matrix(right["pivot"])
            near, far = right["near"].to_numpy(), right["far"].to_numpy()
            limits = np.nan_to_num(left["__r"].to_numpy(dtype=float), nan=np.inf)
            rows_at, cells_at, gaps = [], [], []
            for s in B.row_slices(len(x), len(p)):
                d = np.sqrt(B.squared_distances(x[s], p))
                if probes is None:
                    slack = 1e-6 * (1.0 + d.max())
                    low = np.maximum(np.maximum(d - far, near - d), (d - d.min(1)[:, None]) / 2)
                    keep = low <= limits[s][:, None] + slack
                else:
                    keep = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) < probes
                r, c = np.nonzero(keep)
                rows_at.append(r + s.start)
                cells_at.append(c)
                gaps.append(d[r, c])
            at, to = np.concatenate(rows_at), np.concatenate(cells_at)
            return pd.DataFrame({qid: left[qid].to_numpy()[at], "cell": right["cell"].to_numpy()[to], "__d": np.concatenate(gaps)})

        schema = f"`{qid}` {rows.schema[qid].dataType.simpleString()}, cell bigint, __d double"
        return rows.groupBy("top", "part").cogroup(cells.groupBy("top", "part")).applyInPandas(run, schema)

    def ranked_tops(self, queries: DataFrame, tops: int) -> DataFrame:
        """(queries, top, place, __d): the up to ``tops`` first-level cells with the nearest pivots, place from 0."""
        shared = self.spark.sparkContext.broadcast((self.pivots, self.summary.counts > 0))

        @F.pandas_udf("array<struct<top:int,d:double>>")
        def nearest(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            p, live = shared.value
            d = np.where(live[None, :], np.sqrt(B.squared_distances(B.matrix(v), p)), np.inf)
            order = np.argsort(d, axis=1, kind="stable")[:, : min(tops, int(live.sum()))]
            return pd.Series([[{"top": int(t), "d": float(row[t])} for t in o] for row, o in zip(d, order)], dtype=object)

        first = queries.select("*", F.posexplode(nearest(self.vec)).alias("place", "__p"))
        return first.withColumn("top", F.col("__p.top")).withColumn("__d", F.col("__p.d")).drop("__p")

    def ranked(self, queries: DataFrame, qid: str, tops: int, probes: int) -> DataFrame:
        """(queries, cell, place), each query once per cell: the up to ``probes`` cells with the nearest pivots below the ``tops`` nearest first-level cells, place from 0."""
        first = self.ranked_tops(queries, tops)
        if not self.two:
            return first.filter(F.col("place") < probes).withColumn("cell", F.col("top").cast("long")).drop("top", "__d")
        below = self._descend(first.select(qid, self.vec, "top", F.lit(None).cast("double").alias("__r")), qid, probes)
        cells = below.groupBy(qid).agg(F.slice(F.array_sort(F.collect_list(F.struct("__d", "cell"))), 1, probes).alias("__c"))
        return queries.join(cells, qid).select(*queries.columns, F.posexplode("__c").alias("place", "__c")).withColumn("cell", F.col("__c.cell")).drop("__c")
