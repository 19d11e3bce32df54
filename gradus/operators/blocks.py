"""Exact distance joins cut into bounded blocks.

Data rows are placed in the cell of their nearest pivot (a few hundred random
rows). A query needs only the cells that can hold rows within its radius, by
the triangle inequality; nothing else is pruned, so results are exact. A
(cell) is further cut by id hash into data blocks and query chunks of bounded
size, and each (cell, block, chunk) is one grouped task: no task holds a hot
cell, and a task returns at most a few rows per query, never its pairs.

Where nothing can be pruned, every row travels once per block and once per
chunk. These hold a sixteenth of the rows, so up to ``PIECES * BLOCK_ROWS``
rows what is shuffled grows with the rows alone; beyond, with their square
over ``BLOCK_ROWS``.

Everything that travels by broadcast is bounded by ``MAX_CELLS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.bounds import collect_small, join_dimension
from gradus.session import checkpointed

MAX_CELLS = 1024
#: rows of a data block or a query chunk: a share of 1 / PIECES between these
LEAST_ROWS, BLOCK_ROWS, PIECES = 2048, 1 << 15, 16
#: pairs whose distances are held at once
SLICE_PAIRS = 1 << 20
#: rows and columns of a tile of distances
TILE_ROWS, TILE_COLS = 512, 2048


def matrix(values: pd.Series) -> np.ndarray:
    """A column of equally long arrays as one matrix."""
    if not len(values):
        return np.zeros((0, 0))
    return np.concatenate(values.to_numpy(), dtype=float).reshape(len(values), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fast squared distances; accurate to ``squared_slack``."""
    d2 = a @ (-2.0 * b.T)
    d2 += (a * a).sum(1)[:, None]
    d2 += (b * b).sum(1)[None, :]
    return np.maximum(d2, 0.0, out=d2)


def squared_slack(a: np.ndarray, b: np.ndarray) -> float:
    """Bound on the rounding error of :func:`squared_distances`."""
    top = float((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))
    return 1e-12 * (1.0 + top) * max(1, a.shape[1])


class Tiles:
    """Squared distances between rows of two matrices, a tile at a time, accurate to ``slack``.

    A tile is one product, in single precision if its error is small beside
    ``scale``, the squared distances that matter.
    """

    def __init__(self, q: np.ndarray, d: np.ndarray, scale: float = 0.0):
        # differences don't change when both sides move
        middle = d.mean(0) if len(d) else np.zeros(q.shape[1])
        q, d = q - middle, d - middle
        qq, dd = (q * q).sum(1), (d * d).sum(1)
        top = float(qq.max(initial=0.0) + dd.max(initial=0.0)) + 1e-30
        # rounding of the numbers, of the sums and of a bound that is compared with them
        slack = {kind: 4 * (q.shape[1] + 8) * float(np.finfo(kind).eps) * top for kind in (np.float32, np.float64)}
        kind = np.float32 if top < 1e30 and slack[np.float32] <= 0.01 * scale else np.float64
        self.slack = slack[kind]
        self.q = np.hstack([-2.0 * q, qq[:, None], np.ones((len(q), 1))]).astype(kind)
        self.d = np.ascontiguousarray(np.hstack([d, np.ones((len(d), 1)), dd[:, None]]).astype(kind).T)

    def squared(self, rows: slice, cols: slice) -> np.ndarray:
        return self.q[rows] @ self.d[:, cols]


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


def pair_distances(a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs (a[r], b[c]), some at a time."""
    step = max(1, SLICE_PAIRS // max(1, a.shape[1]))
    out = np.empty(len(r))
    for at in range(0, len(r), step):
        out[at : at + step] = exact_distance(a[r[at : at + step]], b[c[at : at + step]])
    return out


def row_slices(rows: int, width: int, cells: int = SLICE_PAIRS):
    step = max(1, cells // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


@dataclass(frozen=True)
class Cells:
    """Pivots with the number of rows and the distance range of each cell."""

    pivots: np.ndarray
    counts: np.ndarray
    near: np.ndarray
    far: np.ndarray


def cell_count(n: int) -> int:
    return 1 if n <= 2 * LEAST_ROWS else min(MAX_CELLS, max(PIECES, -(-n // BLOCK_ROWS)))


def block_size(n: int) -> int:
    """Rows of a block of a table of ``n`` rows."""
    return min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // PIECES)))


def pick_pivots(data: DataFrame, id_col: str, vec: str, cells: int, seed: int = 7) -> np.ndarray:
    """Rows in hash order; a single cell needs no real pivot."""
    if cells <= 1:
        return np.zeros((1, 1))
    from gradus.operators.outliers import hash_sample

    return np.asarray([r[0] for r in hash_sample(data.select(id_col, vec), id_col, cells, seed).select(vec).collect()], dtype=float)


def place(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` and ``cdist``: nearest pivot and the distance to it."""
    if len(pivots) == 1:
        return df.withColumn("cell", F.lit(0)).withColumn("cdist", F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, cdist double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        p = shared.value
        out = pd.DataFrame({"cell": np.zeros(len(v), dtype="int32"), "cdist": np.zeros(len(v))})
        if len(v):
            x = matrix(v)
            cell = squared_distances(x, p).argmin(1)
            out["cell"], out["cdist"] = cell.astype("int32"), exact_distance(x, p[cell])
        return out

    return df.withColumn("__p", nearest(vec)).withColumn("cell", F.col("__p.cell")).withColumn("cdist", F.col("__p.cdist")).drop("__p")


def summarise_cells(placed: DataFrame, pivots: np.ndarray) -> Cells:
    m = len(pivots)
    if m == 1:
        return Cells(pivots, np.ones(1, dtype=np.int64), np.zeros(1), np.full(1, np.inf))
    counts, near, far = np.zeros(m, dtype=np.int64), np.full(m, np.inf), np.full(m, -np.inf)
    for r in collect_small(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cdist").alias("lo"), F.max("cdist").alias("hi"))):
        counts[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["lo"], r["hi"]
    return Cells(pivots, counts, near, far)


def candidate_cells(queries: DataFrame, vec: str, radius, cells: Cells, k: int = 0) -> DataFrame:
    """Adds ``cells``: those that can hold rows within ``radius``.

    A null radius is replaced by the smallest distance that surely covers ``k``
    rows: cells are taken in the order of their farthest possible member.
    """
    live = cells.counts > 0
    if len(live) == 1:
        return queries.withColumn("cells", F.array(F.lit(0)))
    shared = queries.sparkSession.sparkContext.broadcast((cells, live))

    @F.pandas_udf("array<int>")
    def reach(v: pd.Series, r: pd.Series) -> pd.Series:
        c, ok = shared.value
        out = []
        if len(v):
            d = np.sqrt(squared_distances(matrix(v), c.pivots))
            limits = r.to_numpy(dtype=float)
            slack = 1e-6 * (1.0 + d.max())
            home = np.where(ok[None, :], d, np.inf).min(1)
            worst = d + np.where(ok, c.far, np.inf)[None, :]
            if k:
                order = np.argsort(worst, axis=1)
                covered = np.cumsum(c.counts[order], axis=1) >= k
                first = covered.argmax(1)
                sure = np.where(covered.any(1), np.take_along_axis(worst, np.take_along_axis(order, first[:, None], 1), 1)[:, 0], np.inf)
                limits = np.where(np.isnan(limits), sure, np.minimum(limits, sure))
            low = np.maximum(np.maximum(d - c.far[None, :], c.near[None, :] - d), (d - home[:, None]) / 2)
            keep = ok[None, :] & (low <= limits[:, None] + slack)
            out = [np.flatnonzero(row).astype("int32") for row in keep]
        return pd.Series(out, dtype=object)

    return queries.withColumn("cells", reach(vec, radius))


Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def blocked_join(
    queries: DataFrame, data: DataFrame, qid: str, did: str, kernel: Kernel, schema: str,
    one_block: bool = False, block_rows: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Run ``kernel(queries, data)`` on every bounded (cell, block, chunk).

    Both sides carry ``cell``. A query meets all data blocks of its cell, or
    with ``one_block`` a single one (enough for an upper bound).
    """
    counts = checkpointed(data.groupBy("cell").agg(F.count("*").alias("nd")).join(queries.groupBy("cell").agg(F.count("*").alias("nq")), "cell", "left"))
    if block_rows is None or chunk_rows is None:
        fit = block_size(counts.agg(F.sum("nd")).first()[0] or 0)
        block_rows, chunk_rows = block_rows or fit, chunk_rows or fit
    blocks_of = F.ceil(F.col("nd") / block_rows)
    asked_by = F.coalesce(F.col("nq"), F.lit(0)) / (blocks_of * chunk_rows if one_block else F.lit(chunk_rows))
    sizes = counts.select("cell", blocks_of.cast("int").alias("nb"), F.greatest(F.lit(1), F.ceil(asked_by)).cast("int").alias("nc"))
    with_sizes = lambda df: join_dimension(df, sizes, "cell", "inner")
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    own_block = F.pmod(F.xxhash64(F.lit(11), F.col(qid)), F.col("nb")).cast("int")
    q = with_sizes(queries).withColumn("block", own_block if one_block else F.explode(every))
    q = q.withColumn("chunk", F.pmod(F.xxhash64(F.lit(13), F.col(qid)), F.col("nc")).cast("int")).drop("nb", "nc")
    d = with_sizes(data).withColumn("block", F.pmod(F.xxhash64(F.lit(17), F.col(did)), F.col("nb")).cast("int"))
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).drop("nb", "nc")
    d = d.select(*[F.col(c).alias(c) for c in d.columns])  # fresh column ids: both sides may share a parent
    keys = ["cell", "block", "chunk"]
    empty = pd.DataFrame()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return empty
        return kernel(left, right)

    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(run, schema)


def nearest_in_block(
    q: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, within: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, distance) of the k nearest by (distance, id), distances recomputed exactly.

    Rows farther than ``within``, a distance per query (NaN: none known), may
    be left out; that saves most queries the search for their k-th nearest.
    """
    rows, cols, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    k = min(k, len(d))
    some = squared_distances(q[:64], d[:TILE_COLS])
    tiles = Tiles(q, d, float(np.median(np.partition(some, min(k + 8, some.shape[1] - 1), axis=1)[:, min(k + 8, some.shape[1] - 1)])))
    top = np.full(len(q), np.inf) if within is None else np.where(np.isnan(within), np.inf, within * within)

    def best(s: slice, cut: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of the found pairs, exactly; lowers ``cut`` to the k-th one."""
        r, c, near = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((near, r))
        r, c, near = r[order], c[order], near[order]
        first = np.searchsorted(r, r, side="left")
        last = np.minimum(first + k, np.searchsorted(r, r, side="right")) - 1
        keep = near <= near[last] + 2 * tiles.slack
        r, c = r[keep], c[keep]
        e = pair_distances(q[s], r, d, c)
        order = np.lexsort((d_ids[c], e, r))
        r, c, e = r[order], c[order], e[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        full = place == k - 1
        cut[r[full]] = np.minimum(cut[r[full]], e[full] ** 2 + 2 * tiles.slack)
        return r[place < k], c[place < k], e[place < k]

    for s in row_slices(len(q), 1, TILE_ROWS):
        cut, found, held = top[s] + 2 * tiles.slack, [], 0
        for at in range(0, len(d), TILE_COLS):
            d2 = tiles.squared(s, slice(at, at + TILE_COLS))
            if not at and k <= d2.shape[1]:
                many = np.flatnonzero(np.isinf(cut) | ((d2 <= cut.astype(d2.dtype)[:, None]).sum(1) > 8 * k))
                cut[many] = np.minimum(cut[many], np.partition(d2[many], k - 1, axis=1)[:, k - 1] + 2 * tiles.slack)
            r, c = np.divmod(np.flatnonzero(d2 <= cut.astype(d2.dtype)[:, None]), d2.shape[1])
            found.append((r, c + at, d2[r, c].astype(float)))
            held += len(r)
            if held > SLICE_PAIRS:
                r, c, e = best(s, cut, found)
                found, held = [(r, c, e * e)], len(r)
        r, c, e = best(s, cut, found)
        rows.append(r + s.start)
        cols.append(c)
        dist.append(e)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def within_block(q: np.ndarray, d: np.ndarray, eps: float):
    """Yields the pairs (query rows, data rows) within eps, borderline ones decided exactly."""
    for r, c, _ in levels_in_block(q, d, np.array([eps])):
        yield r, c


def levels_in_block(q: np.ndarray, d: np.ndarray, steps: np.ndarray):
    """Yields (query rows, data rows, place of the least of the rising ``steps`` that the distance keeps to), for pairs within the last one."""
    squares = steps * steps
    tiles = Tiles(q, d, float(squares[0]))
    slack = 2 * tiles.slack
    for s in row_slices(len(q), 1, TILE_ROWS):
        for at in range(0, len(d), TILE_COLS):
            d2 = tiles.squared(s, slice(at, at + TILE_COLS))
            r, c = np.divmod(np.flatnonzero(d2 <= d2.dtype.type(squares[-1] + slack)), d2.shape[1])
            near, c = d2[r, c].astype(float), c + at
            level = np.searchsorted(squares, near)
            edge = np.flatnonzero((np.searchsorted(squares, near - slack) != np.searchsorted(squares, near + slack, side="right")) | (level == len(steps)))
            level[edge] = np.searchsorted(steps, pair_distances(q[s], r[edge], d, c[edge]))
            keep = level < len(steps)
            yield r[keep] + s.start, c[keep], level[keep]
