"""Nearest-neighbour and radius joins and what builds on them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators import blocks as B
from gradus.operators.ordering import global_row_number
from gradus.operators.pivot_tree import MAX_INNER, PivotTree
from gradus.session import checkpointed


def distinct_vectors(df: DataFrame, id_col: str, vec: str, keep: int) -> DataFrame:
    """(rep, vec, n, ids): one row per distinct vector with its ``keep`` smallest ids.

    Copies of one vector would meet pairwise otherwise. The row limit inside
    the window is applied before the shuffle, so a vector with very many copies
    ships ``keep`` ids per task.
    """
    w = Window.partitionBy(vec).orderBy(id_col)
    first = df.select(id_col, vec).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= keep)
    return first.groupBy(vec).agg(F.min(id_col).alias("rep"), F.array_sort(F.collect_list(id_col)).alias("ids"))


def knn_join(
    queries: DataFrame, data: DataFrame, id_col: str, vec: str, k: int, exclude_self: bool = True,
    cells: int | None = None, inner: int | None = None, block_rows: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """(id, neighbor, dist, rank): the k nearest data rows per query row, by (Euclidean distance, id).

    With ``exclude_self`` a row is never its own neighbour (ids compared).
    """
    need = k + 1 if exclude_self else k
    q, asked, tree = _asked(queries, data, id_col, vec, need, cells, inner)
    found = _found_exact(tree, asked, need, block_rows=block_rows, chunk_rows=chunk_rows)
    return _nearest_rows(found, q, asked, k, need, exclude_self)


def _asked(queries: DataFrame, data: DataFrame, id_col: str, vec: str, need: int, cells: int | None, inner: int | None) -> tuple[DataFrame, DataFrame, PivotTree]:
    """The query rows, their distinct vectors and the tree of the distinct data vectors."""
    q = queries.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    d = data.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    asked = q.groupBy("vec").agg(F.min("id").alias("qrep")).persist()
    return q, asked, PivotTree(distinct_vectors(d, "id", "vec", need), "rep", "vec", cells, inner)


FOUND = "qrep bigint, dist double, ids array<bigint>, cell bigint"


def _nearest_kernel(need: int):
    def top(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = left["theta"].to_numpy(dtype=float) if "theta" in left else None
        r, c, e = B.nearest_in_block(B.matrix(left["vec"]), B.matrix(right["vec"]), right["rep"].to_numpy(), need, known)
        return pd.DataFrame({"qrep": left["qrep"].to_numpy()[r], "dist": e, "ids": right["ids"].to_numpy()[c], "cell": right["cell"].to_numpy()[c]})

    return top


def _found_exact(tree: PivotTree, asked: DataFrame, need: int, **sizes) -> DataFrame:
    """The nearest of every block that can hold one of the ``need`` nearest."""

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right) < need:
            return pd.DataFrame({"qrep": left["qrep"], "theta": np.nan})
        r, _, e = B.nearest_in_block(B.matrix(left["vec"]), B.matrix(right["vec"]), right["rep"].to_numpy(), need)
        return pd.DataFrame({"qrep": left["qrep"].to_numpy()[r], "theta": e}).groupby("qrep", as_index=False)["theta"].max()

    base = tree.placed.drop("cdist", "top")
    if tree.one:
        spread = asked.withColumn("cell", F.lit(0).cast("long"))
    else:
        theta = B.blocked_join(tree.home(asked, "qrep"), base, "qrep", "rep", bound, "qrep bigint, theta double", one_block=True, **sizes)
        spread = tree.reach(asked.join(theta, "qrep", "left"), "qrep", F.col("theta"), need)
    return B.blocked_join(spread, base, "qrep", "rep", _nearest_kernel(need), FOUND, **sizes)


def _best(found: DataFrame, need: int) -> DataFrame:
    """(qrep, dist, nid, cell): the ``need`` nearest rows per query vector."""
    pick = Window.partitionBy("qrep").orderBy("dist", "nid")
    members = found.select("qrep", "dist", F.explode("ids").alias("nid"), "cell")
    return members.withColumn("__k", F.row_number().over(pick)).filter(F.col("__k") <= need).drop("__k")


def _nearest_rows(found: DataFrame, q: DataFrame, asked: DataFrame, k: int, need: int, exclude_self: bool) -> DataFrame:
    """From the best of every block to the k nearest of every query row."""
    ranked = _best(found, need)
    lists = ranked.groupBy("qrep").agg(F.array_sort(F.collect_list(F.struct("dist", "nid"))).alias("near"))
    per_vector = asked.join(lists, "qrep").select("vec", "near")
    rows = q.join(per_vector, "vec")
    own = F.filter("near", lambda s: s["nid"] != F.col("id")) if exclude_self else F.col("near")
    return rows.select("id", F.posexplode(F.slice(own, 1, k)).alias("pos", "n")).select(
        F.col("id"), F.col("n.nid").alias("neighbor"), F.col("n.dist").alias("dist"), (F.col("pos") + 1).alias("rank")
    )


@dataclass(frozen=True)
class ApproximateNeighbors:
    """``rows`` as from :func:`knn_join`; a query looked into its ``probes`` nearest cells below its ``tops`` nearest first-level ones.

    ``recall`` is the share of true neighbours that lie there, measured on the sampled queries.
    """

    rows: DataFrame
    recall: float
    probes: int
    tops: int


def knn_join_approximate(
    queries: DataFrame, data: DataFrame, id_col: str, vec: str, k: int, recall: float = 0.95, sample: int = 256, exclude_self: bool = True,
    cells: int | None = None, inner: int | None = None, block_rows: int | None = None, chunk_rows: int | None = None,
) -> ApproximateNeighbors:
    """Nearest neighbours from the cells with the nearest pivots; distances are exact, a neighbour in another cell is missed.

    ``sample`` queries, drawn by hash, are answered exactly first. The cells of
    their true neighbours say how many cells must be looked into for
    ``recall`` (two standard errors of the sample are added to it); the rest of
    the work grows with queries x cells looked into x rows of a cell. A query
    whose cells hold too few rows is answered exactly.
    """
    from gradus.operators.outliers import hash_sample

    need = k + 1 if exclude_self else k
    sizes = {"block_rows": block_rows, "chunk_rows": chunk_rows}
    q, asked, tree = _asked(queries, data, id_col, vec, need, cells, inner)
    if tree.one:
        return ApproximateNeighbors(_nearest_rows(_found_exact(tree, asked, need, **sizes), q, asked, k, need, exclude_self), 1.0, 1, 1)
    drawn = checkpointed(hash_sample(asked, "qrep", sample, 29))
    truth = checkpointed(_best(_found_exact(tree, drawn, need, **sizes), need).select("qrep", "cell", F.floor(F.col("cell") / (MAX_INNER if tree.two else 1)).cast("int").alias("top")))
    total = truth.count()
    enough = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / max(total, 1)))

    def smallest(places: DataFrame, share: float) -> tuple[int, float]:
        """The least number of places that holds ``share`` of the true neighbours, and what it holds."""
        seen, most = 0, 0
        for row in places.groupBy("place").count().orderBy("place").collect():  # at most a place per cell of a query
            seen, most = seen + row["count"], row["place"]
            if seen >= share * total:
                break
        return most + 1, seen / total if total else 1.0

    by_top = tree.ranked_tops(drawn, len(tree.pivots)).select("qrep", "top", "place")
    tops, _ = smallest(truth.join(by_top, ["qrep", "top"]), enough + (1 - enough) / 2 if tree.two else enough)
    by_cell = tree.ranked(drawn, "qrep", tops, MAX_INNER).select("qrep", "cell", "place")
    probes, held = smallest(truth.join(by_cell, ["qrep", "cell"]), enough)
    spread = checkpointed(tree.ranked(asked, "qrep", tops, probes).drop("place"))
    base = tree.placed.drop("cdist", "top")
    found = checkpointed(B.blocked_join(spread, base, "qrep", "rep", _nearest_kernel(need), FOUND, **sizes))
    whole = found.groupBy("qrep").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") >= need)
    short = checkpointed(asked.join(whole, "qrep", "left_anti"))
    if not short.isEmpty():
        found = found.join(short, "qrep", "left_anti").unionByName(_found_exact(tree, short, need, **sizes))
    return ApproximateNeighbors(_nearest_rows(found, q, asked, k, need, exclude_self), held, probes, tops)


def eps_join(
    df: DataFrame, id_col: str, vec: str, eps: float, cells: int | None = None, inner: int | None = None,
    block_rows: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """(id_a, id_b, dist): pairs with id_a < id_b within ``eps``. The pairs are the result; clustering does not use this."""
    d = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    tree = PivotTree(d, "id", "vec", cells, inner)

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, x = B.matrix(left["vec"]), B.matrix(right["vec"])
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        out = []
        for r, c in B.within_block(q, x, eps):
            once = a[r] < b[c]
            r, c = r[once], c[once]
            out.append(pd.DataFrame({"id_a": a[r], "id_b": b[c], "dist": B.pair_distances(q, r, x, c)}))
        return pd.concat(out)

    spread = tree.reach(tree.placed.select("id", "vec"), "id", F.lit(float(eps)))
    return B.blocked_join(
        spread, tree.placed.drop("cdist", "top"), "id", "id", pairs, "id_a bigint, id_b bigint, dist double",
        block_rows=block_rows, chunk_rows=chunk_rows,
    )


def k_distance_curve(df: DataFrame, id_col: str, vec: str, k: int, **opts) -> DataFrame:
    """Distance to the k-th neighbour of every row, in ascending order with its place."""
    far = knn_join(df, df, id_col, vec, k, **opts).groupBy("id").agg(F.max("dist").alias("k_distance"))
    return global_row_number(far, [F.col("k_distance"), F.col("id")], "place")


def outlier_lof(df: DataFrame, id_col: str, vec: str, k: int = 20, contamination: float | str = "auto", **opts) -> DataFrame:
    """Local outlier factor; every step after the neighbour join is an aggregation or an equi-join on ids."""
    from gradus.operators.outliers import flag_highest

    near = knn_join(df, df, id_col, vec, k, **opts).select("id", "neighbor", "dist").persist()
    kdist = near.groupBy("id").agg(F.max("dist").alias("kd"))
    reach = near.join(kdist.withColumnRenamed("id", "neighbor"), "neighbor").select(
        "id", "neighbor", F.greatest("dist", "kd").alias("reach")
    )
    density = reach.groupBy("id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = density.select(F.col("id").alias("neighbor"), F.col("lrd").alias("other"))
    ratio = near.join(other, "neighbor").groupBy("id").agg(F.avg("other").alias("mean_other"))
    scored = ratio.join(density, "id").select(F.col("id").alias(id_col), (F.col("mean_other") / F.col("lrd")).alias("score")).persist()
    return flag_highest(scored, "score", contamination)


def neighbour_weight(dist: Column, zero_seen: Column, weights: str) -> Column:
    """1 for uniform votes; else 1/d, where exact matches silence all others."""
    if weights == "uniform":
        return F.lit(1.0)
    return F.when(zero_seen, (dist == 0).cast("double")).otherwise(1.0 / F.nullif(dist, F.lit(0.0)))


def knn_classifier(
    train: DataFrame, test: DataFrame, id_col: str, vec: str, y: str, k: int = 5, weights: str = "uniform", **opts
) -> DataFrame:
    """(id, prediction, confidence): vote of the k nearest training rows, smallest class on ties."""
    near = knn_join(test, train, id_col, vec, k, exclude_self=False, **opts)
    labels = train.select(F.col(id_col).alias("neighbor"), F.col(y).alias("label"))
    voted = near.join(labels, "neighbor")
    zero = F.max(F.col("dist") == 0).over(Window.partitionBy("id"))
    voted = voted.withColumn("w", neighbour_weight(F.col("dist"), zero, weights))
    sums = voted.groupBy("id", "label").agg(F.sum("w").alias("w"))
    return sums.groupBy("id").agg(
        F.max_by("label", F.struct("w", (-F.col("label")).alias("o"))).alias("prediction"),
        (F.max("w") / F.sum("w")).alias("confidence"),
    ).withColumnRenamed("id", id_col)


def _block_donors(q: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, first: int = 64):
    """Yields (query rows, positions, data rows, distances): for every missing element the ``k`` nearest rows that have it, by (distance, id).

    All distances come from matrix products in single precision; those of up to
    ``first`` nearest rows of a query are computed again exactly. They answer a
    missing element if ``k`` of them have it and are surely nearer than the
    rest; else the query is compared with all rows exactly.
    """
    dim = q.shape[1]
    mq, mx = ~np.isnan(q), ~np.isnan(x)
    zq, zx = np.nan_to_num(q), np.nan_to_num(x)
    # differences don't change when both sides move
    seen = mx.sum(0)
    middle = np.divide(zx.sum(0), seen, out=np.zeros(dim), where=seen > 0)
    cq, cx = np.where(mq, q - middle, 0.0), np.where(mx, x - middle, 0.0)
    top = (cq * cq).sum(1).max(initial=0.0) + (cx * cx).sum(1).max(initial=0.0)
    slack = 1e-6 * top * dim
    sides = np.hstack([cq * cq, -2.0 * cq, mq]).astype(np.float32), np.ascontiguousarray(np.hstack([mx, cx, cx * cx]).astype(np.float32).T)
    both = mq.astype(np.float32), np.ascontiguousarray(mx.astype(np.float32).T)
    # the rank in the first tile that leaves somewhat more than ``first`` of all rows
    rank = min(len(x), B.TILE_COLS, first * min(len(x), B.TILE_COLS) // max(1, len(x)) + 2)

    def squared(s: slice, cols: slice) -> np.ndarray:
        shared = both[0][s] @ both[1][:, cols]
        d2 = np.maximum(sides[0][s] @ sides[1][:, cols], 0.0)
        d2 *= dim
        with np.errstate(divide="ignore", invalid="ignore"):
            d2 /= shared
        d2[shared == 0] = np.inf
        return d2

    def nearest(s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of the rows, a matrix; which of them are real; a distance that none of the others lies within."""
        found, limit = [], None
        for at in range(0, len(x), B.TILE_COLS):
            d2 = squared(s, slice(at, at + B.TILE_COLS))
            if limit is None:
                limit = np.partition(d2, rank - 1, axis=1)[:, rank - 1] if rank < len(x) else np.full(len(d2), np.inf, np.float32)
            r, c = np.divmod(np.flatnonzero((d2 <= limit[:, None]) & np.isfinite(d2)), d2.shape[1])
            found.append((r, c + at, d2[r, c]))
            if sum(len(f[0]) for f in found) > B.SLICE_PAIRS or at + B.TILE_COLS >= len(x):
                r, c, near = (np.concatenate(v) for v in zip(*found))
                order = np.lexsort((near, r))
                r, c, near = r[order], c[order], near[order]
                place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                last = place == first
                limit[r[last]] = near[last]
                keep = place < first
                r, c, place = r[keep], c[keep], place[keep]
                found = [(r, c, near[keep])]
        width = int(place.max(initial=-1)) + 1
        cand, real = np.zeros((len(limit), width), np.int64), np.zeros((len(limit), width), bool)
        cand[r, place], real[r, place] = c, True
        return cand, real, limit.astype(float)

    def exact(rows: np.ndarray, cand: np.ndarray) -> np.ndarray:
        shared = mq[rows][:, None, :] & mx[cand]
        diff = np.where(shared, zq[rows][:, None, :] - zx[cand], 0.0)
        n = shared.sum(2)
        return np.sqrt(np.divide((diff * diff).sum(2) * dim, n, out=np.full(n.shape, np.inf), where=n > 0))

    for s in B.row_slices(len(q), 1, B.TILE_ROWS):
        cand, real, limit = nearest(s)
        rows, rest = np.arange(s.start, s.start + len(cand)), limit - slack * dim
        dist = np.concatenate([exact(rows[at : at + 64], cand[at : at + 64]) for at in range(0, len(rows), 64)])
        dist[~real] = np.inf
        order = np.lexsort((x_ids[cand], dist), axis=1)
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        at, pos = np.nonzero(~mq[s])
        has = mx[cand[at], pos[:, None]] & np.isfinite(dist[at])
        pick = has & (np.cumsum(has, axis=1) <= k)
        last = np.where(pick, dist[at], 0.0).max(1, initial=0.0)
        sure = np.isinf(limit)[at] | ((pick.sum(1) == k) & (last * last < rest[at]))
        g, c = np.nonzero(pick & sure[:, None])
        yield rows[at[g]], pos[g], cand[at[g], c], dist[at[g], c]
        for i in np.unique(at[~sure]):
            far = np.concatenate([exact(rows[i : i + 1], np.arange(lo, min(lo + 16384, len(x)))[None, :])[0] for lo in range(0, len(x), 16384)])
            every = np.lexsort((x_ids, far))
            every = every[np.isfinite(far[every])]
            for j in pos[~sure & (at == i)]:
                own = every[mx[every, j]][:k]
                yield np.full(len(own), rows[i]), np.full(len(own), j), own, far[own]


def impute_knn(
    df: DataFrame, id_col: str, vec: str, dim: int, k: int = 5, name: str = "imputed",
    block_rows: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Null elements become the 1/d-weighted mean of the k nearest rows that have the element.

    The distance uses the coordinates both rows have, rescaled to all
    coordinates. It obeys no triangle inequality, so no cell can be skipped and
    the work is (distinct rows with nulls) x (distinct rows); each block task
    returns k donors per missing element. Elements without a donor take the
    column mean.
    """
    from gradus.functions.arrays import fill_array
    from gradus.operators.features import fit_block

    d = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    known = d.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).persist()
    gaps = known.filter(F.exists("vec", lambda x: x.isNull())).select(F.col("rep").alias("qrep"), "vec")

    def donors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, copies = left["qrep"].to_numpy(), right["rep"].to_numpy(), right["n"].to_numpy()
        x = B.matrix(right["vec"])
        found = [(a[i], j, b[c], copies[c], dist, x[c, j]) for i, j, c, dist in _block_donors(B.matrix(left["vec"]), x, b, k)]
        return pd.DataFrame({name: np.concatenate(v) for name, v in zip(("qrep", "pos", "rep", "n", "dist", "value"), zip(*found))})

    found = B.blocked_join(
        gaps.withColumn("cell", F.lit(0)), known.withColumn("cell", F.lit(0)), "qrep", "rep", donors,
        "qrep bigint, pos int, rep bigint, n bigint, dist double, value double", block_rows=block_rows, chunk_rows=chunk_rows,
    )
    w = Window.partitionBy("qrep", "pos").orderBy("dist", "rep")
    near = found.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k)
    # copies of a donor count one by one until k rows are used
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = near.withColumn("__used", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - before))).filter("__used > 0")
    sums = used.groupBy("qrep", "pos").agg(
        (F.sum(F.when(F.col("dist") == 0, F.col("__used") * F.col("value"))) / F.sum(F.when(F.col("dist") == 0, F.col("__used")))).alias("same"),
        (F.sum(F.col("__used") * F.col("value") / F.nullif(F.col("dist"), F.lit(0.0)))
         / F.sum(F.col("__used") / F.nullif(F.col("dist"), F.lit(0.0)))).alias("near"),
    )
    fills = sums.groupBy("qrep").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("same", "near").alias("v")))).alias("fills"))
    per_vector = gaps.join(fills, "qrep", "left").select("vec", "fills")
    mean = fit_block(d, "vec", dim).mean
    has_gap = F.exists("vec", lambda x: x.isNull())
    complete = d.filter(~has_gap).withColumn("fills", F.lit(None).cast("map<int,double>"))
    holed = d.filter(has_gap).join(per_vector, "vec", "left")
    merged = complete.unionByName(holed.select("id", "vec", "fills"))
    filled = F.transform("vec", lambda x, i: F.coalesce(x, F.try_element_at("fills", i)))
    return merged.select(F.col("id").alias(id_col), fill_array(filled, mean).alias(name))
