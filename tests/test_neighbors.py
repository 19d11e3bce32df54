"""Blocked joins with many tiny cells, blocks and chunks, against brute force; with hot copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.operators import density, mutual_info, neighbors, quality

TINY = {"cells": 9, "block_rows": 40, "chunk_rows": 30}
ONE = {"cells": 1}
TWO = {"cells": 4, "inner": 3, "block_rows": 40, "chunk_rows": 30}


def points(n=300, dim=3, seed=1, copies=100):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.3, size=(n // 3, dim)) for c in (0.0, 2.0, 4.0)])
    x[:copies] = x[0]  # a third of the rows are copies of one vector
    return x


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>").cache()


def distances(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("opts", [TINY, ONE, TWO])
def test_knn_join(spark, opts):
    x = points()
    df = table(spark, x)
    got = neighbors.knn_join(df, df, "id", "v", 5, **opts).toPandas()
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {i: sorted(zip(d[i], range(len(x))))[:5] for i in range(len(x))}
    assert len(got) == 5 * len(x)
    for i, g in got.sort_values("rank").groupby("id"):
        assert g["neighbor"].tolist() == [j for _, j in want[i]]
        assert np.allclose(g["dist"], [v for v, _ in want[i]], atol=1e-12)


def test_knn_join_other_table(spark):
    x = points(seed=2, copies=0)
    q, d = table(spark, x[::4]), table(spark, x)
    got = neighbors.knn_join(q, d, "id", "v", 3, exclude_self=False, **TINY).toPandas()
    dist = distances(x[::4], x)
    for i, g in got.sort_values("rank").groupby("id"):
        assert g["neighbor"].tolist() == np.argsort(dist[i], kind="stable")[:3].tolist()


@pytest.mark.parametrize("opts", [TINY, ONE, TWO])
def test_eps_join(spark, opts):
    x = points(copies=20)
    got = neighbors.eps_join(table(spark, x), "id", "v", 0.4, **opts).toPandas()
    d = distances(x, x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 0.4}
    assert set(zip(got["id_a"], got["id_b"])) == want and len(got) == len(want)


def brute_dbscan(x, eps, m):
    near = distances(x, x) <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                u = todo.pop()
                for v in np.flatnonzero(near[u]):
                    if core[v] and label[v] < 0:
                        label[v] = n
                        todo.append(v)
            n += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        found = [label[j] for j in np.flatnonzero(near[i]) if core[j]]
        out[i] = min(found) if found else -1
    return out, core


@pytest.mark.parametrize("opts", [TINY, ONE, TWO])
def test_dbscan(spark, opts):
    x = points(copies=90)
    got = density.dbscan(table(spark, x), "id", "v", 0.35, 5, **opts).toPandas().sort_values("id")
    label, core = brute_dbscan(x, 0.35, 5)
    assert got["cluster"].tolist() == label.tolist() and got["is_core"].tolist() == core.tolist()


@pytest.mark.parametrize("opts", [TINY, ONE, TWO])
def test_neighbour_table_answers_every_setting(spark, opts):
    x = points(copies=40)
    epses, min_ptses = [0.45, 0.2, 0.3, 0.35], [3, 5, 45]
    table_of = density.NeighbourTable(density.EpsGraph(table(spark, x), "id", "v", **opts), epses, min_ptses)
    got = table_of.clusters().toPandas().sort_values("id")
    assert len(got) == len(x) * len(epses) * len(min_ptses)
    for eps in epses:
        for m in min_ptses:
            label, core = brute_dbscan(x, eps, m)
            one = got[(got["eps"] == eps) & (got["min_pts"] == m)]
            assert one["cluster"].tolist() == label.tolist() and one["is_core"].tolist() == core.tolist()


def test_search_scores(spark):
    x = points(copies=0)
    df = table(spark, x)
    squared = density.dbscan_search(df, "id", "v", [0.3, 0.5], [4]).toPandas().set_index("eps")
    plain = density.dbscan_search(df, "id", "v", [0.3, 0.5], [4], score="euclidean", **TWO).toPandas().set_index("eps")
    for eps in (0.3, 0.5):
        label, _ = brute_dbscan(x, eps, 4)
        kept, y = x[label >= 0], label[label >= 0]
        for got, d in ((squared, distances(kept, kept) ** 2), (plain, distances(kept, kept))):
            s = []
            for i in range(len(kept)):
                own = y == y[i]
                a, b = d[i, own].sum() / max(own.sum() - 1, 1), min(d[i, y == c].mean() for c in set(y) - {y[i]})
                s.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
            assert np.isclose(got.loc[eps, "silhouette"], np.mean(s), atol=1e-9)
            assert got.loc[eps, "n_clusters"] == label.max() + 1 and np.isclose(got.loc[eps, "noise_percent"], 100 * (label < 0).mean())


@pytest.mark.parametrize("opts", [TINY, TWO, ONE])
def test_approximate_neighbours_reach_the_recall(spark, opts):
    x = points(n=600, seed=5, copies=100)
    df = table(spark, x)
    found = neighbors.knn_join_approximate(df, df, "id", "v", 5, recall=0.9, sample=60, **opts)
    got, exact = found.rows.toPandas(), neighbors.knn_join(df, df, "id", "v", 5).toPandas()
    assert len(got) == len(exact) == 5 * len(x)
    both = got.merge(exact, on=["id", "neighbor"])
    assert len(both) >= 0.9 * len(exact) and found.recall >= 0.9 and np.allclose(both["dist_x"], both["dist_y"])
    assert opts is ONE or found.probes < opts["cells"] * opts.get("inner", 1)


def test_more_neighbours_than_a_cell_holds(spark):
    x = points(n=60, copies=0)
    df = table(spark, x)
    found = neighbors.knn_join_approximate(df, df, "id", "v", 40, recall=0.1, sample=10, cells=20, block_rows=40, chunk_rows=30)
    assert found.rows.count() == 40 * 60


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    out = density.connected_components(spark.createDataFrame(chain + star, "a bigint, b bigint")).toPandas()
    got = dict(zip(out["node"], out["component"]))
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 80))


def test_lof_and_knn_classifier(spark):
    x = np.vstack([points(seed=4, copies=0), [[30.0, 30.0, 30.0]]])
    df = table(spark, x)
    out = neighbors.outlier_lof(df, "id", "v", 10, 0.01, **TINY).toPandas().set_index("id")
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = np.array([1 / (np.maximum(kd[near[i]], d[i, near[i]]).mean() + 1e-10) for i in range(len(x))])
    lof = np.array([lrd[near[i]].mean() / lrd[i] for i in range(len(x))])
    assert np.allclose(out.loc[range(len(x)), "score"], lof) and out.loc[300, "is_outlier"]
    labelled = df.join(spark.createDataFrame([(i, i // 100) for i in range(300)], "id bigint, y int"), "id")
    pred = neighbors.knn_classifier(labelled, labelled, "id", "v", "y", 5, "distance", **TINY).toPandas()
    assert (pred["prediction"] == pred["id"] // 100).mean() > 0.95 and (pred["confidence"] <= 1 + 1e-12).all()


def test_impute_knn(spark):
    rng = np.random.default_rng(8)
    x = points(n=90, dim=4, copies=0)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:6] = x[0] = [1.0, np.nan, 0.5, 2.0]  # equal rows with the same gap
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = neighbors.impute_knn(df, "id", "v", 4, 5, block_rows=20, chunk_rows=15).toPandas().set_index("id")["imputed"]
    mean = np.nanmean(x, axis=0)
    for i in range(len(x)):
        ok = ~np.isnan(x)
        both = ok & ok[i]
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.sqrt(np.where(both, (x - x[i]) ** 2, 0).sum(1) * 4 / both.sum(1))
        for j in range(4):
            if ok[i, j]:
                assert got[i][j] == x[i, j]
                continue
            donors = [k for k in np.lexsort((np.arange(len(x)), d)) if ok[k, j] and not np.isnan(d[k])][:5]
            dd = d[donors]
            w = (dd == 0).astype(float) if (dd == 0).any() else 1 / dd
            want = (w * x[donors, j]).sum() / w.sum() if len(donors) else mean[j]
            assert np.isclose(got[i][j], want, atol=1e-9)


def test_tiles_keep_the_nearest_and_the_borders():
    from gradus.operators import blocks as B

    rng = np.random.default_rng(12)
    grid = rng.integers(0, 3, (2600, 3)).astype(float)
    for x in (grid, rng.normal(size=(2600, 5)), rng.normal(size=(2600, 2)) * 1e-4 + 1e5, rng.normal(size=(300, 4)) * 1e20, rng.normal(size=(3, 4))):
        ids, q = rng.permutation(len(x)), x[:40]
        d = np.sqrt(((q[:, None, :] - x[None]) ** 2).sum(2))
        near = np.array([np.lexsort((ids, row))[:5] for row in d])
        limits = np.where(np.arange(len(q)) % 2, np.nan, np.take_along_axis(d, near, 1)[:, -1])
        for within in (None, limits):
            r, c, e = B.nearest_in_block(q, x, ids, 5, within)
            assert (c.reshape(near.shape) == near).all() and (e == d[r, c]).all()
        steps = np.unique(np.quantile(d, [0.1, 0.4]))
        r, c, level = (np.concatenate(v) for v in zip(*B.levels_in_block(q, x, steps)))
        assert len(r) == (d <= steps[-1]).sum() and (level == np.searchsorted(steps, d[r, c])).all()
    wide = B.Tiles(rng.normal(size=(2, 3)), rng.normal(size=(9, 3)), 1.0)
    assert wide.squared(slice(0, 2), slice(0, 9)).dtype == np.float32


def test_donors_are_the_nearest_over_several_tiles():
    rng = np.random.default_rng(14)
    for x in (rng.normal(size=(5000, 6)), rng.integers(0, 3, (2600, 4)).astype(float)):
        x[rng.random(x.shape) < 0.4] = np.nan
        ids, q = rng.permutation(len(x)), x[:30]
        got = {}
        for i, j, c, e in neighbors._block_donors(q, x, ids, 3):
            for a, b, row, dist in zip(i, j, c, e):
                got.setdefault((int(a), int(b)), []).append((dist, int(ids[row])))
        both = ~np.isnan(q)[:, None] & ~np.isnan(x)[None]
        n = both.sum(2)
        gap = np.where(both, np.nan_to_num(q)[:, None] - np.nan_to_num(x)[None], 0.0)
        d = np.sqrt(np.where(n > 0, (gap * gap).sum(2) * x.shape[1] / np.maximum(n, 1), np.inf))
        for i, j in zip(*np.nonzero(np.isnan(q))):
            own = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(d[i]))
            want = sorted(zip(d[i, own], ids[own].tolist()))[:3]
            assert np.allclose([v for v, _ in sorted(got.get((i, j), []))], [v for v, _ in want]) and len(got.get((i, j), [])) == len(want)


def test_cluster_benchmark_shares_the_distances(spark, monkeypatch):
    from gradus.operators import blocks as B
    from gradus.operators import clustering

    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(c, 0.5, size=(30, 2)) for c in (0.0, 2.0, 5.0)])
    df, joins, plain = table(spark, x), [], B.blocked_join
    monkeypatch.setattr(B, "blocked_join", lambda *a, **k: joins.append(1) or plain(*a, **k))
    label = lambda c: lambda d: d.withColumn("cluster", c)
    found = clustering.cluster_benchmark(df, "id", "v", {
        "thirds": label((F.col("id") / 30).cast("int")), "halves": label(F.when(F.col("id") < 45, 0).otherwise(1)), "odd": label((F.col("id") % 3).cast("int")),
        "some": label(F.when(F.col("id") < 60, F.col("id") % 2).otherwise(-1)),
    }).toPandas().set_index("algorithm")["silhouette"]
    assert len(joins) == 2
    for name, c, n in (("thirds", np.arange(90) // 30, 90), ("halves", (np.arange(90) >= 45) * 1, 90), ("odd", np.arange(90) % 3, 90), ("some", np.arange(60) % 2, 60)):
        d, s = np.sqrt(((x[:n, None] - x[None, :n]) ** 2).sum(2)), []
        for i in range(n):
            a = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
            b = min(d[i][c == o].mean() for o in set(c) - {c[i]})
            s.append((b - a) / max(a, b))
        assert np.isclose(found[name], np.mean(s), atol=1e-9)


def test_silhouette_blocks(spark):
    x = points(copies=60)
    y = np.repeat([0, 1, 2], 100)
    df = table(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id bigint, c int"), "id")
    got = quality.silhouette(df, "id", "v", "c", block_rows=50, chunk_rows=40).first()["silhouette"]
    d = distances(x, x)
    s = []
    for i in range(len(x)):
        a = d[i, y == y[i]].sum() / 99
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    assert np.isclose(got, np.mean(s), atol=1e-9)


@pytest.mark.parametrize("max_rows", [60, 10**6])
def test_neighbour_mutual_information(spark, max_rows):
    rng = np.random.default_rng(2)
    n = 240
    y = rng.integers(0, 3, n)
    x = np.stack([rng.normal(size=n), y + 0.3 * rng.normal(size=n)], 1)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "id bigint, v array<double>, y int")
    got = mutual_info.mutual_info_neighbour(df, "id", "v", "y", 3, max_rows)
    psi = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, m))
    for j in range(2):
        total = 0.0
        for i in range(n):
            d = np.abs(x[:, j] - x[i, j])
            same = np.sort(d[(y == y[i]) & (np.arange(n) != i)])[2]
            total += psi(max(1, int((d < same).sum())))
        want = psi(n) + psi(3) - np.mean([psi(int((y == c).sum())) for c in y]) - total / n
        assert np.isclose(got[j], max(0.0, want), atol=1e-6)


def test_rows_travel_a_bounded_number_of_times():
    from gradus.operators import blocks

    for n in (100_000, 500_000):
        assert n / blocks.block_size(n) <= 16 and blocks.cell_count(n) == 16
    assert blocks.block_size(10**8) == blocks.BLOCK_ROWS and blocks.block_size(10) == blocks.LEAST_ROWS


def test_donors_of_a_block_are_those_of_all_distances():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(300, 6)), np.round(rng.normal(size=(300, 6))), rng.normal(size=(300, 6)) * 1e6 + 1e9, rng.normal(size=(7, 6))):
        x[rng.random(x.shape) < 0.3] = np.nan
        ids, q = rng.permutation(len(x)), x[:60]
        got = set()
        for rows, pos, at, _ in neighbors._block_donors(q, x, ids, 5, first=32):
            got |= set(zip(rows.tolist(), pos.tolist(), at.tolist()))
        want = set()
        for i, row in enumerate(q):
            both = ~np.isnan(row) & ~np.isnan(x)
            d = np.sqrt(np.where(both, np.nan_to_num(row) - np.nan_to_num(x), 0.0).__pow__(2).sum(1) * 6 / np.maximum(both.sum(1), 1))
            order = [c for c in np.lexsort((ids, d)) if both[c].any()]
            want |= {(i, int(j), int(c)) for j in np.flatnonzero(np.isnan(row)) for c in [c for c in order if not np.isnan(x[c, j])][:5]}
        assert got == want


def test_forest_of_a_block_keeps_the_components_of_every_level():
    rng = np.random.default_rng(5)
    a, b, level = rng.integers(0, 80, 400), rng.integers(0, 80, 400), rng.integers(0, 4, 400)
    kept = density._forest(a, b, level, 80)

    def parts(at, top):
        label = np.arange(80)
        for u, v in zip(a[at][level[at] <= top], b[at][level[at] <= top]):
            label[label == max(label[u], label[v])] = min(label[u], label[v])
        return label.tolist()

    assert len(kept) < 80 and all(parts(kept, t) == parts(np.arange(400), t) for t in range(4))
    forests = density._Forests(np.arange(80), np.arange(80), most=0)
    for i in range(0, 400, 10):
        forests.add(a[i : i + 10], b[i : i + 10], level[i : i + 10])
    assert len(forests.edges()[0]) < 80
