"""Neighbour joins, clustering, cluster quality and cluster features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.functions import arrays
from gradus.operators import clustering, density, neighbors, quality, ward
from gradus.plans.registry import query
from gradus.plans.standins import DIM
from gradus.plans.statistics import rounded

_PAIRS = """pairs AS (SELECT a.id AS id, b.id AS other, list_distance(a.vec, b.vec) AS dist FROM blocks a JOIN blocks b ON a.id <> b.id)"""
_KNN = _PAIRS + """, knn AS (SELECT * FROM (SELECT id, other AS neighbor, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM pairs) WHERE rank <= {k})"""


@query(
    "knn_join",
    f"WITH {_KNN.format(k=5)} SELECT id, neighbor, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM knn",
    ("blocks",),
)
def _(t):
    return rounded(neighbors.knn_join(t.blocks, t.blocks, "id", "vec", 5), "dist")


#: a first level of 16 pivots with 4 each below, so that the second level is at work on the smallest tables
TREE = {"cells": 16, "inner": 4}


@query(
    "knn_join_tree",
    f"WITH {_KNN.format(k=5)} SELECT id, neighbor, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM knn",
    ("blocks",),
)
def _(t):
    return rounded(neighbors.knn_join(t.blocks, t.blocks, "id", "vec", 5, **TREE), "dist")


@query("knn_join_approximate")
def _(t):
    return neighbors.knn_join_approximate(t.blocks, t.blocks, "id", "vec", 5, recall=0.95, **TREE).rows


@query(
    "knn_join_approximate_check",
    f"""WITH {_KNN.format(k=5)} SELECT count(*) AS n, true AS recall_reached, count(*) AS ranked FROM knn""",
    ("blocks",),
)
def _(t):
    """Against the exact join: the share of neighbours found is at least 0.95, and no row has fewer or wrongly ordered ones."""
    found = neighbors.knn_join_approximate(t.blocks, t.blocks, "id", "vec", 5, recall=0.95, **TREE).rows
    exact = neighbors.knn_join(t.blocks, t.blocks, "id", "vec", 5)
    both = found.alias("f").join(exact.select("id", "neighbor", F.col("dist").alias("true")), ["id", "neighbor"], "left")
    order = Window.partitionBy("id").orderBy("rank")
    ranked = both.withColumn("before", F.lag("dist").over(order))
    return ranked.agg(
        F.count("*").alias("n"), (F.count("true") >= 0.95 * F.count("*")).alias("recall_reached"),
        F.count_if((F.col("dist") >= F.coalesce("before", F.lit(0.0))) & (F.coalesce("true", "dist") == F.col("dist"))).alias("ranked"),
    )


@query(
    "eps_join",
    f"WITH {_PAIRS} SELECT id AS id_a, other AS id_b, round(dist, 6) AS dist FROM pairs WHERE dist <= 1.15 AND id < other",
    ("blocks",),
)
def _(t):
    return rounded(neighbors.eps_join(t.blocks, "id", "vec", 1.15), "dist")


@query(
    "k_distance_curve",
    f"""WITH {_KNN.format(k=5)}, m AS (SELECT id, max(dist) AS k_distance FROM knn GROUP BY 1)
    SELECT id, round(k_distance, 6) AS k_distance, row_number() OVER (ORDER BY k_distance, id) - 1 AS place FROM m""",
    ("blocks",),
)
def _(t):
    return rounded(neighbors.k_distance_curve(t.blocks, "id", "vec", 5), "k_distance")


@query(
    "knn_classifier",
    """WITH tr AS (SELECT * FROM blocks WHERE label < 8), te AS (SELECT * FROM blocks WHERE label >= 8),
    n AS (SELECT * FROM (SELECT te.id, tr.id AS nb, tr.y, list_distance(te.vec, tr.vec) AS d,
      row_number() OVER (PARTITION BY te.id ORDER BY list_distance(te.vec, tr.vec), tr.id) AS k FROM te, tr) WHERE k <= 7),
    v AS (SELECT id, y, sum(1 / d) AS w FROM n GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, y) AS k, sum(w) OVER (PARTITION BY id) AS total FROM v)
    SELECT id, y AS prediction, round(w / total, 6) AS confidence FROM r WHERE k = 1""",
    ("blocks",),
)
def _(t):
    b = t.blocks
    out = neighbors.knn_classifier(b.filter("label < 8"), b.filter("label >= 8"), "id", "vec", "y", 7, "distance")
    return rounded(out, "confidence")


@query(
    "outlier_lof",
    f"""WITH {_KNN.format(k=20)}, kd AS (SELECT id, max(dist) AS kd FROM knn GROUP BY 1),
    den AS (SELECT knn.id, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM knn JOIN kd ON kd.id = neighbor GROUP BY 1),
    s AS (SELECT knn.id, avg(o.lrd) / any_value(den.lrd) AS score FROM knn JOIN den o ON o.id = neighbor JOIN den ON den.id = knn.id GROUP BY 1)
    SELECT id, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS is_outlier FROM s""",
    ("blocks",),
)
def _(t):
    return rounded(neighbors.outlier_lof(t.blocks, "id", "vec", 20), "score")


@query(
    "impute_knn",
    """WITH h AS (SELECT id, list_transform(job_desc, lambda e: nullif(e, 0)) AS v FROM blocks),
    gaps AS (SELECT id, v, pos FROM (SELECT id, v, unnest(range(1, 65)) AS pos FROM h) WHERE v[pos] IS NULL),
    pairs AS (SELECT a.id AS id, b.id AS other, b.v AS bv,
      sqrt(64.0::DOUBLE / list_count(list_transform(range(1, 65), lambda i: a.v[i] + b.v[i]))
        * list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS d FROM h a, h b),
    cand AS (SELECT g.id, g.pos, d, bv[g.pos] AS val, row_number() OVER (PARTITION BY g.id, g.pos ORDER BY d, other) AS k
      FROM gaps g JOIN pairs p ON p.id = g.id WHERE bv[g.pos] IS NOT NULL)
    SELECT id, pos - 1 AS pos, round(sum(val / d) / sum(1 / d), 6) AS value FROM cand WHERE k <= 5 GROUP BY 1, 2""",
    ("blocks",),
)
def _(t):
    holed = t.blocks.select("id", arrays.zero_to_null_array(F.col("job_desc")).alias("v"))
    out = neighbors.impute_knn(holed, "id", "v", DIM)
    both = holed.join(out, "id").select("id", F.posexplode(F.arrays_zip("v", "imputed")).alias("pos", "p"))
    return both.filter(F.col("p.v").isNull()).select("id", F.col("pos").cast("bigint").alias("pos"), F.round("p.imputed", 6).alias("value"))


_POINTS = "points AS (SELECT id, vec AS v FROM blocks)"
_DBSCAN = """near AS (SELECT a.id AS id, b.id AS other FROM points a JOIN points b ON list_distance(a.v, b.v) <= {eps}),
    core AS (SELECT id FROM near GROUP BY 1 HAVING count(*) >= {m}),
    ce AS (SELECT near.id, other FROM near JOIN core c1 ON c1.id = near.id JOIN core c2 ON c2.id = other),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.other, reach.root FROM reach JOIN ce ON ce.id = reach.id),
    lab AS (SELECT id, min(root) AS label FROM reach GROUP BY 1),
    num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM lab)),
    border AS (SELECT near.id, min(label) AS label FROM near JOIN lab ON lab.id = near.other WHERE near.id NOT IN (SELECT id FROM core) GROUP BY 1),
    asg AS (SELECT * FROM lab UNION ALL SELECT * FROM border),
    res AS (SELECT p.id, coalesce(cluster, -1) AS cluster, p.id IN (SELECT id FROM core) AS is_core
      FROM points p LEFT JOIN asg ON asg.id = p.id LEFT JOIN num ON num.label = asg.label)"""


def _points(t):
    return t.blocks.select("id", F.col("vec").alias("v"))


@query("dbscan", f"WITH RECURSIVE {_POINTS}, {_DBSCAN.format(eps=1.17, m=4)} SELECT * FROM res", ("blocks",))
def _(t):
    return density.dbscan(_points(t), "id", "v", 1.17, 4)


def _search_sql(eps: float, m: int) -> str:
    return f"""SELECT * FROM (WITH RECURSIVE {_POINTS}, {_DBSCAN.format(eps=eps, m=m)},
    kept AS (SELECT res.id, cluster, v FROM res JOIN points ON points.id = res.id WHERE cluster >= 0),
    d AS (SELECT a.id, a.cluster, b.cluster AS oc, sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS tot, count(*) AS n FROM kept a JOIN kept b ON true GROUP BY 1, 2, 3),
    ab AS (SELECT id, max(tot / nullif(n - 1, 0)) FILTER (WHERE cluster = oc) AS a, min(tot / n) FILTER (WHERE cluster <> oc) AS b FROM d GROUP BY 1)
    SELECT {eps}::DOUBLE AS eps, {m} AS min_pts, CAST(coalesce((SELECT max(cluster) + 1 FROM res), 0) AS INTEGER) AS n_clusters,
    round(100.0 * (SELECT count(*) FROM res WHERE cluster < 0) / (SELECT count(*) FROM res), 6) AS noise_percent,
    CASE WHEN (SELECT max(cluster) FROM res) > 0 THEN round((SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM ab), 6) END AS silhouette)"""


EPSES, MIN_PTSES = (1.08, 1.12, 1.15, 1.17), (3, 4)


@query("dbscan_search", " UNION ALL ".join(_search_sql(e, m) for e in EPSES for m in MIN_PTSES), ("blocks",))
def _(t):
    return rounded(density.dbscan_search(_points(t), "id", "v", EPSES, MIN_PTSES), "noise_percent", "silhouette")


@query(
    "dbscan_settings",
    " UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, {m} AS min_pts, * FROM (WITH RECURSIVE {_POINTS}, {_DBSCAN.format(eps=e, m=m)} SELECT * FROM res)" for e in EPSES for m in MIN_PTSES),
    ("blocks",),
)
def _(t):
    return density.NeighbourTable(density.EpsGraph(_points(t), "id", "v", **TREE), EPSES, MIN_PTSES).clusters()


@query(
    "silhouette",
    """WITH d AS (SELECT a.id, a.y, b.y AS oy, sum(list_distance(a.vec, b.vec)) AS tot, count(*) AS n FROM blocks a JOIN blocks b ON true GROUP BY 1, 2, 3),
    ab AS (SELECT id, max(tot / (n - 1)) FILTER (WHERE y = oy) AS a, min(tot / n) FILTER (WHERE y <> oy) AS b FROM d GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM ab""",
    ("blocks",),
)
def _(t):
    return rounded(quality.silhouette(t.blocks, "id", "vec", "y"), "silhouette")


@query(
    "silhouette_squared",
    """WITH d AS (SELECT a.id, a.y, b.y AS oy, sum(list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec)) AS tot, count(*) AS n FROM blocks a JOIN blocks b ON true GROUP BY 1, 2, 3),
    ab AS (SELECT id, max(tot / (n - 1)) FILTER (WHERE y = oy) AS a, min(tot / n) FILTER (WHERE y <> oy) AS b FROM d GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_squared FROM ab""",
    ("blocks",),
)
def _(t):
    return rounded(quality.silhouette_squared(t.blocks, "vec", "y"), "silhouette_squared")


_CENTERS = """long AS (SELECT id, y, pos, vec[pos] AS x FROM (SELECT id, y, vec, unnest(range(1, 65)) AS pos FROM blocks)),
    c AS (SELECT y, pos, avg(x) AS m, count(*) AS n FROM long GROUP BY 1, 2), g AS (SELECT pos, avg(x) AS gm FROM long GROUP BY 1),
    dist AS (SELECT id, long.y, sum((x - m) * (x - m)) AS d2 FROM long JOIN c ON c.y = long.y AND c.pos = long.pos GROUP BY 1, 2)"""


@query(
    "calinski_harabasz",
    f"""WITH {_CENTERS}, b AS (SELECT sum(n * (m - gm) * (m - gm)) AS v FROM c JOIN g ON g.pos = c.pos), w AS (SELECT sum(d2) AS v, count(*) AS n, count(DISTINCT y) AS k FROM dist)
    SELECT CAST(k AS INTEGER) AS k, round((b.v / (k - 1)) / (w.v / (n - k)), 6) AS calinski_harabasz FROM b, w""",
    ("blocks",),
)
def _(t):
    return rounded(quality.calinski_harabasz(t.blocks, "vec", "y"), "calinski_harabasz")


@query(
    "davies_bouldin",
    f"""WITH {_CENTERS}, s AS (SELECT y, avg(sqrt(d2)) AS s FROM dist GROUP BY 1),
    p AS (SELECT a.y AS i, b.y AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM c a JOIN c b ON a.pos = b.pos AND a.y <> b.y GROUP BY 1, 2),
    r AS (SELECT i, max((si.s + sj.s) / gap) AS worst FROM p JOIN s si ON si.y = i JOIN s sj ON sj.y = j GROUP BY 1)
    SELECT CAST(count(*) AS INTEGER) AS k, round(avg(worst), 6) AS davies_bouldin FROM r""",
    ("blocks",),
)
def _(t):
    return rounded(quality.davies_bouldin(t.blocks, "vec", "y"), "davies_bouldin")


@query("kmeans")
def _(t):
    return clustering.kmeans(t.blocks, "vec", 3).select("id", "cluster", "center_distance")


@query("elbow_scan")
def _(t):
    return clustering.elbow_scan(t.blocks, "vec", range(2, 11))


@query("pca_project")
def _(t):
    return clustering.pca_project(t.blocks, "vec", 2).select("id", *[F.get("pc", F.lit(i)).alias(f"pc{i}") for i in range(2)])


@query("kmeans_on_pca")
def _(t):
    return clustering.kmeans_on_pca(t.blocks, "vec", 3, 50).select("id", "cluster", "center_distance")


@query("hierarchical_clusters")
def _(t):
    return clustering.hierarchical_clusters(t.blocks, "vec", 3, ["id"]).select("id", "cluster")


@query("ward_merges")
def _(t):
    return ward.ward_linkage(t.blocks, "vec")


@query("gaussian_mixture")
def _(t):
    out = clustering.gaussian_mixture(t.blocks.select("id", "vec"), "vec", 3, ["id"], max_iter=10)
    return out.select("id", "cluster", F.array_max("responsibility").alias("responsibility"))


@query("spectral_clusters")
def _(t):
    return clustering.spectral_clusters(t.blocks, "id", "vec", 3)


@query("minibatch_kmeans")
def _(t):
    return clustering.minibatch_kmeans(t.blocks, "id", "vec", 3, rounds=4, batch=256).select("id", "cluster")


@query("cluster_benchmark")
def _(t):
    b = t.blocks.select("id", "vec").persist()
    return clustering.cluster_benchmark(b, "id", "vec", {
        "kmeans": lambda d: clustering.kmeans(d, "vec", 3, restarts=1),
        "bisecting": lambda d: clustering.bisecting_clusters(d, "vec", 3, ["id"]),
        "ward": lambda d: clustering.hierarchical_clusters(d, "vec", 3, ["id"]),
    })


def _masked(t):
    return t.blocks.select("id", arrays.zero_to_null_array(F.col("job_desc")).alias("v"))


@query("kmeans_soft_features")
def _(t):
    rows = _masked(t)
    fit = clustering.fit_cluster_features(rows, "v", DIM, 3, restarts=2)
    return clustering.apply_cluster_probabilities(rows, fit, "v").drop("v")


@query("kmeans_onehot_features")
def _(t):
    rows = _masked(t)
    fit = clustering.fit_cluster_features(rows, "v", DIM, 3, restarts=1)
    return clustering.apply_cluster_onehot(rows, fit, "v").drop("v")
