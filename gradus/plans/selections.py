"""Outlier rules and feature selection that SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import outliers, selection
from gradus.plans.registry import query
from gradus.plans.standins import DIM
from gradus.plans.statistics import rounded

NAMES = [f"e{i:02d}" for i in range(DIM)]
_LONG = "long AS (SELECT id, y, label, pos, vec[pos + 1] AS x FROM (SELECT id, y, label, vec, unnest(range(0, 64)) AS pos FROM blocks))"
_NAME = "'e' || lpad(CAST(pos AS VARCHAR), 2, '0')"


def _ranked(scores: str, k: int, digits: int = 6) -> str:
    """SQL tail: rank a (pos, score) relation like the selectors do."""
    return f"""SELECT {_NAME} AS feature, CAST(pos AS INTEGER) AS position, round(score, {digits}) AS score,
    CAST(rk AS INTEGER) AS rank, rk <= {k} AS selected FROM (SELECT pos, score, row_number() OVER (ORDER BY score DESC NULLS LAST, pos) AS rk FROM {scores})"""


@query(
    "outlier_zscore",
    """WITH p AS (SELECT id, feature_2 * feature_2 AS feature_2, feature_10 FROM postings),
    s AS (SELECT avg(feature_2) AS a, stddev_pop(feature_2) AS sa, avg(feature_10) AS b, stddev_pop(feature_10) AS sb FROM p)
    SELECT id, coalesce(greatest(abs(feature_2 - a) / sa, abs(feature_10 - b) / sb) > 2, false) AS is_outlier FROM p, s""",
    ("postings",),
)
def _(t):
    p = t.postings.select("id", (F.col("feature_2") * F.col("feature_2")).alias("feature_2"), "feature_10")
    return outliers.outlier_zscore(p, ["feature_2", "feature_10"], 2.0).select("id", "is_outlier")


@query(
    "outlier_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events, q""",
)
def _(t):
    return outliers.outlier_iqr(t.events, ["value"]).select("event_id", "is_outlier")


_FLAGS = "flags AS (SELECT id, y, feature_2 > 450 AS a, feature_10 > 9000 AS b, feature_11 AS c FROM coded)"


def _flags(t):
    return t.coded.select(
        "id", "y", (F.col("feature_2") > 450).alias("a"), (F.col("feature_10") > 9000).alias("b"), F.col("feature_11").alias("c")
    )


@query(
    "outlier_vote_rule",
    f"""WITH {_FLAGS} SELECT id, CAST(a AS INTEGER) + CAST(coalesce(b, false) AS INTEGER) + CAST(c AS INTEGER) AS votes,
    CAST(a AS INTEGER) + CAST(coalesce(b, false) AS INTEGER) + CAST(c AS INTEGER) >= 2 AS is_outlier FROM flags""",
    ("coded",),
)
def _(t):
    return outliers.outlier_vote(_flags(t), ["a", "b", "c"]).select("id", "votes", "is_outlier")


@query(
    "remove_outliers",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_totalprice >
    (SELECT avg(o_totalprice) + 1.5 * stddev_pop(o_totalprice) FROM orders) AND NOT o_totalprice <
    (SELECT avg(o_totalprice) - 1.5 * stddev_pop(o_totalprice) FROM orders)""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    flags = outliers.outlier_zscore(o, ["o_totalprice"], 1.5)
    return outliers.remove_outliers(o, flags, "o_orderkey")


@query(
    "outlier_ids",
    """SELECT event_id FROM events WHERE abs(value - (SELECT avg(value) FROM events)) > 3 * (SELECT stddev_pop(value) FROM events)""",
)
def _(t):
    return outliers.outlier_ids(outliers.outlier_zscore(t.events, ["value"]), "event_id")


@query(
    "outlier_report",
    f"""WITH {_FLAGS} SELECT y, count(*) FILTER (WHERE a) AS n_outliers, count(*) AS n, CAST(GROUPING(y) AS INTEGER) AS is_total,
    round(100.0 * count(*) FILTER (WHERE a) / count(*), 6) AS percent, 'rule' AS method, 'auto' AS contamination FROM flags GROUP BY ROLLUP (y)""",
    ("coded",),
)
def _(t):
    out = outliers.outlier_report(_flags(t).withColumnRenamed("a", "is_outlier"), "y", "rule")
    return rounded(out.withColumn("is_total", F.col("is_total").cast("int")), "percent")


@query(
    "select_variance",
    f"""WITH {_LONG}, v AS (SELECT pos, var_pop(x) AS score FROM long GROUP BY 1)
    SELECT {_NAME} AS feature, CAST(pos AS INTEGER) AS position, round(score, 9) AS score,
    CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank, score > (SELECT quantile_cont(score, 0.5) FROM v) AS selected FROM v""",
    ("blocks",),
)
def _(t):
    return rounded(selection.select_variance(t.blocks, "vec", NAMES, 0.5), "score", digits=9)


def _related(t):
    """Each vector with eight noisy copies of its first elements appended."""
    noisy = F.zip_with(F.slice("vec", 1, 8), F.slice("vec", 9, 8), lambda a, b: a + 0.5 * b)
    return t.blocks.select("id", "y", F.concat("vec", noisy).alias("vec"))


@query(
    "select_correlation",
    """WITH w AS (SELECT id, list_concat(vec, list_transform(range(1, 9), lambda i: vec[i] + 0.5::DOUBLE * vec[i + 8])) AS vec FROM blocks),
    l AS (SELECT id, pos, vec[pos + 1] AS x FROM (SELECT id, vec, unnest(range(0, 72)) AS pos FROM w)),
    m AS (SELECT a.pos AS i, max(abs(c)) AS score FROM (SELECT a.pos AS i, b.pos AS j, corr(a.x, b.x) AS c FROM l a JOIN l b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2) q
      JOIN (SELECT DISTINCT pos FROM l) a ON a.pos = q.i GROUP BY 1),
    s AS (SELECT pos, score FROM (SELECT DISTINCT pos FROM l) d LEFT JOIN m ON m.i = d.pos)
    SELECT 'e' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, CAST(pos AS INTEGER) AS position, round(score, 6) AS score,
    CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, pos) AS INTEGER) AS rank, coalesce(score <= 0.5, true) AS selected FROM s""",
    ("blocks",),
)
def _(t):
    names = [f"e{i:02d}" for i in range(DIM + 8)]
    return rounded(selection.select_correlation(_related(t), "vec", names, 0.5), "score")


_CHI2 = f"""WITH {_LONG}, r AS (SELECT pos, min(x) AS lo, max(x) - min(x) AS w FROM long GROUP BY 1),
    o AS (SELECT long.pos, y, sum((x - lo) / w) AS obs, count(*) AS n FROM long JOIN r ON long.pos = r.pos GROUP BY 1, 2),
    e AS (SELECT *, sum(obs) OVER (PARTITION BY pos) * n / sum(n) OVER (PARTITION BY pos) AS expct FROM o),
    sc AS (SELECT pos, sum((obs - expct) * (obs - expct) / expct) AS score FROM e GROUP BY 1) """


@query("select_chi2", _CHI2 + _ranked("sc", 20), ("blocks",))
def _(t):
    return rounded(selection.select_chi2(t.blocks, "vec", "y", NAMES, 20), "score")


_ANOVA = f"""WITH {_LONG}, g AS (SELECT pos, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM long GROUP BY 1, 2),
    a AS (SELECT pos, avg(x) AS gm FROM long GROUP BY 1),
    sc AS (SELECT g.pos, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS score FROM g JOIN a ON g.pos = a.pos GROUP BY 1) """


@query("select_anova", _ANOVA + _ranked("sc", 32), ("blocks",))
def _(t):
    return rounded(selection.select_anova(t.blocks, "vec", "y", NAMES, "auto"), "score")


_MI = f"""WITH {_LONG}, q AS (SELECT pos, quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM long GROUP BY 1),
    b AS (SELECT long.pos, y, len(list_filter(e, lambda v: v < x)) AS bin FROM long JOIN q ON long.pos = q.pos),
    c AS (SELECT pos, y, bin, count(*) AS n FROM b GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS t, sum(n) OVER (PARTITION BY pos, y) AS ty, sum(n) OVER (PARTITION BY pos, bin) AS tb FROM c),
    sc AS (SELECT pos, sum(n / t * ln(n * t / (ty * tb))) AS score FROM w GROUP BY 1) """


@query("select_mutual_info", _MI + _ranked("sc", 32), ("blocks",))
def _(t):
    return rounded(selection.select_mutual_info(t.blocks, "vec", "y", NAMES, "auto"), "score")


_MIN = f"""WITH {_LONG}, nc AS (SELECT y, count(*) AS c, (SELECT count(*) FROM blocks) AS n FROM blocks GROUP BY 1),
    psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329::DOUBLE AS p
      FROM (SELECT unnest(range(1, 5000)) AS i)),
    kd AS (SELECT pos, id, max(d) AS d FROM (SELECT a.pos, a.id, abs(a.x - b.x) AS d,
        row_number() OVER (PARTITION BY a.pos, a.id ORDER BY abs(a.x - b.x)) AS k FROM long a JOIN long b ON a.pos = b.pos AND a.y = b.y AND a.id <> b.id) WHERE k <= 3 GROUP BY 1, 2),
    m AS (SELECT a.pos, a.id, greatest(1, count(*)) AS m FROM long a JOIN kd ON kd.pos = a.pos AND kd.id = a.id JOIN long b ON b.pos = a.pos AND abs(a.x - b.x) < kd.d GROUP BY 1, 2),
    base AS (SELECT any_value(pn.p) + any_value(p3.p) - sum(c * pc.p) / any_value(n) AS v FROM nc JOIN psi pn ON pn.i = n JOIN psi p3 ON p3.i = 3 JOIN psi pc ON pc.i = c),
    sc AS (SELECT pos, greatest(0, (SELECT v FROM base) - avg(p)) AS score FROM m JOIN psi ON psi.i = m GROUP BY 1) """


@query("select_mutual_info_neighbour", (_MIN + _ranked("sc", 32)).replace("round(score, 6) AS score", "round(score, 5) AS score"), ("blocks",))
def _(t):
    return rounded(selection.select_mutual_info(t.blocks, "vec", "y", NAMES, "auto", neighbours=3), "score", digits=5)


@query(
    "select_from_model",
    """WITH i AS (SELECT p_brand AS feature, avg(p_size) AS importance FROM part GROUP BY 1)
    SELECT feature, round(importance, 6) AS importance, importance >= 0.75 * (SELECT avg(importance) FROM i) AND
    importance >= (SELECT quantile_cont(importance, 0.5) FROM i) AS selected FROM i""",
)
def _(t):
    imp = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance"))
    by_mean = selection.select_from_model(imp, "0.75*mean").select("feature", "importance", F.col("selected").alias("m"))
    by_median = selection.select_from_model(imp, "median").select("feature", F.col("selected").alias("d"))
    out = by_mean.join(by_median, "feature").withColumn("selected", F.col("m") & F.col("d"))
    return rounded(out.select("feature", "importance", "selected"), "importance")


@query(
    "apply_selection",
    f"""WITH {_LONG}, v AS (SELECT pos, var_pop(x) AS score FROM long GROUP BY 1),
    k AS (SELECT pos, row_number() OVER (ORDER BY pos) AS place FROM v WHERE score > (SELECT quantile_cont(score, 0.95) FROM v))
    SELECT id, CAST(max(x) FILTER (WHERE place = 1) AS DOUBLE) AS f1, max(x) FILTER (WHERE place = 2) AS f2,
    max(x) FILTER (WHERE place = 3) AS f3, max(x) FILTER (WHERE place = 4) AS f4 FROM long JOIN k ON long.pos = k.pos GROUP BY 1""",
    ("blocks",),
)
def _(t):
    chosen = selection.select_variance(t.blocks, "vec", NAMES, 0.95)
    out = selection.apply_selection(t.blocks, chosen, "vec", "kept")
    return out.select("id", *[F.get("kept", F.lit(i)).alias(f"f{i + 1}") for i in range(4)])


@query("select_tree_importance")
def _(t):
    return selection.select_tree_importance(t.blocks, "vec", "y", NAMES, 0.65, trees=40)


@query("select_l1")
def _(t):
    return selection.select_l1(t.blocks, "vec", "y", NAMES, 20)


@query("select_rfe")
def _(t):
    return selection.select_rfe(t.blocks, "vec", "y", NAMES, 40, trees=10, step=0.2)


@query("select_vote")
def _(t):
    b = t.blocks
    tables = [
        selection.select_anova(b, "vec", "y", NAMES, 32),
        selection.select_mutual_info(b, "vec", "y", NAMES, 32),
        selection.select_tree_importance(b, "vec", "y", NAMES, 32, trees=20),
    ]
    return selection.select_vote(tables, 32, DIM)


def _chosen(scores: str) -> str:
    tail = "SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY score DESC NULLS LAST, pos) AS rk FROM sc) WHERE rk <= 32"
    return f"SELECT pos FROM ({scores} {tail})"


@query(
    "select_vote_rule",
    f"""SELECT {_NAME} AS feature, CAST(pos AS INTEGER) AS position, CAST(votes AS DOUBLE) AS score, CAST(rk AS INTEGER) AS rank, rk <= 32 AS selected FROM
    (SELECT pos, votes, row_number() OVER (ORDER BY votes >= 2 DESC, CASE WHEN votes >= 2 THEN 0 ELSE -votes END, pos) AS rk FROM
      (SELECT p.pos, count(v.pos) AS votes FROM (SELECT unnest(range(0, 64)) AS pos) p LEFT JOIN
        ({_chosen(_ANOVA)} UNION ALL {_chosen(_MI)} UNION ALL {_chosen(_CHI2)}) v ON v.pos = p.pos GROUP BY 1))""",
    ("blocks",),
)
def _(t):
    b = t.blocks
    tables = [
        selection.select_anova(b, "vec", "y", NAMES, 32),
        selection.select_mutual_info(b, "vec", "y", NAMES, 32),
        selection.select_chi2(b, "vec", "y", NAMES, 32),
    ]
    return selection.select_vote(tables, 32, DIM)


@query("importance_table")
def _(t):
    imp = selection.forest_importances(t.blocks, "vec", "y", trees=20)
    return selection.importance_table(t.spark, imp, NAMES)
