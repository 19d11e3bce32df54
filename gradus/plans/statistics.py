"""Counts, descriptive statistics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import arrays
from gradus.operators import aggregates
from gradus.plans.registry import query


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("value_counts", "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return aggregates.value_counts(t.lineitem, "l_shipdate")


@query(
    "value_shares",
    """SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share,
    round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY 1""",
)
def _(t):
    return rounded(aggregates.value_shares(t.lineitem, "l_returnflag"), "share", "percent")


@query(
    "value_counts_all_categoricals",
    """SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""",
)
def _(t):
    return aggregates.value_counts_all_categoricals(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "group_mean",
    "SELECT CAST(month(d) AS INTEGER) AS m, round(avg(y), 6) AS mean FROM coded GROUP BY 1",
    ("coded",),
)
def _(t):
    return rounded(aggregates.group_mean(t.coded.withColumn("m", F.month("d")), "m", "y"), "mean")


@query(
    "group_mean_std_count",
    """SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std,
    count(l_quantity) AS n FROM lineitem GROUP BY 1""",
)
def _(t):
    return rounded(aggregates.group_mean_std_count(t.lineitem, "l_suppkey", "l_quantity"), "mean", "std")


@query(
    "global_mean_std",
    "SELECT round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std FROM coded WHERE d IS NOT NULL",
    ("coded",),
)
def _(t):
    return rounded(aggregates.global_mean_std(t.coded, "y", F.col("d").isNotNull()), "mean", "std")


@query(
    "group_count_multi",
    "SELECT salary_category, feature_1, count(*) AS n FROM postings GROUP BY 1, 2",
    ("postings",),
)
def _(t):
    return aggregates.group_count_multi(t.postings, ["salary_category", "feature_1"])


_DESCRIBE = """SELECT '{0}' AS "column", count({0}) AS count, count(*) - count({0}) AS nulls, round(avg({0}), 7) AS mean,
    round(stddev_samp({0}), 6) AS std, min({0}) AS min, round(quantile_cont({0}, 0.25), 6) AS q25,
    round(quantile_cont({0}, 0.5), 6) AS q50, round(quantile_cont({0}, 0.75), 6) AS q75, max({0}) AS max FROM numbers"""
_NUMERIC = ["quantity", "price", "discount", "gappy"]


@query("describe", " UNION ALL ".join(_DESCRIBE.format(c) for c in _NUMERIC), ("numbers",))
def _(t):
    return rounded(rounded(aggregates.describe(t.numbers, _NUMERIC), "std", "q25", "q50", "q75"), "mean", digits=7)


@query("min_date", "SELECT min(d) AS min_date FROM coded", ("coded",))
def _(t):
    return aggregates.min_date(t.coded, "d")


def _per_column(cols, expr, name):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {expr.format(c)} AS {name} FROM numbers""" for c in cols)


@query("zero_count", _per_column(["discount", "tax", "gappy"], "count(*) FILTER (WHERE {0} = 0)", "n_zero"), ("numbers",))
def _(t):
    return aggregates.zero_count(t.numbers, ["discount", "tax", "gappy"])


@query("null_count", _per_column(["discount", "tax", "gappy"], "count(*) - count({0})", "n_null"), ("numbers",))
def _(t):
    return aggregates.null_count(t.numbers, ["discount", "tax", "gappy"])


@query(
    "null_ratio",
    _per_column(["discount", "tax", "gappy"], "round((count(*) - count({0})) / count(*), 6)", "null_ratio"),
    ("numbers",),
)
def _(t):
    return rounded(aggregates.null_ratio(t.numbers, ["discount", "tax", "gappy"]), "null_ratio")


@query("distinct_values", "SELECT DISTINCT l_suppkey FROM lineitem")
def _(t):
    return aggregates.distinct_values(t.lineitem, "l_suppkey")


@query(
    "crosstab",
    """SELECT job_title, count(*) FILTER (WHERE salary_category = 'High') AS "High",
    count(*) FILTER (WHERE salary_category = 'Low') AS "Low",
    count(*) FILTER (WHERE salary_category = 'Medium') AS "Medium" FROM postings GROUP BY 1""",
    ("postings",),
)
def _(t):
    return aggregates.crosstab(t.postings, "job_title", "salary_category")


@query(
    "cluster_profile",
    """SELECT cluster, y, n, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_size,
    round(100.0 * n / sum(n) OVER (PARTITION BY cluster), 6) AS percent
    FROM (SELECT label AS cluster, y, count(*) AS n FROM blocks GROUP BY 1, 2)""",
    ("blocks",),
)
def _(t):
    return rounded(aggregates.cluster_profile(t.blocks.withColumnRenamed("label", "cluster"), "cluster", "y"), "percent")


@query(
    "cluster_mean_distance",
    """WITH long AS (SELECT id, label, pos, vec[pos] AS x FROM (SELECT id, label, vec, unnest(range(1, 65)) AS pos FROM blocks)),
    c AS (SELECT label, pos, avg(x) AS m FROM long GROUP BY 1, 2),
    d AS (SELECT id, long.label, sqrt(sum((x - m) * (x - m))) AS dist FROM long JOIN c ON long.label = c.label AND long.pos = c.pos GROUP BY 1, 2)
    SELECT label, round(avg(dist), 6) AS mean_distance, count(*) AS n FROM d GROUP BY 1""",
    ("blocks",),
)
def _(t):
    from gradus.operators.quality import with_centroid_distance

    placed = with_centroid_distance(t.blocks, "vec", "label", "dist")
    return rounded(aggregates.cluster_mean_distance(placed, "label", "dist"), "mean_distance")


@query(
    "class_outlier_rate",
    """SELECT y, count(*) FILTER (WHERE flag) AS n_outliers, count(*) AS n, CAST(GROUPING(y) AS INTEGER) AS is_total,
    round(100.0 * count(*) FILTER (WHERE flag) / count(*), 6) AS percent
    FROM (SELECT y, feature_2 > 450 AS flag FROM coded) GROUP BY ROLLUP (y)""",
    ("coded",),
)
def _(t):
    out = aggregates.class_outlier_rate(t.coded.withColumn("flag", F.col("feature_2") > 450), "y", "flag")
    return rounded(out.withColumn("is_total", F.col("is_total").cast("int")), "percent")


@query(
    "column_variance",
    _per_column(["quantity", "discount", "tax", "mixed", "constant", "gappy"], "round(var_pop({0}), 5)", "variance"),
    ("numbers",),
)
def _(t):
    return rounded(
        aggregates.column_variance(t.numbers, ["quantity", "discount", "tax", "mixed", "constant", "gappy"]), "variance", digits=5
    )


_QS = (0.25, 0.75)


@query(
    "column_percentiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {q}::DOUBLE AS q, round(quantile_cont({c}, {q}), 6) AS value FROM numbers"""
        for c in ("quantity", "price", "gappy") for q in _QS
    ),
    ("numbers",),
)
def _(t):
    return rounded(aggregates.column_percentiles(t.numbers, ["quantity", "price", "gappy"], _QS), "value")


_CORR = ["quantity", "price", "mixed", "gappy"]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 6) AS corr FROM {'(SELECT 1)' if a == b else 'numbers'}"
    for a in _CORR for b in _CORR
)


@query("corr_matrix", _CORR_SQL, ("numbers",))
def _(t):
    return rounded(aggregates.corr_matrix(t.numbers, _CORR), "corr")


@query(
    "score_summary",
    """SELECT count(*) AS n_iterations, round(sum(std), 6) AS total_fit_time, min(score) AS min, max(score) AS max,
    round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std FROM history""",
    ("history",),
)
def _(t):
    return rounded(aggregates.score_summary(t.history, "score", "std"), "total_fit_time", "mean", "std")


@query(
    "confidence_summary",
    """WITH c AS (SELECT greatest(p0, p1, p2) AS conf FROM ordinal)
    SELECT round(avg(conf), 6) AS mean, round(quantile_cont(conf, 0.5), 6) AS median, round(min(conf), 6) AS min, round(max(conf), 6) AS max FROM c""",
    ("ordinal",),
)
def _(t):
    p = t.probabilities.select(arrays.ordinal_probabilities([F.col("c1"), F.col("c2")]).alias("p"))
    return rounded(aggregates.confidence_summary(p, "p"), "mean", "median", "min", "max")


@query(
    "majority_baseline",
    """SELECT y AS label, n, round(n / total, 6) AS accuracy FROM (SELECT y, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
    FROM coded GROUP BY 1) ORDER BY n DESC, y LIMIT 1""",
    ("coded",),
)
def _(t):
    return rounded(aggregates.majority_baseline(t.coded, "y"), "accuracy")


@query(
    "histogram",
    """WITH r AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
    b AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS INTEGER), 19) AS bin, lo, w FROM lineitem, r)
    SELECT bin, count(*) AS n, round(any_value(bin * w + lo), 6) AS left_edge FROM b GROUP BY 1""",
)
def _(t):
    return rounded(aggregates.histogram(t.lineitem, "l_extendedprice", 20), "left_edge")


@query(
    "group_rare",
    """WITH c AS (SELECT p_brand, count(*) AS k FROM part GROUP BY 1)
    SELECT p_partkey, CASE WHEN k >= 80 THEN part.p_brand ELSE 'Other' END AS p_brand FROM part JOIN c ON part.p_brand = c.p_brand""",
)
def _(t):
    return aggregates.group_rare(t.part.select("p_partkey", "p_brand"), "p_brand", 80)


@query(
    "target_distribution",
    "SELECT y, count(*) AS n FROM coded GROUP BY 1",
    ("coded",),
)
def _(t):
    return aggregates.target_distribution(t.coded, "y").select(F.explode("distribution").alias("y", "n"))
