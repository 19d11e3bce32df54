"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import features, lookups
from gradus.plans.lookups import _DIM
from gradus.plans.registry import query
from gradus.plans.standins import POSTING_SCHEMA
from gradus.plans.statistics import rounded


@query(
    "impute_mean",
    """SELECT id, round(coalesce(feature_10, (SELECT avg(feature_10) FROM postings)), 6) AS feature_10, feature_2 FROM postings""",
    ("postings",),
)
def _(t):
    return rounded(features.impute_mean(t.postings.select("id", "feature_10", "feature_2"), ["feature_10", "feature_2"]), "feature_10")


@query(
    "standardize",
    """WITH s AS (SELECT avg(quantity) AS m1, stddev_pop(quantity) AS s1, avg(price) AS m2, stddev_pop(price) AS s2 FROM numbers)
    SELECT round((quantity - m1) / s1, 6) AS quantity, round((price - m2) / s2, 6) AS price, 0.0::DOUBLE AS constant FROM numbers, s""",
    ("numbers",),
)
def _(t):
    cols = ["quantity", "price", "constant"]
    return rounded(features.standardize(t.numbers.select(*cols), cols), "quantity", "price")


@query(
    "zscore_sample",
    "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events",
)
def _(t):
    return rounded(features.zscore_sample(t.events.select("event_id", "value"), "value", "z").drop("value"), "z")


@query(
    "minmax_scale",
    """WITH s AS (SELECT min(quantity) AS l1, max(quantity) AS h1, min(price) AS l2, max(price) AS h2 FROM numbers)
    SELECT round((quantity - l1) / (h1 - l1), 6) AS quantity, round((price - l2) / (h2 - l2), 6) AS price, 0.0::DOUBLE AS constant FROM numbers, s""",
    ("numbers",),
)
def _(t):
    cols = ["quantity", "price", "constant"]
    return rounded(features.minmax_scale(t.numbers.select(*cols), cols), "quantity", "price")


_MIN = 295
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot_min_freq",
    """WITH f AS (SELECT *, count(*) OVER (PARTITION BY grp) AS k FROM
      (SELECT c_custkey AS id, CASE WHEN c_nationkey < 20 THEN 'n' || (c_nationkey % 4) WHEN c_nationkey < 23 THEN 'rare' || c_nationkey END AS grp FROM customer))
    SELECT id, CAST(coalesce(grp = 'n0', false) AS DOUBLE) AS grp_n0, CAST(coalesce(grp = 'n1', false) AS DOUBLE) AS grp_n1,
    CAST(coalesce(grp = 'n2', false) AS DOUBLE) AS grp_n2, CAST(coalesce(grp = 'n3', false) AS DOUBLE) AS grp_n3,
    CAST(coalesce(grp LIKE 'rare%', true) AS DOUBLE) AS grp_infrequent_sklearn FROM f""",
)
def _(t):
    grp = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("n"), F.col("c_nationkey") % 4)).when(
        F.col("c_nationkey") < 23, F.concat(F.lit("rare"), F.col("c_nationkey"))
    )
    df = t.customer.select(F.col("c_custkey").alias("id"), grp.alias("grp"))
    return features.one_hot_min_freq(df, "grp", df.count() * 2 // 15)


@query(
    "one_hot",
    "SELECT id, "
    + ", ".join(f"CAST(coalesce(feature_1 = '{v}', false) AS DOUBLE) AS \"feature_1_{v}\"" for v in "ABC")
    + ", CAST(salary_category = 'High' AS DOUBLE) AS \"salary_category_High\", CAST(salary_category = 'Low' AS DOUBLE) AS \"salary_category_Low\","
    + " CAST(salary_category = 'Medium' AS DOUBLE) AS \"salary_category_Medium\" FROM postings",
    ("postings",),
)
def _(t):
    return features.one_hot(t.postings.select("id", "feature_1", "salary_category"), ["feature_1", "salary_category"])


_MONTH_SQL = """WITH g AS (SELECT avg(y) AS gm, stddev_samp(y) AS gs FROM coded WHERE d IS NOT NULL),
    s AS (SELECT month(d) AS m, avg(y) AS mm, coalesce(stddev_samp(y), 0) AS ms FROM coded WHERE d IS NOT NULL GROUP BY 1),
    f AS (SELECT min(d) AS first FROM coded)
    SELECT id, (year(d) - year(first)) * 12 + month(d) - month(first) AS months_since_first, CAST(month(d) AS BIGINT) AS month_of_year,
    round(coalesce(mm, gm), 6) AS month_target_mean, round(coalesce(ms, gs), 6) AS month_target_std
    FROM coded LEFT JOIN s ON month(d) = s.m, g, f"""


@query("month_target_encode", _MONTH_SQL, ("coded",))
def _(t):
    out = features.month_target_encode(t.coded.select("id", "d", "y"), "d", "y").drop("d", "y")
    out = out.withColumn("months_since_first", F.col("months_since_first").cast("bigint"))
    out = out.withColumn("month_of_year", F.col("month_of_year").cast("bigint"))
    return rounded(out, "month_target_mean", "month_target_std")


@query(
    "date_features",
    """SELECT id, (year(d) - year(first)) * 12 + month(d) - month(first) AS months_since_first
    FROM coded, (SELECT min(d) AS first FROM coded)""",
    ("coded",),
)
def _(t):
    out = features.date_features(t.coded.select("id", "d"), "d").drop("d")
    return out.withColumn("months_since_first", F.col("months_since_first").cast("bigint"))


@query(
    "state_and_flag_features",
    _DIM
    + """ SELECT id, CAST(mean_salary AS DOUBLE) AS job_state, CASE WHEN feature_1 IN ('B', 'C') THEN 1 ELSE 0 END AS feature_1
    FROM postings p LEFT JOIN dim ON p.job_state = dim.job_state""",
    ("postings",),
)
def _(t):
    return features.state_and_flag_features(t.postings.select("id", "job_state", "feature_1"), lookups.state_salary(t.spark))


@query(
    "polynomial_features",
    """SELECT id, c1, c2, round(c1 * c1, 9) AS "c1^2", round(c1 * c2, 9) AS "c1 c2", round(c2 * c2, 9) AS "c2^2" FROM probabilities""",
    ("probabilities",),
)
def _(t):
    out = features.polynomial_features(t.probabilities, ["c1", "c2"], 2, keep=["id"])
    return rounded(out, "c1^2", "c1 c2", "c2^2", digits=9)


def _flat_sql():
    titles = [f"title_{i}" for i in range(25)]
    hot = ", ".join(f"""CAST(coalesce(job_title = '{v}', false) AS DOUBLE) AS "title__job_title_{v}" """ for v in titles)
    return (
        _DIM
        + f""", g AS (SELECT id, CAST(mean_salary AS DOUBLE) AS js, CASE WHEN feature_1 IN ('B', 'C') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f1, {hot},
        CAST((year(d) - year(first)) * 12 + month(d) - month(first) AS DOUBLE) AS ms, CAST(feature_3 AS DOUBLE) AS b3, CAST(feature_11 AS DOUBLE) AS b11,
        feature_2 AS q2, feature_10 AS q10 FROM coded LEFT JOIN dim ON coded.job_state = dim.job_state, (SELECT min(d) AS first FROM coded)),
    i AS (SELECT g.* EXCLUDE (js, ms, q2, q10), coalesce(js, (SELECT avg(js) FROM g)) AS js, coalesce(ms, (SELECT avg(ms) FROM g)) AS ms,
        q2, coalesce(q10, (SELECT avg(q10) FROM g)) AS q10 FROM g),
    s AS (SELECT avg(js) AS a1, stddev_pop(js) AS s1, avg(ms) AS a2, stddev_pop(ms) AS s2, avg(q2) AS a3, stddev_pop(q2) AS s3, avg(q10) AS a4, stddev_pop(q10) AS s4 FROM i)
    SELECT id, round((js - a1) / s1, 6) AS js_f1__job_state, f1 AS js_f1__feature_1, {', '.join(f'"title__job_title_{v}"' for v in titles)},
    round((ms - a2) / s2, 6) AS date__months_since_first, b3 AS bools__feature_3, b11 AS bools__feature_11,
    round((q2 - a3) / s3, 6) AS quants__feature_2, round((q10 - a4) / s4, 6) AS quants__feature_10 FROM i, s"""
    )


_SCALED = ("js_f1__job_state", "date__months_since_first", "quants__feature_2", "quants__feature_10")


@query("preprocess_flat", _flat_sql(), ("coded",))
def _(t):
    out = features.preprocess_flat(t.postings, POSTING_SCHEMA, lookups.state_salary(t.spark), keep=["id"])
    return rounded(out, *_SCALED)
