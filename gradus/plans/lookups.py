"""Lookups, statistics joined back, semi and anti joins, alignment, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions.scalars import STATE_MEAN_SALARY
from gradus.operators import lookups, ranking
from gradus.plans.registry import query

_STATES_SQL = ", ".join(f"('{k}', {v})" for k, v in STATE_MEAN_SALARY.items())
_DIM = f"WITH dim(job_state, mean_salary) AS (VALUES {_STATES_SQL})"
SPLIT = "2000-01-01"


@query(
    "lookup_join",
    _DIM + " SELECT id, p.job_state, mean_salary FROM postings p LEFT JOIN dim ON p.job_state = dim.job_state",
    ("postings",),
)
def _(t):
    return lookups.lookup_join(t.postings.select("id", "job_state"), lookups.state_salary(t.spark), "job_state")


@query(
    "lookup_join_default",
    _DIM
    + """ SELECT id, p.job_state, round(coalesce(CAST(mean_salary AS DOUBLE), (SELECT avg(mean_salary) FROM dim)), 6) AS mean_salary
    FROM postings p LEFT JOIN dim ON p.job_state = dim.job_state""",
    ("postings",),
)
def _(t):
    dim = lookups.state_salary(t.spark)
    out = lookups.lookup_join_default(t.postings.select("id", "job_state"), dim, "job_state", "mean_salary")
    return out.withColumn("mean_salary", F.round("mean_salary", 6))


@query(
    "group_stat_join",
    """SELECT id, c.job_title, round(m, 6) AS title_encoded FROM coded c
    JOIN (SELECT job_title, avg(y) AS m FROM coded GROUP BY 1) s ON c.job_title = s.job_title""",
    ("coded",),
)
def _(t):
    out = lookups.group_stat_join(t.coded.select("id", "job_title", "y"), "job_title", "y", "title_encoded")
    return out.select("id", "job_title", F.round("title_encoded", 6).alias("title_encoded"))


@query(
    "outer_align_stats",
    """WITH a AS (SELECT s_nationkey AS nationkey, avg(s_acctbal) AS supplier_mean FROM supplier GROUP BY 1),
    b AS (SELECT c_nationkey AS nationkey, avg(c_acctbal) AS customer_mean, stddev_samp(c_acctbal) AS customer_std FROM customer GROUP BY 1)
    SELECT coalesce(a.nationkey, b.nationkey) AS nationkey, round(coalesce(supplier_mean, 100), 6) AS supplier_mean,
    round(coalesce(customer_mean, 100), 6) AS customer_mean, round(coalesce(customer_std, 100), 6) AS customer_std
    FROM a FULL OUTER JOIN b ON a.nationkey = b.nationkey""",
)
def _(t):
    a = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.avg("s_acctbal").alias("supplier_mean"))
    b = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(
        F.avg("c_acctbal").alias("customer_mean"), F.stddev_samp("c_acctbal").alias("customer_std")
    )
    out = lookups.outer_align_stats([a, b], "nationkey", 100.0)
    return out.select("nationkey", *[F.round(c, 6).alias(c) for c in ("supplier_mean", "customer_mean", "customer_std")])


@query(
    "semi_join_inliers",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN
    (SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 9000 OR c_acctbal < 0))""",
)
def _(t):
    flags = t.customer.select(
        F.col("c_custkey").alias("o_custkey"), ((F.col("c_acctbal") > 9000) | (F.col("c_acctbal") < 0)).alias("is_outlier")
    )
    return lookups.semi_join_inliers(t.orders, flags, "o_custkey").select("o_orderkey", "o_totalprice")


@query(
    "anti_join_ids",
    """WITH e AS (SELECT DISTINCT c_custkey AS id FROM customer), g AS (SELECT DISTINCT o_custkey + 5 AS id FROM orders)
    SELECT id, 'missing' AS kind FROM e WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT id, 'extra' AS kind FROM g WHERE id NOT IN (SELECT id FROM e)""",
)
def _(t):
    expected = t.customer.select(F.col("c_custkey").alias("id"))
    got = t.orders.select((F.col("o_custkey") + 5).alias("id"))
    return lookups.anti_join_ids(expected, got, "id")


def _files(t):
    p = t.predictors
    return {c: p.select("id", F.col(c).alias("label")) for c in ("by_price", "by_status", "by_month")}


@query("align_predictions", "SELECT id, by_price, by_status, by_month FROM predictors", ("predictors",))
def _(t):
    return lookups.align_predictions(_files(t), "id", "label")


@query(
    "anti_join_values",
    """SELECT DISTINCT c_mktsegment || c_nationkey AS grp FROM customer WHERE c_acctbal >= 0 AND c_mktsegment || c_nationkey NOT IN
    (SELECT c_mktsegment || c_nationkey FROM customer WHERE c_acctbal < 0)""",
)
def _(t):
    c = t.customer.select(F.concat("c_mktsegment", "c_nationkey").alias("grp"), "c_acctbal")
    return lookups.anti_join_values(c.filter("c_acctbal >= 0"), c.filter("c_acctbal < 0"), "grp")


@query(
    "union_train_test",
    """SELECT id, job_title, feature_2 FROM postings""",
    ("postings",),
)
def _(t):
    p = t.postings.select("id", "job_title", "feature_2", "salary_category", "order_date")
    train = p.filter(F.col("order_date") < SPLIT).drop("order_date")
    test = p.filter(F.col("order_date") >= SPLIT).drop("order_date", "salary_category")
    return ranking.union_train_test(train, test)


@query(
    "concat_vertical",
    """SELECT 'customer' AS kind, c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY 2
    UNION ALL SELECT 'supplier' AS kind, s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY 2""",
)
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n"))
    return ranking.concat_vertical([a.withColumn("kind", F.lit("customer")), b.withColumn("kind", F.lit("supplier"))])


@query(
    "except_values",
    """SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
)
def _(t):
    a = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return ranking.except_values(a, b)


@query(
    "dedup_pairs",
    "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
)
def _(t):
    return ranking.dedup_pairs(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")
