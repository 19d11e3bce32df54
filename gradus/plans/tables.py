"""Scans, ids, target split, prediction and run files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.plans.registry import query
from gradus.sources.tables import assign_row_ids, scan_slice, scan_table, split_features_target


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders")
def _(t):
    df = scan_table(t.spark, f"{t.dir}/orders.parquet", required=["o_orderkey", "o_totalprice"])
    return df.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("scan_slice", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def _(t):
    return scan_slice(t.orders, 3, 20, "o_orderkey")


@query(
    "assign_row_ids",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 + 1000 AS row_id FROM orders""",
)
def _(t):
    return assign_row_ids(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 1000).select(
        "o_orderkey", "row_id"
    )


@query("split_features_target", "SELECT id, job_title, feature_1, salary_category FROM postings", ("postings",))
def _(t):
    p = t.postings.select("id", "job_title", "feature_1", "salary_category")
    features, target = split_features_target(p, "salary_category", "id")
    return features.join(target, "id")
