"""The postings data model expressed over the star-schema test tables.

Each view exists twice, as a DataFrame and as a SQL common table expression,
so that a query and its SQL check start from the same rows. Missing values and
rare cases come from the data itself (negative balances, tiny prices, near-zero
vector elements).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions.schema import FeatureSchema

#: columns of the ``postings`` view by role
POSTING_SCHEMA = FeatureSchema(
    boolean=("feature_3", "feature_11"), block=(), quantitative=("feature_2", "feature_10")
)
VECTOR_SCHEMA = FeatureSchema(
    date=("job_posted_date",), categorical=("job_title", "feature_1", "job_state"),
    boolean=("feature_3",), quantitative=("feature_2", "feature_10"), packed="job_desc", block=(),
)
NEAR_ZERO = 0.02
DIM = 64


def _postings(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") < 20000, "unknown").otherwise(F.date_format("o_orderdate", "yyyy/MM")).alias("job_posted_date"),
        F.concat(F.lit("title_"), F.col("c_nationkey")).alias("job_title"),
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").when(F.col("o_orderstatus") == "P", "C").alias("feature_1"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "MI").when(F.col("c_mktsegment") == "BUILDING", "TX")
        .when(F.col("c_mktsegment") == "FURNITURE", "NC").when(F.col("c_mktsegment") == "HOUSEHOLD", "ZZ").alias("job_state"),
        (F.col("o_totalprice") / 1000).alias("feature_2"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("feature_10"),
        (F.col("o_totalprice") > 250000).alias("feature_3"),
        (F.month("o_orderdate") <= 6).alias("feature_11"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "High").when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
        .otherwise("Low").alias("salary_category"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


_POSTINGS_SQL = """
SELECT o_orderkey AS id,
  CASE WHEN o_totalprice < 20000 THEN 'unknown' ELSE strftime(o_orderdate, '%Y/%m') END AS job_posted_date,
  'title_' || c_nationkey AS job_title,
  CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' WHEN 'P' THEN 'C' END AS feature_1,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MI' WHEN 'BUILDING' THEN 'TX' WHEN 'FURNITURE' THEN 'NC' WHEN 'HOUSEHOLD' THEN 'ZZ' END AS job_state,
  o_totalprice / 1000 AS feature_2,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS feature_10,
  o_totalprice > 250000 AS feature_3,
  month(o_orderdate) <= 6 AS feature_11,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS salary_category,
  CAST(o_orderdate AS DATE) AS order_date
FROM orders JOIN customer ON o_custkey = c_custkey"""

_CODE_SQL = "CASE salary_category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END"


def _coded(t):
    """Postings with parsed date and ordinal target."""
    from gradus.functions import scalars

    p = t.postings
    return p.withColumn("d", scalars.parse_year_month(F.col("job_posted_date"))).withColumn(
        "y", scalars.ordinal_encode(F.col("salary_category"))
    )


_CODED_SQL = f"SELECT *, CAST(try_strptime(job_posted_date, '%Y/%m') AS DATE) AS d, {_CODE_SQL} AS y FROM postings"


def _blocks(t):
    """One vector per id; near-zero elements are zeros; y is a learnable ordered class."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    score = F.get(x, F.lit(0)) + 2 * F.get(x, F.lit(1))
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        F.transform(x, lambda e: F.when(F.abs(e) < NEAR_ZERO, F.lit(0.0)).otherwise(e)).alias("job_desc"),
        x.alias("vec"),
        F.when(score < -0.12, 0).when(score < 0.12, 1).otherwise(2).alias("y"),
        F.col("label"),
    )


_BLOCKS_SQL = f"""
SELECT id, list_transform(vec, lambda e: CASE WHEN abs(e) < {NEAR_ZERO} THEN 0.0::DOUBLE ELSE e END) AS job_desc, vec,
  CASE WHEN vec[1] + 2 * vec[2] < -0.12 THEN 0 WHEN vec[1] + 2 * vec[2] < 0.12 THEN 1 ELSE 2 END AS y, label
FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""


def _history(t):
    """Search histories: one run per user, one iteration per event, score = value / 1000."""
    return t.events.select(
        F.col("user_id").alias("run_index"),
        F.col("event_id").alias("iteration"),
        F.col("event_type").alias("model"),
        F.col("ts"),
        (F.col("value") / 1000).alias("score"),
        (F.get_json_object("props", "$.k").cast("int") / 1000.0).cast("double").alias("std"),
    )


_HISTORY_SQL = """
SELECT user_id AS run_index, event_id AS iteration, event_type AS model, ts, value / 1000 AS score,
  CAST(CAST(props ->> '$.k' AS INTEGER) AS DOUBLE) / 1000.0 AS std
FROM events"""


def _predictors(t):
    """Three rule-based prediction columns per order."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") > 340000, "High").when(F.col("o_totalprice") > 170000, "Medium").otherwise("Low").alias("by_price"),
        F.when(F.col("o_orderstatus") == "P", "High").when(F.col("o_orderstatus") == "O", "Medium").otherwise("Low").alias("by_status"),
        F.when(F.month("o_orderdate") > 8, "High").when(F.month("o_orderdate") > 4, "Medium").otherwise("Low").alias("by_month"),
    )


_PREDICTORS_SQL = """
SELECT o_orderkey AS id,
  CASE WHEN o_totalprice > 340000 THEN 'High' WHEN o_totalprice > 170000 THEN 'Medium' ELSE 'Low' END AS by_price,
  CASE WHEN o_orderstatus = 'P' THEN 'High' WHEN o_orderstatus = 'O' THEN 'Medium' ELSE 'Low' END AS by_status,
  CASE WHEN month(o_orderdate) > 8 THEN 'High' WHEN month(o_orderdate) > 4 THEN 'Medium' ELSE 'Low' END AS by_month
FROM orders"""


def _probabilities(t):
    """Cumulative and class probabilities per part, some of them crossing."""
    c1 = F.least(F.lit(1.0), F.col("p_size") / F.lit(50.0))
    c2 = (F.col("p_retailprice") - 900.0) / F.lit(100.0)
    return t.part.select(F.col("p_partkey").alias("id"), c1.alias("c1"), c2.alias("c2"), F.col("p_type").alias("p_type"))


_PROBABILITIES_SQL = """
SELECT p_partkey AS id, least(1.0::DOUBLE, CAST(p_size AS DOUBLE) / 50.0::DOUBLE) AS c1,
  (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS c2, p_type FROM part"""

_ORDINAL_SQL = """
SELECT id, p_type, raw[1] / s AS p0, raw[2] / s AS p1, raw[3] / s AS p2 FROM (
  SELECT id, p_type, raw, raw[1] + raw[2] + raw[3] AS s FROM (
    SELECT id, p_type, [greatest(1 - c1, 0), greatest(c1 - c2, 0), greatest(c2, 0)] AS raw FROM probabilities))"""


def _numbers(t):
    """Numeric features per line item, with a related column and a constant one."""
    return t.lineitem.select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * 0.001 + F.col("l_quantity")).alias("mixed"),
        F.lit(1.0).alias("constant"),
        F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("gappy"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"),
    )


_NUMBERS_SQL = """
SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  l_extendedprice * 0.001::DOUBLE + l_quantity AS mixed, 1.0::DOUBLE AS constant,
  CASE WHEN l_linestatus = 'O' THEN l_tax END AS gappy,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y
FROM lineitem"""

def _candidates(t):
    """Full labelled rows: a vector with its order and customer attributes (gaps where none match)."""
    o = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") < 20000, "unknown").otherwise(F.date_format("o_orderdate", "yyyy/MM")).alias("job_posted_date"),
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C").alias("feature_1"),
        (F.col("o_totalprice") / 1000).alias("feature_2"),
        (F.month("o_orderdate") <= 6).cast("int").alias("feature_3"),
    )
    c = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("title_"), F.col("c_nationkey") % 5).alias("job_title"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "MI").when(F.col("c_mktsegment") == "BUILDING", "TX")
        .when(F.col("c_mktsegment") == "FURNITURE", "NC").when(F.col("c_mktsegment") == "HOUSEHOLD", "ZZ").alias("job_state"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("feature_10"),
    )
    b = t.blocks.select(
        "id", "job_desc", F.when(F.col("y") == 0, "Low").when(F.col("y") == 1, "Medium").otherwise("High").alias("salary_category")
    )
    return b.join(o, "id", "left").join(c, "id", "left")


VIEWS = {
    "candidates": _candidates,
    "postings": _postings, "coded": _coded, "blocks": _blocks, "history": _history,
    "predictors": _predictors, "probabilities": _probabilities, "numbers": _numbers,
}
VIEW_SQL = {
    "postings": _POSTINGS_SQL, "coded": _CODED_SQL, "blocks": _BLOCKS_SQL, "history": _HISTORY_SQL,
    "predictors": _PREDICTORS_SQL, "probabilities": _PROBABILITIES_SQL, "numbers": _NUMBERS_SQL,
    "ordinal": _ORDINAL_SQL,
}
NEEDS = {"coded": ("postings",), "ordinal": ("probabilities",)}


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """Prepend the SQL of the used views as common table expressions."""
    order: list[str] = []
    for name in uses:
        for v in (*NEEDS.get(name, ()), name):
            if v not in order:
                order.append(v)
    if not order:
        return sql
    views = ", ".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"
