"""Projections, filters, casts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import arrays, dates, scalars
from gradus.operators import projection
from gradus.plans.registry import query
from gradus.plans.standins import POSTING_SCHEMA


@query(
    "select_features",
    """SELECT id, job_posted_date, job_title, feature_1, job_state, feature_3, feature_11, feature_2, feature_10
    FROM postings""",
    ("postings",),
)
def _(t):
    return projection.select_features(t.postings, POSTING_SCHEMA, ["id"])


@query("select_by_pattern", "SELECT id, feature_2, feature_10 FROM postings", ("postings",))
def _(t):
    return projection.select_by_pattern(t.postings, r"^feature_", "numeric", keep=["id"])


@query(
    "zero_to_null",
    "SELECT l_orderkey, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey",
        scalars.zero_to_null(F.col("l_discount")).alias("discount"),
        scalars.zero_to_null(F.col("l_tax")).alias("tax"),
    )


@query(
    "parse_year_month",
    "SELECT id, CAST(try_strptime(job_posted_date, '%Y/%m') AS DATE) AS d FROM postings",
    ("postings",),
)
def _(t):
    return t.postings.select("id", scalars.parse_year_month(F.col("job_posted_date")).alias("d"))


_DATE_TEXTS = """texts AS (SELECT o_orderkey AS id, o_orderdate AS true_date, CASE o_orderkey % 9
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%B %d, %Y')
      WHEN 4 THEN strftime(o_orderdate, '%d %b %Y 10:20') WHEN 5 THEN strftime(o_orderdate, '%Y%m%d') WHEN 6 THEN strftime(o_orderdate, '%a, %d.%m.%Y') WHEN 7 THEN strftime(o_orderdate, '%b %Y')
      ELSE strftime(o_orderdate, 'week %j of %Y') END AS txt FROM orders)"""


def _date_texts(t):
    """Order dates in eight layouts and as texts that aren't dates."""
    layouts = ("yyyy-MM-dd", "yyyy/MM", "dd/MM/yyyy", "MMMM dd, yyyy", "dd MMM yyyy '10:20'", "yyyyMMdd", "EEE, dd.MM.yyyy", "MMM yyyy")
    text = F.date_format("o_orderdate", "'week' DDD 'of' yyyy")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", layout)).otherwise(text)
    return t.orders.select(F.col("o_orderkey").alias("id"), text.alias("txt"))


@query(
    "infer_dates",
    f"""WITH {_DATE_TEXTS} SELECT id, CAST(CASE WHEN id % 9 IN (1, 7) THEN date_trunc('month', true_date) WHEN id % 9 < 8 THEN true_date END AS DATE) AS d FROM texts""",
)
def _(t):
    texts = _date_texts(t)
    return texts.select("id", dates.fit_date_layouts(texts, "txt").parse(F.col("txt")).alias("d"))


@query(
    "date_layouts",
    f"""WITH {_DATE_TEXTS} SELECT CASE id % 9 WHEN 0 THEN 'Y-N-N' WHEN 1 THEN 'Y-N' WHEN 2 THEN 'N-N-Y' WHEN 3 THEN 'A-N-Y' WHEN 4 THEN 'N-A-Y' WHEN 5 THEN 'C' WHEN 6 THEN 'N-N-Y' WHEN 7 THEN 'A-Y' END AS layout,
    count(*) AS texts, count(*) FILTER (id % 9 < 8) AS read FROM texts GROUP BY 1""",
)
def _(t):
    return dates.layout_report(_date_texts(t), "txt")


@query(
    "parse_date_lenient",
    """WITH texts AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 'O' THEN strftime(o_orderdate, '%Y/%m') ELSE strftime(o_orderdate, 'Q%m %Y') END AS txt FROM orders)
    SELECT id, CAST(coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%Y/%m')) AS DATE) AS d FROM texts""",
)
def _(t):
    status = F.col("o_orderstatus")
    txt = (
        F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(status == "O", F.date_format("o_orderdate", "yyyy/MM"))
        .otherwise(F.date_format("o_orderdate", "'Q'MM yyyy"))
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), txt.alias("txt")).select(
        "id", scalars.parse_date_lenient(F.col("txt")).alias("d")
    )


@query(
    "binarize_in_set",
    """SELECT id, CASE WHEN f IN ('B', 'C') THEN 1 ELSE 0 END AS flag
    FROM (SELECT id, CASE WHEN feature_2 < 30 THEN NULL ELSE feature_1 END AS f FROM postings)""",
    ("postings",),
)
def _(t):
    f = F.when(F.col("feature_2") >= 30, F.col("feature_1"))
    return t.postings.select("id", scalars.binarize_in_set(f, ("B", "C")).alias("flag"))


@query(
    "binary_target",
    "SELECT id, CASE WHEN salary_category = 'High' THEN 1 ELSE 0 END AS y_high FROM postings",
    ("postings",),
)
def _(t):
    return t.postings.select("id", scalars.binary_target(F.col("salary_category"), "High").alias("y_high"))


@query(
    "ordinal_encode",
    """SELECT id, CASE salary_category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS code
    FROM postings""",
    ("postings",),
)
def _(t):
    return t.postings.select("id", scalars.ordinal_encode(F.col("salary_category")).alias("code"))


@query(
    "ordinal_decode",
    """SELECT p_partkey, CASE p_size - 1 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS label
    FROM part""",
)
def _(t):
    return t.part.select("p_partkey", scalars.ordinal_decode(F.col("p_size") - 1).alias("label"))


@query(
    "label_encode_alpha",
    "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part",
)
def _(t):
    return projection.label_encode_alpha(t.part.select("p_partkey", "p_brand"), "p_brand")


@query(
    "label_decode",
    """WITH codes AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part))
    SELECT p_partkey, CAST(p_size % 8 AS BIGINT) AS predicted, p_type FROM
      (SELECT p_partkey, p_size FROM part) LEFT JOIN codes ON p_size % 8 = code""",
)
def _(t):
    table = projection.label_table(t.part, "p_type")
    coded = t.part.select("p_partkey", (F.col("p_size") % 8).cast("bigint").alias("predicted"))
    return projection.label_decode(coded, "predicted", table)


@query(
    "cast_types",
    """SELECT id, job_title, CAST(feature_3 AS INTEGER) AS feature_3, CAST(feature_11 AS INTEGER) AS feature_11,
    CAST(trunc(feature_10) AS INTEGER) AS feature_10 FROM postings""",
    ("postings",),
)
def _(t):
    cols = t.postings.select("id", "job_title", "feature_3", "feature_11", "feature_10")
    return projection.cast_types(cols, {"feature_10": "int"})


@query(
    "fill_null_const",
    "SELECT id, coalesce(feature_10, 0.0) AS feature_10, coalesce(job_state, 'none') AS job_state FROM postings",
    ("postings",),
)
def _(t):
    p = projection.fill_null_const(t.postings.select("id", "feature_10", "job_state"), 0.0, ["feature_10"])
    return projection.fill_null_const(p, "none", ["job_state"])


@query(
    "fill_null_mean",
    "SELECT id, round(coalesce(feature_10, (SELECT avg(feature_10) FROM postings)), 6) AS feature_10 FROM postings",
    ("postings",),
)
def _(t):
    from gradus.operators.features import impute_mean

    return impute_mean(t.postings.select("id", "feature_10"), ["feature_10"]).withColumn(
        "feature_10", F.round("feature_10", 6)
    )


@query(
    "drop_nulls",
    "SELECT id, feature_10, job_state FROM postings WHERE feature_10 IS NOT NULL AND job_state IS NOT NULL",
    ("postings",),
)
def _(t):
    return projection.drop_nulls(t.postings.select("id", "feature_10", "job_state"), ["feature_10", "job_state"])


@query("filter_eq", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return projection.filter_eq(t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag"), "l_returnflag", "R")


@query(
    "valid_vector_rows",
    "SELECT id, y FROM blocks WHERE job_desc[1] <> 0",
    ("blocks",),
)
def _(t):
    masked = t.blocks.withColumn("job_desc", arrays.zero_to_null_array(F.col("job_desc")))
    return projection.valid_vector_rows(masked, "job_desc").select("id", "y")


@query("drop_column", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return projection.drop_column(t.orders, "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


@query(
    "prefix_columns",
    """SELECT id, job_state AS js_f1__job_state, feature_1 AS js_f1__feature_1, feature_2 AS quants__feature_2,
    feature_10 AS quants__feature_10 FROM postings""",
    ("postings",),
)
def _(t):
    steps = {"js_f1": ["job_state", "feature_1"], "quants": ["feature_2", "feature_10"]}
    return projection.prefix_columns(t.postings, steps, keep=["id"])


@query(
    "short_param_name",
    """SELECT p_partkey, list_extract(string_split('model__' || p_type || '__' || p_brand, '__'), -1) AS short,
    printf('%.6f', p_retailprice) AS shown FROM part""",
)
def _(t):
    long = F.concat(F.lit("model__"), F.col("p_type"), F.lit("__"), F.col("p_brand"))
    return t.part.select(
        "p_partkey", scalars.short_param_name(long).alias("short"), F.format_string("%.6f", "p_retailprice").alias("shown")
    )


@query(
    "months_since",
    """SELECT id, (year(d) - 1998) * 12 + month(d) - 6 AS months FROM coded""",
    ("coded",),
)
def _(t):
    ref = F.lit("1998-06-01").cast("date")
    return t.coded.select("id", scalars.months_since(F.col("d"), ref).cast("bigint").alias("months"))


@query("month_of_year", "SELECT id, CAST(month(d) AS INTEGER) AS m FROM coded", ("coded",))
def _(t):
    return t.coded.select("id", scalars.month_of_year(F.col("d")).alias("m"))


@query(
    "l2_norm",
    "SELECT id, round(sqrt(list_sum(list_transform(job_desc, lambda e: e * e))), 6) AS norm FROM blocks",
    ("blocks",),
)
def _(t):
    return t.blocks.select("id", F.round(arrays.l2_norm(F.col("job_desc")), 6).alias("norm"))


_DISTS_SQL = """WITH dists AS (SELECT id,
      [sqrt(list_sum(list_transform(vec, lambda e: e * e))), sqrt(list_sum(list_transform(vec, lambda e: (e - 0.1::DOUBLE) * (e - 0.1::DOUBLE)))),
       sqrt(list_sum(list_transform(vec, lambda e: (e + 0.1::DOUBLE) * (e + 0.1::DOUBLE))))] AS d FROM blocks)"""


def _dists(t):
    centers = [[0.0] * 64, [0.1] * 64, [-0.1] * 64]
    return t.blocks.select("id", arrays.center_distances(F.col("vec"), centers).alias("d"))


@query(
    "distance_softmax",
    _DISTS_SQL
    + """, e AS (SELECT id, list_transform(d, lambda x: exp(list_min(d) - x)) AS w FROM dists)
    SELECT id, round(w[1] / list_sum(w), 6) AS p0, round(w[2] / list_sum(w), 6) AS p1, round(w[3] / list_sum(w), 6) AS p2 FROM e""",
    ("blocks",),
)
def _(t):
    soft = _dists(t).select("id", arrays.distance_softmax(F.col("d")).alias("p"))
    return soft.select("id", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


@query("min_distance", _DISTS_SQL + " SELECT id, round(list_min(d), 6) AS min_dist FROM dists", ("blocks",))
def _(t):
    return _dists(t).select("id", F.round(arrays.min_distance(F.col("d")), 6).alias("min_dist"))


@query(
    "argmax_class",
    "SELECT id, CAST(list_position([c1, c2], greatest(c1, c2)) - 1 AS INTEGER) AS cls FROM probabilities",
    ("probabilities",),
)
def _(t):
    return t.probabilities.select("id", arrays.argmax_class(F.array("c1", "c2")).alias("cls"))


@query(
    "clip_renormalize",
    """SELECT id, round(a / nullif(a + b, 0), 6) AS p0, round(b / nullif(a + b, 0), 6) AS p1
    FROM (SELECT id, greatest(c1 - 0.5, 0) AS a, greatest(c2 - 0.5, 0) AS b FROM probabilities)""",
    ("probabilities",),
)
def _(t):
    p = arrays.clip_renormalize(F.array(F.col("c1") - 0.5, F.col("c2") - 0.5))
    return t.probabilities.select("id", p.alias("p")).select(
        "id", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(1)), 6).alias("p1")
    )


@query(
    "threshold_decode",
    "SELECT id, CAST(c1 > 0.5 AS INTEGER) + CAST(c2 > 0.5 AS INTEGER) AS cls FROM probabilities",
    ("probabilities",),
)
def _(t):
    return t.probabilities.select("id", arrays.threshold_decode([F.col("c1"), F.col("c2")]).alias("cls"))


@query(
    "standardize_value",
    """SELECT event_id, round((value - 50) / 10, 6) AS z, round(abs(value - 50), 6) AS abs_dev, round(sqrt(value), 6) AS root,
    round(exp(-value / 100), 6) AS decay, round(log10(value), 6) AS log_value, round(value, 1) AS one_digit FROM events""",
)
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id",
        F.round((v - 50) / 10, 6).alias("z"),
        F.round(scalars.elementwise(v - 50, "abs"), 6).alias("abs_dev"),
        F.round(scalars.elementwise(v, "sqrt"), 6).alias("root"),
        F.round(scalars.elementwise(-v / 100, "exp"), 6).alias("decay"),
        F.round(scalars.elementwise(v, "log10"), 6).alias("log_value"),
        scalars.elementwise(v, "round", 1).alias("one_digit"),
    )
