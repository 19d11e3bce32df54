"""Ranking, top-n, running values, run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import arrays
from gradus.operators import ranking
from gradus.plans.registry import query
from gradus.plans.statistics import _CORR, rounded


@query(
    "running_best",
    """SELECT run_index, iteration, max(score) OVER (PARTITION BY run_index ORDER BY ts, iteration) AS best_so_far FROM history""",
    ("history",),
)
def _(t):
    return ranking.running_best(t.history, "run_index", "ts", "iteration", "score").select(
        "run_index", "iteration", "best_so_far"
    )


@query(
    "cumulative_share",
    """WITH v AS (SELECT pos, var_pop(x) AS v FROM (SELECT pos, vec[pos + 1] AS x FROM (SELECT vec, unnest(range(0, 64)) AS pos FROM blocks)) GROUP BY 1),
    c AS (SELECT CAST(pos AS INTEGER) AS pos, v / sum(v) OVER () AS share, sum(v) OVER (ORDER BY pos) / sum(v) OVER () AS cumulative FROM v)
    SELECT pos, round(share, 6) AS share, round(cumulative, 6) AS cumulative, (SELECT min(pos) FROM c WHERE cumulative >= 0.9) AS first_at_target FROM c""",
    ("blocks",),
)
def _(t):
    from gradus.operators.aggregates import vector_moments

    v = vector_moments(t.blocks, "vec").select("pos", "var_pop")
    return rounded(ranking.cumulative_share(v, "pos", "var_pop", 0.9), "share", "cumulative")


@query(
    "top_n",
    """SELECT run_index, iteration, score, std, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_index
    ORDER BY score DESC, iteration) AS INTEGER) AS position FROM history) WHERE position <= 5""",
    ("history",),
)
def _(t):
    h = t.history.select("run_index", "iteration", "score", "std")
    return ranking.top_n(h, 5, "score", "iteration", by="run_index")


@query(
    "rank_results",
    """SELECT run_index, iteration, score, rank() OVER (PARTITION BY run_index ORDER BY score DESC) AS rank_test_score FROM history""",
    ("history",),
)
def _(t):
    return ranking.rank_results(t.history.select("run_index", "iteration", "score"), "run_index", "score")


@query(
    "best_iteration",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_index ORDER BY score DESC, iteration) AS k,
      first_value(score) OVER (PARTITION BY run_index ORDER BY iteration) AS first_score FROM history)
    SELECT run_index, iteration AS best_iteration, score AS best_score, std AS best_std, round(score - first_score, 6) AS improvement
    FROM r WHERE k = 1""",
    ("history",),
)
def _(t):
    return rounded(ranking.best_iteration(t.history, "run_index", "iteration", "score", "std"), "improvement")


@query(
    "iteration_duration",
    """SELECT run_index, iteration, round(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_index ORDER BY ts, iteration)), 0)
    / 1000000, 6) AS duration FROM history""",
    ("history",),
)
def _(t):
    out = ranking.iteration_duration(t.history, "run_index", "ts", "iteration")
    return rounded(out.select("run_index", "iteration", "duration"), "duration")


@query(
    "next_run_index",
    """WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'gbt_runlast' ELSE event_type || '_score_run' || lpad(CAST(user_id AS VARCHAR), 3, '0') END AS name FROM events)
    SELECT coalesce(max(try_cast(nullif(regexp_extract(name, '_run(\\d+)$', 1), '') AS INTEGER)), 0) + 1 AS next_index FROM f""",
)
def _(t):
    name = F.when(F.col("event_type") == "error", "gbt_runlast").otherwise(
        F.concat("event_type", F.lit("_score_run"), F.lpad(F.col("user_id").cast("string"), 3, "0"))
    )
    return ranking.next_run_index(t.events.select(name.alias("name")), "name")


@query(
    "latest_run",
    """SELECT event_type || '_run' || user_id AS path, ts AS end_time FROM events ORDER BY ts DESC, path DESC LIMIT 1""",
)
def _(t):
    runs = t.events.select(F.concat("event_type", F.lit("_run"), "user_id").alias("path"), F.col("ts").alias("end_time"))
    return ranking.latest_run(runs, "path", "end_time")


@query(
    "row_topk_classes",
    """WITH r AS (SELECT id, unnest([0, 1, 2]) AS cls, unnest([p0, p1, p2]) AS p FROM ordinal),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS pos FROM r)
    SELECT id, max(cls) FILTER (WHERE pos = 1) AS first_class, round(max(p) FILTER (WHERE pos = 1), 6) AS first_prob,
    max(cls) FILTER (WHERE pos = 2) AS second_class, round(max(p) FILTER (WHERE pos = 2), 6) AS second_prob FROM k GROUP BY 1""",
    ("ordinal",),
)
def _(t):
    p = arrays.ordinal_probabilities([F.col("c1"), F.col("c2")])
    top = t.probabilities.select("id", arrays.row_topk_classes(p, 2).alias("k"))
    return top.select(
        "id",
        F.get("k", F.lit(0))["class"].alias("first_class"), F.round(F.get("k", F.lit(0))["prob"], 6).alias("first_prob"),
        F.get("k", F.lit(1))["class"].alias("second_class"), F.round(F.get("k", F.lit(1))["prob"], 6).alias("second_prob"),
    )


@query(
    "topk_long_abs",
    """WITH w AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) - 4500 AS v FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, c_mktsegment AS class, round(v, 6) AS coefficient, round(abs(v), 6) AS abs_coef FROM w ORDER BY abs(v) DESC, 1, 2 LIMIT 10""",
)
def _(t):
    long = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("class")).agg((F.avg("c_acctbal") - 4500).alias("coefficient"))
    return rounded(ranking.topk_abs(long, "c_nationkey", 10), "coefficient", "abs_coef")


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM numbers"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]
)


@query("top_corr_pairs", f"SELECT * FROM ({_PAIRS_SQL}) ORDER BY corr DESC LIMIT 4", ("numbers",))
def _(t):
    return rounded(ranking.top_corr_pairs(t.numbers, _CORR, 4), "corr")


@query(
    "top_importance",
    """SELECT p_brand AS feature, round(sum(p_retailprice), 2) AS importance FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 10""",
)
def _(t):
    imp = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return rounded(ranking.top_importance(imp, 10), "importance", digits=2)


@query("sort_rows", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey")
def _(t):
    return ranking.sort_rows(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey")
