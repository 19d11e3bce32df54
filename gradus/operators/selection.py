"""Feature selection. Each selector returns (feature, position, score, rank, selected), one row per feature."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.bounds import collect_small
from gradus.operators.aggregates import vector_corr_pairs, vector_moments
from gradus.operators.quantiles import SKETCH_ACCURACY

SELECTION = "feature string, position int, score double, rank int, selected boolean"


def selection_size(n_features: int | float | str, total: int) -> int:
    """auto: half of the features, at least 10; fraction: its share; number: itself; never more than all."""
    if n_features == "auto":
        return min(total, max(10, total // 2))
    if isinstance(n_features, float) and 0 < n_features < 1:
        return max(1, int(total * n_features))
    return min(int(n_features), total)


def ranked_table(spark, scores: Sequence[float | None], names: Sequence[str], k: int | None = None, keep=None) -> DataFrame:
    """Best score first, missing scores last, equal scores in column order."""
    order = sorted(range(len(names)), key=lambda i: (scores[i] is None, -(scores[i] or 0.0), i))
    place = {i: r + 1 for r, i in enumerate(order)}
    rows = [
        (names[i], i, scores[i], place[i], bool(keep[i]) if keep is not None else place[i] <= k)
        for i in range(len(names))
    ]
    return spark.createDataFrame(rows, SELECTION)


def select_variance(df: DataFrame, vec: str, names: Sequence[str], q: float = 0.5) -> DataFrame:
    """Population variance strictly above the q-quantile of all variances."""
    found = {r["pos"]: r["var_pop"] for r in collect_small(vector_moments(df, vec))}
    scores = [found.get(i) for i in range(len(names))]
    present = sorted(v for v in scores if v is not None)
    pos = q * (len(present) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    cut = present[lo] + (present[hi] - present[lo]) * (pos - lo)
    return ranked_table(df.sparkSession, scores, names, keep=[v is not None and v > cut for v in scores])


def select_correlation(df: DataFrame, vec: str, names: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """A feature goes when some later one correlates with it above the threshold; score = that largest value."""
    pairs = vector_corr_pairs(df, vec, names)
    worst = {r["i"]: r["c"] for r in collect_small(pairs.groupBy("i").agg(F.max(F.abs("corr")).alias("c")))}
    scores = [worst.get(i) for i in range(len(names))]
    return ranked_table(df.sparkSession, scores, names, keep=[v is None or not v > threshold for v in scores])


def _class_moments(df: DataFrame, vec: str, y: str):
    """(position, class) -> n, sum, mean, var, low, high; features x classes rows."""
    return {(r["pos"], r[y]): r for r in collect_small(vector_moments(df, vec, [y]))}


def chi2_scores(moments: dict, p: int) -> list[float | None]:
    classes = sorted({c for _, c in moments})
    out: list[float | None] = []
    for i in range(p):
        rows = [moments[(i, c)] for c in classes if (i, c) in moments]
        low, high = min(r["low"] for r in rows), max(r["high"] for r in rows)
        if high == low:
            out.append(None)
            continue
        n = sum(r["n"] for r in rows)
        observed = [(r["total"] - r["n"] * low) / (high - low) for r in rows]
        total = sum(observed)
        expected = [total * r["n"] / n for r in rows]
        out.append(sum((o - e) ** 2 / e for o, e in zip(observed, expected)))
    return out


def select_chi2(df: DataFrame, vec: str, y: str, names: Sequence[str], k) -> DataFrame:
    """Class sums of min-max scaled values against their expectation.

    Scaling is linear, so the scaled sums follow from the per-class sums and the
    overall range: one pass, no rescaled copy of the data.
    """
    scores = chi2_scores(_class_moments(df, vec, y), len(names))
    return ranked_table(df.sparkSession, scores, names, selection_size(k, len(names)))


def anova_scores(moments: dict, p: int) -> list[float | None]:
    classes = sorted({c for _, c in moments})
    out: list[float | None] = []
    for i in range(p):
        rows = [moments[(i, c)] for c in classes if (i, c) in moments]
        n, k = sum(r["n"] for r in rows), len(rows)
        mean = sum(r["n"] * r["mean"] for r in rows) / n
        between = sum(r["n"] * (r["mean"] - mean) ** 2 for r in rows)
        within = sum(r["n"] * r["var_pop"] for r in rows)
        out.append((between / (k - 1)) / (within / (n - k)) if within > 0 and k > 1 and n > k else None)
    return out


def select_anova(df: DataFrame, vec: str, y: str, names: Sequence[str], k) -> DataFrame:
    """One-way F statistic from per-class counts, means and variances."""
    scores = anova_scores(_class_moments(df, vec, y), len(names))
    return ranked_table(df.sparkSession, scores, names, selection_size(k, len(names)))


def quantile_edges(df: DataFrame, vec: str, p: int, bins: int) -> list[list[float]]:
    """Per position, the inner edges of ``bins`` bins of equal shares: for each, the least value up to which its share of the non-null values lies.

    A sketch brackets every edge, one pass counts the values below the brackets, one reads
    the values inside them (a few in ten thousand).
    """
    slack, inner = 2.0 / SKETCH_ACCURACY, range(1, bins)
    probs = [max(0.0, min(1.0, i / bins + side)) for i in inner for side in (-slack, slack)]
    sketch = df.select(
        *[F.percentile_approx(F.get(vec, F.lit(i)), F.array(*map(F.lit, probs)), F.lit(SKETCH_ACCURACY)).alias(f"e{i}") for i in range(p)]
    ).first()
    known = [(i, sketch[f"e{i}"][::2], sketch[f"e{i}"][1::2]) for i in range(p) if sketch[f"e{i}"] is not None]
    if not known:
        return [[] for _ in range(p)]
    ends = df.sparkSession.createDataFrame(known, "pos int, low array<double>, high array<double>")
    x = F.col("x")
    rows = df.select(F.posexplode(vec).alias("pos", "x")).filter(x.isNotNull()).withColumn("x", x.cast("double")).join(F.broadcast(ends), "pos")
    at = lambda side, i: F.get(side, F.lit(i - 1))
    counts = collect_small(rows.groupBy("pos").agg(F.count("*").alias("n"), *[F.count_if(x < at("low", i)).alias(f"b{i}") for i in inner]))
    wanted = [(r["pos"], i, max(1, -(-i * r["n"] // bins)) - r[f"b{i}"]) for r in counts for i in inner]
    need = df.sparkSession.createDataFrame(wanted, "pos int, edge int, need bigint")
    inside = F.array_compact(F.array(*[F.when((x >= at("low", i)) & (x <= at("high", i)), F.lit(i)) for i in inner]))
    values = rows.select("pos", "x", F.explode(inside).alias("edge")).groupBy("pos", "edge", "x").count()
    upto = F.sum("count").over(Window.partitionBy("pos", "edge").orderBy("x"))
    found = values.withColumn("upto", upto).join(F.broadcast(need), ["pos", "edge"]).filter("upto >= need")
    edges: list[list[float]] = [[] for _ in range(p)]
    for r in sorted(collect_small(found.groupBy("pos", "edge").agg(F.min("x").alias("x"))), key=lambda r: (r["pos"], r["edge"])):
        edges[r["pos"]].append(r["x"])
    return edges


def mutual_info_binned(df: DataFrame, vec: str, y: str, p: int, bins: int = 10) -> list[float]:
    """Mutual information of quantile-binned positions with the class.

    Bin edges are exact (:func:`quantile_edges`); the contingency counts
    (positions x bins x classes) are the only other thing shuffled.
    """
    edges = quantile_edges(df, vec, p, bins)
    shared = F.array(*[F.array(*[F.lit(v) for v in e]).cast("array<double>") for e in edges])
    long = df.select(F.col(y).alias("c"), F.posexplode(F.zip_with(
        vec, shared, lambda x, e: F.size(F.filter(e, lambda v: v < x))
    )).alias("pos", "bin"))
    cells: dict[int, dict[tuple[int, object], int]] = {}
    for r in collect_small(long.filter(F.col("bin").isNotNull()).groupBy("pos", "bin", "c").count(), 1_000_000):
        cells.setdefault(r["pos"], {})[(r["bin"], r["c"])] = r["count"]
    out = []
    for i in range(p):
        counts = cells.get(i, {})
        n = sum(counts.values())
        b_tot: dict[int, int] = {}
        c_tot: dict[object, int] = {}
        for (b, c), m in counts.items():
            b_tot[b] = b_tot.get(b, 0) + m
            c_tot[c] = c_tot.get(c, 0) + m
        out.append(sum(m / n * math.log(m * n / (b_tot[b] * c_tot[c])) for (b, c), m in counts.items()) if n else 0.0)
    return out


def select_mutual_info(
    df: DataFrame, vec: str, y: str, names: Sequence[str], k, bins: int = 10, neighbours: int | None = None, id_col: str = "id"
) -> DataFrame:
    """Binned estimator by default; with ``neighbours`` the nearest-neighbour estimator."""
    if neighbours:
        from gradus.operators.mutual_info import mutual_info_neighbour

        found = mutual_info_neighbour(df, id_col, vec, y, neighbours)
        scores = [found.get(i, 0.0) for i in range(len(names))]
    else:
        scores = mutual_info_binned(df, vec, y, len(names), bins)
    return ranked_table(df.sparkSession, scores, names, selection_size(k, len(names)))


def features_and_label(df: DataFrame, vec: str, y: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(array_to_vector(vec).alias("features"), F.col(y).cast("double").alias("label"))


def forest_importances(df: DataFrame, vec: str, y: str, trees: int = 100, depth: int = 5, seed: int = 42) -> list[float]:
    from pyspark.ml.classification import RandomForestClassifier

    data = features_and_label(df, vec, y)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    return [float(v) for v in model.featureImportances.toArray()]


def select_tree_importance(df: DataFrame, vec: str, y: str, names: Sequence[str], k, trees: int = 100, depth: int = 5) -> DataFrame:
    """Forest importances; ``rank`` is the importance order."""
    scores = forest_importances(df, vec, y, trees, depth)
    return ranked_table(df.sparkSession, scores, names, selection_size(k, len(names)))


def select_l1(df: DataFrame, vec: str, y: str, names: Sequence[str], k, c: float = 0.1) -> DataFrame:
    """L1 logistic, one model per class; norm of the coefficients over the classes above 1e-5."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    data = features_and_label(df, vec, y).persist()
    learner = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * data.count()), maxIter=100)
    model = OneVsRest(classifier=learner, parallelism=4).fit(data)
    data.unpersist()
    scores = [float(sum(abs(m.coefficients[i]) for m in model.models)) for i in range(len(names))]
    size = selection_size(k, len(names))
    order = sorted(range(len(names)), key=lambda i: (-scores[i], i))[:size]
    return ranked_table(df.sparkSession, scores, names, keep=[i in order and scores[i] > 1e-5 for i in range(len(names))])


def select_rfe(df: DataFrame, vec: str, y: str, names: Sequence[str], k, trees: int = 50, depth: int = 5, step: float = 0.1) -> DataFrame:
    """Refit a forest and drop the weakest tenth until ``k`` features remain.

    ``rank`` is 1 for kept features and grows with earlier elimination; the
    score is the importance in the last fit the feature took part in.
    """
    size = selection_size(k, len(names))
    left = list(range(len(names)))
    drop = max(1, int(step * len(names)))
    scores, ranks, rounds = [0.0] * len(names), [1] * len(names), []
    cached = df.select(vec, y).persist()
    while True:
        sub = cached.select(F.array(*[F.get(vec, F.lit(i)) for i in left]).alias("__v"), y)
        imp = forest_importances(sub, "__v", y, trees, depth)
        for i, v in zip(left, imp):
            scores[i] = v
        if len(left) <= size:
            break
        n_out = min(drop, len(left) - size)
        gone = sorted(range(len(left)), key=lambda j: (imp[j], -j))[:n_out]
        rounds.append([left[j] for j in gone])
        left = [i for j, i in enumerate(left) if j not in set(gone)]
    cached.unpersist()
    for back, group in enumerate(reversed(rounds)):
        for i in group:
            ranks[i] = back + 2
    rows = [(names[i], i, scores[i], ranks[i], i in set(left)) for i in range(len(names))]
    return df.sparkSession.createDataFrame(rows, SELECTION)


def select_vote(tables: Sequence[DataFrame], k, total: int) -> DataFrame:
    """Features chosen by at least half of the selectors, topped up by votes in column order, cut at ``k``."""
    size = selection_size(k, total)
    votes: dict[int, int] = {}
    names: dict[int, str] = {}
    for t in tables:
        for r in collect_small(t):
            names[r["position"]] = r["feature"]
            votes[r["position"]] = votes.get(r["position"], 0) + int(r["selected"])
    need = len(tables) // 2 + 1
    chosen = [i for i in sorted(votes) if votes[i] >= need]
    rest = sorted((i for i in votes if votes[i] < need), key=lambda i: (-votes[i], i))
    order = chosen + rest
    rows = [(names[i], i, float(votes[i]), r + 1, r < size) for r, i in enumerate(order)]
    return tables[0].sparkSession.createDataFrame(rows, SELECTION)


def select_from_model(importances: DataFrame, rule: str = "mean") -> DataFrame:
    """Keep importance at or above the mean, the median or a multiple such as ``0.75*mean``."""
    rows = collect_small(importances.select("feature", "importance"))
    values = sorted(r["importance"] for r in rows)
    factor, _, base = rule.rpartition("*")
    mid = len(values) // 2
    median = values[mid] if len(values) % 2 else (values[mid - 1] + values[mid]) / 2
    cut = (float(factor) if factor else 1.0) * (sum(values) / len(values) if base == "mean" else median)
    return importances.withColumn("cut", F.lit(cut)).withColumn("selected", F.col("importance") >= F.col("cut"))


def selected_positions(selection: DataFrame, by: str = "position") -> list[int]:
    return [r["position"] for r in sorted(collect_small(selection.filter("selected")), key=lambda r: (r[by], r["position"]))]


def apply_selection(df: DataFrame, selection: DataFrame, vec: str, name: str, by: str = "position") -> DataFrame:
    """The chosen positions of a vector column, in column order or in rank order."""
    keep = selected_positions(selection, by)
    return df.withColumn(name, F.array(*[F.get(vec, F.lit(i)) for i in keep]))


def importance_table(spark, importances: Sequence[float], names: Sequence[str]) -> DataFrame:
    rows = sorted(zip(names, map(float, importances)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")
