"""Histogram trees, the ordinal net, the logistic path, Ward linkage, robust covariance, halving, date layouts."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import dates
from gradus.operators import evaluation, logit_path, models, ordinal_net, outliers, trees, ward


def rows_of(n=600, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    score = x[:, 0] + 0.8 * x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)
    return x, np.digitize(score, [-0.6, 0.6])


@pytest.fixture(scope="module")
def learnable(spark):
    x, y = rows_of()
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, vec array<double>, y int")
    return x, y, df.repartition(4).cache()


# --- trees ------------------------------------------------------------------


def plain_round(bins, g, h, depth, n_bins, l1, l2, allowed):
    """One regression tree by exhaustive search: the value of every row."""
    out = np.zeros(len(g))
    soft = lambda s: np.sign(s) * max(abs(s) - l1, 0)
    score = lambda rows: soft(g[rows].sum()) ** 2 / (h[rows].sum() + l2)

    def split(rows, level):
        best = None
        if level < depth:
            for f in allowed:
                for b in range(n_bins - 1):
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= 1.0:
                        gain = 0.5 * (score(left) + score(right) - score(rows))
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, left, right)
        if best is None:
            out[rows] = -soft(g[rows].sum()) / (h[rows].sum() + l2)
        else:
            split(best[1], level + 1)
            split(best[2], level + 1)

    split(np.arange(len(g)), 0)
    return out


def test_boosting_matches_exhaustive_search(spark, learnable):
    x, y, df = learnable
    model = trees.fit_boosted_classes(df, "id", "vec", "y", 4, rounds=3, depth=2, rate=0.5, subsample=1.0, columns=1.0, l1=0.5, l2=2.0, bins=8)
    bins = np.column_stack([np.searchsorted(model.edges[j], x[:, j], "left") for j in range(4)])
    margin = np.tile(model.base, (len(x), 1))
    losses = []
    for _ in range(3):
        p = trees.softmax(margin)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        margin = margin + 0.5 * np.column_stack([plain_round(bins, p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), 2, 8, 0.5, 2.0, range(4)) for k in range(3)])
    assert np.allclose(model.losses[:3], losses) and np.allclose(model.margins(bins), margin, atol=1e-8)
    got = model.transform(df, "vec").orderBy("id").collect()
    assert np.allclose([r["probability"] for r in got], trees.softmax(margin), atol=1e-8)
    assert [r["prediction"] for r in got] == trees.softmax(margin).argmax(1).tolist()


def test_boosting_learns_and_penalties_shrink(spark, learnable):
    _, _, df = learnable
    plain = trees.fit_boosted_classes(df, "id", "vec", "y", 4, rounds=8, depth=3, rate=0.4, subsample=0.8, columns=0.7, bins=16)
    assert all(b < a for a, b in zip(plain.losses, plain.losses[1:]))
    again = trees.fit_boosted_classes(df.repartition(7), "id", "vec", "y", 4, rounds=8, depth=3, rate=0.4, subsample=0.8, columns=0.7, bins=16)
    assert np.allclose(plain.losses, again.losses)
    strong = trees.fit_boosted_classes(df, "id", "vec", "y", 4, rounds=1, depth=3, l1=1e6, bins=16)
    assert np.allclose(strong.losses[0], strong.losses[1])


def test_trees_take_nulls_one_class_and_groups_of_trees(spark, monkeypatch):
    df = spark.createDataFrame([(i, [None if i % 3 == 0 else float(i % 7)], "only") for i in range(50)], "id bigint, vec array<double>, y string")
    got = trees.fit_boosted_classes(df, "id", "vec", "y", 1, rounds=1, depth=2, bins=4).transform(df, "vec").select("prediction").distinct().collect()
    assert [r[0] for r in got] == ["only"]
    two = df.withColumn("y", F.when(F.col("id") % 3 == 0, "gap").otherwise("seen"))
    whole = trees.fit_bagged_forest(two, "id", "vec", "y", 1, 6, 2, bins=4)
    monkeypatch.setattr(trees, "HISTOGRAM_NUMBERS", 1)  # a group per tree
    single = trees.fit_bagged_forest(two, "id", "vec", "y", 1, 6, 2, bins=4)
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() for a, b in zip(whole.trees, single.trees))
    votes = whole.left_out_votes().filter("n_out > 0").collect()
    assert all(r["label"] == r["prediction"] for r in votes)  # missing values go right


def test_left_out_votes(spark, learnable):
    _, y, df = learnable
    fitted = trees.fit_bagged_forest(df, "id", "vec", "y", 4, 40, 5, bins=16)
    got = fitted.left_out_votes().orderBy("id").toPandas()
    assert len(got) == len(y) and got["label"].tolist() == y.tolist()
    assert abs(got["n_out"].mean() / 40 - np.exp(-1)) < 0.02
    state = fitted.rows.select("id", "hash").orderBy("id").toPandas()
    drawn = trees.bootstrap_weights(state["hash"].to_numpy(), 40, 42)
    assert ((drawn == 0).sum(1) == got["n_out"].to_numpy()).all() and abs(drawn.mean() - 1) < 0.03
    assert (got["prediction"] == got["label"]).mean() > 0.6 > np.bincount(y).max() / len(y)
    row = evaluation.holdout_estimate_forest(df, "id", "vec", "y", 4, 40, 5, bins=16).first()
    assert np.isclose(row["accuracy"], (got["prediction"] == got["label"]).mean()) and row["n"] == len(y)


# --- net --------------------------------------------------------------------


@pytest.mark.parametrize("masked", [False, True])
def test_gradient_of_the_net(masked):
    rng = np.random.default_rng(1)
    shape = ordinal_net.Shape(3, (5, 4), 4)
    w, x, y = shape.start(2) + 0.05 * rng.normal(size=shape.size), rng.normal(size=(20, 3)), rng.integers(0, 4, 20)
    masks = [(rng.random((20, n)) > 0.3) / 0.7 for n in (5, 4)] if masked else None
    _, grad = shape.loss_and_gradient(w, x, y, masks)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        diff = (shape.loss_and_gradient(w + step, x, y, masks)[0] - shape.loss_and_gradient(w - step, x, y, masks)[0]) / 2e-6
        assert np.isclose(diff, grad[i], atol=1e-4)


def test_net_learns_with_falling_outputs(spark, learnable):
    _, y, df = learnable
    net = ordinal_net.fit_ordinal_net(df, "id", "vec", "y", 4, hidden=(16,), epochs=25)
    out = net.cumulative(df, "vec").toPandas()
    assert (out["cum_0"] >= out["cum_1"]).all() and net.losses[-1] < 0.8 * net.losses[0]
    pred = (out[["cum_0", "cum_1"]] > 0.5).sum(1)
    assert (pred == out["y"]).mean() > np.bincount(y).max() / len(y) + 0.1
    options = {"hidden": (6,), "epochs": 3, "batches": 4, "dropout": 0.2}
    a, b = (ordinal_net.fit_ordinal_net(d, "id", "vec", "y", 4, **options) for d in (df, df.repartition(6)))
    assert np.allclose(a.weights, b.weights) and len(a.losses) == 12


# --- logistic path ----------------------------------------------------------


def test_path_reaches_every_optimum(spark, learnable):
    x, y, df = learnable
    folded = evaluation.stratified_kfold(df, "id", "y", 3)
    path = logit_path.fit_logit_path(folded, "vec", "y", "fold", 4, [0.001, 0.1, 10.0], tol=1e-7, max_passes=300)
    assert path.weights.shape == (3, 4, 3, 5) and path.gradients.max() < 1e-5
    fold = np.array([r["fold"] for r in folded.orderBy("id").collect()])
    z = np.column_stack([(x - path.mean) / path.scale, np.ones(len(x))])
    for i, c in enumerate(path.cs):
        for j in range(4):
            used = fold != j
            p = trees.softmax(z[used] @ path.weights[i, j].T)
            grad = (p - np.eye(3)[y[used]]).T @ z[used] / used.sum()
            grad[:, :-1] += path.weights[i, j][:, :-1] / (c * used.sum())
            assert np.abs(grad).max() < 1e-5
            if j < 3:
                assert np.isclose(path.scores[i, j], ((z[~used] @ path.weights[i, j].T).argmax(1) == y[~used]).mean())
    table = path.coefficients(spark, list("abcd")).collect()
    assert len(table) == 15 and path.score_table(spark).filter("is_best").count() == 1
    w = {(r["feature"], r["class"]): r["coefficient"] for r in table}
    margin = np.column_stack([sum(x[:, j] * w[f, k] for j, f in enumerate("abcd")) + w["(intercept)", k] for k in range(3)])
    best = path.weights[path.cs.index(path.best), -1]
    assert np.allclose(trees.softmax(margin), trees.softmax(z @ best.T), atol=1e-9)


def test_ten_penalties_by_default(spark, learnable):
    _, _, df = learnable
    path = models.logistic_regression_cv(df.withColumn("fold", (F.col("id") % 2).cast("int")), "vec", "y", "fold", 4, max_passes=40)
    assert len(path.cs) == 10 and np.isclose(path.cs[0], 1e-4) and np.isclose(path.cs[-1], 1e4)


# --- Ward -------------------------------------------------------------------


def plain_ward(x):
    """Heights by merging the cheapest pair again and again."""
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        cost = lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        best = min(((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i)))
        heights.append(best[0] ** 0.5)
        groups[best[2]] = groups[best[2]] + groups.pop(best[1])
    return np.array(heights)


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def test_ward_is_exact_on_single_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    fit = ward.fit_ward(vectors(spark, x), "v")
    assert np.allclose(fit.merges[:, 2], plain_ward(x)) and (np.diff(fit.merges[:, 2]) >= 0).all() and fit.merges[-1, 3] == 60
    assert np.isclose((fit.merges[:, 2] ** 2 / 2).sum(), ((x - x.mean(0)) ** 2).sum())


def test_ward_finds_groups_from_copies_and_summaries(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.2, size=(80, 2)) for c in (0.0, 5.0, 10.0)])
    x[:30] = x[0]
    for summaries in (2048, 25):
        fit = ward.fit_ward(vectors(spark, x), "v", summaries)
        assert fit.sizes.sum() == 240 and len(fit.means) <= summaries and np.allclose((fit.means * fit.sizes[:, None]).sum(0), x.sum(0))
        got = fit.apply(vectors(spark, x), "v", 3).orderBy("id").toPandas()["cluster"].to_numpy()
        assert len(set(got)) == 3 and all(len(set(got[i : i + 80])) == 1 for i in (0, 80, 160))
    assert ward.fit_ward(vectors(spark, x[:1]), "v").labels(3).tolist() == [0]
    table = fit.merge_table(spark).collect()
    assert [r["step"] for r in table] == list(range(1, len(fit.means)))


# --- robust covariance ------------------------------------------------------


def test_reweighted_covariance_is_consistent(spark):
    rng = np.random.default_rng(6)
    true = np.array([[2.0, 0.6, 0.0], [0.6, 1.0, 0.2], [0.0, 0.2, 0.5]])
    x = rng.multivariate_normal([1.0, 2.0, 3.0], true, 6000)
    mean, cov = outliers.fit_elliptic(vectors(spark, x), "id", "v")
    assert np.allclose(mean, [1, 2, 3], atol=0.1) and abs(np.trace(cov) / np.trace(true) - 1) < 0.05
    x[:600] += 30.0
    mean, cov = outliers.fit_elliptic(vectors(spark, x), "id", "v")
    assert np.allclose(mean, [1, 2, 3], atol=0.1) and abs(np.trace(cov) / np.trace(true) - 1) < 0.06
    flags = outliers.outlier_elliptic(vectors(spark, x), "id", "v", 0.1).filter("is_outlier").select("id").toPandas()["id"]
    assert sorted(flags) == list(range(600))


def test_chi2_quantile():
    for share, dof, want in ((0.5, 1, 0.454936), (0.975, 5, 12.832502), (0.5, 64, 63.335031)):
        assert np.isclose(outliers.chi2_quantile(share, dof), want, atol=1e-5)


# --- search -----------------------------------------------------------------


def test_halving_keeps_the_best(spark, learnable):
    _, _, df = learnable
    folded = evaluation.stratified_kfold(models.with_features(df, "vec", "y"), "id", "y", 2).cache()
    space = {"depth": ("int", 1, 6), "trees": ("choice", [1, 12])}

    def make(p):
        return evaluation.estimator_fit_predict(models.random_forest(p["trees"], p["depth"]), ["id", "y", "fold", "prediction"])

    got = evaluation.halving_search(folded, make, space, 6, 2, "y", "id", eta=2, least_share=0.4)
    rows = got.collect()
    assert [sum(r["rung"] == i for r in rows) for i in range(2)] == [6, 3] and sorted({r["share"] for r in rows}) == [0.5, 1.0]
    for draw in (r["draw"] for r in rows if r["rung"] == 1):
        assert next(r["survives"] for r in rows if r["rung"] == 0 and r["draw"] == draw)
    full = evaluation.param_search(folded, make, space, 6, 2, "y").filter("is_best").first()["mean_test_score"]
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["mean_test_score"] >= full - 0.02
    again = evaluation.halving_search(folded, make, space, 6, 2, "y", "id", eta=2, least_share=0.4).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


# --- dates ------------------------------------------------------------------


def test_date_layouts(spark):
    day = datetime.date
    cases = [
        ("2024-03-05", day(2024, 3, 5)), ("2024/03", day(2024, 3, 1)), ("2024.3.5", day(2024, 3, 5)), ("20240305", day(2024, 3, 5)), ("2024", day(2024, 1, 1)),
        ("03/2024", day(2024, 3, 1)), ("March 5, 2024", day(2024, 3, 5)), ("5th of", None), ("5th Mar 2024", day(2024, 3, 5)), ("Sept 2024", day(2024, 9, 1)),
        ("2024 March", day(2024, 3, 1)), ("2024-Mar-05", day(2024, 3, 5)), ("Tue, 05 Mar 2024 10:20:30 +0100", day(2024, 3, 5)), ("2024-03-05T10:20:30.5Z", day(2024, 3, 5)),
        ("2024-02-30", None), ("2024-13-01", None), ("soon", None), ("", None), (None, None), ("12:30", None), ("5", None), ("2024--03", None),
    ]
    for extra, first in (([("25/12/2024", day(2024, 12, 25)), ("03/05/2024", day(2024, 5, 3))], True), ([("12/25/2024", day(2024, 12, 25)), ("03/05/2024", day(2024, 3, 5))], False)):
        rows = cases + extra
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, t string")
        fit = dates.fit_date_layouts(df, "t")
        got = [r["d"] for r in df.select("id", fit.parse(F.col("t")).alias("d")).orderBy("id").collect()]
        assert got == [d for _, d in rows], [(t, g) for (t, d), g in zip(rows, got) if d != g]
        assert fit.day_first is first and fit.texts == len(rows) - 1 and fit.unread == sum(d is None for _, d in rows) - 1
    nothing = spark.createDataFrame([], "id int, t string")
    assert dates.fit_date_layouts(nothing, "t").texts == 0 and dates.layout_report(nothing, "t").collect() == []


# --- exact beyond one task's rows -------------------------------------------


def test_ward_linkage_by_rounds_is_the_chain(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(150, 3)), np.repeat(rng.normal(size=(20, 3)), 4, 0)])
    want = ward.fit_ward(vectors(spark, x), "v").merge_table(spark).orderBy("step").collect()
    got = ward.ward_linkage(vectors(spark, x), "v", local=90).orderBy("step").collect()
    assert len(got) == 169 and [(r["step"], r["a"], r["b"], r["size"]) for r in got] == [(r["step"], r["a"], r["b"], r["size"]) for r in want]
    assert np.allclose([r["height"] for r in got], [r["height"] for r in want])


def test_ward_rounds_ask_only_clusters_without_a_partner(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(20, 8)), 3, 0)])
    want = ward.fit_ward(vectors(spark, x), "v").merge_table(spark).orderBy("step").collect()
    asked, plain = [], ward._cheapest

    def counted(q, a, s, x, b, t):
        asked.append((len(q), len(x)))
        return plain(q, a, s, x, b, t)

    monkeypatch.setattr(ward, "_cheapest", counted)
    got = ward.ward_linkage(vectors(spark, x), "v", local=40).orderBy("step").collect()
    assert len(asked) > 3 and all(rows < left for rows, left in asked[1:]) and sum(rows for rows, _ in asked) < 0.7 * sum(left for _, left in asked)
    monkeypatch.undo()
    spread = ward.ward_linkage(vectors(spark, x), "v", local=40, cells=500 * 8).orderBy("step").collect()
    for rows in (got, spread):
        assert [(r["step"], r["a"], r["b"], r["size"]) for r in rows] == [(r["step"], r["a"], r["b"], r["size"]) for r in want]
        assert np.allclose([r["height"] for r in rows], [r["height"] for r in want])


def test_ward_rounds_end_on_equal_costs(spark):
    for width, cells in ((12, 1 << 21), (3, 0)):
        x = np.array([[i, j] for i in range(width) for j in range(width)], dtype=float)
        rows = ward.ward_linkage(vectors(spark, x), "v", local=5, cells=cells).orderBy("step").collect()
        assert len(rows) == len(x) - 1 and rows[-1]["size"] == len(x) and all(a["height"] <= b["height"] for a, b in zip(rows, rows[1:]))
        assert np.isclose(sum(r["height"] ** 2 / 2 for r in rows), ((x - x.mean(0)) ** 2).sum())


def test_bin_edges_are_exact_beyond_the_sketch(spark):
    from gradus.operators import selection

    n = 60_000
    df = spark.range(n).select(F.array(F.xxhash64("id") / 2.0**63, F.when(F.col("id") % 7 > 0, (F.col("id") % 1000) / 8.0), F.lit(None).cast("double")).alias("v"))
    rows = np.array([[np.nan if e is None else e for e in r["v"]] for r in df.collect()])
    edges = selection.quantile_edges(df, "v", 3, 10)
    for j in (0, 1):
        own = np.sort(rows[~np.isnan(rows[:, j]), j])
        assert edges[j] == [own[-(-i * len(own) // 10) - 1] for i in range(1, 10)]
    assert edges[2] == []
