"""Models, densities and searches on small made tables."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from plinth.operators import generators, learning, neighbors, selection, stats
from plinth.plans import catalog

FOLDER = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def rows(spark):
    df = generators.classification(spark, 400, 3).withColumn("id", F.xxhash64("x0", "x1", "x2"))
    return learning.assemble(df, ["x0", "x1", "x2"], "y", ["id"]).cache()


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_registry_spellings_and_errors(rows):
    assert type(learning.estimator("xgboost")).__name__ == "GBTClassifier"
    with pytest.raises(ValueError, match="unknown algorithm"):
        learning.estimator("nope")


def test_ensembles_learn_a_plane(rows):
    models = {"a": learning.estimator("logistic"), "b": learning.estimator("decision_tree", maxDepth=4)}
    fitted = {n: m.fit(rows) for n, m in models.items()}
    assert accuracy(learning.vote(rows, fitted, ["id"])) > 0.9
    base, final = learning.stack(rows, models, learning.estimator("logistic"), ["id"], 2)
    assert accuracy(learning.stacked(rows, base, final, ["id"])) > 0.9
    assert accuracy(selection.AdaBoost(3, 2).fit(rows).transform(rows)) > 0.85


def test_important_features_come_out(rows):
    found = learning.permutation_importance(rows, learning.estimator("logistic").fit(rows), ["x0", "x1", "x2"], ["id"])
    assert min(found["x0"], found["x1"]) > 0.1 > abs(found["x2"])


def test_search_and_halving(rows):
    assert learning.search(rows, "decision_tree", {"maxDepth": [1, 4]}, ["id"], folds=2)[0]["params"] == {"maxDepth": 4}
    assert selection.halving(rows, "decision_tree", {"maxDepth": [1, 4]}, ["id"]) == {"maxDepth": 4}


def test_optimiser_finds_a_peak():
    best, value = selection.optimise(lambda s: -((s["x"] - 3) ** 2) - (s["k"] != "b"), {"x": ("float", 0, 10), "k": ("choice", ["a", "b"])}, 60)
    assert abs(best["x"] - 3) < 1 and best["k"] == "b" and value > -1


def test_neighbours(spark):
    df = spark.range(300).select("id", (F.col("id") % 20).cast("double").alias("a"), F.when(F.col("id") == 7, 500.0).otherwise((F.col("id") % 13).cast("double")).alias("b"))
    assert neighbors.isolation_forest(df, ["id"], ["a", "b"]).orderBy(F.desc("isolation")).first()["id"] == 7
    assert neighbors.local_outlier_factor(df, ["id"], ["a", "b"]).orderBy(F.desc("lof")).first()["id"] == 7
    gap = df.withColumn("b", F.when(F.col("id") % 10 != 0, F.col("id") / 10)).withColumn("a", F.col("id").cast("double"))
    for out in (neighbors.knn_impute(gap, ["id"], ["a", "b"], 2), neighbors.iterative_impute(gap, ["a", "b"], 2)):
        assert out.where(F.abs(F.col("b") - F.col("id") / 10) > 0.5).count() <= 2


def _spread(spark, n=600):
    """A third of all rows equal, a grid with ties, a far group, rows with nulls; extra columns."""
    i = F.col("id")
    a = F.when(i % 3 == 0, 5.0).when(i % 50 == 1, 1e6 + i).otherwise((i * 7 % 31).cast("double"))
    b = F.when(i % 3 == 0, 5.0).otherwise((i * 11 % 17).cast("double"))
    return spark.range(n).select("id", a.alias("a"), F.when(i % 10 != 7, b).alias("b"), F.lit("x").alias("w"))


def _shared(d, n, k):
    """Weights of the k nearest rows: whole distances first, the last one's rows share what is left."""
    w, left = np.zeros(len(d)), k
    for x in np.unique(d[n > 0]):
        at = (d == x) & (n > 0)
        w[at] = n[at] * min(n[at].sum(), left) / n[at].sum()
        left -= min(n[at].sum(), left)
    return w


@pytest.mark.parametrize("cell_rows", [1000, 8])
def test_densities_equal_a_search_of_all_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(neighbors, "LEAST_ROWS", 4)
    df = _spread(spark)
    got = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(df, ["id"], ["a", "b"], 6).collect()}
    rows = df.toPandas()
    x = rows[["a", "b"]].to_numpy(float)
    whole = np.flatnonzero(~np.isnan(x).any(axis=1))
    d = np.sqrt(((x[whole, None] - x[None, whole]) ** 2).sum(axis=2))
    w = np.array([_shared(d[i], 1 - (np.arange(len(whole)) == i), 6) for i in range(len(whole))])
    far = np.array([d[i][w[i] > 0].max() for i in range(len(whole))])
    own = 1 / np.maximum((w * np.maximum(d, far)).sum(axis=1) / w.sum(axis=1), 1e-12)
    want = (w * own).sum(axis=1) / w.sum(axis=1) / own
    assert len(got) == len(rows) and all(got[i] is None for i in set(range(len(rows))) - set(whole.tolist()))
    assert np.allclose([got[i] for i in whole.tolist()], want, rtol=1e-6)


@pytest.mark.parametrize("cell_rows", [1000, 8])
def test_imputed_values_equal_a_search_of_all_rows(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(neighbors, "LEAST_ROWS", 4)
    df = _spread(spark).withColumn("a", F.when(F.col("id") % 14 != 3, F.col("a")))
    got = neighbors.knn_impute(df, ["id"], ["a", "b"], 4).orderBy("id").toPandas()
    x = df.orderBy("id").toPandas()[["a", "b"]].to_numpy(float)
    donors, want = x[~np.isnan(x).any(axis=1)], x.copy()
    for i in np.flatnonzero(np.isnan(x).any(axis=1)):
        here = ~np.isnan(x[i])
        if here.any():
            w = _shared(np.sqrt(((donors[:, here] - x[i, here]) ** 2).sum(axis=1)), np.ones(len(donors)), 4)
            want[i, ~here] = (w @ donors[:, ~here]) / w.sum()
        else:
            want[i] = donors.mean(axis=0)
    assert list(got.columns) == df.columns and np.allclose(got[["a", "b"]].to_numpy(float), want)


def test_neighbours_of_empty_and_single_tables(spark):
    none = _spread(spark).where("id < 0")
    assert neighbors.local_outlier_factor(none, ["id"], ["a", "b"]).count() == 0 and neighbors.knn_impute(none, ["id"], ["a", "b"]).count() == 0
    one = _spread(spark).where("id = 1")
    assert neighbors.local_outlier_factor(one, ["id"], ["a", "b"]).first()["lof"] == 1
    assert neighbors.knn_impute(_spread(spark).where("id = 7"), ["id"], ["a", "b"]).first()["b"] is None


def test_dbscan_separates_groups_and_noise(spark):
    df = spark.range(60).select("id", F.when(F.col("id") < 30, F.col("id") * 0.1).when(F.col("id") < 59, 50 + F.col("id") * 0.1).otherwise(1000.0).alias("x"))
    got = {r["id"]: r["cluster"] for r in neighbors.dbscan(df, "id", ["x"], 0.5, 3).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 59)} == {30} and got[59] == -1


def _dbscan_by_pairs(rows, eps, least):
    rows = [r for r in rows if None not in r]
    k, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float)
    with np.errstate(invalid="ignore"):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
    near, none = d <= eps * eps, 10**9
    core = near.sum(1) >= least
    label, before = np.where(core, k, none), None
    while before is None or (label != before).any():
        before, label = label, np.where(core, np.where(near & core[None], label[None], none).min(1), none)
    nearest = [min(((d[i, j], label[j]) for j in np.flatnonzero(near[i] & core)), default=(0, -1))[1] for i in range(len(k))]
    return {int(k[i]): int(label[i] if core[i] else nearest[i]) for i in range(len(k))}


def test_dbscan_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    loose = [(i, round(float(a), 2), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(0, 4, 400), rng.normal(0, 1, 400), strict=True))]
    loose += [(400 + i, 1.0, 1.0) for i in range(5)] + [(410, None, 1.0)] + [(411 + i, float("inf"), 2.0) for i in range(5)]
    bands = [(i, i * 0.02, float(np.sin(i * 0.02) + i % 2 * 0.6 + rng.uniform(0, 0.1))) for i in range(300)]
    for rows, eps, least in ((loose, 0.3, 4), (bands, 0.35, 4)):
        want = _dbscan_by_pairs(rows, eps, least)
        got = {r["id"]: r["cluster"] for r in neighbors.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], eps, least).collect()}
        assert got == want and len(set(want.values())) > 1


def test_dbscan_writes_no_pairs_of_a_dense_place(spark, monkeypatch):
    from plinth.sources import tables

    sizes, write = [], tables.durable
    monkeypatch.setattr(tables, "durable", lambda df: (lambda out: (sizes.append(out.count()), out)[1])(write(df)))
    df = spark.range(1500).select("id", (F.col("id") * 1e-4).alias("x"), F.lit(1.0).alias("y"))
    assert {r["cluster"] for r in neighbors.dbscan(df, "id", ["x", "y"], 1.0, 4).collect()} == {0}
    assert max(sizes) <= 1500


def test_near_point_sets_are_found_by_halves():
    x = np.random.default_rng(1).uniform(0, 1, (3000, 2))
    y = x + [1.5, 0.0]
    least = min(((y[:, None] - x[i]) ** 2).sum(-1).min() for i in range(len(x)))
    assert neighbors._touch(x, y, least) and not neighbors._touch(x, y, np.nextafter(least, 0))


def test_chi_square_and_rank_tests(spark):
    assert abs(stats.chi2_upper(5.991465, 2) - 0.05) < 1e-6 and abs(stats.chi2_upper(1.0, 5) - 0.962566) < 1e-5
    df = spark.createDataFrame([(float(i), float(i) + (1 if i % 4 else -1), float(-i)) for i in range(40)], "a double, b double, c double")
    assert abs(stats.spearman(df, "a", "c").first()["rho"] + 1) < 1e-12
    assert stats.wilcoxon(df, "a", "b")["p"] < 0.01
    assert stats.friedman(df, "a", ["a", "b", "c"])["p"] < 1e-6


def test_knn_votes(spark):
    points = spark.range(100).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"), (F.col("id") >= 50).cast("int").alias("y"))
    got = {r["id"]: r["prediction"] for r in learning.knn(points.where("id % 10 = 0"), points, "id", "v", "y", 3).collect()}
    assert got == {i: float(i > 50) for i in range(0, 100, 10)}


@pytest.mark.parametrize("name", ["ml10_adaboost", "ml16_gaussian_mixture", "ml22_voting", "ml23_bagging", "ml25_stacking"])
def test_model_queries_count_every_row(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["ml29_active_learning", "ml30_permutation_importance", "h02_grid_search", "v01_learning_curve"])
def test_model_queries_fit_every_row(spark, monkeypatch, name):
    seen = []
    for module, f in ((selection, "uncertain"), (learning, "permutation_importance"), (learning, "search"), (selection, "learning_curve")):
        monkeypatch.setattr(module, f, lambda df, *a, g=getattr(module, f), **b: (seen.append(df.count()), g(df, *a, **b))[1])
    catalog.QUERIES[name](spark, FOLDER).count()
    assert seen == [spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()]
