"""Further tests, densities, ensembles and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import features as X
from plinth.operators import learning as L
from plinth.operators import neighbors as N
from plinth.operators import selection as H
from plinth.operators import stats as S
from plinth.plans.catalog import query
from plinth.plans.evaluation import REG, regressions, rounded, table
from plinth.plans.features import HOLES, holes
from plinth.plans.learning import returned


@query("e22_prediction_interval", REG + "SELECT p_partkey, round(p - 1.96 * (SELECT sqrt(avg((y - p) * (y - p))) FROM p), 4) AS low, round(p + 1.96 * (SELECT sqrt(avg((y - p) * (y - p))) FROM p), 4) AS high FROM p")
def _(t):
    p = regressions(t)
    half = p.agg((1.96 * F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))))).alias("h"))
    return p.join(F.broadcast(half)).select("p_partkey", F.round(F.col("p") - F.col("h"), 4).alias("low"), F.round(F.col("p") + F.col("h"), 4).alias("high"))


@query("e25_confidence_levels", """
WITH p AS (SELECT (doc_id % 99 + 1) / 101.0 AS p FROM documents), e AS (SELECT 1 + (p * log2(p) + (1 - p) * log2(1 - p)) AS c FROM p) SELECT CASE WHEN c < 0.3 THEN 'low' WHEN c < 0.7 THEN 'medium' ELSE 'high' END AS level, count(*) AS n, round(avg(c), 6) AS mean FROM e GROUP BY 1""")
def _(t):
    p = (F.col("doc_id") % 99 + 1) / 101.0
    e = t.documents.select((1 + p * F.log2(p) + (1 - p) * F.log2(1 - p)).alias("c"))
    level = F.when(F.col("c") < 0.3, "low").when(F.col("c") < 0.7, "medium").otherwise("high")
    return e.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"))


@query("e27_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS rho FROM r""")
def _(t):
    return rounded(S.spearman(t.part, "p_size", "p_retailprice"))


@query("t13_wilcoxon", REG + """, d AS (SELECT y - p AS d, abs(y - p) AS m FROM p WHERE y <> p), r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM d)
SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM r UNION ALL SELECT 'statistic', CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) FROM r""")
def _(t):
    p = regressions(t).select(F.round("y", 6).alias("y"), F.round("p", 6).alias("p"))
    exact = p.select(F.round(F.col("y") - F.col("p"), 6).alias("y"), F.lit(0.0).alias("p"))
    return table(t, S.wilcoxon(exact, "y", "p"), ["n", "statistic"])


@query("t13_friedman", """
WITH v AS (SELECT l_orderkey AS k, l_linenumber AS j, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c FROM lineitem), r AS (SELECT
(a > b)::INT + (a > c)::INT + (1 + (a = b)::INT + (a = c)::INT + 1) / 2.0 AS ra, (b > a)::INT + (b > c)::INT + (1 + (b = a)::INT + (b = c)::INT + 1) / 2.0 AS rb, (c > a)::INT + (c > b)::INT + (1 + (c = a)::INT + (c = b)::INT + 1) / 2.0 AS rc FROM v)
SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM r UNION ALL SELECT 'statistic', round(12.0 / (count(*) * 12) * (power(sum(ra), 2) + power(sum(rb), 2) + power(sum(rc), 2)) - 12 * count(*), 3) FROM r""")
def _(t):
    v = t.lineitem.select((F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 50).alias("c"))
    return table(t, S.friedman(v, "k", ["a", "b", "c"]), ["n", "statistic"], 3)


@query("t03_bootstrap_difference")
def _(t):
    return table(t, S.bootstrap_difference(regressions(t), ["p_partkey"], "y", "p", 50), ["low", "median", "high", "p"])


@query("d06_target_analysis", "SELECT count(DISTINCT quality) AS classes, round(max(n) / min(n), 6) AS imbalance FROM (SELECT quality, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def _(t):
    g = t.labels.groupBy("quality").count()
    return g.agg(F.count(F.lit(1)).alias("classes"), F.round(F.max("count") / F.min("count"), 6).alias("imbalance"))


@query("d08_distribution", """
WITH m AS (SELECT count(*) AS n, avg(value) AS a, var_pop(value) AS v FROM events), s AS (SELECT avg(power(value - a, 3)) / power(max(v), 1.5) AS skew, avg(power(value - a, 4)) / power(max(v), 2) - 3 AS kurtosis FROM events, m) SELECT round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, abs(skew) < 0.5 AS is_normal FROM s""")
def _(t):
    return t.events.agg(F.round(F.skewness("value"), 5).alias("skew"), F.round(F.kurtosis("value"), 5).alias("kurtosis"), (F.abs(F.skewness("value")) < 0.5).alias("is_normal"))


@query("d02_imputation_quality", "WITH h AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) SELECT round(avg(v), 6) AS observed, round(avg(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM h))), 6) AS imputed, round(100.0 * (count(*) - count(v)) / count(*), 4) AS missing FROM h")
def _(t):
    h = holes(t).select("v", F.col("v").alias("o"))
    return X.impute_numbers(h, ["v"], "median").transform(h).agg(F.round(F.avg("o"), 6).alias("observed"), F.round(F.avg("v"), 6).alias("imputed"), F.round(100.0 * (F.count(F.lit(1)) - F.count("o")) / F.count(F.lit(1)), 4).alias("missing"))


@query("d11_weighted_distance", "SELECT event_id, round(sqrt(0.7 * power(value - 20, 2) + 0.3 * power(user_id - 50, 2)), 5) AS d FROM events")
def _(t):
    return t.events.select("event_id", F.round(F.sqrt(0.7 * F.pow(F.col("value") - 20, F.lit(2)) + 0.3 * F.pow(F.col("user_id") - 50, F.lit(2))), 5).alias("d"))


@query("m03_knn_impute", HOLES + """, g AS (SELECT user_id AS o, count(v) AS n, sum(v) AS s FROM h WHERE v IS NOT NULL GROUP BY 1), q AS (SELECT DISTINCT user_id AS u FROM h WHERE v IS NULL), d AS (SELECT u, abs(u - o) AS d, sum(n) AS n, sum(s) AS s FROM q, g GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY u ORDER BY d) - n AS before FROM d), f AS (SELECT u, sum(least(n, 5 - before) * s / n) / sum(least(n, 5 - before)) AS f FROM c WHERE before < 5 GROUP BY 1) SELECT event_id, round(coalesce(v, f), 6) AS v FROM h LEFT JOIN f ON user_id = u""")
def _(t):
    h = holes(t).select("event_id", F.col("user_id").cast("double").alias("u"), "v")
    return N.knn_impute(h, ["event_id"], ["u", "v"]).select("event_id", F.round("v", 6).alias("v"))


@query("m04_iterative_impute")
def _(t):
    h = holes(t).select("event_id", F.col("user_id").cast("double").alias("u"), "v")
    return N.iterative_impute(h, ["u", "v"], 2).select("event_id", F.round("v", 6).alias("v"))


@query("o03_isolation_forest")
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    return N.isolation_forest(rows, ["c_custkey"], ["c_acctbal", "n"]).select("c_custkey", F.round("isolation", 6).alias("isolation"))


@query("o04_local_outlier_factor", """
WITH p AS (SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT a.x, a.y, b.x AS ox, b.y AS oy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, b.n - CAST(a.x = b.x AND a.y = b.y AS INTEGER) AS n FROM p a, p b),
s AS (SELECT *, sum(n) OVER (PARTITION BY x, y, d) AS m, sum(n) OVER (PARTITION BY x, y ORDER BY d) AS upto FROM r WHERE n > 0), e AS (SELECT *, n * least(m, 20 - (upto - m)) / m AS w FROM s WHERE upto - m < 20),
f AS (SELECT x AS ox, y AS oy, max(d) AS far FROM e GROUP BY 1, 2), l AS (SELECT x, y, 1 / greatest(sum(w * greatest(d, far)) / sum(w), 1e-12) AS own FROM e JOIN f USING (ox, oy) GROUP BY 1, 2),
g AS (SELECT e.x, e.y, sum(w * own) / sum(w) AS other FROM e JOIN l ON l.x = ox AND l.y = oy GROUP BY 1, 2) SELECT c_custkey, round(other / own, 6) AS lof FROM customer JOIN g ON g.x = c_acctbal AND g.y = c_nationkey JOIN l ON l.x = g.x AND l.y = g.y""")
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    return N.local_outlier_factor(rows, ["c_custkey"], ["c_acctbal", "n"]).select("c_custkey", F.round("lof", 6).alias("lof"))


@query("ml15_dbscan")
def _(t):
    rows = t.part.select("p_partkey", "p_size", (F.col("p_retailprice") / 20).alias("p"))
    return N.dbscan(rows, "p_partkey", ["p_size", "p"], 1.5, 4)


@query("ml10_adaboost")
def _(t):
    df = returned(t)
    p = H.AdaBoost(3).fit(df).transform(df)
    return p.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("ml16_gaussian_mixture")
def _(t):
    df = returned(t)
    return L.cluster(df, "gaussian_mixture", 2).transform(df).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("ml22_voting")
def _(t):
    df, keys = returned(t), ["l_orderkey", "l_linenumber"]
    models = {n: L.estimator(n, **p).fit(df) for n, p in (("logistic", {"maxIter": 5}), ("decision_tree", {"maxDepth": 3}))}
    return L.vote(df, models, keys).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("ml25_stacking")
def _(t):
    df, keys = returned(t), ["l_orderkey", "l_linenumber"]
    models = {"logistic": L.estimator("logistic", maxIter=5), "tree": L.estimator("decision_tree", maxDepth=3)}
    base, final = L.stack(df, models, L.estimator("logistic", maxIter=5), keys, 2)
    return L.stacked(df, base, final, keys).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("ml23_bagging")
def _(t):
    df, keys = returned(t), ["l_orderkey", "l_linenumber"]
    return L.vote(df, L.bag(df, L.estimator("decision_tree", maxDepth=3), keys, 3), keys).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("ml29_active_learning")
def _(t):
    df = returned(t)
    scored = L.estimator("logistic", maxIter=5).fit(df).transform(df)
    return H.uncertain(scored, 20, "margin", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round("uncertainty", 6).alias("uncertainty"))


@query("ml30_permutation_importance")
def _(t):
    df = returned(t)
    found = L.permutation_importance(df, L.estimator("decision_tree", maxDepth=3).fit(df), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])
    return t.spark.createDataFrame([(k, float(v)) for k, v in found.items()], "feature string, importance double")


@query("h02_grid_search")
def _(t):
    found = L.search(returned(t), "decision_tree", {"maxDepth": [2, 3]}, ["l_orderkey", "l_linenumber"], folds=2)
    return t.spark.createDataFrame([(str(r["params"]), float(r["mean"])) for r in found], "params string, mean double")


@query("v01_learning_curve")
def _(t):
    curve = H.learning_curve(returned(t), L.estimator("decision_tree", maxDepth=3), ["l_orderkey", "l_linenumber"], (0.3, 1.0))
    return t.spark.createDataFrame([(c["size"], float(c["train"]), float(c["valid"])) for c in curve], "size double, train double, valid double")
