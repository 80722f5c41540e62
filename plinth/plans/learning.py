"""Model queries: fitted with pyspark.ml on the tables; rows are scores, so only shape and range are checked by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import learning as L
from plinth.plans.catalog import query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def returned(t):
    rows = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return L.assemble(rows, FEATURES, "y", ["l_orderkey", "l_linenumber"])


def _scores(name, **params):
    def plan(t):
        df = returned(t)
        model = L.estimator(name, **params).fit(df.where("l_orderkey % 5 <> 0"))
        p = model.transform(df.where("l_orderkey % 5 = 0"))
        return p.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))

    return plan


query("ml01_logistic")(_scores("logistic_regression", maxIter=10))
query("ml02_random_forest")(_scores("random_forest", numTrees=5, maxDepth=4, seed=1))
query("ml03_gradient_boosting")(_scores("gradient_boosting", maxIter=3, seed=1))
query("ml04_linear_svm")(_scores("svm", maxIter=5))
query("ml06_naive_bayes")(_scores("naive_bayes"))
query("ml08_decision_tree")(_scores("decision_tree", maxDepth=4))


@query("ml12_ridge")
def _(t):
    df = L.assemble(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey"])
    m = L.estimator("ridge", "regression").fit(df)
    return t.spark.createDataFrame([(n, float(c)) for n, c in zip(["l_quantity", "l_discount", "l_tax"], m.coefficients, strict=True)], "feature string, coefficient double")


@query("ml13_kmeans")
def _(t):
    from pyspark.ml.functions import array_to_vector

    df = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    return L.cluster(df, "kmeans", 5).transform(df).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("ml19_pca")
def _(t):
    from pyspark.ml.functions import array_to_vector

    df = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    _, shares = L.reduce_pca(df, 5)
    return t.spark.createDataFrame(list(enumerate(shares)), "component int, share double")


@query("ml07_knn")
def _(t):
    q = t.embeddings.where("vec_id % 100 = 0")
    return L.knn(q, t.embeddings, "vec_id", "embedding", "label", 5)


@query("ml31_item_similarity", """
WITH r AS (SELECT user_id, event_type AS i, avg(value) AS r FROM events GROUP BY 1, 2) SELECT x.i AS a, y.i AS b, round(sum(x.r * y.r) / sqrt(sum(x.r * x.r) * sum(y.r * y.r)), 6) AS similarity FROM r x JOIN r y ON x.user_id = y.user_id AND x.i < y.i GROUP BY 1, 2""")
def _(t):
    s = L.item_similarity(t.events, "user_id", "event_type", "value")
    return s.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("h04_pareto_models", "SELECT * FROM (VALUES ('a'), ('c')) v(model)")
def _(t):
    found = L.pareto([{"model": "a", "accuracy": 0.9, "seconds": 5.0}, {"model": "b", "accuracy": 0.8, "seconds": 6.0}, {"model": "c", "accuracy": 0.7, "seconds": 1.0}], ["accuracy"], ["seconds"])
    return t.spark.createDataFrame([(r["model"],) for r in found], "model string")
