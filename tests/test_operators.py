"""Hand-checked cases and invariants of operators."""

import math

import pytest
from pyspark.sql import functions as F

from plinth.operators import basket, features, quality, splits, stats, windows
from plinth.operators.columns import select
from plinth.plans import catalog


def column(df, name):
    return [r[name] for r in df.collect()]


def test_population_and_sample_deviation(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)], "x double")
    z = column(features.standard(df, ["x"]).transform(df), "x")
    assert abs(sum(v * v for v in z) / 4 - 1) < 1e-12
    d = stats.describe(df, ["x"]).first()
    assert abs(d["std"] - 3.559026) < 1e-6 and d["q25"] == 1.75 and d["q50"] == 3.0


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(9,), (9,), (1,), (1,), (None,)], "x int")
    assert features.mode(df, "x") == 1
    assert features.mode(df.where("x IS NULL"), "x", "unknown") == "unknown"


def test_rank_buckets_follow_equal_count_edges(spark):
    df = spark.range(1, 13).select(windows.rank_bucket(F.col("id"), F.lit(12), 5).alias("b"))
    assert [r["count"] for r in df.groupBy("b").count().orderBy("b").collect()] == [3, 2, 2, 2, 3]


def test_equal_width_edges(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (10.0,)], "x double")
    assert column(features.equal_width(df, "x", 5, "b").transform(df), "b") == [1, 1, 2, 5]


def test_mcnemar_is_capped(spark):
    df = spark.createDataFrame([(True, False), (False, True)], "a boolean, b boolean")
    assert stats.mcnemar(df, F.col("a"), F.col("b"))["p"] == 1.0


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (2.0, 5, 0.101939), (1.96, 1e6, 0.05)])
def test_t_distribution(t, df, p):
    assert abs(stats.t_two_sided(t, df) - p) < 2e-4


def test_t_quantile_and_effect_labels():
    assert abs(stats.t_quantile(0.05, 10) - 2.228139) < 1e-5
    assert [stats.cohen_label(x) for x in (0.1, -0.3, 0.6, 2)] == ["negligible", "small", "medium", "large"]


def test_chi2_and_normal():
    assert abs(stats.chi2_upper_one(3.841459) - 0.05) < 1e-6
    assert abs(stats.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert math.isclose(stats.binomial_two_sided(0, 5), 2 / 32)


def test_unknown_category_is_all_zeros(spark):
    f = features.one_hot(spark.createDataFrame([("a",), ("b",)], "c string"), "c")
    assert f.transform(spark.createDataFrame([("z",)], "c string")).first().asDict() == {"c_a": 0, "c_b": 0}


def test_select_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        select(spark.range(1), names=["nope"])


def test_severity_levels():
    assert [quality.severity(x) for x in (0.01, 0.1, 0.3, 0.6)] == ["info", "warning", "error", "critical"]


def test_validation_finds_planted_issues(spark):
    df = spark.createDataFrame([(1.0, "7", 1), (float("inf"), "8", 1), (float("inf"), "8", 1)], "x double, s string, k int")
    found = {(c, name) for _, c, _, name, _ in quality.validate(df)}
    assert {("infinite", "x"), ("type", "s"), ("constant", "k"), ("duplicates", None)} <= found
    assert quality.validate(df.limit(0))[0][0] == "critical"


def test_schema_check(spark):
    df = spark.createDataFrame([(1, 150.0)], "id int, value double")
    assert quality.check_schema(df, {"id": "int", "value": "float"}, {"value": (0, 100)}) == ["column value outside [0, 100]: 1 rows"]
    assert quality.check_schema(df, {"other": "int"}) == ["missing column other"]


def test_itemsets_of_three(spark):
    rows = [(i, x) for i, items in enumerate(["abc", "abc", "ab", "c"]) for x in items]
    sets = {tuple(r["items"]): r["n"] for r in basket.itemsets(spark.createDataFrame(rows, "b int, i string"), "b", "i", 0.5).collect()}
    assert sets[("a", "b", "c")] == 2 and sets[("a", "b")] == 3 and sets[("c",)] == 3


def test_hash_split_is_stable_when_rows_are_added(spark):
    small, large = (splits.hash_split(spark.range(n), ["id"], 0.3)[1] for n in (500, 1000))
    assert {r[0] for r in small.collect()} == {r[0] for r in large.where("id < 500").collect()}


def test_adjusted_and_recursive_means(spark):
    from pyspark.sql.window import Window

    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate((1, 2, 3))], "i int, x double")
    w = Window.orderBy("i")
    r = df.select(windows.exponential("x", w, 0.5).alias("a"), windows.exponential("x", w, 0.5, adjusted=False).alias("b")).collect()
    assert abs(r[2]["a"] - (3 + 1 + 0.25) / 1.75) < 1e-12 and [x["b"] for x in r] == [1.0, 1.5, 2.25]


def test_tf_idf_has_pairs_stop_words_and_norm(spark):
    df = spark.createDataFrame([(1, "The red cat"), (2, "red dog, red and cat"), (3, None)], "k long, t string")
    got = {(r.k, r.term): (r.n, r.tfidf) for r in features.tf_idf(df, "k", "t").collect()}
    assert {t for k, t in got if k == 2} == {"red", "dog", "cat", "red dog", "dog red", "red cat"} and {t for k, t in got if k == 1} == {"red", "cat", "red cat"}
    a, b = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    norm = math.sqrt((2 * a) ** 2 + 2 * a * a + 3 * b * b)
    assert got[2, "red"][0] == 2 and abs(got[2, "red"][1] - 2 * a / norm) < 1e-12 and abs(got[2, "dog red"][1] - b / norm) < 1e-12
    assert abs(got[1, "cat"][1] - 1 / math.sqrt(3)) < 1e-12
    assert {r.term for r in features.tf_idf(df, "k", "t", 1).collect()} == {"red"}


def test_tf_idf_query_reads_documents(spark):
    catalog.load()
    out = catalog.QUERIES["f28_tf_idf"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "term", "n", "tfidf"] and out.select("term").distinct().count() == 1000
    sums = out.groupBy("doc_id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-3).count() == 0


def test_one_quantile_is_exact_among_many_values(spark, monkeypatch):
    import numpy as np

    from plinth.operators import order

    df = spark.range(20_000).select(F.when(F.col("id") % 9 > 0, F.sin(F.col("id")) * 100).alias("z"))
    x = np.array([r["z"] for r in df.dropna().collect()])
    sizes, write = [], order.durable
    monkeypatch.setattr(order, "durable", lambda d: (lambda out: (sizes.append(out.count()), out)[1])(write(d)))
    for p in (0.0, 0.25, 0.95, 1.0):
        assert abs(order.quantile(df, "z", p) - np.quantile(x, p)) < 1e-12
    assert max(sizes) < 100  # values elsewhere are only counted
    for accuracy in (3, 10):
        assert abs(order.quantile(df, "z", 0.95, accuracy) - np.quantile(x, 0.95)) < 1e-12
    assert order.quantile(df.where("z > 1000"), "z", 0.5) is None
    ties = spark.range(1000).select((F.col("id") >= 949).cast("double").alias("z"))
    assert abs(order.quantile(ties, "z", 0.95) - 1.0) < 1e-12 and abs(order.quantile(ties, "z", 0.949) - np.quantile([0.0] * 949 + [1.0] * 51, 0.949)) < 1e-12


def test_distance_anomalies_take_no_percentile_of_all_values_in_one_task(spark, tmp_path):
    from plinth.plans import catalog

    catalog.load()
    rows = spark.range(1000).select(F.when(F.col("id") % 2 > 0, "A").otherwise("B").alias("l_returnflag"), (F.col("id") * 1.0).alias("l_quantity"), (F.col("id") * 3.0).alias("l_extendedprice"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["o05_distance_anomaly"](spark, str(tmp_path))
    assert sum(r["n"] for r in out.collect()) == 50
    assert "percentile(" not in out._jdf.queryExecution().toString()
