"""Group and global aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators import stats as S
from plinth.plans.catalog import query


def r(c, n=4):
    return F.round(c, n)


@query("flagship_revenue", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def flagship(t):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(revenue), 2).alias("revenue"), r(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("a01_group_mean_std", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(r(F.avg("value"), 6).alias("mean"), r(F.stddev_samp("value"), 6).alias("std"), F.count("value").alias("n"))


@query("a02_multi_aggregates", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(r(F.sum(p), 2).alias("total"), r(F.avg(p), 2).alias("mean"), r(F.min(p), 2).alias("low"), r(F.max(p), 2).alias("high"), F.countDistinct("o_custkey").alias("customers"))


@query("a04_distinct_per_group", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))


@query("a05_median_per_group", "SELECT p_type, round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_type").agg(r(F.percentile("p_retailprice", F.lit(0.5))).alias("median"))


@query("a06_first_last", "SELECT user_id, CAST(arg_min(event_id, ts) AS BIGINT) AS first_event, CAST(arg_max(event_id, ts) AS BIGINT) AS last_event FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"))


@query("a07_basket_sizes", "SELECT round(avg(n), 6) AS mean_size, max(n) AS largest FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(t):
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(r(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"))


@query("a08_value_shares", "SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4) AS pct FROM documents GROUP BY 1")
def _(t):
    return S.value_shares(t.documents, "lang").select("lang", "n", r("pct").alias("pct"))


@query("a09_rate_difference", """
SELECT source, round(avg(toxic) FILTER (quality = 1) - avg(toxic) FILTER (quality = 0), 6) AS gap FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(r(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))) - F.avg(F.when(F.col("quality") == 0, F.col("toxic"))), 6).alias("gap"))


@query("a10_best_and_worst", """
WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT arg_max(c_mktsegment, v) AS best, arg_min(c_mktsegment, v) AS worst FROM m""")
def _(t):
    m = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    return m.agg(F.max_by("c_mktsegment", "v").alias("best"), F.min_by("c_mktsegment", "v").alias("worst"))


@query("a11_global_stats", """
SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate FROM events""")
def _(t):
    v = F.col("value")
    return t.events.agg(r(F.avg(v), 6).alias("mean"), r(F.stddev_samp(v), 6).alias("std"), r(F.try_divide(F.stddev_samp(v), F.avg(v)), 6).alias("cv"), r(F.avg(F.when(v == 0, 1.0).otherwise(0.0)), 6).alias("zero_rate"))


@query("a12_quantiles", "SELECT p, round(v, 4) AS v FROM (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p, unnest(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM orders)")
def _(t):
    return S.quantiles(t.orders, "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95]).select("p", r("v").alias("v"))


@query("a13_describe", """
SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(min(c_acctbal), 4) AS low, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, round(max(c_acctbal), 4) AS high FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 4), round(stddev_samp(c_nationkey), 4), round(min(c_nationkey), 4), round(quantile_cont(c_nationkey, 0.25), 4), round(quantile_cont(c_nationkey, 0.5), 4), round(quantile_cont(c_nationkey, 0.75), 4), round(max(c_nationkey), 4) FROM customer""")
def _(t):
    d = S.describe(t.customer, ["c_acctbal", "c_nationkey"])
    return d.select("column_name", "n", *[r(c).alias(c) for c in d.columns[2:]])


@query("a14_correlation_per_group", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def _(t):
    g = t.lineitem.groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 10").select("l_returnflag", r("r", 6).alias("r"))


@query("a15_correlation_matrix", """
SELECT 'l_discount' AS a, 'l_quantity' AS b, round(corr(l_discount, l_quantity), 6) AS r FROM lineitem
UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem""")
def _(t):
    return S.correlations(t.lineitem, ["l_discount", "l_quantity", "l_tax"]).select("a", "b", r("r", 6).alias("r"))


@query("a16_covariance_beta", "SELECT round(covar_samp(l_extendedprice, l_quantity), 4) AS cov, round(covar_samp(l_extendedprice, l_quantity) / var_pop(l_quantity), 6) AS beta FROM lineitem")
def _(t):
    cov = F.covar_samp("l_extendedprice", "l_quantity")
    return t.lineitem.agg(r(cov).alias("cov"), r(F.try_divide(cov, F.var_pop("l_quantity")), 6).alias("beta"))


@query("a17_concentration", """
WITH g AS (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(v) AS s FROM g) SELECT round(sum((v / s) * (v / s)), 8) AS hhi FROM g, t""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    return g.agg(r(F.sum(F.col("v") * F.col("v")) / F.pow(F.sum("v"), F.lit(2)), 8).alias("hhi"))


@query("a18_crosstab", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 4) AS pct FROM orders GROUP BY 1, 2""")
def _(t):
    g = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", r(100 * F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))))


@query("a19_pivot", """
SELECT o_orderpriority, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 4) AS F, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 4) AS O, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 4) AS P FROM orders GROUP BY 1""")
def _(t):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice")).na.fill(0.0)
    return p.select("o_orderpriority", *[r(c).alias(c) for c in ("F", "O", "P")])


@query("a20_class_balance", "SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(min(n) / max(n), 6) AS balance FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)")
def _(t):
    return t.labels.groupBy("toxic").count().agg(F.min("count").alias("least"), F.max("count").alias("most"), r(F.min("count") / F.max("count"), 6).alias("balance"))


@query("a21_sparsity", "SELECT round(1 - count(DISTINCT (o_custkey, l_partkey)) / (count(DISTINCT o_custkey)::DOUBLE * count(DISTINCT l_partkey)), 8) AS sparsity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    p = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    return p.agg(r(1 - F.count(F.lit(1)) / (F.countDistinct("o_custkey").cast("double") * F.countDistinct("l_partkey")), 8).alias("sparsity"))


@query("a22_contingency", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("a23_masked_counts", "SELECT count(*) FILTER (l_returnflag = 'R' AND l_quantity > 30) AS a, count(*) FILTER (l_linestatus = 'O' OR l_discount > 0.08) AS b FROM lineitem")
def _(t):
    c = F.col
    return t.lineitem.agg(F.count_if((c("l_returnflag") == "R") & (c("l_quantity") > 30)).alias("a"), F.count_if((c("l_linestatus") == "O") | (c("l_discount") > 0.08)).alias("b"))


@query("a25_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(t):
    d = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("s_acctbal"), 2).alias("balance"))


@query("a25_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("a26_histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(29, floor((value - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def _(t):
    return S.histogram(t.events, "value", 30)
