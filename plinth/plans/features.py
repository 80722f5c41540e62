"""Missing data, outliers and features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators import features as X
from plinth.operators.order import quantile
from plinth.plans.catalog import query

HOLES = "WITH h AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS k FROM events) "


def holes(t):
    c = F.col
    return t.events.select("event_id", "user_id", "ts", "event_type", F.when(c("event_id") % 7 != 0, c("value")).alias("v"), F.when(c("event_id") % 11 != 0, c("event_type")).alias("k"))


def r(c, n=6):
    return F.round(c, n)


@query("m01_impute_mean", HOLES + "SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM h)), 6) AS v FROM h")
def _(t):
    h = holes(t)
    return X.impute_numbers(h, ["v"]).transform(h).select("event_id", r("v").alias("v"))


@query("m01_impute_median", HOLES + "SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM h)), 6) AS v, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS v_missing FROM h")
def _(t):
    h = holes(t)
    return X.impute_numbers(h, ["v"], "median", indicator=True).transform(h).select("event_id", r("v").alias("v"), "v_missing")


@query("m02_impute_mode", HOLES + ", m AS (SELECT k FROM h WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1) SELECT event_id, coalesce(h.k, m.k) AS k, coalesce(h.k, 'missing') AS k2 FROM h, m")
def _(t):
    h = holes(t)
    return h.select("event_id", F.coalesce("k", F.lit(X.mode(h, "k", "unknown"))).alias("k"), F.coalesce("k", F.lit("missing")).alias("k2"))


@query("m07_forward_fill", HOLES + "SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS v FROM h")
def _(t):
    return X.fill_along(holes(t), ["v"], ["user_id"], ["ts", "event_id"]).select("event_id", r("v").alias("v"))


@query("m08_back_fill_zero", HOLES + "SELECT event_id, round(coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS v FROM h")
def _(t):
    return X.fill_along(holes(t), ["v"], ["user_id"], ["ts", "event_id"], back=True).select("event_id", r(F.coalesce("v", F.lit(0.0))).alias("v"))


@query("m09_missing_profile", HOLES + "SELECT 'v' AS column_name, count(*) - count(v) AS missing, round(100.0 * (count(*) - count(v)) / count(*), 4) AS pct FROM h UNION ALL SELECT 'k', count(*) - count(k), round(100.0 * (count(*) - count(k)) / count(*), 4) FROM h")
def _(t):
    from plinth.operators.quality import missing_profile

    return missing_profile(holes(t).select("v", "k")).select("column_name", "missing", r("pct", 4).alias("pct"))


@query("o01_zscore_outliers", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id FROM events, s WHERE abs(value - m) / d <= 3")
def _(t):
    return t.events.where(~X.zscore_outlier(t.events, ["value"])).select("event_id")


@query("o02_iqr_outliers", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def _(t):
    low, high = X.iqr_fences(t.events, ["value"])["value"]
    return t.events.where((F.col("value") < low) | (F.col("value") > high)).select("event_id")


@query("o05_distance_anomaly", """
WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS d FROM lineitem), x AS (SELECT l_returnflag, sqrt(power((l_quantity - a) / b, 2) + power((l_extendedprice - c) / d, 2)) AS z FROM lineitem, s), q AS (SELECT quantile_cont(z, 0.95) AS e FROM x)
SELECT l_returnflag, count(*) AS n FROM x, q WHERE z > e GROUP BY 1""")
def _(t):
    c = ["l_quantity", "l_extendedprice"]
    z = X.standard(t.lineitem, c).transform(t.lineitem.select("l_returnflag", *c)).select("l_returnflag", F.sqrt(F.pow(c[0], F.lit(2)) + F.pow(c[1], F.lit(2))).alias("z"))
    edge = quantile(z, "z", 0.95)
    return z.where(F.col("z") > F.lit(edge)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("o07_rolling_anomaly", """
WITH w AS (SELECT event_id, value, avg(value) OVER r AS m, stddev_samp(value) OVER r AS d, count(*) OVER r AS n FROM events WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT event_id FROM w WHERE n = 20 AND abs(value - m) > 3 * d""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    x = t.events.select("event_id", "value", F.avg("value").over(w).alias("m"), F.stddev_samp("value").over(w).alias("d"), F.count("value").over(w).alias("n"))
    return x.where((F.col("n") == 20) & (F.abs(F.col("value") - F.col("m")) > 3 * F.col("d"))).select("event_id")


@query("o08_clip_outliers", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS value FROM events, q")
def _(t):
    low, high = X.iqr_fences(t.events, ["value"])["value"]
    return t.events.select("event_id", r(F.least(F.greatest("value", F.lit(low)), F.lit(high))).alias("value"))


@query("f01_standard_scale", "WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b FROM lineitem) SELECT l_linestatus, round(sum(abs((l_quantity - a) / b)), 4) AS total FROM lineitem, s GROUP BY 1")
def _(t):
    x = X.standard(t.lineitem, ["l_quantity"]).transform(t.lineitem.select("l_linestatus", "l_quantity"))
    return x.groupBy("l_linestatus").agg(r(F.sum(F.abs("l_quantity")), 4).alias("total"))


@query("f02_minmax_scale", "WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) SELECT c_custkey, round((c_acctbal - a) / (b - a), 6) AS c_acctbal FROM customer, s")
def _(t):
    return X.minmax(t.customer, ["c_acctbal"]).transform(t.customer).select("c_custkey", r("c_acctbal").alias("c_acctbal"))


@query("f03_robust_scale", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round((value - m) / (b - a), 6) AS value FROM events, q")
def _(t):
    return X.robust(t.events, ["value"]).transform(t.events).select("event_id", r("value").alias("value"))


@query("f04_quantile_transform")
def _(t):
    return X.quantile_uniform(t.events, ["value"]).transform(t.events).select("event_id", r("value").alias("value"))


@query("f05_auto_scale")
def _(t):
    return X.auto_scale(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"]).transform(t.lineitem).agg(*[r(F.avg(c), 4).alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")])


@query("f06_unit_rows", "SELECT event_id, round(value / nullif(sqrt(value * value + CAST(user_id AS DOUBLE) * user_id), 0), 6) AS value FROM events")
def _(t):
    return X.unit_rows(["value", "user_id"]).transform(t.events).select("event_id", r("value").alias("value"))


@query("f07_one_hot", "SELECT doc_id, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS lang_de, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS lang_en, CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS lang_es, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS lang_fr FROM documents")
def _(t):
    return X.one_hot(t.documents, "lang").transform(t.documents.select("doc_id", "lang"))


@query("f09_label_encode", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS code FROM documents")
def _(t):
    return X.label(t.documents, "source", "code").transform(t.documents).select("doc_id", F.col("code").cast("long").alias("code"))


@query("f10_target_encode", "WITH m AS (SELECT f, o_orderpriority, avg(o_totalprice) AS code FROM orders, range(5) v(f) WHERE o_orderkey % 5 <> f GROUP BY 1, 2) SELECT o_orderkey, round(coalesce(code, 0), 4) AS code FROM orders LEFT JOIN m ON m.f = o_orderkey % 5 AND m.o_orderpriority = orders.o_orderpriority")
def _(t):
    folded = t.orders.withColumn("fold", F.col("o_orderkey") % 5)
    return X.target_encode_folds(folded, "fold", "o_orderpriority", "o_totalprice").select("o_orderkey", r("code", 4).alias("code"))


@query("f11_smoothed_target_encode", "WITH g AS (SELECT avg(o_totalprice) AS g FROM orders), m AS (SELECT o_custkey, (sum(o_totalprice) + 10 * max(g)) / (count(*) + 10) AS code FROM orders, g GROUP BY 1) SELECT o_orderkey, round(code, 4) AS code FROM orders JOIN m USING (o_custkey)")
def _(t):
    codes = X.target(t.orders, "o_custkey", "o_totalprice", smoothing=10)
    return X.target_encode(t.orders, codes, "o_custkey").select("o_orderkey", r("code", 4).alias("code"))


@query("d01_frequency_encode", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS frequency FROM part")
def _(t):
    return t.part.join(X.frequency(t.part, "p_brand"), "p_brand").select("p_partkey", "frequency")


@query("f12_feature_hashing")
def _(t):
    return t.documents.groupBy(X.hash_buckets("source").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_group_rare", "WITH g AS (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 0.12 * (SELECT count(*) FROM documents)) SELECT lang, count(*) AS n FROM (SELECT CASE WHEN lang IN (SELECT lang FROM g) THEN lang ELSE 'other' END AS lang FROM documents) GROUP BY 1")
def _(t):
    return X.group_rare(t.documents, "lang", 0.12).transform(t.documents).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("f16_equal_width", "WITH s AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) SELECT p_partkey, CAST(greatest(1, least(5, ceil((p_retailprice - a) * 5 / (b - a)))) AS BIGINT) AS bin FROM part, s")
def _(t):
    return X.equal_width(t.part, "p_retailprice", 5, "bin").transform(t.part).select("p_partkey", "bin")


@query("f17_quantile_bins", "WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events) SELECT event_id, CAST(1 + (value > e[1])::INT + (value > e[2])::INT + (value > e[3])::INT AS BIGINT) AS bin FROM events, q")
def _(t):
    return X.quantile_bins(t.events, "value", 4, "bin").transform(t.events).select("event_id", "bin")


@query("f18_bands", "SELECT CASE WHEN n_chars > 0 AND n_chars <= 500 THEN 'short' WHEN n_chars > 500 AND n_chars <= 2000 THEN 'medium' WHEN n_chars > 2000 AND n_chars <= 10000 THEN 'long' END AS band, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(X.cut("n_chars", [0, 500, 2000, 10000], ["short", "medium", "long"]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("f21_polynomial", "SELECT event_id, round(value * value, 4) AS v2, round(value * user_id, 4) AS vu, CAST(user_id * user_id AS BIGINT) AS u2 FROM events")
def _(t):
    p = X.polynomial(["value", "user_id"])
    return t.events.select("event_id", r(p["value^2"], 4).alias("v2"), r(p["value user_id"], 4).alias("vu"), p["user_id^2"].cast("long").alias("u2"))


@query("f20_pairwise", "SELECT l_linestatus, round(sum(l_discount * l_tax), 4) AS m, round(sum(l_discount + l_tax), 4) AS a, round(sum(l_discount - l_tax), 4) AS s, round(sum(l_discount / nullif(l_tax, 0)), 2) AS q FROM lineitem GROUP BY 1")
def _(t):
    p = X.pairwise(["l_discount", "l_tax"])
    rows = t.lineitem.select("l_linestatus", *[e.alias(n) for n, e in p.items()])
    return rows.groupBy("l_linestatus").agg(r(F.sum("l_discount_multiply_l_tax"), 4).alias("m"), r(F.sum("l_discount_add_l_tax"), 4).alias("a"), r(F.sum("l_discount_subtract_l_tax"), 4).alias("s"), r(F.sum("l_discount_ratio_l_tax"), 2).alias("q"))


@query("f22_unskew", "SELECT event_id, round(ln(1 + value), 6) AS value_log FROM events")
def _(t):
    return X.unskew(t.events, ["value"]).transform(t.events).select("event_id", r("value_log").alias("value_log"))


@query("f24_anova_f", """
WITH g AS (SELECT l_returnflag AS k, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1), a AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g)
SELECT 'l_quantity' AS feature, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM a""")
def _(t):
    return X.anova_f(t.lineitem, ["l_quantity"], "l_returnflag").select("feature", r("f", 4).alias("f"))


@query("f24_regression_f", "SELECT 'l_quantity' AS feature, round(power(corr(l_quantity, l_extendedprice), 2) / (1 - power(corr(l_quantity, l_extendedprice), 2)) * (count(*) - 2), 1) AS f FROM lineitem")
def _(t):
    return X.regression_f(t.lineitem, ["l_quantity"], "l_extendedprice").select("feature", r("f", 1).alias("f"))


@query("f26_datetime_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN day(o_orderdate) = 1 THEN 1 ELSE 0 END AS month_start, CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN 1 ELSE 0 END AS month_end, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders""")
def _(t):
    p = X.datetime_parts("o_orderdate")
    return t.orders.select("o_orderkey", *[(r(e) if n == "month_sin" else e).alias(n) for n, e in p.items() if n not in ("month_cos", "weekday_sin", "weekday_cos")])


@query("f28_tf_idf")
def _(t):
    return X.tf_idf(t.documents, "doc_id", "text").select("doc_id", "term", "n", r("tfidf").alias("tfidf"))


@query("f28_text_counts", "SELECT doc_id, length(text) AS chars, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS INTEGER) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), 0)).alias("words"))


@query("f32_feature_union", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, min(value) AS a, max(value) AS b FROM events) SELECT event_id, round(0.5 * (value - m) / d, 6) AS z__value, round(2 * (value - a) / (b - a), 6) AS u__value FROM events, s")
def _(t):
    e = t.events.select("event_id", "value")
    u = X.unite({"z": X.standard(e, ["value"]), "u": X.minmax(e, ["value"])}, {"z": 0.5, "u": 2.0})
    return u.transform(e).select("event_id", r("z__value").alias("z__value"), r("u__value").alias("u__value"))


@query("d04_uncorrelated", "SELECT 'l_quantity' AS feature UNION ALL SELECT 'l_discount' UNION ALL SELECT 'l_tax'")
def _(t):
    kept = X.uncorrelated(t.lineitem.withColumn("twice", F.col("l_quantity") * 2), ["l_quantity", "twice", "l_discount", "l_tax"])
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")
