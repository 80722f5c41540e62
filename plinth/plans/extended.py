"""Reports, preparations, impacts and further operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions import scalars as S
from plinth.operators import columns as C
from plinth.operators import features as X
from plinth.operators import impact as I
from plinth.operators import metrics as M
from plinth.operators import preparing as P
from plinth.operators import reporting as R
from plinth.operators import splits
from plinth.plans.catalog import query
from plinth.plans.evaluation import PRED, REG, predictions, regressions, rounded
from plinth.plans.features import HOLES, holes
from plinth.plans.series import DAILY, by_day, daily, r

# reports


@query("e08_residuals", REG + "SELECT round(avg(y - p), 6) AS mean, round(stddev_pop(y - p), 6) AS std, round(min(y - p), 6) AS low, round(max(y - p), 6) AS high, round(quantile_cont(y - p, 0.25), 6) AS q25, round(quantile_cont(y - p, 0.75), 6) AS q75, round(corr(y, p), 6) AS correlation FROM p")
def _(t):
    return rounded(R.residuals(regressions(t), "y", "p"))


SERIES = DAILY + ", f AS (SELECT day, sales AS y, sales * (1 + (n % 5 - 2) / 20.0) AS p FROM d), l AS (SELECT *, lag(y, 7) OVER (ORDER BY day) AS y7, lag(y) OVER (ORDER BY day) AS y1, lag(p) OVER (ORDER BY day) AS p1 FROM f) "


def forecasts(t):
    f = daily(t).select("day", F.col("sales").alias("y"), (F.col("sales") * (1 + (F.col("n") % 5 - 2) / 20.0)).alias("p"))
    return f.withColumns({"y7": F.lag("y", 7).over(by_day()), "y1": F.lag("y").over(by_day()), "p1": F.lag("p").over(by_day())})


@query("e16_series_errors", SERIES + "SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(abs((y - p) / y)), 6) AS mape, round(avg(abs(y - p)) / avg(abs(y - y7)), 6) AS mase FROM l")
def _(t):
    e = R.series_errors(forecasts(t), "y", "p", F.col("y7"))
    return e.select(r("mse", 2).alias("mse"), r("rmse").alias("rmse"), r("mae").alias("mae"), *[r(c, 6).alias(c) for c in ("r2", "mape", "mase")])


@query("e19_forecast_accuracy", SERIES + "SELECT round(100 * avg(abs(y - p) / y), 6) AS mape, round(100 * avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) AS smape, round(avg(abs(y - p)) / avg(abs(y - y1)), 6) AS mase, round(greatest(0, 100 - 100 * avg(abs(y - p) / y)), 6) AS accuracy, round(100 * avg(CASE WHEN y1 IS NULL THEN NULL WHEN sign(y - y1) = sign(p - p1) THEN 1.0 ELSE 0.0 END), 6) AS directional FROM l")
def _(t):
    return rounded(R.forecast_accuracy(forecasts(t), "y", "p", F.col("y1"), F.col("p1")))


@query("e06_overfitting", PRED + "SELECT round(avg(CASE WHEN doc_id % 4 <> 0 THEN CAST(y = p AS INTEGER) END), 6) AS train, round(avg(CASE WHEN doc_id % 4 = 0 THEN CAST(y = p AS INTEGER) END), 6) AS test, round(avg(CASE WHEN doc_id % 4 <> 0 THEN CAST(y = p AS INTEGER) END) - avg(CASE WHEN doc_id % 4 = 0 THEN CAST(y = p AS INTEGER) END), 6) AS gap FROM p")
def _(t):
    right, held = (F.col("y") == F.col("p")).cast("int"), F.col("doc_id") % 4 == 0
    return rounded(R.overfitting(predictions(t), F.when(~held, right), F.when(held, right)))


MODELS = PRED + ", m AS (SELECT 'second' AS name, avg(CAST(y = p2 AS INTEGER)) AS accuracy, CAST(NULL AS DOUBLE) AS brier FROM p UNION ALL SELECT 'first', avg(CAST(y = p AS INTEGER)), NULL FROM p UNION ALL SELECT 'scores', avg(CAST(y = CAST(s >= 0.5 AS INTEGER) AS INTEGER)), avg((s - y) * (s - y)) FROM p) "


def models(t):
    p, right = predictions(t), lambda c: F.avg((F.col("y") == c).cast("int"))
    one = p.agg(right(F.col("p")).alias("a"), right(F.col("p2")).alias("b"), right((F.col("s") >= 0.5).cast("int")).alias("c"), F.avg((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("d"))
    row = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("accuracy"), b.cast("double").alias("brier"))
    return one.select(F.inline(F.array(row("first", F.col("a"), F.lit(None)), row("second", F.col("b"), F.lit(None)), row("scores", F.col("c"), F.col("d")))))


@query("e17_model_comparison", MODELS + "SELECT name, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, row_number() OVER (ORDER BY accuracy DESC NULLS LAST, name) AS place FROM m")
def _(t):
    return rounded(R.compare(models(t), "accuracy"))


@query("t10_rank_missing_last", MODELS + "SELECT name, round(brier, 6) AS brier, row_number() OVER (ORDER BY brier NULLS LAST, name) AS place FROM m")
def _(t):
    return rounded(R.compare(models(t), "brier", larger_is_better=False).select("name", "brier", "place"))


@query("d09_multi_criteria", MODELS + ", s AS (SELECT *, coalesce(accuracy, 0) * 0.7 - coalesce(brier, 0) * 0.3 AS score FROM m) SELECT name, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, name) AS place FROM s")
def _(t):
    return rounded(R.multi_criteria(models(t), {"accuracy": 0.7, "brier": -0.3}).select("name", "score", "place"))


@query("t08_stability", "WITH s AS (SELECT avg(value) AS a FROM events GROUP BY user_id) SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(stddev_pop(a) / abs(avg(a)), 6) AS cv, round(min(a), 6) AS low, round(max(a), 6) AS high, round(max(a) - min(a), 6) AS range FROM s")
def _(t):
    return rounded(R.stability(t.events.groupBy("user_id").agg(F.avg("value").alias("a")), "a"))


@query("e24_utility", PRED + ", k AS (SELECT c, count(*) FILTER (y = c AND p = c) / count(*) FILTER (p = c) AS a, count(*) FILTER (y = c AND p = c) / count(*) FILTER (y = c) AS b FROM p, (VALUES (0), (1)) v(c) GROUP BY 1), w AS (SELECT *, CASE c WHEN 1 THEN 0.9 ELSE 0.5 END AS w, CASE c WHEN 1 THEN 4.0 ELSE 1.0 END AS q FROM k) SELECT round(sum(w * (1 + q) * a * b / (q * a + b)) / sum(w), 6) AS utility FROM w")
def _(t):
    return rounded(R.utility(M.per_class(predictions(t), "y", "p"), {"1": 0.9, "0": 0.5}))


ENTROPY = "(CASE WHEN {0} > 0 THEN -({0}) * log2({0}) ELSE 0 END + CASE WHEN 1 - ({0}) > 0 THEN -(1 - ({0})) * log2(1 - ({0})) ELSE 0 END)"


@query("e30_ensemble_uncertainty", PRED + f", e AS (SELECT doc_id, s AS a, (s + p) / 2 AS b, (s + p2) / 2 AS c FROM p), m AS (SELECT *, (a + b + c) / 3 AS m FROM e) SELECT doc_id, round(m, 6) AS mean, round(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3, 6) AS variance, round({ENTROPY.format('m')} - ({ENTROPY.format('a')} + {ENTROPY.format('b')} + {ENTROPY.format('c')}) / 3, 6) AS information FROM m")
def _(t):
    e = predictions(t).select("doc_id", F.col("s").alias("a"), ((F.col("s") + F.col("p")) / 2).alias("b"), ((F.col("s") + F.col("p2")) / 2).alias("c"))
    return e.select("doc_id", *[r(v, 6).alias(k) for k, v in R.ensemble_uncertainty(["a", "b", "c"]).items()])


@query("d19_extra_metrics", PRED + "SELECT round((avg(CAST(p = 1 AS INTEGER)) FILTER (y = 1) + avg(CAST(p = 0 AS INTEGER)) FILTER (y = 0)) / 2, 6) AS balanced_accuracy, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance FROM p")
def _(t):
    return rounded(R.extra_metrics(predictions(t), "y", "p"))


@query("d19_average_precision", PRED + ", g AS (SELECT s, sum(y) AS a, count(*) AS n FROM p GROUP BY 1), c AS (SELECT s, sum(a) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY s DESC)), q AS (SELECT s, tp / (SELECT sum(y) FROM p) AS rec, tp / k AS pre FROM c) SELECT round(sum(x), 6) AS average_precision FROM (SELECT (rec - coalesce(lag(rec) OVER (ORDER BY s DESC), 0)) * pre AS x FROM q)")
def _(t):
    return rounded(R.average_precision(M.curve(predictions(t), "y", "s")))


# impacts


@query("b07_churn_return", PRED + ", c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM p), s AS (SELECT *, tp * 1200.0 * 0.7 AS saved, (tp + 2 * fp) * 25.0 AS cost FROM c) SELECT tp, fp, fn, tn, round(saved, 4) AS saved, round(fn * 1200.0, 4) AS lost, round((tp + fp) * 25.0, 4) AS campaign, round(saved - cost, 4) AS net, round(coalesce((saved - cost) / nullif(cost, 0) * 100, 0), 6) AS roi, round(cost / greatest(tp, 1), 6) AS cost_per_retained FROM s")
def _(t):
    return rounded(I.churn(predictions(t), "y", "p"))


@query("b08_fraud_impact", PRED + ", c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, coalesce(avg(s * 1000) FILTER (y = 1), 500) AS m FROM p), s AS (SELECT *, tp * m AS prevented, (tp + fp) * 25.0 AS alerts, fp * 10.0 AS bother FROM c) SELECT tp, fp, fn, round(prevented, 4) AS prevented, round(fn * m, 4) AS losses, round(prevented - alerts - bother, 4) AS net, round(tp / greatest(tp + fn, 1), 6) AS detection_rate, round((alerts + bother) / greatest(tp, 1), 6) AS cost_per_detection, round(coalesce((prevented - alerts - bother) / nullif(prevented, 0) * 100, 0), 6) AS savings_rate FROM s")
def _(t):
    p = predictions(t).withColumn("amount", F.col("s") * 1000)
    return I.fraud(p, "y", "p", "amount").select("tp", "fp", "fn", *[r(c, 4).alias(c) for c in ("prevented", "losses", "net")], *[r(c, 6).alias(c) for c in ("detection_rate", "cost_per_detection", "savings_rate")])


@query("b12_quality_cost", """
WITH i AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'pass' WHEN l_returnflag = 'A' THEN 'minor' ELSE 'major' END AS y, CASE WHEN l_linenumber % 3 = 0 THEN 'pass' WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber % 5 = 0 THEN 'minor' ELSE 'pass' END ELSE 'major' END AS p FROM lineitem),
c AS (SELECT y, p, CASE y WHEN 'minor' THEN 5.0 WHEN 'major' THEN 50.0 ELSE 1.0 END AS cost, CASE y WHEN 'minor' THEN 2.0 WHEN 'major' THEN 20.0 ELSE 0.0 END AS rework FROM i),
s AS (SELECT cost, 0.5 + CASE WHEN y = 'pass' AND p = 'pass' THEN 0 WHEN y <> 'pass' AND p <> 'pass' THEN rework WHEN y <> 'pass' THEN cost ELSE 2.0 END AS spent, CASE WHEN y <> 'pass' AND p <> 'pass' THEN cost - rework ELSE 0 END AS caught FROM c),
a AS (SELECT sum(cost) AS baseline, sum(spent) AS spent, sum(caught) AS caught, count(*) AS n FROM s)
SELECT round(baseline, 4) AS baseline, round(spent, 4) AS spent, round(baseline - spent + caught, 4) AS savings, round((baseline - spent + caught) / baseline, 6) AS savings_rate, round(spent / n, 6) AS cost_per_item FROM a""")
def _(t):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    y = F.when(flag == "N", "pass").when(flag == "A", "minor").otherwise("major")
    p = F.when(line % 3 == 0, "pass").when(flag == "N", F.when(line % 5 == 0, "minor").otherwise("pass")).otherwise("major")
    return rounded(I.quality(t.lineitem.select(y.alias("y"), p.alias("p")), "y", "p", {"pass": 1.0, "minor": 5.0, "major": 50.0}, {"minor": 2.0, "major": 20.0}, "pass", 0.5, 2.0))


@query("b13_maintenance", """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN value > 40 THEN 'Failure' WHEN value > 20 THEN 'Warning' ELSE 'Normal' END AS y, CASE WHEN event_id % 4 = 0 THEN 'Warning' WHEN value > 30 THEN 'Failure' ELSE 'Normal' END AS p FROM events),
l AS (SELECT *, lead(y, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM e),
c AS (SELECT count(*) FILTER (y = 'Failure' AND p IN ('Warning', 'Failure')) AS warned, count(*) FILTER (y = 'Failure') AS failures, count(*) FILTER (y = 'Normal' AND p IN ('Warning', 'Failure')) AS false_alarms, count(*) FILTER (y = 'Normal') AS normal, count(*) FILTER (ahead = 'Failure' AND p = 'Warning' AND y IN ('Normal', 'Warning')) AS effective, count(*) FILTER (ahead = 'Failure') AS windows FROM l),
s AS (SELECT warned, false_alarms, warned / greatest(failures, 1) AS a, false_alarms / greatest(normal, 1) AS b, effective / greatest(windows, 1) AS c FROM c)
SELECT warned, false_alarms, round(a, 6) AS early_warning_rate, round(b, 6) AS false_alarm_rate, round(c, 6) AS effectiveness, round(a * 0.6 + (1 - b) * 0.3 + c * 0.1, 6) AS reliability FROM s""")
def _(t):
    v = F.col("value")
    e = t.events.select("user_id", "ts", "event_id", F.when(v > 40, "Failure").when(v > 20, "Warning").otherwise("Normal").alias("y"), F.when(F.col("event_id") % 4 == 0, "Warning").when(v > 30, "Failure").otherwise("Normal").alias("p"))
    e = e.withColumn("ahead", F.lead("y", 2).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rounded(I.maintenance(e, "y", "p", F.col("ahead"), "Failure", "Normal", ["Warning", "Failure"]))


@query("b10_funnel_return", "WITH g AS (SELECT event_type, count(*) AS shown, count(*) FILTER (value > 10) AS clicked, count(*) FILTER (value > 20) AS bought, coalesce(sum(value) FILTER (value > 20), 0) AS revenue FROM events GROUP BY 1) SELECT event_type, shown, clicked, bought, round(revenue, 4) AS revenue, round(clicked / shown, 6) AS ctr, round(bought / nullif(clicked, 0), 6) AS conversion, round((revenue - shown * 2.0) / (shown * 2.0), 6) AS roi FROM g")
def _(t):
    v = F.col("value")
    f = I.funnel(t.events, ["event_type"], F.lit(True), v > 10, v > 20, v, 2.0)
    return f.select("event_type", "shown", "clicked", "bought", r("revenue", 4).alias("revenue"), *[r(c, 6).alias(c) for c in ("ctr", "conversion", "roi")])


# preparations


@query("f14_auto_encoder", """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_custkey % 30 AS VARCHAR) AS band, o_totalprice FROM orders), m AS (SELECT band, avg(o_totalprice) AS code FROM o GROUP BY 1)
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P", round(code, 4) AS band FROM o JOIN m USING (band)""")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 30).cast("string").alias("band"), "o_totalprice")
    e = P.Encoder().fit(o, ["o_orderstatus", "band"], "o_totalprice")
    return e.transform(o).drop("o_totalprice").withColumn("band", r("band", 4))


@query("f13_encoding_plan", "SELECT 'p_brand' AS name, CASE WHEN count(DISTINCT p_brand) <= 10 THEN 'onehot' WHEN count(DISTINCT p_brand) > 50 THEN 'label' ELSE 'target' END AS strategy FROM part UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) <= 10 THEN 'onehot' WHEN count(DISTINCT p_type) > 50 THEN 'label' ELSE 'target' END FROM part UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 10 THEN 'onehot' WHEN count(DISTINCT p_name) > 50 THEN 'label' ELSE 'target' END FROM part")
def _(t):
    return t.spark.createDataFrame(list(P.encoding_plan(t.part, ["p_brand", "p_type", "p_name"], "p_retailprice").items()), "name string, strategy string")


@query("f40_preprocess", HOLES + """, i AS (SELECT event_id, coalesce(v, (SELECT avg(v) FROM h)) AS v, coalesce(k, (SELECT k FROM h WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1)) AS k FROM h), s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM i)
SELECT event_id, round((v - m) / d, 6) AS v, CAST(k = (SELECT min(k) FROM i) AS INTEGER) AS first_kind FROM i, s""")
def _(t):
    h = holes(t).select("event_id", "v", "k")
    out = P.Preprocessor().fit(h, leave=("event_id",)).transform(h)
    first = sorted(c for c in out.columns if c.startswith("k_"))[0]
    return out.select("event_id", r("v", 6).alias("v"), F.col(f"`{first}`").alias("first_kind"))


@query("f39_adaptive", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events), o AS (SELECT avg(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END) > 0.1 AS wild, avg(value) AS mean, stddev_pop(value) AS dev FROM events, q)
SELECT event_id, round(CASE WHEN wild THEN (value - m) / (b - a) ELSE (value - mean) / dev END, 6) AS value FROM events, q, o""")
def _(t):
    e = t.events.select("event_id", "value", F.lit(1.0).alias("constant"))
    plan = P.adaptive_plan(e, leave=("event_id",))
    return P.adapt(e, plan).select("event_id", r("value", 6).alias("value"))


@query("f36_dynamic_union", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS wide FROM part")
def _(t):
    blocks = {"price": X.standard(t.part, ["p_retailprice"]), "size": X.minmax(t.part, ["p_size"])}
    n = lambda df, c: df.select(c).distinct().count()
    u = P.dynamic_union(t.part, blocks, lambda df: ["price" if n(df, "p_retailprice") > n(df, "p_size") else "size"])
    return u.transform(t.part).select("p_partkey", r("price__p_retailprice", 6).alias("wide"))


@query("f37_stack", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_discount * 2, 6) AS total, 2 AS n FROM lineitem")
def _(t):
    s = P.stack(["l_quantity", "l_discount"]).transform(t.lineitem)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("features")[0] + F.col("features")[1] * 2, 6).alias("total"), F.size("features").alias("n"))


@query("f41_debugger", HOLES + "SELECT count(*) AS rows, count(*) FILTER (v IS NULL) AS v_nulls, count(*) FILTER (k IS NULL) AS k_nulls, count(DISTINCT k) AS labels FROM h")
def _(t):
    d = P.describe_flow(holes(t), "k")
    labels = sum(1 for k in d["labels"] if k is not None)
    return t.spark.createDataFrame([(d["rows"], d["nulls"]["v"], d["nulls"]["k"], labels)], "rows long, v_nulls long, k_nulls long, labels long")


@query("f42_rule_counts", "SELECT p_partkey, CAST(p_size > 40 AS INTEGER) + CAST(p_retailprice > 1500 AS INTEGER) + CAST(p_brand LIKE '%1' AS INTEGER) AS violations, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS likely FROM part")
def _(t):
    broken = C.points([(F.col("p_size") > 40, 1), (F.col("p_retailprice") > 1500, 1), (F.col("p_brand").like("%1"), 1)])
    return t.part.select("p_partkey", broken.cast("int").alias("violations"), r(S.logistic((F.col("p_size") - 25) / 10.0), 6).alias("likely"))


@query("d03_inlier_scale", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) SELECT event_id, round((value - m) / d, 6) AS value FROM events, s")
def _(t):
    low, high = X.iqr_fences(t.events, ["value"])["value"]
    fitted = X.standard(t.events.where(F.col("value").between(low, high)), ["value"])
    return fitted.transform(t.events).select("event_id", r("value", 6).alias("value"))


@query("d07_feature_profile", "SELECT 'p_size' AS name, count(*) FILTER (p_size IS NULL) * 100.0 / count(*) AS missing, count(DISTINCT p_size) AS n_distinct, round(var_pop(p_size), 4) AS variance, CAST(max(p_size) - min(p_size) AS DOUBLE) AS range, var_pop(p_size) < 1e-10 AS constant FROM part UNION ALL SELECT 'p_retailprice', count(*) FILTER (p_retailprice IS NULL) * 100.0 / count(*), count(DISTINCT p_retailprice), round(var_pop(p_retailprice), 4), round(max(p_retailprice) - min(p_retailprice), 4), var_pop(p_retailprice) < 1e-10 FROM part")
def _(t):
    cells = [F.struct(F.lit(c).alias("name"), (100.0 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias("missing"), F.countDistinct(c).alias("n_distinct"), r(F.var_pop(c), 4).alias("variance"), r((F.max(c) - F.min(c)).cast("double"), 4).alias("range"), (F.var_pop(c) < 1e-10).alias("constant")) for c in ("p_size", "p_retailprice")]
    return t.part.agg(F.array(*cells).alias("all")).select(F.inline("all"))


@query("d14_downcast_plan", "SELECT 'l_linenumber' AS name, CASE WHEN max(l_linenumber) < 128 THEN 'tinyint' WHEN max(l_linenumber) < 32768 THEN 'smallint' ELSE 'int' END AS type FROM lineitem UNION ALL SELECT 'l_orderkey', CASE WHEN max(l_orderkey) < 128 THEN 'tinyint' WHEN max(l_orderkey) < 32768 THEN 'smallint' WHEN max(l_orderkey) < 2147483648 THEN 'int' ELSE 'bigint' END FROM lineitem")
def _(t):
    return t.spark.createDataFrame(list(P.downcast_plan(t.lineitem, ["l_linenumber", "l_orderkey"]).items()), "name string, type string")


# relational


@query("j03_zip_rows", "WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS place, s_suppkey FROM supplier) SELECT place, c_custkey, s_suppkey FROM a FULL JOIN b USING (place)")
def _(t):
    return P.zip_rows(t.customer.select("c_custkey"), t.supplier.select("s_suppkey"), ["c_custkey"], ["s_suppkey"])


@query("j12_update_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, round(CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS o_totalprice FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    changes = o.where("o_orderkey % 9 = 0").select("o_orderkey", F.lit("changed").alias("o_orderpriority"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return P.update_rows(o, changes, "o_orderkey", ["o_orderpriority", "o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("k07_set_operations", "WITH b AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, s))), '') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(s, x))), '') AS only FROM b")
def _(t):
    b = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("s"))
    return b.select("l_orderkey", F.array_join(F.array_sort(F.array_union("a", "s")), "").alias("either"), F.array_join(F.array_sort(F.array_except("a", "s")), "").alias("only"))


@query("o09_group_deviation", "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, round(value - m, 6) AS deviation FROM events JOIN m USING (event_type)")
def _(t):
    means = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return t.events.join(means, "event_type").select("event_id", r(F.col("value") - F.col("m"), 6).alias("deviation"))


@query("p19_drop_rename", "SELECT s_suppkey AS id, s_name AS name, s_nationkey FROM supplier")
def _(t):
    return t.supplier.drop("s_acctbal").withColumnsRenamed({"s_suppkey": "id", "s_name": "name"})


@query("p03_feature_list", "SELECT p_partkey, p_size, p_type FROM part")
def _(t):
    return C.select(t.part, names=["p_partkey", "p_type", "p_size"]).select("p_partkey", "p_size", "p_type")


@query("p09_products", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount, 6) AS product FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("l_quantity") * F.col("l_discount"), 6).alias("product"))


@query("p11_size_levels", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS level FROM part")
def _(t):
    return t.part.select("p_partkey", C.levels("p_size", [(40, "large"), (20, "medium")], "small").alias("level"))


@query("p16_rate", "SELECT event_type, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(r(C.rate(F.col("value") > 10), 6).alias("rate"))


@query("a03_sum_min_max", "SELECT p_brand, round(sum(p_retailprice), 2) AS total, round(min(p_retailprice), 2) AS low, round(max(p_retailprice), 2) AS high FROM part GROUP BY 1")
def _(t):
    p = F.col("p_retailprice")
    return t.part.groupBy("p_brand").agg(r(F.sum(p), 2).alias("total"), r(F.min(p), 2).alias("low"), r(F.max(p), 2).alias("high"))


@query("w31_keep_last", "SELECT o_custkey, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w17_warm_up", DAILY + "SELECT day, round(CASE WHEN row_number() OVER (ORDER BY day) <= 20 THEN 0 ELSE avg(sales) OVER (ORDER BY day ROWS 4 PRECEDING) END, 4) AS sma FROM d")
def _(t):
    return daily(t).select("day", r(F.when(F.row_number().over(by_day()) <= 20, 0.0).otherwise(F.avg("sales").over(by_day().rowsBetween(-4, 0)))).alias("sma"))


@query("j13_scenarios", "SELECT s_suppkey, scenario, round(s_acctbal * (1 + shock), 4) AS stressed FROM supplier, (VALUES ('mild', -0.05), ('severe', -0.3)) v(scenario, shock)")
def _(t):
    s = C.stress(t.supplier, "s_acctbal", {"mild": -0.05, "severe": -0.3})
    return s.select("s_suppkey", "scenario", r("stressed").alias("stressed"))


@query("b15_stress_table", "SELECT scenario, round(sum(o_totalprice * (1 + shock)), 2) AS total, round(min(o_totalprice * (1 + shock)), 4) AS low FROM orders, (VALUES ('base', 0.0), ('down', -0.2)) v(scenario, shock) GROUP BY 1")
def _(t):
    return C.stress(t.orders, "o_totalprice", {"base": 0.0, "down": -0.2}).groupBy("scenario").agg(r(F.sum("stressed"), 2).alias("total"), r(F.min("stressed")).alias("low"))


@query("f08_dummies", "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus_P\" FROM orders")
def _(t):
    return X.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", drop_first=True).transform(t.orders.select("o_orderkey", "o_orderstatus"))


@query("f35_weighted_union", "SELECT p_partkey, round(0.5 * (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS price, round(0.5 * (p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part), 6) AS size FROM part")
def _(t):
    u = X.unite({"a": X.standard(t.part, ["p_retailprice"]), "b": X.minmax(t.part, ["p_size"])}, {"a": 0.5, "b": 0.5})
    return u.transform(t.part).select("p_partkey", r("a__p_retailprice", 6).alias("price"), r("b__p_size", 6).alias("size"))


@query("f34_conditional_union", "SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part), 6) AS size FROM part")
def _(t):
    many = t.part.select(F.countDistinct("p_size")).first()[0] > 2
    u = X.unite({"a": X.standard(t.part, ["p_retailprice"]), "b": X.minmax(t.part, ["p_size"])}, when={"a": not many, "b": many})
    return u.transform(t.part).select("p_partkey", r("b__p_size", 6).alias("size"))


# scalars


@query("x04_cyclical", "SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) AS s, round(cos(hour(ts) * 2 * pi() / 24), 6) AS c FROM events")
def _(t):
    s, c = S.cyclic(F.hour("ts"), 24)
    return t.events.select("event_id", r(s, 6).alias("s"), r(c, 6).alias("c"))


@query("x07_arrays", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: length(x) > 6)) AS long, round(list_avg(list_transform(w, lambda x: length(x))), 6) AS mean FROM w")
def _(t):
    w = t.documents.where("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    total = F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size(F.filter("w", lambda x: F.length(x) > 6)).cast("long").alias("long"), r(F.try_divide(total, F.size("w")), 6).alias("mean"))


@query("x08_maps", "SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 5.0 ELSE 0.5 END AS weight FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", C.mapped("event_type", {"click": 1.0, "purchase": 5.0}, 0.5))


@query("x10_casts", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, TRY_CAST(o_orderstatus AS INTEGER) IS NULL AS bad, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderstatus FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("whole"), F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderstatus").try_cast("int").isNull().alias("bad"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("status"))


@query("x11_conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, least(c_acctbal, 1000.0) AS capped FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"), C.clip("c_acctbal", high=1000.0).alias("capped"))


@query("x02_moments", "SELECT event_type, round(stddev_samp(value) / sqrt(count(value)), 6) AS standard_error, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS low FROM events GROUP BY 1")
def _(t):
    error = F.stddev_samp("value") / F.sqrt(F.count("value"))
    return t.events.groupBy("event_type").agg(r(error, 6).alias("standard_error"), r(F.avg("value") - 1.96 * error, 6).alias("low"))


@query("d05_days_since", "SELECT o_orderkey, date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) AS days FROM orders")
def _(t):
    first = t.orders.agg(F.min("o_orderdate").alias("first"))
    return t.orders.join(F.broadcast(first)).select("o_orderkey", F.datediff("o_orderdate", "first").cast("long").alias("days"))


@query("t05_effect_label", "WITH g AS (SELECT event_type, (avg(value) - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) AS d FROM events GROUP BY 1) SELECT event_type, CASE WHEN abs(d) < 0.2 THEN 'small' WHEN abs(d) < 0.5 THEN 'medium' ELSE 'large' END AS label FROM g")
def _(t):
    every = t.events.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    g = t.events.groupBy("event_type").agg(F.avg("value").alias("a")).join(F.broadcast(every))
    d = F.abs((F.col("a") - F.col("m")) / F.col("s"))
    return g.select("event_type", F.when(d < 0.2, "small").when(d < 0.5, "medium").otherwise("large").alias("label"))


@query("q05_encode_strings", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment, c_nationkey FROM customer")
def _(t):
    c = X.label(t.customer, "c_mktsegment").transform(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"))
    return c.withColumn("c_mktsegment", F.col("c_mktsegment").cast("long"))


@query("q12_collinear", "SELECT 'l_extendedprice' AS a, 'l_quantity' AS b, round(corr(l_extendedprice, l_quantity), 6) AS correlation, abs(corr(l_extendedprice, l_quantity)) > 0.9 AS collinear, stddev_pop(l_extendedprice) / stddev_pop(l_quantity) > 100 AS scales_differ FROM lineitem")
def _(t):
    link, ratio = F.corr("l_extendedprice", "l_quantity"), F.stddev_pop("l_extendedprice") / F.stddev_pop("l_quantity")
    return t.lineitem.agg(F.lit("l_extendedprice").alias("a"), F.lit("l_quantity").alias("b"), r(link, 6).alias("correlation"), (F.abs(link) > 0.9).alias("collinear"), (ratio > 100).alias("scales_differ"))


@query("k12_bootstrap_means")
def _(t):
    b = splits.bootstrap(t.part.select("p_partkey", "p_retailprice"), ["p_partkey"], 20, seed=3)
    return b.groupBy("round").agg(F.avg("p_retailprice").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("b23_forecast_ahead", DAILY + ", l AS (SELECT max(day) AS day, arg_max(sales, day) AS s FROM d), w AS (SELECT avg(sales) AS a FROM (SELECT sales FROM d ORDER BY day DESC LIMIT 7)) SELECT strftime(CAST(l.day AS DATE) + CAST(h AS INTEGER), '%Y-%m-%d') AS day, round(w.a + (l.s - w.a) * power(0.5, h), 4) AS forecast FROM l, w, range(1, 15) r(h)")
def _(t):
    d = daily(t)
    last = d.orderBy(F.desc("day")).limit(7).agg(F.max("day").alias("day"), F.max_by("sales", "day").alias("s"), F.avg("sales").alias("a"))
    # each step feeds the one before back: f(h) = a + (f(h - 1) - a) / 2
    step = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda h: F.struct(h.alias("h"), (F.col("a") + (F.col("s") - F.col("a")) * F.pow(F.lit(0.5), h)).alias("f")))
    return last.select("day", F.explode(step).alias("z")).select(F.date_format(F.date_add(F.to_date("day"), F.col("z.h")), "yyyy-MM-dd").alias("day"), r("z.f").alias("forecast"))
