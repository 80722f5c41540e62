"""Metrics and statistical tests. Predictions are made from key arithmetic, so SQL can make the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import metrics as M
from plinth.operators import stats as S
from plinth.plans.catalog import query

PRED = "WITH p AS (SELECT doc_id, toxic AS y, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS p, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS p2, (toxic * 60 + (doc_id * 37) % 41) / 101.0 AS s, source FROM labels JOIN documents USING (doc_id)) "
REG = "WITH p AS (SELECT p_partkey, p_retailprice AS y, p_retailprice + (p_partkey * 13) % 21 - 10 AS p FROM part) "


def predictions(t):
    d, y = F.col("doc_id"), F.col("toxic")
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return j.select("doc_id", y.alias("y"), F.when(d % 7 == 0, 1 - y).otherwise(y).alias("p"), F.when(d % 5 == 0, 1 - y).otherwise(y).alias("p2"), ((y * 60 + (d * 37) % 41) / 101.0).alias("s"), "source")


def regressions(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", F.col("p_retailprice").alias("y"), (F.col("p_retailprice") + (k * 13) % 21 - 10).alias("p"))


def rounded(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("e02_detection", PRED + """, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM p)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(fp / (fp + tn), 6) AS fpr, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2 FROM c""")
def _(t):
    return rounded(M.detection(predictions(t), "y", "p"))


@query("e05_class_report", PRED + """, k AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp, count(*) FILTER (y = c AND p <> c) AS fn FROM p, (VALUES (0), (1)) v(c) GROUP BY 1)
SELECT c AS class, support, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""")
def _(t):
    return rounded(M.per_class(predictions(t), "y", "p"))


@query("e34_averages", PRED + """, k AS (SELECT c, count(*) FILTER (y = c) AS n, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp FROM p, (VALUES (0), (1)) v(c) GROUP BY 1),
m AS (SELECT n, tp, fp, tp / (tp + fp) AS a, tp / n AS b FROM k), f AS (SELECT *, 2 * a * b / (a + b) AS f FROM m)
SELECT 'macro' AS average, round(avg(a), 6) AS precision, round(avg(b), 6) AS recall, round(avg(f), 6) AS f1, round(sum(tp) / sum(n), 6) AS accuracy FROM f
UNION ALL SELECT 'weighted', round(sum(a * n) / sum(n), 6), round(sum(b * n) / sum(n), 6), round(sum(f * n) / sum(n), 6), round(sum(tp) / sum(n), 6) FROM f
UNION ALL SELECT 'micro', round(sum(tp) / sum(tp + fp), 6), round(sum(tp) / sum(n), 6), round(sum(tp) / sum(n), 6), round(sum(tp) / sum(n), 6) FROM f""")
def _(t):
    return rounded(M.averages(predictions(t), "y", "p"))


@query("e03_auc", PRED + ", a AS (SELECT s FROM p WHERE y = 1), b AS (SELECT s FROM p WHERE y = 0) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) AS auc FROM a, b")
def _(t):
    return rounded(M.auc(predictions(t), "y", "s"))


@query("e04_curves", PRED + """, g AS (SELECT s, sum(y) AS a, count(*) AS n FROM p GROUP BY 1), c AS (SELECT s, sum(a) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY s DESC)), t AS (SELECT sum(y) AS a, count(*) AS n FROM p)
SELECT round(s, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(k - tp AS BIGINT) AS fp, round(tp / a, 6) AS tpr, round((k - tp) / (n - a), 6) AS fpr, round(tp / k, 6) AS precision FROM c, t""")
def _(t):
    return rounded(M.curve(predictions(t), "y", "s"))


@query("e33_thresholds", PRED + """, g AS (SELECT s, sum(y) AS a, count(*) AS n FROM p GROUP BY 1), c AS (SELECT s, sum(a) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY s DESC)), t AS (SELECT sum(y) AS a, count(*) AS n FROM p),
x AS (SELECT s, round(tp / a - (k - tp) / (n - a), 12) AS j, round(2 * (tp / a) * (tp / k) / (tp / a + tp / k), 12) AS f FROM c, t WHERE tp > 0) SELECT round(arg_max(s, (j, s)), 6) AS youden, round(arg_max(s, (f, s)), 6) AS f1 FROM x""")
def _(t):
    return rounded(M.best_threshold(predictions(t), "y", "s"))


@query("e07_regression", REG + """SELECT round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained, round(avg(abs((y - p) / y)), 6) AS mape, round(avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) AS smape,
round(avg(y - p), 6) AS residual_mean, round(stddev_pop(y - p), 6) AS residual_std, round(min(y - p), 6) AS residual_min, round(max(y - p), 6) AS residual_max, round(quantile_cont(y - p, 0.25), 6) AS residual_q25, round(quantile_cont(y - p, 0.75), 6) AS residual_q75, round(corr(y, p), 6) AS correlation FROM p""")
def _(t):
    return rounded(M.regression(regressions(t), "y", "p"))


@query("e13_calibration", PRED + "SELECT CAST(ceil(s * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(s), 6) AS confidence, round(avg(y), 6) AS accuracy FROM p WHERE s > 0 GROUP BY 1")
def _(t):
    return rounded(M.calibration(predictions(t), "y", "s"))


@query("e13_brier_ece", PRED + ", c AS (SELECT ceil(s * 10) AS b, count(*) AS n, avg(s) AS m, avg(y) AS a FROM p WHERE s > 0 GROUP BY 1), q AS (SELECT y, s, greatest(least(s, 1 - 1e-15), 1e-15) AS z FROM p) SELECT round(avg(power(s - y, 2)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(z) ELSE ln(1 - z) END), 6) AS log_loss, round((SELECT sum(n * abs(m - a)) FROM c) / count(*), 6) AS ece FROM q")
def _(t):
    return rounded(M.brier_and_ece(predictions(t), "y", "s"))


@query("e15_fairness", PRED + ", g AS (SELECT source, count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY 1) SELECT source, n, round(a, 6) AS accuracy, round(r, 6) AS positive_rate, round(max(r) OVER () - min(r) OVER (), 6) AS parity_gap FROM g")
def _(t):
    return rounded(M.fairness(predictions(t), "y", "p", "source"))


@query("e26_ranking", """
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS rel FROM events),
g AS (SELECT user_id, sum(CASE WHEN k <= 10 THEN rel ELSE 0 END) AS h, sum(rel) AS t, sum(CASE WHEN k <= 10 AND rel = 1 THEN 1 / log2(k + 1) ELSE 0 END) AS d FROM r GROUP BY 1)
SELECT user_id, round(h / 10, 6) AS precision, round(CASE WHEN t > 0 THEN h / t ELSE 0 END, 6) AS recall, round(CASE WHEN h > 0 THEN 2 * (h / 10) * (h / t) / (h / 10 + h / t) ELSE 0 END, 6) AS f1,
round(CASE WHEN t > 0 THEN d / list_sum(list_transform(range(1, CAST(least(t, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM g""")
def _(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    r = t.events.select("user_id", F.row_number().over(w).alias("k"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("rel"))
    return rounded(M.ranking(r, "user_id", "k", "rel", 10))


@query("e10_agreement", """
WITH c AS (SELECT label AS a, vec_id % 7 AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c),
s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t, sum(n * (na - 1) / 2) AS i, sum(n * (nb - 1) / 2) AS j, ln(sum(n)) - sum(n * ln(na)) / sum(n) AS ha, ln(sum(n)) - sum(n * ln(nb)) / sum(n) AS hb, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hij FROM m),
z AS (SELECT *, i * j / (t * (t - 1) / 2) AS e, ha + hb - hij AS mi FROM s) SELECT round((ij - e) / ((i + j) / 2 - e), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM z""")
def _(t):
    return rounded(M.clustering_agreement(t.embeddings.select("label", (F.col("vec_id") % 7).alias("b")), "label", "b"))


@query("e09_cluster_quality")
def _(t):
    return rounded(M.cluster_quality(t.embeddings, "embedding", "label"), 4)


@query("e28_returns", "WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT s / lag(s) OVER (ORDER BY day) - 1 AS x FROM d) SELECT round(avg(x) / stddev_pop(x) * sqrt(252), 6) AS sharpe, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(quantile_cont(x, 0.05), 6) AS var5 FROM r WHERE x IS NOT NULL")
def _(t):
    from plinth.operators.windows import change
    from plinth.plans.series import by_day

    d = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum("o_totalprice").alias("s"))
    return rounded(M.returns(d.select(change("s", by_day()).alias("x")).where("x IS NOT NULL"), "x"))


@query("e29_diversity", PRED + """, c AS (SELECT count(*) FILTER (y = p AND y = p2) AS a, count(*) FILTER (y <> p AND y <> p2) AS d, count(*) FILTER (y = p AND y <> p2) AS b, count(*) FILTER (y <> p AND y = p2) AS c, count(*) AS n, avg(CASE WHEN p <> p2 THEN 1.0 ELSE 0.0 END) AS g FROM p), e AS (SELECT *, ((a + b) * (a + c) + (d + c) * (d + b)) / (n * n) AS x FROM c)
SELECT round(g, 6) AS disagreement, round((a * d - b * c) / (a * d + b * c), 6) AS yule_q, round(((a + d) / n - x) / (1 - x), 6) AS kappa FROM e""")
def _(t):
    return rounded(M.disagreement(predictions(t), "y", "p", "p2"))


def table(t, rows: dict, keys: list[str], n: int = 6):
    out = [(k, float(rows[k])) for k in keys]
    return t.spark.createDataFrame(out, "name string, value double").select("name", F.round("value", n).alias("value"))


@query("t01_paired_t", REG + "SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM p UNION ALL SELECT 't', round(avg(y - p) / (stddev_samp(y - p) / sqrt(count(*))), 6) FROM p UNION ALL SELECT 'd', round(avg(y - p) / sqrt((var_samp(y) + var_samp(p)) / 2), 6) FROM p")
def _(t):
    return table(t, S.paired_t(regressions(t), "y", "p"), ["n", "t", "d"])


@query("t02_mcnemar", PRED + ", c AS (SELECT count(*) FILTER (y = p AND y <> p2) AS b, count(*) FILTER (y <> p AND y = p2) AS c FROM p) SELECT 'b' AS name, CAST(b AS DOUBLE) AS value FROM c UNION ALL SELECT 'c', CAST(c AS DOUBLE) FROM c UNION ALL SELECT 'statistic', round(CASE WHEN b + c < 25 THEN least(b, c) ELSE power(abs(b - c) - 1, 2) / (b + c) END, 6) FROM c")
def _(t):
    p = predictions(t)
    return table(t, S.mcnemar(p, F.col("p") == F.col("y"), F.col("p2") == F.col("y")), ["b", "c", "statistic"])


@query("t04_mean_interval")
def _(t):
    return table(t, S.mean_interval(t.customer, "c_acctbal"), ["n", "mean", "low", "high"], 4)


@query("t07_effect_size", "WITH g AS (SELECT avg(value) FILTER (event_type = 'purchase') AS a, avg(value) FILTER (event_type = 'click') AS b, var_samp(value) FILTER (event_type = 'purchase') AS va, var_samp(value) FILTER (event_type = 'click') AS vb FROM events) SELECT round((a - b) / sqrt((va + vb) / 2), 6) AS cohen_d, round((a - b) / sqrt(vb), 6) AS glass_delta FROM g")
def _(t):
    v = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    a, b = v("purchase"), v("click")
    gap = F.avg(a) - F.avg(b)
    return rounded(t.events.agg(F.try_divide(gap, F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("cohen_d"), F.try_divide(gap, F.stddev_samp(b)).alias("glass_delta")))


@query("t12_ks_drift", """
WITH v AS (SELECT value AS x, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS g FROM events), n AS (SELECT sum(g) AS a, sum(1 - g) AS b FROM v), c AS (SELECT x, sum(sum(g)) OVER (ORDER BY x) AS a, sum(sum(1 - g)) OVER (ORDER BY x) AS b FROM v GROUP BY 1) SELECT 'd' AS name, round(max(abs(c.a / n.a - c.b / n.b)), 6) AS value FROM c, n""")
def _(t):
    return table(t, S.ks_two_sample(t.events, "value", F.col("event_id") % 2 == 0), ["d"])
