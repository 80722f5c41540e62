"""Time series and other ordered queries. Global series run over one row a day, keyed ones over their key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators import windows as W
from plinth.plans.catalog import query

DAILY = "WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS sales, count(*) AS n FROM orders GROUP BY 1) "


def daily(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("sales"), F.count(F.lit(1)).alias("n"))


def by_day():
    """Days in order; the daily table has one row a day."""
    return Window.orderBy("day")


def r(c, n=4):
    return F.round(c, n)


@query("w01_lag_global", DAILY + "SELECT day, lag(sales, 1) OVER (ORDER BY day) AS lag1, lag(sales, 7) OVER (ORDER BY day) AS lag7 FROM d")
def _(t):
    return daily(t).select("day", F.lag("sales", 1).over(by_day()).alias("lag1"), F.lag("sales", 7).over(by_day()).alias("lag7"))


@query("w02_lag_per_key", "SELECT o_orderkey, round(lag(o_totalprice, 1) OVER w, 2) AS lag1, round(lag(o_totalprice, 3) OVER w, 2) AS lag3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", r(F.lag("o_totalprice", 1).over(w), 2).alias("lag1"), r(F.lag("o_totalprice", 3).over(w), 2).alias("lag3"))


@query("w03_lead_per_key", "SELECT event_id, round(lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS target FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", r(F.lead("value", 1).over(w), 6).alias("target"))


@query("w04_rolling_shifted", DAILY + """
SELECT day, CASE WHEN count(sales) OVER w = 7 THEN round(avg(sales) OVER w, 4) END AS mean7, CASE WHEN count(sales) OVER w = 7 THEN round(max(sales) OVER w, 4) END AS max7, CASE WHEN count(sales) OVER w = 7 THEN round(min(sales) OVER w, 4) END AS min7
FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def _(t):
    return daily(t).select("day", *[r(W.rolling(f, "sales", by_day(), 7, shift=1)).alias(n) for f, n in ((F.avg, "mean7"), (F.max, "max7"), (F.min, "min7"))])


@query("w05_rolling_mean", DAILY + "SELECT day, CASE WHEN count(sales) OVER w = 30 THEN round(avg(sales) OVER w, 4) END AS mean30 FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def _(t):
    return daily(t).select("day", r(W.rolling(F.avg, "sales", by_day(), 30)).alias("mean30"))


@query("w06_rolling_per_key", "SELECT event_id, round(avg(value) OVER w, 6) AS mean3, round(stddev_samp(value) OVER w, 5) AS std3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", r(W.rolling(F.avg, "value", w, 3, full=False), 6).alias("mean3"), r(W.rolling(F.stddev_samp, "value", w, 3, full=False), 5).alias("std3"))


@query("w07_rolling_slope", DAILY + """, s AS (SELECT day, sales, row_number() OVER (ORDER BY day) AS i FROM d)
SELECT day, CASE WHEN count(*) OVER w = 6 THEN round(regr_slope(sales, i) OVER w, 3) END AS slope FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(t):
    return daily(t).select("day", r(W.slope("sales", by_day(), 6), 3).alias("slope"))


@query("w08_rolling_rate", "SELECT event_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return t.events.select("event_id", r(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).over(w), 6).alias("rate"))


@query("w09_exponential_smoothing", """
WITH d AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_id, round(sum(b.value * power(0.7, a.i - b.i)) / sum(power(0.7, a.i - b.i)), 6) AS ewm FROM d a JOIN d b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", r(W.exponential("value", w, 0.3), 6).alias("ewm"))


@query("w10_recursive_ema", """
WITH RECURSIVE d AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT user_id, event_id, i, value AS ema FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.event_id, d.i, e.ema + 2.0 / 13 * (d.value - e.ema) FROM e JOIN d ON d.user_id = e.user_id AND d.i = e.i + 1)
SELECT event_id, round(ema, 6) AS ema12 FROM e""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", r(W.exponential("value", w, 2 / 13, adjusted=False), 6).alias("ema12"))


@query("w11_bollinger", DAILY + """
SELECT day, CASE WHEN count(*) OVER w = 20 THEN round(avg(sales) OVER w - 2 * stddev_pop(sales) OVER w, 3) END AS lower_band, CASE WHEN count(*) OVER w = 20 THEN round(avg(sales) OVER w + 2 * stddev_pop(sales) OVER w, 3) END AS upper_band
FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(t):
    m, s = W.rolling(F.avg, "sales", by_day(), 20), W.rolling(F.stddev_pop, "sales", by_day(), 20)
    return daily(t).select("day", r(m - 2 * s, 3).alias("lower_band"), r(m + 2 * s, 3).alias("upper_band"))


@query("w12_rsi", DAILY + """, c AS (SELECT day, sales - lag(sales) OVER (ORDER BY day) AS x FROM d), g AS (SELECT day, count(x) OVER w AS k, avg(greatest(x, 0)) OVER w AS up, avg(greatest(-x, 0)) OVER w AS down FROM c WINDOW w AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT day, CASE WHEN k < 14 THEN 50.0 WHEN down = 0 THEN 100.0 ELSE round(100 - 100 / (1 + up / down), 4) END AS rsi FROM g""")
def _(t):
    c = daily(t).withColumn("x", F.col("sales") - F.lag("sales").over(by_day()))
    w = by_day().rowsBetween(-13, 0)
    g = c.select("day", F.count("x").over(w).alias("k"), F.avg(F.greatest("x", F.lit(0.0))).over(w).alias("up"), F.avg(F.greatest(-F.col("x"), F.lit(0.0))).over(w).alias("down"))
    return g.select("day", F.when(F.col("k") < 14, 50.0).when(F.col("down") == 0, 100.0).otherwise(r(100 - 100 / (1 + F.try_divide("up", "down")))).alias("rsi"))


@query("w13_williams_r", DAILY + """, g AS (SELECT day, sales, count(*) OVER w AS k, max(sales) OVER w AS hi, min(sales) OVER w AS lo FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT day, CASE WHEN k < 14 OR hi = lo THEN -50.0 ELSE round(-100 * (hi - sales) / (hi - lo), 4) END AS williams, CASE WHEN k < 14 OR hi = lo THEN 50.0 ELSE round(100 * (sales - lo) / (hi - lo), 4) END AS stochastic FROM g""")
def _(t):
    w = by_day().rowsBetween(-13, 0)
    g = daily(t).select("day", "sales", F.count(F.lit(1)).over(w).alias("k"), F.max("sales").over(w).alias("hi"), F.min("sales").over(w).alias("lo"))
    short, span = (F.col("k") < 14) | (F.col("hi") == F.col("lo")), F.col("hi") - F.col("lo")
    return g.select("day", F.when(short, -50.0).otherwise(r(F.try_divide(-100 * (F.col("hi") - F.col("sales")), span))).alias("williams"), F.when(short, 50.0).otherwise(r(F.try_divide(100 * (F.col("sales") - F.col("lo")), span))).alias("stochastic"))


@query("w14_true_range", """
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_totalprice) AS hi, min(o_totalprice) AS lo, arg_max(o_totalprice, o_orderkey) AS cl FROM orders GROUP BY 1),
x AS (SELECT day, greatest(hi - lo, coalesce(abs(hi - lag(cl) OVER (ORDER BY day)), 0), coalesce(abs(lo - lag(cl) OVER (ORDER BY day)), 0)) AS tr FROM d)
SELECT day, CASE WHEN count(*) OVER w = 14 THEN round(avg(tr) OVER w, 3) END AS atr FROM x WINDOW w AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def _(t):
    d = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.max_by("o_totalprice", "o_orderkey").alias("cl"))
    p = F.lag("cl").over(by_day())
    x = d.select("day", F.greatest(F.col("hi") - F.col("lo"), F.coalesce(F.abs(F.col("hi") - p), F.lit(0.0)), F.coalesce(F.abs(F.col("lo") - p), F.lit(0.0))).alias("tr"))
    return x.select("day", r(W.rolling(F.avg, "tr", by_day(), 14), 3).alias("atr"))


@query("w15_volatility", DAILY + """, l AS (SELECT day, ln(sales / lag(sales) OVER (ORDER BY day)) AS x FROM d) SELECT day, CASE WHEN count(x) OVER w = 20 THEN round(stddev_pop(x) OVER w * sqrt(252), 5) END AS vol FROM l WINDOW w AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(t):
    x = daily(t).select("day", F.ln(F.try_divide(F.col("sales"), F.lag("sales").over(by_day()))).alias("x"))
    return x.select("day", r(W.rolling(F.stddev_pop, "x", by_day(), 20) * F.sqrt(F.lit(252.0)), 5).alias("vol"))


@query("w16_momentum", DAILY + "SELECT day, round(sales / lag(sales, 9) OVER (ORDER BY day) - 1, 6) AS momentum FROM d")
def _(t):
    return daily(t).select("day", r(W.change("sales", by_day(), 9), 6).alias("momentum"))


@query("w18_diff_and_change", DAILY + "SELECT day, round(sales - lag(sales) OVER (ORDER BY day), 2) AS diff1, round(sales - lag(sales, 7) OVER (ORDER BY day), 2) AS diff7, round(sales / lag(sales) OVER (ORDER BY day) - 1, 6) AS pct1 FROM d")
def _(t):
    return daily(t).select("day", r(F.col("sales") - F.lag("sales").over(by_day()), 2).alias("diff1"), r(F.col("sales") - F.lag("sales", 7).over(by_day()), 2).alias("diff7"), r(W.change("sales", by_day()), 6).alias("pct1"))


@query("w19_cumulative_sum", DAILY + "SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS orders_so_far FROM d")
def _(t):
    return daily(t).select("day", F.sum("n").over(by_day().rowsBetween(Window.unboundedPreceding, 0)).alias("orders_so_far"))


@query("w20_drawdown", DAILY + "SELECT day, round((sales - max(sales) OVER w) / max(sales) OVER w, 6) AS drawdown FROM d WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)")
def _(t):
    return daily(t).select("day", r(W.drawdown("sales", by_day()), 6).alias("drawdown"))


@query("w21_cumulative_return", "SELECT event_id, round(exp(sum(ln(1 + value / 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS growth FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", r(F.exp(F.sum(F.ln(1 + F.col("value") / 1000)).over(w)), 6).alias("growth"))


@query("w22_rank_average", """
SELECT p_partkey, CAST(rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank_average, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS rank_first FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def _(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    ties = F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size"))
    return t.part.select("p_partkey", (F.rank().over(w) + (ties - 1) / 2).alias("rank_average"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("long").alias("rank_first"))


RFM = """
WITH g AS (SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
s AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency DESC, o_custkey) AS a, row_number() OVER (ORDER BY frequency, o_custkey) AS b, row_number() OVER (ORDER BY monetary, o_custkey) AS c FROM g),
q AS (SELECT *, CAST(greatest(1, ceil((a - 1) * 5 / (n - 1))) AS BIGINT) AS r_score, CAST(greatest(1, ceil((b - 1) * 5 / (n - 1))) AS BIGINT) AS f_score, CAST(greatest(1, ceil((c - 1) * 5 / (n - 1))) AS BIGINT) AS m_score FROM s),
z AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers' WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers' WHEN r_score >= 3 AND f_score >= 3 AND m_score <= 2 THEN 'Potential Loyalists'
 WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 AND m_score >= 3 THEN 'Cannot Lose Them' WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating' ELSE 'Others' END AS segment FROM q) """


@query("w23_rfm_scores", RFM + "SELECT o_custkey, recency, frequency, r_score, f_score, m_score, segment FROM z")
def _(t):
    s = W.rfm(t.orders.withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", "o_totalprice", "o_orderkey")
    return s.select("o_custkey", "recency", "frequency", "r_score", "f_score", "m_score", W.rfm_segment().alias("segment"))


@query("b04_rfm_segments", RFM + "SELECT o_custkey, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS code, round(r_score * 0.3 + f_score * 0.3 + m_score * 0.4, 6) AS weighted, segment FROM z")
def _(t):
    s = W.rfm(t.orders.withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", "o_totalprice", "o_orderkey")
    return s.select("o_custkey", W.rfm_code().alias("code"), r(W.rfm_weighted(), 6).alias("weighted"), W.rfm_segment().alias("segment"))


@query("b05_segment_profile", RFM + "SELECT segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, round(avg(recency), 4) AS recency, round(sum(monetary) / sum(sum(monetary)) OVER (), 6) AS revenue_share, round(avg(monetary / frequency) * (365 / greatest(avg(recency), 30)) * 2, 2) AS clv FROM z GROUP BY 1")
def _(t):
    s = W.rfm(t.orders.withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", "o_totalprice", "o_orderkey").withColumn("segment", W.rfm_segment())
    g = s.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("recency").alias("rec"), F.sum("monetary").alias("m"), F.avg(F.col("monetary") / F.col("frequency")).alias("spend"))
    every = Window.partitionBy()
    return g.select("segment", "n", r(100 * F.col("n") / F.sum("n").over(every)).alias("pct"), r("rec").alias("recency"), r(F.col("m") / F.sum("m").over(every), 6).alias("revenue_share"), r(F.col("spend") * (365 / F.greatest("rec", F.lit(30.0))) * 2, 2).alias("clv"))


@query("w24_decile_lift", """
WITH s AS (SELECT l_returnflag = 'R' AS y, ntile(10) OVER (ORDER BY l_quantity * l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS decile FROM lineitem), g AS (SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM s GROUP BY 1)
SELECT decile, n, positives, round((positives / n) / (sum(positives) OVER () / sum(n) OVER ()), 6) AS lift, round(sum(positives) OVER (ORDER BY decile) / sum(positives) OVER (), 6) AS gain FROM g""")
def _(t):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = t.lineitem.select((F.col("l_quantity") * F.col("l_discount")).alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), key.alias("k"))
    d = W.deciles(rows, "score", "y", "k")
    return d.select("decile", "n", "positives", r("lift", 6).alias("lift"), r("gain", 6).alias("gain"))


@query("w25_group_share", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER w, 8) AS share, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_samp(c_acctbal) OVER w, 0), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(t):
    w = Window.partitionBy("c_nationkey")
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", r(F.try_divide(b, F.sum(b).over(w)), 8).alias("share"), r(F.try_divide(b - F.avg(b).over(w), F.stddev_samp(b).over(w)), 6).alias("z"))


@query("w26_sequence_pattern", "SELECT a, c, count(*) AS n FROM (SELECT event_type AS a, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) WHERE c IS NOT NULL GROUP BY 1, 2")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = t.events.select(F.col("event_type").alias("a"), F.lead("event_type", 2).over(w).alias("c"))
    return p.where("c IS NOT NULL").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"))


@query("w27_seasonal_naive_mase", DAILY + ", e AS (SELECT abs(sales - lag(sales, 7) OVER (ORDER BY day)) AS s, abs(sales - lag(sales, 1) OVER (ORDER BY day)) AS f FROM d) SELECT round(avg(f) / avg(s), 6) AS mase FROM e WHERE s IS NOT NULL")
def _(t):
    e = daily(t).select(F.abs(F.col("sales") - F.lag("sales", 7).over(by_day())).alias("s"), F.abs(F.col("sales") - F.lag("sales", 1).over(by_day())).alias("f"))
    return e.where("s IS NOT NULL").agg(r(F.try_divide(F.avg("f"), F.avg("s")), 6).alias("mase"))


@query("w28_directional_accuracy", DAILY + ", e AS (SELECT sign(sales - lag(sales) OVER w) AS a, sign(lag(sales) OVER w - lag(sales, 2) OVER w) AS p FROM d WINDOW w AS (ORDER BY day)) SELECT round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e WHERE p IS NOT NULL")
def _(t):
    a, b = F.lag("sales").over(by_day()), F.lag("sales", 2).over(by_day())
    e = daily(t).select(F.signum(F.col("sales") - a).alias("a"), F.signum(a - b).alias("p"))
    return e.where("p IS NOT NULL").agg(r(F.avg(F.when(F.col("a") == F.col("p"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("w29_seasonal_decomposition", DAILY + """, n AS (SELECT day, sales, row_number() OVER (ORDER BY day) - 1 AS i, CASE WHEN count(*) OVER w = 7 THEN avg(sales) OVER w END AS trend FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT i % 7 AS p, avg(sales - trend) AS x FROM n GROUP BY 1), c AS (SELECT p, x - avg(x) OVER () AS season FROM s) SELECT day, round(trend, 3) AS trend, round(season, 3) AS season, round(sales - trend - season, 3) AS residual FROM n JOIN c ON i % 7 = p""")
def _(t):
    w = by_day().rowsBetween(-3, 3)
    n = daily(t).select("day", "sales", ((F.row_number().over(by_day()) - 1) % 7).alias("p"), F.when(F.count("sales").over(w) == 7, F.avg("sales").over(w)).alias("trend"))
    s = n.groupBy("p").agg(F.avg(F.col("sales") - F.col("trend")).alias("x"))
    s = s.select("p", (F.col("x") - F.avg("x").over(Window.partitionBy())).alias("season"))
    return n.join(F.broadcast(s), "p").select("day", r("trend", 3).alias("trend"), r("season", 3).alias("season"), r(F.col("sales") - F.col("trend") - F.col("season"), 3).alias("residual"))


@query("w30_relative_value", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS excess FROM events")
def _(t):
    return t.events.select("event_id", r(F.col("value") - F.avg("value").over(Window.partitionBy(F.to_date("ts"))), 6).alias("excess"))


@query("w32_more_ranks", "SELECT p_partkey, CAST(dense_rank() OVER w AS BIGINT) AS dense, round(percent_rank() OVER w, 6) AS pct, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS quarter, round(nth_value(p_retailprice, 2) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS second FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def _(t):
    w, u = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return t.part.select("p_partkey", F.dense_rank().over(w).cast("long").alias("dense"), r(F.percent_rank().over(w), 6).alias("pct"), F.ntile(4).over(u).cast("long").alias("quarter"), r(F.nth_value("p_retailprice", 2).over(u.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("second"))


@query("st07_tumbling_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    g = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))
    return g.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query("st07_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM n GROUP BY user_id, session""")
def _(t):
    g = t.events.groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")
