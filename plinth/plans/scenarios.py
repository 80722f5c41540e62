"""Domain analytics composed of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators import basket as B
from plinth.plans.catalog import query


def r(c, n=6):
    return F.round(c, n)


BRANDS = "WITH b AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT count(DISTINCT l_orderkey) AS n FROM b), one AS (SELECT p_type AS a, count(*) AS n FROM b GROUP BY 1), two AS (SELECT x.p_type AS a, y.p_type AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_type < y.p_type GROUP BY 1, 2) "


def baskets(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type")


@query("b01_itemsets", BRANDS + """, three AS (SELECT x.p_type AS a, y.p_type AS b, z.p_type AS c, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_type < y.p_type JOIN b z ON z.l_orderkey = y.l_orderkey AND y.p_type < z.p_type GROUP BY 1, 2, 3), m AS (SELECT CAST(floor(0.05 * n) AS BIGINT) AS least, n AS total FROM t)
SELECT items, CAST(len(string_split(items, '|')) AS INTEGER) AS size, u.n, round(u.n / total, 6) AS support FROM (SELECT a AS items, n FROM one UNION ALL SELECT a || '|' || b, n FROM two UNION ALL SELECT a || '|' || b || '|' || c, n FROM three) u, m WHERE u.n >= least""")
def _(t):
    s = B.itemsets(baskets(t), "l_orderkey", "p_type", 0.05, 3)
    return s.select(F.array_join("items", "|").alias("items"), "size", "n", r("support").alias("support"))


@query("b02_rules", BRANDS + """, m AS (SELECT CAST(floor(0.05 * n) AS BIGINT) AS least, n AS total FROM t), d AS (SELECT a, b, n FROM two UNION ALL SELECT b, a, n FROM two)
SELECT d.a AS antecedent, d.b AS consequent, round(d.n / total, 6) AS support, round(d.n / x.n, 6) AS confidence, round(d.n / x.n / (y.n / total), 6) AS lift, round((1 - y.n / total) / nullif(1 - d.n / x.n, 0), 6) AS conviction FROM d JOIN one x ON d.a = x.a JOIN one y ON d.b = y.a, m WHERE d.n >= least AND x.n >= least AND y.n >= least""")
def _(t):
    rules = B.rules(B.itemsets(baskets(t), "l_orderkey", "p_type", 0.05, 2))
    return rules.select(F.col("antecedent")[0].alias("antecedent"), "consequent", *[r(c).alias(c) for c in ("support", "confidence", "lift", "conviction")])


@query("b03_recommendations", BRANDS + """, d AS (SELECT a, b, n FROM two UNION ALL SELECT b, a, n FROM two), c AS (SELECT d.a AS item, d.b AS recommended, d.n / x.n AS confidence, row_number() OVER (PARTITION BY d.a ORDER BY d.n DESC, d.b) AS k FROM d JOIN one x ON d.a = x.a) SELECT item, recommended, round(confidence, 6) AS confidence, k FROM c WHERE k <= 5""")
def _(t):
    p = B.pair_counts(baskets(t), "l_orderkey", "p_type")
    d = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    one = baskets(t).distinct().groupBy(F.col("p_type").alias("a")).agg(F.count(F.lit(1)).alias("na"))
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return d.join(one, "a").withColumn("k", k).where("k <= 5").select(F.col("a").alias("item"), F.col("b").alias("recommended"), r(F.col("n") / F.col("na")).alias("confidence"), F.col("k").cast("long").alias("k"))


@query("b07_churn_impact", """
WITH c AS (SELECT o_custkey, max(o_orderdate) AS last, sum(o_totalprice) AS v FROM orders GROUP BY 1), m AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT count(*) FILTER (date_diff('day', CAST(last AS DATE), CAST(now AS DATE)) > 180) AS churned, round(coalesce(sum(v) FILTER (date_diff('day', CAST(last AS DATE), CAST(now AS DATE)) > 180), 0) * 0.7, 2) AS retained_value, round(count(*) FILTER (date_diff('day', CAST(last AS DATE), CAST(now AS DATE)) > 180) * 50.0, 2) AS cost FROM c, m""")
def _(t):
    c = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.sum("o_totalprice").alias("v"))
    c = c.join(F.broadcast(t.orders.agg(F.max("o_orderdate").alias("now"))))
    gone = F.datediff("now", "last") > 180
    return c.agg(F.count_if(gone).alias("churned"), F.round(F.coalesce(F.sum(F.when(gone, F.col("v"))), F.lit(0.0)) * 0.7, 2).alias("retained_value"), F.round(F.count_if(gone) * 50.0, 2).alias("cost"))


@query("b09_safety_stock", """
WITH d AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(q), 4) AS demand, round(1.65 * sqrt(avg(q)), 4) AS safety, round(avg(q) * 7 + 1.65 * sqrt(avg(q)), 4) AS reorder FROM d GROUP BY 1""")
def _(t):
    d = t.lineitem.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.sum("l_quantity").alias("q"))
    m = F.avg("q")
    return d.groupBy("l_suppkey").agg(r(m, 4).alias("demand"), r(1.65 * F.sqrt(m), 4).alias("safety"), r(m * 7 + 1.65 * F.sqrt(m), 4).alias("reorder"))


@query("b10_funnel", """
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS m FROM events GROUP BY 1)
SELECT CAST(sum(v) AS BIGINT) AS views, CAST(sum(c) AS BIGINT) AS clicks, CAST(sum(p) AS BIGINT) AS purchases, round(sum(p) / nullif(sum(c), 0), 6) AS conversion, round(sum(m), 4) AS revenue FROM u""")
def _(t):
    k = F.col("event_type")
    n = lambda x: F.count_if(k == x)
    return t.events.agg(n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("purchases"), r(F.try_divide(n("purchase"), n("click"))).alias("conversion"), r(F.coalesce(F.sum(F.when(k == "purchase", F.col("value"))), F.lit(0.0)), 4).alias("revenue"))


@query("b16_risk_strata", """
WITH s AS (SELECT c_custkey, 0.5 * (1 - (c_acctbal + 1000) / 11000) + 0.5 * (c_nationkey / 24.0) AS x FROM customer) SELECT CASE WHEN x <= 0.25 THEN 'low' WHEN x <= 0.5 THEN 'moderate' WHEN x <= 0.75 THEN 'high' ELSE 'critical' END AS stratum, count(*) AS n FROM s GROUP BY 1""")
def _(t):
    x = 0.5 * (1 - (F.col("c_acctbal") + 1000) / 11000) + 0.5 * (F.col("c_nationkey") / 24.0)
    band = F.when(x <= 0.25, "low").when(x <= 0.5, "moderate").when(x <= 0.75, "high").otherwise("critical")
    return t.customer.groupBy(band.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("b17_lead_ranking", """
WITH a AS (SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS x, p_size / 50.0 AS y FROM part) SELECT p_partkey, round(0.7 * x + 0.3 * y, 6) AS score FROM a ORDER BY round(0.7 * x + 0.3 * y, 6) DESC, p_partkey LIMIT 25""")
def _(t):
    m = t.part.agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    x = (F.col("p_retailprice") - F.col("a")) / (F.col("b") - F.col("a"))
    return t.part.join(F.broadcast(m)).select("p_partkey", r(0.7 * x + 0.3 * (F.col("p_size") / 50.0)).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(25)


@query("b18_relative_risk", """
WITH j AS (SELECT source, toxic FROM labels JOIN documents USING (doc_id)), b AS (SELECT avg(toxic) AS base FROM j) SELECT source, round(avg(toxic), 6) AS risk, round(avg(toxic) / max(base), 6) AS relative FROM j, b GROUP BY 1""")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("s"), F.count("toxic").alias("n"))
    every = Window.partitionBy()
    risk = F.col("s") / F.col("n")
    return j.select("source", r(risk).alias("risk"), r(F.try_divide(risk, F.sum("s").over(every) / F.sum("n").over(every))).alias("relative"))


@query("b19_portfolio_weights", """
WITH d AS (SELECT o_orderpriority AS a, strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), x AS (SELECT a, v / lag(v) OVER (PARTITION BY a ORDER BY m) - 1 AS q FROM d), s AS (SELECT a, greatest(avg(q) / nullif(stddev_samp(q), 0), 0) AS sharpe FROM x WHERE q IS NOT NULL GROUP BY 1 HAVING count(*) >= 10), w AS (SELECT a, least(sharpe / sum(sharpe) OVER (), 0.4) AS w FROM s)
SELECT a AS asset, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def _(t):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("asset"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("asset").orderBy("m")
    x = d.select("asset", (F.try_divide(F.col("v"), F.lag("v").over(w)) - 1).alias("q")).where("q IS NOT NULL")
    s = x.groupBy("asset").agg(F.greatest(F.try_divide(F.avg("q"), F.stddev_samp("q")), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    every = Window.partitionBy()
    c = s.select("asset", F.least(F.try_divide(F.col("s"), F.sum("s").over(every)), F.lit(0.4)).alias("w"))
    return c.select("asset", r(F.try_divide(F.col("w"), F.sum("w").over(every))).alias("weight"))


@query("b20_text_features", """
SELECT doc_id, length(text) AS chars, CAST(length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) AS BIGINT) AS stops, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS caps, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS digits, round((length(text) - length(regexp_replace(text, '[.!?]', '', 'g'))) / greatest(length(text), 1), 6) AS stop_rate FROM documents""")
def _(t):
    x, n = F.col("text"), F.length("text")
    stops = n - F.length(F.regexp_replace(x, "[.!?]", ""))
    return t.documents.select("doc_id", n.cast("long").alias("chars"), stops.cast("long").alias("stops"), F.length(F.regexp_replace(x, "[^A-Z]", "")).cast("long").alias("caps"), F.length(F.regexp_replace(x, "[^0-9]", "")).cast("long").alias("digits"), r(stops / F.greatest(n, F.lit(1))).alias("stop_rate"))


@query("b21_rule_sentiment", """
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), s AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ('good', 'great', 'of', 'the'))) AS p, len(list_filter(w, lambda x: x IN ('bad', 'poor', 'to', 'and'))) AS n FROM w)
SELECT conv_id, turn, CAST(p AS INTEGER) AS p, CAST(n AS INTEGER) AS n, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM s""")
def _(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    s = t.conversations.withColumn("w", words).select("conv_id", "turn", F.size(F.filter("w", lambda x: x.isin("good", "great", "of", "the"))).alias("p"), F.size(F.filter("w", lambda x: x.isin("bad", "poor", "to", "and"))).alias("n"))
    return s.withColumn("sentiment", F.when(F.col("p") > F.col("n"), "positive").when(F.col("n") > F.col("p"), "negative").otherwise("neutral"))


@query("b24_customer_pack", """
SELECT o_custkey, count(*) AS orders, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice) / nullif(avg(o_totalprice), 0), 6) AS peak, count(DISTINCT o_orderpriority) AS kinds, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS span FROM orders GROUP BY 1""")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), r(F.avg(p), 4).alias("mean"), r(F.try_divide(F.max(p), F.avg(p))).alias("peak"), F.countDistinct("o_orderpriority").alias("kinds"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"))


@query("d12_ab_routing", "SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    arm = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    return t.events.groupBy(arm.alias("arm")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))
