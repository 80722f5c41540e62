"""Projections, filters, joins, sorts, sets, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators import columns as C
from plinth.operators import splits
from plinth.plans.catalog import query
from plinth.sources.tables import latest_interactions


@query("s15_latest_interactions", """
SELECT user_id, event_type, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value
FROM events GROUP BY user_id, event_type""")
def _(t):
    last = latest_interactions(t.events.select("event_id", "ts", "user_id", "event_type", "value"), "user_id", "event_type", "ts", "event_id")
    return last.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("s12_date_range", "SELECT strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS date FROM range(90) r(i)")
def _(t):
    from plinth.sources.tables import date_range

    return date_range(t.spark, "2024-01-01", 90).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("p01_select_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    return C.select(t.customer, names=["c_custkey"], indexes=[4])


@query("p02_select_by_dtype", "SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def _(t):
    return C.select(t.customer, dtypes=["number"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("p04_ratio_columns", """
SELECT o_orderkey, round(o_totalprice / nullif(c_acctbal, 0), 6) AS price_to_balance, round(o_totalprice / 12, 6) AS monthly
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", F.round(C.ratio("o_totalprice", "c_acctbal"), 6).alias("price_to_balance"), F.round(F.col("o_totalprice") / 12, 6).alias("monthly"))


@query("p05_flags", """
SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    flagged = C.flags(t.lineitem.select("l_returnflag", "l_quantity", "l_discount"), {"large": F.col("l_quantity") > 25, "discounted": F.col("l_discount") >= 0.05})
    return flagged.groupBy("l_returnflag").agg(F.sum("large").alias("large"), F.sum("discounted").alias("discounted"))


@query("p06_quantile_flags", """
WITH q AS (SELECT quantile_cont(value, 0.95) AS hi FROM events)
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > hi THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events, q GROUP BY event_type""")
def _(t):
    flagged = C.quantile_flag(t.events.select("event_type", "value"), "value", 0.95, "high")
    return flagged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("high").alias("high"))


@query("p07_weighted_score", "SELECT p_partkey, round(0.6 * p_size / 50 + 0.4 * p_retailprice / 2000, 6) AS score FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(C.weighted((F.col("p_size") / 50, 0.6), (F.col("p_retailprice") / 2000, 0.4)), 6).alias("score"))


@query("p08_point_score", """
SELECT c_custkey, CAST((CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END) + (CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 0 END) + (CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END) AS BIGINT) AS points FROM customer""")
def _(t):
    points = C.points([(F.col("c_acctbal") < 0, 3), (F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 2), (F.col("c_nationkey") < 5, 1)])
    return t.customer.select("c_custkey", points.alias("points"))


@query("p10_case_levels", """
SELECT level, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS level FROM orders) GROUP BY level""")
def _(t):
    level = C.levels("o_totalprice", [(300000, "high"), (100000, "medium")], "low")
    return t.orders.select(level.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("p12_map_values", """
SELECT code, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders) GROUP BY code""")
def _(t):
    return t.orders.select(C.mapped("o_orderstatus", {"O": 1, "F": 2}, 0).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("p13_overwrite_by_mask", "SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 40 THEN 40 ELSE l_quantity END), 2) AS qty FROM lineitem GROUP BY 1")
def _(t):
    out = C.overwrite(t.lineitem.select("l_returnflag", "l_quantity"), "l_quantity", F.col("l_quantity") > 40, F.lit(40.0))
    return out.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("p14_membership", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_acctbal > 0")
def _(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE") & (F.col("c_acctbal") > 0)).select("c_custkey")


@query("p15_conditional_mean_ratio", """
SELECT round(avg(l_extendedprice) FILTER (l_returnflag = 'R') / nullif(avg(l_extendedprice) FILTER (l_returnflag <> 'R'), 0), 6) AS ratio, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem""")
def _(t):
    r = F.col("l_returnflag") == "R"
    ratio = F.try_divide(F.avg(F.when(r, F.col("l_extendedprice"))), F.avg(F.when(~r, F.col("l_extendedprice"))))
    return t.lineitem.agg(F.round(ratio, 6).alias("ratio"), F.round(C.rate(r), 6).alias("rate"))


@query("p17_clip", "SELECT event_id, round(least(greatest(value, 5), 50), 6) AS value FROM events")
def _(t):
    return t.events.select("event_id", F.round(C.clip("value", 5, 50), 6).alias("value"))


@query("p18_row_reductions", "SELECT event_id, round(value + user_id, 6) AS total, round(least(value, user_id), 6) AS low, round(greatest(value, user_id), 6) AS high FROM events")
def _(t):
    return t.events.select("event_id", *[f(["value", "user_id"]) for f in (C.row_sum, C.row_min, C.row_max)]).toDF("event_id", "total", "low", "high").select("event_id", *[F.round(c, 6).alias(c) for c in ("total", "low", "high")])


@query("p20_category_codes", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM customer""")
def _(t):
    return C.category_codes(t.customer, "c_mktsegment", "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@query("p21_ordered_codes", """
SELECT o_orderpriority, CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1 AS BIGINT) AS code, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    codes = C.ordered_codes("o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("code", codes.cast("long"))


@query("p22_stress_scenarios", """
SELECT scenario, round(sum(c_acctbal * (1 + shock)), 4) AS balance FROM customer, (VALUES ('base', 0.0), ('mild', -0.1), ('severe', -0.3)) s(scenario, shock) GROUP BY scenario""")
def _(t):
    stressed = C.stress(t.customer, "c_acctbal", {"base": 0.0, "mild": -0.1, "severe": -0.3})
    return stressed.groupBy("scenario").agg(F.round(F.sum("stressed"), 4).alias("balance"))


@query("p23_duplicate_count", "SELECT count(*) AS n, CAST(count(*) - count(DISTINCT md5(text)) AS BIGINT) AS duplicates FROM documents")
def _(t):
    distinct = t.documents.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return distinct.agg(F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates"))


@query("p24_drop_nulls", "SELECT count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL")
def _(t):
    return t.events.select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")).dropna().agg(F.count(F.lit(1)).alias("n"))


@query("j01_group_stats_join", """
WITH g AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT o_orderkey, round(o_totalprice - m, 4) AS excess FROM orders LEFT JOIN g USING (o_orderpriority)""")
def _(t):
    stats = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return t.orders.join(stats, "o_orderpriority", "left").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("excess"))


@query("j02_two_key_join", """
WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderkey, n, round(o_totalprice / m, 6) AS relative FROM orders LEFT JOIN g USING (o_orderstatus, o_orderpriority)""")
def _(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    stats = t.orders.groupBy(*keys).agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    return t.orders.join(stats, keys, "left").select("o_orderkey", "n", F.round(F.try_divide("o_totalprice", "m"), 6).alias("relative"))


@query("j04_lookup_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    # nation and region are fixed dimensions of 25 and 5 rows
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("j05_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(t):
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey")


@query("j06_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j07_pair_counts", """
WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.p_brand AS brand_a, c.p_brand AS brand_b, count(*) AS n FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.p_brand < c.p_brand GROUP BY 1, 2""")
def _(t):
    from plinth.operators.basket import pair_counts

    baskets = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return pair_counts(baskets, "l_orderkey", "p_brand").toDF("brand_a", "brand_b", "n")


@query("j14_outer_join", """
SELECT coalesce(s.n, c.n) AS nation, s.suppliers, c.customers FROM (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY 1) s
FULL OUTER JOIN (SELECT c_nationkey AS n, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.n = c.n""")
def _(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "nation", "full")


@query("j14_asof_join", """
SELECT a.event_id, b.event_id AS prior_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts > b.ts""")
def _(t):
    from plinth.operators.joins import asof

    e = t.events.select("event_id", "user_id", "ts", "event_type")
    left, right = e.where("event_type = 'purchase'"), e.where("event_type = 'click'")
    return asof(left, right, ["user_id"], "ts", {"prior_id": "event_id"}, strict=True).select("event_id", "prior_id")


@query("j14_range_join", """
SELECT a.event_id, count(b.event_id) AS near FROM events a LEFT JOIN events b ON b.event_id <> a.event_id AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE AND b.event_type = 'purchase'
WHERE a.event_type = 'purchase' GROUP BY 1""")
def _(t):
    from plinth.operators.joins import within

    p = t.events.where("event_type = 'purchase'").select("event_id", "ts")
    pairs = within(p, p.withColumnsRenamed({"event_id": "other", "ts": "ts2"}), "ts", "ts2", 1800).where("event_id <> other")
    return p.join(pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("near")), "event_id", "left").select("event_id", F.coalesce("near", F.lit(0)).alias("near"))


@query("j10_pareto_front", """
SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""")
def _(t):
    from plinth.operators.joins import pareto_front

    return pareto_front(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey")


@query("k01_sort", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(t):
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("k02_top_k", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


@query("k03_best_and_worst_groups", """
WITH m AS (SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS a, row_number() OVER (ORDER BY v, p_brand) AS b FROM m)
SELECT p_brand, round(v, 4) AS v, CASE WHEN a <= 3 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE a <= 3 OR b <= 3""")
def _(t):
    m = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    top, bottom = m.orderBy(F.desc("v"), "p_brand").limit(3).withColumn("side", F.lit("top")), m.orderBy("v", "p_brand").limit(3).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("p_brand", F.round("v", 4).alias("v"), "side")


@query("k04_top_k_per_key", "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("k05_top_abs", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 10")
def _(t):
    return t.customer.orderBy(F.desc(F.abs(F.col("c_acctbal") - 5000)), "c_custkey").limit(10).select("c_custkey")


@query("k06_array_overlap", """
WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS s FROM events GROUP BY 1)
SELECT user_id, CAST(len(list_intersect(s, ['click', 'purchase', 'refund'])) AS BIGINT) AS overlap FROM u""")
def _(t):
    sets = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    liked = F.array(*map(F.lit, ["click", "purchase", "refund"]))
    return sets.select("user_id", F.size(F.array_intersect("s", liked)).cast("long").alias("overlap"))


@query("k08_union_balanced", """
SELECT toxic, count(*) AS n FROM (SELECT toxic FROM labels WHERE toxic = 1 UNION ALL SELECT toxic FROM labels WHERE toxic = 0 AND doc_id % 5 = 0) GROUP BY 1""")
def _(t):
    l = t.labels
    return l.where("toxic = 1").unionByName(l.where("toxic = 0 AND doc_id % 5 = 0")).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("k09_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("k10_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500")
def _(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.where("c_acctbal > 9500").select("c_nationkey"))


@query("k10_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).exceptAll(t.supplier.where("s_acctbal > 5000").select("s_nationkey").distinct())


@query("k13_split")
def _(t):
    train, test = splits.hash_split(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("k13_stratified_split", """
WITH r AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders)
SELECT o_orderstatus, CAST(sum(CASE WHEN i <= floor(0.2 * c) THEN 1 ELSE 0 END) AS BIGINT) AS test, count(*) AS n FROM r GROUP BY 1""")
def _(t):
    marked = splits.stratified(t.orders, "o_orderstatus", ["o_orderkey"], 0.2)
    return marked.groupBy("o_orderstatus").agg(F.sum(F.col("is_test").cast("long")).alias("test"), F.count(F.lit(1)).alias("n"))


@query("k14_chronological_split", """
WITH q AS (SELECT quantile_cont(epoch(o_orderdate), 0.7) AS a, quantile_cont(epoch(o_orderdate), 0.85) AS b FROM orders)
SELECT CASE WHEN epoch(o_orderdate) <= a THEN 'train' WHEN epoch(o_orderdate) <= b THEN 'valid' ELSE 'test' END AS part, count(*) AS n FROM orders, q GROUP BY 1""")
def _(t):
    return splits.chronological(t.orders, "o_orderdate", 0.7, 0.15).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("k15_folds", "SELECT CAST(c_custkey % 5 AS BIGINT) AS fold, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def _(t):
    return splits.modulo_folds(t.customer, "c_custkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("k15_expanding_folds", """
WITH d AS (SELECT o_orderkey, ntile(4) OVER (ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT CAST(f AS BIGINT) AS fold, CAST(sum(CASE WHEN b <= f THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN b = f + 1 THEN 1 ELSE 0 END) AS BIGINT) AS test FROM d, range(1, 4) r(f) GROUP BY 1""")
def _(t):
    return splits.expanding_folds(t.orders, ["o_orderdate", "o_orderkey"], 3)


@query("k16_undersample", """
WITH c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)), r AS (SELECT toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS i FROM labels)
SELECT toxic, count(*) AS n FROM r, c WHERE i <= m GROUP BY 1""")
def _(t):
    return splits.undersample(t.labels, "toxic", ["doc_id"]).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
