"""Profiles, validation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import quality as Q
from plinth.plans.catalog import query


@query("q01_roles", """
SELECT * FROM (VALUES ('event_id', 'numerical'), ('ts', 'datetime'), ('user_id', 'numerical'), ('event_type', 'categorical'), ('value', 'numerical'), ('is_buy', 'binary')) v(column_name, role)""")
def _(t):
    e = t.events.drop("props").withColumn("is_buy", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return t.spark.createDataFrame(list(Q.roles(e).items()), "column_name string, role string")


@query("q02_quality_report", "SELECT count(*) AS n, CAST(count(*) - count(DISTINCT (c_custkey, c_mktsegment)) AS BIGINT) AS duplicates, count(*) FILTER (isinf(c_acctbal)) AS infinite, count(DISTINCT c_mktsegment) AS segments FROM customer")
def _(t):
    d = t.customer.groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.abs("c_acctbal") == float("inf")).alias("i"))
    return d.agg(F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates"), F.sum("i").alias("infinite"), F.countDistinct("c_mktsegment").alias("segments"))


@query("q04_task_types", "SELECT * FROM (VALUES ('toxic', 'classification'), ('doc_id', 'regression')) v(target, task)")
def _(t):
    return t.spark.createDataFrame([(c, Q.task_type(t.labels, c)) for c in ("toxic", "doc_id")], "target string, task string")


@query("q06_issues", "SELECT 'info' AS severity, 'missing' AS category, 'v' AS column_name, CAST(count(*) AS VARCHAR) AS n FROM events WHERE event_id % 97 = 0 UNION ALL SELECT 'warning', 'constant', 'c', NULL")
def _(t):
    e = t.events.select("event_id", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("v"), F.lit(1).alias("c"))
    return Q.issues(e).select("severity", "category", "column_name", F.try_element_at("details", F.lit("missing_count")).alias("n"))


@query("q14_schema_check", "SELECT * FROM (SELECT 'column value outside [0, 50]: ' || count(*) || ' rows' AS error FROM events WHERE value < 0 OR value > 50) UNION ALL SELECT 'missing column nope'")
def _(t):
    errors = Q.check_schema(t.events, {"event_id": "int", "value": "float", "nope": "int"}, {"value": (0, 50)})
    return t.spark.createDataFrame([(e,) for e in errors], "error string")


@query("x01_math", "SELECT event_id, round(sqrt(value), 6) AS a, round(ln(1 + value), 6) AS b, round(sin(value), 6) AS c, CAST(sign(value - 10) AS DOUBLE) AS d, CAST(floor(value) AS BIGINT) AS e, round(exp(-value / 100), 6) AS f FROM events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(F.sqrt(v), 6).alias("a"), F.round(F.log1p(v), 6).alias("b"), F.round(F.sin(v), 6).alias("c"), F.signum(v - 10).alias("d"), F.floor(v).alias("e"), F.round(F.exp(-v / 100), 6).alias("f"))


@query("x03_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(week(o_orderdate) AS INTEGER) AS week, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month"), F.weekofyear(d).alias("week"), F.date_format(F.date_trunc("quarter", d), "yyyy-MM-dd").alias("quarter"), F.datediff(d, F.lit("1995-01-01")).alias("days"))


@query("x05_strings", "SELECT p_partkey, upper(p_type) AS a, length(p_name) AS b, p_brand || '-' || p_size AS c, substr(p_name, 1, 3) AS d, replace(p_type, ' ', '_') AS e FROM part")
def _(t):
    return t.part.select("p_partkey", F.upper("p_type").alias("a"), F.length("p_name").cast("long").alias("b"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("c"), F.substring("p_name", 1, 3).alias("d"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("e"))


@query("x06_regex", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(len(regexp_extract_all(html, '<[a-zA-Z]+')) AS INTEGER) AS tags FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<[a-zA-Z]+"), 0)).alias("tags"))


@query("x09_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("x12_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, round(CAST(list_max(embedding) AS DOUBLE), 5) AS top, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at FROM embeddings")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"), F.round(F.array_max("embedding").cast("double"), 5).alias("top"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("at"))


@query("x13_entropy", "WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM g) SELECT source, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY 1")
def _(t):
    from pyspark.sql.window import Window

    g = t.documents.groupBy("source", "lang").count()
    s = g.select("source", (F.col("count") / F.sum("count").over(Window.partitionBy("source"))).alias("p"))
    return s.groupBy("source").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))
