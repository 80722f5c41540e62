"""Ordered computations within a key: lags, rolling frames, smoothing, ranks, deciles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plinth.operators.order import numbered, tile


def rolling(fn, column, w: WindowSpec, size: int, full: bool = True, shift: int = 0) -> Column:
    """fn over the last `size` rows (before the last `shift`); null until the frame is full, unless full is False."""
    frame = w.rowsBetween(-(size - 1) - shift, -shift)
    value = fn(column).over(frame)
    return F.when(F.count(column).over(frame) == size, value) if full else value


def change(column: str, w: WindowSpec, k: int = 1) -> Column:
    """x / x[-k] - 1; null where the earlier value is 0."""
    return F.try_divide(F.col(column), F.lag(column, k).over(w)) - 1


def slope(column: str, w: WindowSpec, size: int) -> Column:
    """Least-squares slope over the last `size` rows, their places being 0, 1, ..."""
    frame = w.rowsBetween(-(size - 1), 0)
    values = F.collect_list(F.col(column)).over(frame)
    mean = (size - 1) / 2
    below = sum((i - mean) ** 2 for i in range(size))
    above = F.aggregate(F.transform(values, lambda x, i: x * (i - mean)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.count(column).over(frame) == size, above / below)


def exponential(column: str, w: WindowSpec, alpha: float, adjusted: bool = True) -> Column:
    """Exponential mean up to the current row: weights (1-alpha)^i normalised, or the recursion from the first value."""
    far = math.ceil(math.log(1e-18) / math.log(1 - alpha))  # rows further back weigh less than a double can tell
    values = F.collect_list(F.col(column)).over(w.rowsBetween(-far, 0))
    if adjusted:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
        step = lambda a, x: F.struct((a["s"] * (1 - alpha) + x).alias("s"), (a["n"] * (1 - alpha) + 1).alias("n"))
        return F.aggregate(values, start, step, lambda a: a["s"] / a["n"])
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda a, x: a + alpha * (x - a))


def drawdown(column: str, w: WindowSpec) -> Column:
    """Fall from the highest value so far, as a share of it."""
    top = F.max(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(F.col(column) - top, top)


def rank_bucket(rank: Column, n: Column, q: int) -> Column:
    """Quantile bucket 1..q of a first-come rank from 1, by equal-count edges."""
    return F.greatest(F.lit(1), F.ceil(F.try_divide((rank - 1) * q, n - 1))).cast("long")


def rfm(df: DataFrame, customer: str, day: str, amount: str, order: str) -> DataFrame:
    """Recency (days before the last day of all), frequency and money of each customer, scored 1 to 5 by rank.

    The ranks run over customers, one row each; ties go by customer.
    """
    last = df.agg(F.max(day).alias("_last"))
    g = df.groupBy(customer).agg(F.max(day).alias("_d"), F.count(F.lit(1)).alias("frequency"), F.sum(amount).alias("monetary"))
    g = g.join(F.broadcast(last)).withColumn("recency", F.datediff("_last", "_d").cast("long")).drop("_last", "_d")
    for out, by in (("r_score", F.desc("recency")), ("f_score", F.asc("frequency")), ("m_score", F.asc("monetary"))):
        g = numbered(g, [by, F.asc(customer)], out)
    n = F.lit(g.count())
    return g.withColumns({c: rank_bucket(F.col(c), n, 5) for c in ("r_score", "f_score", "m_score")})


def rfm_segment() -> Column:
    """Names of customer segments from r_score, f_score and m_score, the first rule that holds."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "New Customers")
        .when((r >= 3) & (f >= 3) & (m <= 2), "Potential Loyalists")
        .when((r <= 2) & (f >= 3) & (m >= 3), "At Risk")
        .when((r <= 2) & (f <= 2) & (m >= 3), "Cannot Lose Them")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Hibernating")
        .otherwise("Others")
    )


def rfm_code() -> Column:
    """The three scores as one string, like 543."""
    return F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])


def rfm_weighted(recency: float = 0.3, frequency: float = 0.3, monetary: float = 0.4) -> Column:
    return F.col("r_score") * recency + F.col("f_score") * frequency + F.col("m_score") * monetary


def deciles(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Lift and gain by score decile, the highest scores in decile 1."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(df.select(label, score, tie), [F.desc(score), F.asc(tie)], "_i").join(F.broadcast(n))
    marked = placed.select(label, tile(F.col("_i"), F.col("_n"), 10).alias("decile"))
    g = marked.groupBy(F.col("decile").cast("long").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"))
    every = Window.partitionBy()
    so_far = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    base = F.sum("positives").over(every) / F.sum("n").over(every)
    return g.withColumns({"lift": F.try_divide(F.col("positives") / F.col("n"), base), "gain": F.try_divide(F.sum("positives").over(so_far), F.sum("positives").over(every))})
