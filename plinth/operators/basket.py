"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Baskets with both items of a pair, a < b. Pairs come from a self-join on the basket, so from its own items only."""
    d = df.select(basket, item).distinct()
    a, b = d.withColumnRenamed(item, "a"), d.withColumnRenamed(item, "b")
    return a.join(b, basket).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def itemsets(df: DataFrame, basket: str, item: str, min_support: float, max_size: int = 3) -> DataFrame:
    """(items, size, n, support) with n >= int(min_support * baskets), level by level.

    Only items that are frequent stay in baskets, and a set grows by items after its last one, so each set of a
    basket comes up once; sets with a rare part are dropped by a semi-join with the level before.
    """
    d = df.select(basket, item).where(F.col(item).isNotNull()).distinct()
    total = d.select(basket).distinct().count()
    least = max(1, int(min_support * total))
    counts = d.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    level = counts.select(F.array(item).alias("items"), "n")
    found = level
    d = d.join(counts.select(item), item, "left_semi")
    held = d.select(basket, F.array(item).alias("items"), F.col(item).alias("last"))
    for _ in range(2, max_size + 1):
        grown = held.join(d, basket).where(F.col(item) > F.col("last")).select(basket, F.array_append("items", F.col(item)).alias("items"), F.col(item).alias("last"))
        level = grown.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        found = found.unionByName(level)
        held = grown.join(level.select("items"), "items", "left_semi")
    return found.select("items", F.size("items").alias("size"), "n", (F.col("n") / F.lit(max(total, 1))).alias("support"))


def rules(sets: DataFrame, min_confidence: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift, conviction) of frequent sets, one item as consequent."""
    parts = sets.where("size > 1").select("items", "support", F.explode("items").alias("consequent")).withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    one = sets.where("size = 1").select(F.col("items")[0].alias("consequent"), F.col("support").alias("sc"))
    joined = parts.join(sets.select(F.col("items").alias("antecedent"), F.col("support").alias("sa")), "antecedent").join(one, "consequent")
    confidence = F.col("support") / F.col("sa")
    out = joined.select("antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / F.col("sc")).alias("lift"), F.try_divide(1 - F.col("sc"), 1 - confidence).alias("conviction"))
    return out.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
