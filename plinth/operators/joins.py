"""Joins that Spark has no operator for: as-of, range, dominance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.sources.tables import durable


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: dict[str, str], strict: bool = False) -> DataFrame:
    """left with the columns `take` (new name: right column) of the last right row at or before its time.

    One union and one window over the keys: the last right row seen so far is carried along, so there is one
    shuffle and no pairing. strict: only rows before. Right rows of the same time: any of the largest values.
    """
    value = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    a = left.select(*keys, F.col(time), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*keys, F.col(time), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value.alias("_v"))
    rank = F.when(F.col("_v").isNull(), 0 if strict else 1).otherwise(1 if strict else 0)
    seen = Window.partitionBy(*keys).orderBy(time, rank).rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(seen))
    return carried.where("_row IS NOT NULL").select("_row.*", *[F.col(f"_last.{n}").alias(n) for n in take])


def within(left: DataFrame, right: DataFrame, a: str, b: str, seconds: int) -> DataFrame:
    """Pairs whose times differ by at most `seconds`: an equi-join on time buckets, then the exact test."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(micros(c) / (seconds * 1_000_000)).cast("long")
    near = F.explode(F.array(*[bucket(a) + i for i in (-1, 0, 1)]))
    pairs = left.withColumn("_bucket", near).join(right.withColumn("_bucket", bucket(b)), "_bucket")
    return pairs.where(F.abs(micros(a) - micros(b)) <= seconds * 1_000_000).drop("_bucket")


def pareto_front(df: DataFrame, most: str, least: str) -> DataFrame:
    """Rows that no other beats in both columns (larger `most`, smaller `least`), ties kept.

    A row survives when its `least` is below every smaller one seen at a larger `most`. Only the best `least`
    of each distinct `most` is compared, range by range, so no task orders the whole table.
    """
    best = durable(df.groupBy(most).agg(F.min(least).alias("_best")).repartitionByRange(F.desc(most)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = best.groupBy("_part").agg(F.min("_best").alias("_low")).select("_part", F.min("_low").over(before).alias("_before"))
    ahead = Window.partitionBy("_part").orderBy(F.desc(most)).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_inside", F.min("_best").over(ahead)).join(F.broadcast(ranges), "_part").withColumn("_ahead", F.least("_inside", "_before"))
    front = best.where("_ahead IS NULL OR _best < _ahead").select(most, "_best")
    return df.join(front, most).where(F.col(least) == F.col("_best")).select(*df.columns)
