"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import gapless, materialize

#: Partial partitions that one place combines at most; more are combined in levels.
FAN_IN = 4096


def difference(parts: list[tuple[int, ...]]) -> np.ndarray:
    """Combine k-way partial partitions; row i of the result gives the final subset of each of part i's subsets.

    The two partial partitions with the largest spread are merged, the heaviest subsets of one with
    the lightest of the other, until one is left.
    """
    n, k = len(parts), len(parts[0])
    orders: list[list[int]] = []
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: -sums[j])
        orders.append(order)
        ranked = [sums[j] for j in order]
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []
    slots = range(k)
    while len(heap) > 1:
        _, a, heavy = heapq.heappop(heap)
        _, b, light = heapq.heappop(heap)
        both = [x + y for x, y in zip(heavy, reversed(light), strict=True)]
        order = sorted(slots, key=both.__getitem__, reverse=True)
        ranked = [both[j] for j in order]
        merges.append((a, b, order))
        heapq.heappush(heap, (ranked[-1] - ranked[0], n + len(merges) - 1, ranked))
    place: dict[int, list[int]] = {n + len(merges) - 1 if merges else 0: list(slots)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        final = place.pop(n + at)
        left, right = [0] * k, [0] * k
        for slot, j in enumerate(order):
            left[j] = final[slot]
            right[k - 1 - j] = final[slot]
        place[a], place[b] = left, right
    out = np.empty((n, k), dtype=np.int32)
    for i in range(n):
        out[i, orders[i]] = place[i]
    return out


def _leaves(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        zeros = (0,) * (shards - 1)
        final = difference([(int(x), *zeros) for x in pdf["bytes"]])
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "bytes": pdf["bytes"].to_numpy(), "part": pdf["part"].to_numpy(), "subset": final[:, 0]})

    return run


def _levels(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {int(p): tuple(int(x) for x in s) for p, s in zip(pdf["part"], pdf["sums"], strict=True)}
        names = sorted(parts)
        final = difference([parts[p] for p in names])
        upper = int(pdf["upper"].iloc[0])
        return pd.DataFrame([(p, j, upper, int(final[i, j]), parts[p][j]) for i, p in enumerate(names) for j in range(shards)], columns=["part", "subset", "upper", "to", "bytes"])

    return run


def assign_groups(groups: DataFrame, shards: int = 16) -> DataFrame:
    """groups (key, bytes), keys distinct -> (key, shard): shards of near equal bytes, each key whole.

    Keys are dealt to hash buckets of about FAN_IN keys, so their number grows with the keys; each bucket is differenced by itself into one partial partition of
    `shards` sums, and those partial partitions are differenced again, level by level with at most
    FAN_IN at a place, so neither a task nor the driver holds more than a bucket. An empty input gives
    an empty result.
    """
    spark = groups.sparkSession
    width = max(1, -(-groups.count() // FAN_IN))
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(width)).cast("long"))
    leaf = materialize(dealt.groupBy("part").applyInPandas(_leaves(shards), "key string, bytes long, part long, subset int"), "kk")
    steps = []
    sums = leaf.groupBy("part", "subset").agg(F.sum("bytes").alias("bytes"))
    parts = width
    while parts > FAN_IN:
        upper = -(-parts // FAN_IN)
        packed = (
            sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", "bytes"))).alias("m"))
            .select("part", F.pmod(F.xxhash64("part"), F.lit(upper)).alias("upper"), F.array(*[F.coalesce(F.col("m")[j], F.lit(0)) for j in range(shards)]).alias("sums"))
        )
        step = materialize(packed.groupBy("upper").applyInPandas(_levels(shards), "part long, subset int, upper long, to int, bytes long"), "kk")
        steps.append(step.select("part", "subset", "upper", "to"))
        sums = step.groupBy(F.col("upper").alias("part"), F.col("to").alias("subset")).agg(F.sum("bytes").alias("bytes"))
        parts = upper
    table: dict[int, list[int]] = {}
    for row in sums.collect():  # at most FAN_IN * shards rows
        table.setdefault(row["part"], [0] * shards)[row["subset"]] = row["bytes"]
    names = sorted(table)
    final = difference([tuple(table[p]) for p in names]) if names else []
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("subset", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    top = spark.createDataFrame([(p, j, int(final[i][j])) for i, p in enumerate(names) for j in range(shards)], schema)
    for step in reversed(steps):
        top = step.join(top.select(F.col("part").alias("upper"), F.col("subset").alias("to"), "shard"), ["upper", "to"]).select("part", "subset", "shard")
    return leaf.join(F.broadcast(top) if not steps else top, ["part", "subset"]).select("key", "shard")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, shard, slot): equal texts stay together.

    size is the UTF-8 length plus 1, a null text counts as the empty text and groups with it. Repeated
    rows each get a slot. slot runs from 0 without gaps in each shard. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign_groups(groups, shards), "key").drop("key")
    return gapless(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents' rows under path/shard=N; placed comes from shard_documents, doc_id is unique."""
    docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
