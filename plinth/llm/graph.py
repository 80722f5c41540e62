"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import materialize, release

#: Edges that one task contracts in memory at most.
EDGES_PER_TASK = 500_000


def _contract(batches):
    """Union-find over one partition's edges; each vertex comes out with its smallest known partner."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(v: int) -> int:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    names = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([root(v) for v in names], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """edges (a, b) of longs, not null -> (v, component): the smallest vertex that each vertex reaches.

    Edges are contracted partition by partition, with at most about per_task edges in a partition, and
    then rewired in rounds of large-star and small-star until nothing changes. When all edges fit in one
    partition, the first contraction is already the answer. No edges give no rows; self-loops and
    repeated edges are harmless.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    while True:
        n = edges.count()
        parts = -(-n // per_task) or 1
        dealt = edges.repartition(parts) if parts == 1 else edges.repartition(parts, F.xxhash64("b"))
        stars = materialize(dealt.mapInArrow(_contract, "a long, b long").where("a != b"), "stars")
        release(edges)
        if parts == 1:
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a != b").distinct(), "large")
        release(stars)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        small = materialize(small.where("a != b").distinct(), "small")
        release(large)
        loose = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        edges = small
        if not loose and not chained:
            stars = small
            break
    leaves = stars.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return leaves.unionByName(stars.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
