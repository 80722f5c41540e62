"""Helpers shared by the text operators: durable intermediates, gapless ranks, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts per Arrow batch: keeps a worker's memory bounded when documents are long.
BATCH_ROWS = 500
#: Entries after which a worker forgets its word cache.
CACHE_WORDS = 400_000
#: Bits of the filters of ids; they only save work, and are at most 16 MB, sent in so many slices.
LEAST_BITS, MOST_BITS, SLICES = 20, 27, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a temporary folder is set, but only for a local master: on a
    cluster a machine-local folder would lose data, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    found = "file://" + tempfile.mkdtemp(prefix="plinth-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: durable, and without lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plinth/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables made by materialize; only after everything read from them has itself been written."""
    for df in written:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def gapless(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in any order that `order` fixes.

    A group may hold most of the rows, so no task ever sees a whole group: rows are dealt by
    (group, hash bucket), numbered there, and shifted by the count of the buckets before.
    `order` must identify a row up to equal rows.
    """
    buckets = shuffle_width(df.sparkSession)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        dealt.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(inside).cast("long") - 1)
    joined = ranked.join(shift, [group, "_bucket"])
    return joined.withColumn(out, F.col("_shift") + F.col("_row")).drop("_bucket", "_shift", "_row")


class WordHashes(dict):
    """Word bytes to unsigned 64-bit hash, remembered up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def lower_words(text: bytes | None) -> list[bytes]:
    """A-Z lowered; words are runs of bytes other than space and 0x09-0x0D."""
    return text.lower().split() if text else []


def utf8_column(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as Python bytes."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def gathered(batches, rows: int):
    """Arrow batches of small rows put together to about `rows` rows each, for work on whole arrays."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _marks(ids: np.ndarray, bits: int) -> np.ndarray:
    return ((ids.view(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _mark(bits: int):
    """The ids of a task as bits set, in slices."""

    def run(batches):
        import pyarrow as pa

        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[_marks(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        for i, part in enumerate(np.packbits(flags).reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "bits"])

    return run


def _or_slices(batches):
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, np.uint8)
            total[i] = total[i] | part if i in total else part
    for i, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "bits"])


class Marked:
    """A filter of 64-bit ids or hashes for tasks: all that were marked pass, and a few others may."""

    def __init__(self, ids: DataFrame):
        spark = ids.sparkSession
        self.bits = min(MOST_BITS, max(LEAST_BITS, (16 * ids.count()).bit_length()))
        marks = ids.mapInArrow(_mark(self.bits), "slice int, bits binary").repartition(SLICES, "slice").mapInArrow(_or_slices, "slice int, bits binary")
        flags = np.zeros((SLICES, (1 << self.bits) // 8 // SLICES), np.uint8)
        for row in marks.collect():  # 64 rows, 16 MB at most
            flags[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
        self.flags = spark.sparkContext.broadcast(flags.ravel())

    def passed(self, ids: np.ndarray) -> np.ndarray:
        """Places of the ids that pass."""
        at = _marks(ids, self.bits)
        return np.flatnonzero((self.flags.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
