"""Packing of token sequences: greedy matching of large pieces, best fit of small ones."""

from __future__ import annotations

import re
import threading

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import bounded_batches, gapless, materialize, utf8_column

CAPACITY = 2048
END_ID = 0

_state = threading.local()
#: Characters on which the fast and the reference tokenizer are tested to agree; others use the latter.
_COMMON = re.compile(r"[^\x00-\u024f\u2010-\u2027]")


def _encoders(name: str):
    """The fast encoder and the reference one for a public byte-level vocabulary, once per worker."""
    cached = getattr(_state, "encoders", None)
    if cached is None or cached[0] != name:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        cached = _state.encoders = (name, fast, lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
    return cached[1], cached[2]


def encode(text: str, name: str = "byte_bpe_50k") -> list[int]:
    """The ids that tokenizers gives with add_special_tokens=False, by the faster library where both agree."""
    fast, slow = _encoders(name)
    if text.isascii() or not _COMMON.search(text):
        return fast.encode(text, allowed_special="all")
    reference = getattr(_state, "reference", None)
    if reference is None:
        reference = _state.reference = slow()
    return reference.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full pieces, after a first one that may be shorter."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, piece, start, length, ids (little-endian uint32 bytes).

    A null or empty text is the end id alone. Only texts longer than capacity are cut. Repeated rows are
    packed as often as they occur; other columns are ignored.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_column(batch, "text"), strict=True):
                ids = encode(text.decode("utf-8", "replace"), vocabulary) if text else []
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4").tobytes()
                rows += [(doc_id, k, s, n, raw[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack a histogram of lengths; the bins come out as runs (length, first rank, first bin, per bin, offset).

    The items of a length with ranks first.. fill `per bin` places at `offset` in consecutive bins. Lengths
    above a third of the capacity are matched greedily, largest with the largest that fits, two a bin;
    then smaller lengths, largest first, go to the fullest bin with room. Work is per class of equal bins,
    so it does not grow with the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    third = capacity // 3
    open_bins: dict[int, list[tuple[tuple, int]]] = {}
    mask = 0

    def put(gap: int, bins: tuple, count: int) -> None:
        nonlocal mask
        if count:
            open_bins.setdefault(gap, []).append((bins, count))
            mask |= 1 << gap

    def take(length: int) -> tuple[int, tuple, int] | None:
        nonlocal mask
        above = mask >> length
        if not above:
            return None
        gap = length + (above & -above).bit_length() - 1
        bins, count = open_bins[gap].pop()
        if not open_bins[gap]:
            mask &= ~(1 << gap)
        return gap, bins, count

    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left.get(n, 0):
            partner = next((m for m in large if m <= min(n, capacity - n) and left.get(m, 0) > (m == n)), None)
            if partner is None:
                pairs, bins, gap = left[n], ((n, 1),), capacity - n
                left[n] = 0
            elif partner == n:
                pairs, bins, gap = left[n] // 2, ((n, 2),), capacity - 2 * n
                left[n] -= 2 * pairs
            else:
                pairs, bins, gap = min(left[n], left[partner]), ((n, 1), (partner, 1)), capacity - n - partner
                left[n] -= pairs
                left[partner] -= pairs
            put(gap, bins, pairs)
    for n in sorted((n for n in left if n <= third), reverse=True):
        todo = left[n]
        while todo:
            gap, bins, count = take(n) or (capacity, (), todo)
            fit = gap // n
            full = min(count, todo // fit)
            put(gap - fit * n, (*bins, (n, fit)), full)
            todo -= full * fit
            count -= full
            if todo and count:
                some = min(todo, fit)
                put(gap - some * n, (*bins, (n, some)), 1)
                todo -= some
                count -= 1
            if bins:
                put(gap, bins, count)
    runs, bin_id, used = [], 0, dict.fromkeys(left, 0)
    for gap in sorted(open_bins):
        for bins, count in open_bins[gap]:
            offset = 0
            for n, fit in bins:
                runs.append((n, used[n], bin_id, fit, offset))
                used[n] += fit * count
                offset += n * fit
            bin_id += count
    return runs


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """pieces with a length column of 1..capacity -> the same rows with sequence_id and offset.

    Only the histogram of lengths, at most `capacity` rows, reaches the driver; a piece then finds its
    place by its rank among pieces of its length. The pieces are read twice, so pass durable rows.
    `order` must identify a piece up to equal rows. No rows give no rows.
    """
    order = order or ["doc_id", "piece"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    runs = np.array(sorted(plan_bins(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    keys = runs[:, 0] * (1 << 48) + runs[:, 1]
    ranked = gapless(pieces, "length", order, "_rank")
    kept = [f.name for f in pieces.schema]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            _, first, bin_id, fit, offset = runs[at].T
            step, place = np.divmod(rank - first, fit)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bin_id + step), pa.array(offset + place * length)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "_rank").mapInArrow(run, T.StructType([*pieces.schema, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack documents; one row a piece with its digest and place."""
    pieces = token_pieces(docs, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    pieces = materialize(pieces, "pieces")
    packed = best_fit(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed ids themselves: sequence_id, ids (array<int>), doc_ids in place order; a sequence is at most capacity ids."""
    pieces = materialize(token_pieces(docs, capacity), "pieces")
    packed = best_fit(pieces, capacity, ["doc_id", "piece", "start", "ids"])
    def unpack(ids: pd.Series) -> pd.Series:
        return ids.map(lambda raw: np.frombuffer(raw, "<u4").astype(np.int32))

    to_array = F.pandas_udf(unpack, "array<int>")
    placed = packed.select("sequence_id", F.struct("offset", "doc_id", to_array("ids").alias("ids")).alias("at"))
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return ordered.select("sequence_id", F.flatten(F.col("at.ids")).alias("ids"), F.col("at.doc_id").alias("doc_ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
