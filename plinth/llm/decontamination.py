"""Benchmark decontamination on templates and on literal words: typed placeholders, window joins and slot consistency."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import CACHE_WORDS, Marked, bounded_batches, materialize, utf8_column

#: Tokens of a window, and how many of a template's must not be placeholders.
WINDOW, MIN_PLAIN = 8, 4
#: Tokens of an item that an aligned, consistent match must cover; shorter items must be covered whole.
MIN_RUN = 13
#: Items of fewer words are matched literally only; as templates they would be too common to tell.
MIN_TEMPLATE = 5
#: Window hashes that are sent to all tasks to skip windows early; with more, a filter of fixed size is sent.
MAX_FILTER = 2_000_000
#: Number words and units that become placeholders.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()
UNITS = "mm cm m km mg g kg lb lbs oz ml l mph kmh km/h s sec min mins minute minutes hour hours day days week weeks month months year years inch inches foot feet mile miles meter meters dollar dollars euro euros cent cents percent % $ € £ degrees".split()
_NUMBER = re.compile(r"[$€£+\-(]*\d[\d.,:/\-]*(?:st|nd|rd|th|%|[a-z]{1,3})?\)?")
_MARKS = ".,;:!?'\"()[]{}"
#: A type is the two low bits of a word's hash, 0 for plain words; a placeholder's hash is its type.
NUM, UNIT, NAME = 1, 2, 3
TYPE = np.uint64(3)


class Canonical(dict):
    """A word to 62 bits of its case-folded form's hash and, in the two low bits, its type."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = word.strip(_MARKS) or word
        low = plain.lower()
        if low in NUMBER_WORDS or _NUMBER.fullmatch(low):
            value = NUM
        elif low in UNITS:
            value = UNIT
        elif len(plain) > 1 and plain[0].isupper() and plain[1:].islower():
            value = NAME
        else:
            value = 0
        value |= max(4, xxhash.xxh64_intdigest(plain.casefold()) & ~3)
        self[word] = value
        return value


_CANONICAL = Canonical()


def template(text: str) -> tuple[list[str], np.ndarray]:
    """The words of a text and their hashes with types."""
    words = text.split()
    return words, np.fromiter(map(_CANONICAL.__getitem__, words), np.uint64, len(words))


def windows(tokens: np.ndarray, width: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows: of all as case-folded words, of those with enough plain tokens as templates; a text shorter than width has none."""
    n = len(tokens) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = tokens & TYPE
    hashes = tokens & ~TYPE if literal else np.where(kind > 0, kind, tokens)
    h = np.full(n, width + 64 * literal, np.uint64)
    plain = np.zeros(n, np.int32)
    for j in range(width):
        part = hashes[j : j + n]
        plain += kind[j : j + n] == 0
        h ^= h >> np.uint64(31)
        h = (h + part) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(plain >= (0 if literal else min(MIN_PLAIN, width)))
    return at, h[at].view(np.int64)


def _slots(words: list[str], tokens: np.ndarray, start: int, width: int) -> list[str]:
    """type:value of each placeholder of a window."""
    return [f"{t}:{words[start + j].strip(_MARKS).lower()}" for j, t in enumerate((tokens[start : start + width] & TYPE).tolist()) if t]


def _windowed(known, width: int, of_items: bool):
    """Rows (id, at, hash, slots, n) of a text's windows; known: what window hashes may match, or None for all.

    A document's literal windows have no slots of their own: their values are those of the item that they meet.
    """

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32()]
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), utf8_column(batch, "text"), strict=True):
                words, tokens = template((raw or b"").decode("utf-8", "replace"))
                for literal in (True,) if width < MIN_TEMPLATE else (False, True):
                    at, hashes = windows(tokens, width, literal)
                    if known is not None and len(at):
                        near = known.passed(hashes)
                        at, hashes = at[near], hashes[near]
                    rows += [(key, p, h, _slots(words, tokens, p, width) if of_items or not literal else None, len(words)) for p, h in zip(at.tolist(), hashes.tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "at", "hash", "slots", "n"])

    return run


class Known:
    """The window hashes of items, for tasks, up to MAX_FILTER of them; the interface of Marked."""

    def __init__(self, spark, hashes: np.ndarray):
        self.hashes = spark.sparkContext.broadcast(np.sort(hashes))

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        known = self.hashes.value
        return np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)


def _count_words(batches):
    """(n): the words of each text, cut as everywhere here."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len((raw or b"").decode("utf-8", "replace").split()) for raw in utf8_column(batch, "text")], pa.int32())], names=["n"])


def _covered(places: list[tuple[int, list[str], list[str]]], n: int, width: int) -> int:
    """The longest stretch of an item that aligned windows cover while each slot value keeps one counterpart.

    places: (place in the item, its slots, the document's slots), in order. A value has one counterpart
    throughout, and two names have two, while different numbers may become the same; a window that breaks
    the mapping so far ends the stretch and begins the next.
    """
    best = run = 0
    end = -1
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    for at, ours, theirs in places:
        pairs = list(zip(ours, theirs, strict=True))
        named = [(a, b) for a, b in pairs if a[0] == "3"]
        fits = all(forth.get(a, b) == b for a, b in pairs) and all(back.get(b, a) == a for a, b in named)
        inner = dict(pairs)
        sound = all(inner[a] == b for a, b in pairs) and len({b for _, b in named}) == len({a for a, _ in named})
        if not sound:
            end = -1
            continue
        if end < at or not fits:
            run, forth, back = width, {}, {}
        else:
            run += at + width - end
        forth.update(pairs)
        back.update((b, a) for a, b in named)
        end = at + width
        best = max(best, run)
    return min(best, n)


def _longest(places: list[tuple[int, list[str], list[str]]], n: int, width: int) -> int:
    """The longer of the stretches of all windows and of those with equal slots, which no other window may break."""
    return max(_covered(places, n, width), _covered([p for p in places if p[1] == p[2]], n, width))


def matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, min_run: int = MIN_RUN, max_filter: int = MAX_FILTER) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (doc_id, item_id, covered, item_words) of contaminated pairs.

    Windows of both sides meet in a join on the hash of the template and on that of the case-folded words, so
    copies are found whatever their case; rows of a document, item and offset, at most twice an item's length,
    are then put in order and checked for consistent slots. Items shorter than a window are
    matched in windows of their own length, those under MIN_TEMPLATE words literally. Null and empty texts match
    nothing. A document with repeated rows gives one result; rows without a doc_id are one document here.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    form = "id long, at int, hash long, slots array<string>, n int"
    found = None
    lengths = {width} | {r["n"] for r in items.select("text").mapInArrow(_count_words, "n int").where(F.col("n").between(1, width - 1)).distinct().collect()}
    for length in sorted(lengths):  # at most `width` lengths
        of_items = items.mapInArrow(_windowed(None, length, True), form).dropDuplicates(["id", "at", "hash"])
        if length < width:
            of_items = of_items.where(F.col("n") == length)
        of_items = materialize(of_items, "windows")
        count = of_items.count()
        if not count:
            continue
        distinct = of_items.select("hash").distinct()
        known = Known(spark, np.array([r["hash"] for r in distinct.collect()], np.int64)) if count <= max_filter else Marked(distinct)
        of_docs = docs.mapInArrow(_windowed(known, length, False), form)
        met = of_docs.alias("d").join(of_items.alias("i"), F.col("d.hash") == F.col("i.hash"))
        met = met.select(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), (F.col("d.at") - F.col("i.at")).alias("shift"), F.col("i.n").alias("item_words"), F.struct(F.col("i.at"), F.col("i.slots").alias("ours"), F.coalesce("d.slots", "i.slots").alias("theirs")).alias("w"))
        found = met if found is None else found.unionByName(met)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("covered", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
    if found is None:
        return spark.createDataFrame([], schema)

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            table = [batch.column(i).to_pylist() for i in range(4)]
            covered = [_longest([(w["at"], w["ours"], w["theirs"]) for w in ws], n, min(width, n)) for n, ws in zip(table[2], table[3], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covered, pa.int32()), batch.column(2)], names=schema.names)

    aligned = found.groupBy("doc_id", "item_id", "shift", "item_words").agg(F.array_sort(F.collect_set("w")).alias("ws")).select("doc_id", "item_id", "item_words", "ws")
    checked = aligned.mapInArrow(check, schema)
    hit = checked.where(F.col("covered") >= F.least(F.lit(min_run), F.col("item_words")))
    return hit.groupBy("doc_id", "item_id", "item_words").agg(F.max("covered").alias("covered")).select(*schema.names)


def _own_key() -> Column:
    """What tells rows apart when doc_id is null or repeated: a hash of the id and the text."""
    return F.xxhash64("doc_id", "text")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a contaminated pair, with their own columns.

    Each row is judged by its own text, also where doc_id is null or repeated.
    """
    bad = matches(docs.select(_own_key().alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_leak")).distinct()
    bad = materialize(bad, "leaks")
    return docs.join(bad, _own_key() == F.col("_leak"), "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document: the items that it holds, and whether it is contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", _own_key().alias("_key"))
    pairs = matches(docs.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    per_doc = pairs.groupBy(F.col("doc_id").alias("_key")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"))
    out = docs.select("doc_id", "_key").join(per_doc, "_key", "left")
    return out.select("doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("covered", F.lit(0)).alias("covered"), F.col("covered").isNotNull().alias("contaminated"))
