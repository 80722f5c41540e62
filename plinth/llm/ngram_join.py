"""Exact Jaccard self-join of word n-gram sets, and the groups that its links form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.llm.common import HASHES, SLICES, Marked, bounded_batches, gathered, lower_words, materialize, release, shuffle_width, utf8_column
from plinth.llm.graph import components

#: Rows and columns of the frequency sketch, a fixed 8 MB; it only orders shingles, so it cannot lose a link.
SKETCH_ROWS, SKETCH_BITS = 2, 20
#: Sets in a block of an index list. Lists of one block are compared within; longer ones by relation first.
BLOCK = 32
#: Lists of shingles seen more often than this are dealt over places of about so many rows.
SALT_ABOVE = 50_000
#: Rows of a list that a task holds while the list's other rows pass by.
HELD_ROWS = 1024
#: Candidates in other groups that a set tries, round by round; None: all that are left.
TRIES = (2, 8, 32, 128, 512, None)
#: Shingles and pairs of a group of candidates that a task verifies at a place; larger groups are dealt over several.
PLACE_SHINGLES, PLACE_PAIRS = 2_000_000, 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word windows; fewer than k words are one window, none are none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    h = HASHES.of(words)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out)


def least_overlap(n, m, percent: int):
    """Shared shingles that sets of n and m need for percent of their union; numbers or arrays."""
    return -(-percent * (n + m) // (100 + percent))


def most_apart(n, m, percent: int):
    """Shingles in one set only that linked sets of n and m can have at most; numbers or arrays."""
    return n + m - 2 * least_overlap(n, m, percent)


def parities(s: np.ndarray) -> bytes:
    """A bit map of a set, of twice to four times its size: each bit is the parity of the shingles that fall there.

    Bits in which two maps differ are at most the shingles in one set only, so maps far apart rule a link out.
    """
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bit maps folded to `width` bytes."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each pair of bit maps the least number of shingles in one set only."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(left), np.int64)
    for a, b in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes[:, 0] == a) & (sizes[:, 1] == b))
        step = max(1, 4_000_000 // int(a + b))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            x, y = (np.frombuffer(b"".join(side[i] for i in part), np.uint8).reshape(len(part), n) for side, n in ((left, a), (right, b)))
            width = min(a, b)
            out[part] = np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum(axis=1, dtype=np.int64)
    return out


def _cells(sets: np.ndarray) -> list[np.ndarray]:
    """The sketch column of each shingle in each row of the sketch."""
    width = np.uint64(64 - SKETCH_BITS)
    return [sets >> width, (sets * np.uint64(0xC2B2AE3D27D4EB4F)) >> width]


def _describe(k: int):
    """Per document its set's size, fingerprint and bit map; per task, at its end, its part of the sketch in slices."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "fp_hi", "fp_lo", "map", "slice", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            rows, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_column(batch, "text"), strict=True):
                s = shingles(text, k)
                d = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                rows.append((doc_id, len(s), (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), parities(s) if len(s) else None, None, None))
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    _count(sketch, held)
                    held, size = [], 0
            _count(sketch, held)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        flat = np.minimum(sketch.ravel(), np.iinfo(np.int32).max).astype("<i4").reshape(SLICES, -1)
        for i in range(SLICES):
            if flat[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, None, i, flat[i].tobytes()), types, strict=True)], names=names)

    return run


def _count(sketch: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        for row, cells in zip(sketch, _cells(np.concatenate(held)), strict=True):
            row += np.bincount(cells.astype(np.int64), minlength=row.size)


def _add_slices(batches):
    """Add the tasks' slices up, a running sum for each slice."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, "<i4").astype(np.int64)
            total[i] = total[i] + part if i in total else part
    for i, sums in total.items():
        raw = np.minimum(sums, np.iinfo(np.int32).max).astype("<i4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([raw], pa.binary())], names=["slice", "counts"])


def _picked(batch, at: np.ndarray) -> list[bytes | None]:
    """The texts at some places of a batch (id, text)."""
    import pyarrow as pa

    return utf8_column(pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at))], names=["text"]), "text")


def _postings(k: int, percent: int, sketch, marked: Marked, salt_above: int):
    """(token, salt, order, p, n, doc): the shingles of a document's prefix, rarest first, and their positions."""

    def run(batches):
        import pyarrow as pa

        counts = sketch.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = marked.passed(ids)
            found = []
            for doc, text in zip(ids[at].tolist(), _picked(batch, at), strict=True):
                s = shingles(text, k)
                if not len(s):
                    continue
                seen = np.minimum(*(row[c.astype(np.int64)] for row, c in zip(counts, _cells(s), strict=True)))
                first = len(s) + (-percent * len(s)) // 100 + 1
                order = np.lexsort((s, seen))[:first]
                h = xxhash.xxh64_intdigest(str(doc)) >> 1
                places = seen[order].astype(np.int64) // max(1, salt_above) + 1
                salt = np.where(places > 1, 1 + h % places, 0)
                found.append((s[order].view(np.int64), salt.astype(np.int32), np.full(first, h, np.int64), np.arange(first, dtype=np.int32), np.full(first, len(s), np.int32), np.full(first, doc, np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["token", "salt", "h", "p", "n", "doc"])

    return run


def _fits(n, p, m, q, percent: int):
    """Whether sets of n and m that share the shingle at their positions p and q, and none before, can link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= least_overlap(n, m, percent))


def _index(percent: int, block: int):
    """Walk index lists and emit candidates: rows (kind, a, b, leader, n, p).

    A list within one block is compared throughout: kind 0 (a, b). A longer list is first related to one set,
    the one of the lowest hash, which lists with like members share: kind 0 with that leader, and kind 1
    (token, document) for what is left open. Kind 2 gives the leaders of salted lists' places.
    """

    def run(batches):
        import pyarrow as pa

        form = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("leader", pa.int64()), ("n", pa.int32()), ("p", pa.int32())])

        def table(kind, a, b, leader, n, p):
            size = len(a)
            wide = lambda x, t: np.broadcast_to(np.asarray(x, t), size)
            columns = (wide(kind, np.int32), a, b, wide(leader, np.int64), wide(n, np.int32), wide(p, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(columns, form, strict=True)], schema=form)

        def walk(token, salt, p, n, doc):
            start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
            size = np.diff(np.append(start, len(token)))
            length = np.repeat(size, size)
            run_of = np.repeat(np.arange(len(start)), size)
            firsts, seconds = [], []
            rows = np.flatnonzero((length > 1) & (length <= block))
            for k in range(1, block):
                rows = rows[(rows + k < len(token))]
                rows = rows[run_of[rows + k] == run_of[rows]] if len(rows) else rows
                if not len(rows):
                    break
                other = rows + k
                good = _fits(n[rows], p[rows], n[other], p[other], percent) & (doc[rows] != doc[other])
                firsts.append(rows[good])
                seconds.append(other[good])
            for at, count in zip(start[size > block].tolist(), size[size > block].tolist(), strict=True):
                part = np.arange(at, at + count)
                good = part[_fits(n[part], p[part], n[at], p[at], percent) & (doc[part] != doc[at])]
                firsts.append(np.full(len(good), at))
                seconds.append(good)
                yield table(1, token[part], doc[part], doc[at], n[part], p[part])
            salted = np.flatnonzero(salt[start])
            if len(salted):
                at = start[salted]
                yield table(2, token[at], doc[at], 0, n[at], p[at])
                short = np.flatnonzero((length <= block) & (salt > 0))
                yield table(1, token[short], doc[short], doc[start[run_of[short]]], n[short], p[short])
            if firsts:
                a, b = doc[np.concatenate(firsts)], doc[np.concatenate(seconds)]
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield table(0, both[0], both[1], 0, 0, 0)

        held = None
        for batch in gathered(batches, 200_000):
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield from walk(*[c[:cut] for c in columns])
        if held is not None:
            yield from walk(*held)

    return run


def _prune(percent: int):
    """Whether the bit maps of a pair are near enough for a link, as the least number of shingles apart, else -1 - that."""

    def test(s: pd.Series, t: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        found = apart(list(s), list(t))
        return pd.Series(np.where(found <= most_apart(n.to_numpy(), m.to_numpy(), percent), found, -1 - found))

    return F.pandas_udf(test, "long")


def _verify(k: int):
    """Rows (comp, part, kind, a, b, text) by place: texts (kind 0), then pairs (kind 1) -> (a, b, n, m, common)."""

    def run(batches):
        import pyarrow as pa

        place, sets, found = None, {}, []
        for batch in batches:
            texts = utf8_column(batch, "text")
            for i, (comp, part, kind, a, b) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True)):
                if (comp, part) != place:
                    place, sets = (comp, part), {}
                if kind == 0:
                    sets[a] = shingles(texts[i], k)
                elif a in sets and b in sets:
                    u, v = sets[a], sets[b]
                    found.append((a, b, len(u), len(v), len(np.intersect1d(u, v, assume_unique=True))))
            if len(found) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "n", "m", "common"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "n", "m", "common"])

    return run


def _near_texts(marked: Marked):
    """(doc, text) of the documents that pass the filter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = marked.passed(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), batch.column(1).take(pa.array(at)).cast(pa.string())], names=["doc", "text"])

    return run


def _answers(docs: DataFrame, pairs: DataFrame, described: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b) -> (a, b, low, high): bounds of the shingles in one set only, and `linked`; high is null where unverified.

    Bit maps rule most pairs out. Of the others each text goes once to the place of its group of candidates,
    where the pairs are counted on whole sets; a group too large for one place is dealt by one side.
    """
    spark = docs.sparkSession
    maps = described.select(F.col("doc_id").alias("doc"), "n", "map")
    both = pairs.join(maps.toDF("a", "n", "s"), "a").join(maps.toDF("b", "m", "t"), "b")
    tested = materialize(both.select("a", "b", "n", "m", _prune(percent)("s", "t", "n", "m").alias("low")).dropDuplicates(["a", "b"]), "tested")
    near = tested.where("low >= 0")
    groups = components(near)
    docs_of = near.select(F.col("a").alias("doc"), "n").unionByName(near.select(F.col("b").alias("doc"), F.col("m").alias("n"))).distinct()
    weights = docs_of.join(groups.toDF("doc", "comp"), "doc").groupBy("comp").agg(F.ceil(F.sum("n") / PLACE_SHINGLES).alias("parts"))
    named = near.join(groups.toDF("b", "comp"), "b")
    crowds = named.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / PLACE_PAIRS).alias("crowds"))
    dealt = named.join(weights, "comp").join(crowds, "comp").select("a", "b", "comp", F.pmod(F.xxhash64("b"), F.greatest("parts", "crowds")).alias("part"))
    dealt = materialize(dealt, "dealt")
    places = dealt.select("comp", "part", F.explode(F.array("a", "b")).alias("doc")).distinct()
    marked = Marked(docs_of.select("doc"))
    texts = docs.mapInArrow(_near_texts(marked), "doc long, text string")
    rows = places.join(texts, "doc").select("comp", "part", F.lit(0).alias("kind"), F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(dealt.select("comp", "part", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))
    ordered = rows.repartition(shuffle_width(spark), "comp", "part").sortWithinPartitions("comp", "part", "kind")
    counted = ordered.mapInArrow(_verify(k), "a long, b long, n long, m long, common long")
    high = F.col("n") + F.col("m") - 2 * F.col("common")
    exact = counted.select("a", "b", high.alias("low"), high.alias("high"), (F.col("common") * (100 + percent) >= percent * (F.col("n") + F.col("m"))).alias("linked"))
    far = tested.where("low < 0").select("a", "b", (-1 - F.col("low")).alias("low"), F.lit(None).cast("long").alias("high"), F.lit(False).alias("linked"))
    out = materialize(exact.unionByName(far), "answers")
    release(tested, dealt)
    return out


def _open(percent: int, block: int, cap: int | None):
    """Rows of lists by (token, place): those held (kind 0), then all (kind 1) -> candidates (held, other, near, more).

    A pair counts when its sets are in different groups. The held rows stand in blocks by size and position;
    a block whose best position leaves too few shingles for a passing row is skipped whole. What is known of
    both sets' distances to their common leader then gives the pair's answer where it can: the distances' sum
    bounds the pair's own from above (near -1: a link), their difference from below. Bit maps decide the most
    of the rest. A held set gives its `cap` nearest candidates, and says if there are more.
    """

    def run(batches):
        import pyarrow as pa

        def nearest(found):
            """Columns held, other, near, more with the nearest `cap` of each held set, each once."""
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            at = np.lexsort((columns[1], columns[2], columns[0]))
            held, other, near, more = (c[at] for c in columns)
            new = np.concatenate([[True], (held[1:] != held[:-1]) | (other[1:] != other[:-1])])
            held, other, near, more = held[new], other[new], near[new], np.maximum.reduceat(more, np.flatnonzero(new))
            start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            size = np.diff(np.append(start, len(held)))
            rank = np.arange(len(held)) - np.repeat(start, size)
            more = np.repeat(np.maximum.reduceat(more | (rank >= cap), start), size)
            return [c[rank < cap] for c in (held, other, near, more)]

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["held", "other", "near", "more"])

        def order(held):
            at = np.lexsort((held["p"], held["n"]))
            held = {x: [v[i] for i in at] if x == "map" else v[at] for x, v in held.items()}
            held["start"] = start = np.arange(0, len(at), block)
            held["least"], held["most"] = np.minimum.reduceat(held["n"], start), np.maximum.reduceat(held["n"], start)
            held["first"] = np.minimum.reduceat(held["p"], start)
            return held

        def meet(held, rows):
            n, p = rows["n"][:, None], rows["p"][:, None]
            low, high = np.maximum(held["least"], -(-percent * n // 100)), np.minimum(held["most"], 100 * n // percent)
            # the best partner in a block is its smallest possible set for the need, its largest and earliest for the supply
            need = least_overlap(n, low, percent)
            skip = (low > high) | (n - p < need) | (high - held["first"] < need)
            at, of = np.nonzero(~skip)
            if not len(at):
                return
            sizes = np.minimum(block, len(held["n"]) - held["start"][of])
            i = np.repeat(at, sizes)
            j = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(held["start"][of], sizes)
            x, y = {c: v[i] for c, v in rows.items() if c != "map"}, {c: held[c][j] for c in ("doc", "n", "p", "g", "leader", "low", "high")}
            good = (x["g"] != y["g"]) & (x["top"] | (x["doc"] > y["doc"])) & _fits(x["n"], x["p"], y["n"], y["p"], percent)
            limit = most_apart(x["n"], y["n"], percent)
            same = x["leader"] == y["leader"]
            good &= ~(same & (x["high"] >= 0) & (y["low"] - x["high"] > limit)) & ~(same & (y["high"] >= 0) & (x["low"] - y["high"] > limit))
            i, j, limit = i[good], j[good], limit[good]
            if not len(i):
                return
            x, y, same = {c: v[good] for c, v in x.items()}, {c: v[good] for c, v in y.items()}, same[good]
            sure = same & (x["high"] >= 0) & (y["high"] >= 0) & (x["high"] + y["high"] <= limit)
            far = apart([rows["map"][a] for a in i.tolist()], [held["map"][b] for b in j.tolist()])
            near = far <= limit
            if near.any():
                yield y["doc"][near], x["doc"][near], np.where(sure, -1, far)[near], np.zeros(near.sum(), bool)

        key, waiting, held, found = None, [], None, []
        names = ("doc", "n", "p", "g", "leader", "low", "high", "top")
        for batch in gathered(batches, 2000):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            columns = {c: batch.column(3 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            maps = batch.column(3 + len(names)).to_pylist()
            change = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])]))
            for at, end in zip(change.tolist(), np.append(change[1:], len(kind)).tolist(), strict=True):
                rows = {c: v[at:end] for c, v in columns.items()}
                rows["map"] = maps[at:end]
                if tuple(keys[:, at]) != key:
                    key, waiting, held = tuple(keys[:, at]), [], None
                if kind[at] == 0:
                    waiting.append(rows)
                    continue
                if held is None and waiting:
                    held = order({c: sum((w[c] for w in waiting), []) if c == "map" else np.concatenate([w[c] for w in waiting]) for c in rows})
                if held is not None:
                    for part in range(0, end - at, 256):
                        found.extend(meet(held, {c: v[part : part + 256] for c, v in rows.items()}))
            if sum(len(f[0]) for f in found) > 200_000:
                if cap:
                    found = [nearest(found)]
                if not cap or len(found[0][0]) > 100_000:
                    yield emit(found)
                    found = []
        if found:
            yield emit([nearest(found)] if cap else found)

    return run


def ngram_groups(docs: DataFrame, k: int = 5, percent: int = 80, salt_above: int = SALT_ABOVE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id) by exact Jaccard links of word k-gram sets.

    Two documents link when the shared shingles are at least `percent` of the union; component_id is the
    smallest doc_id that links reach. Equal sets are one class from the start. Shingles are ordered from
    rare to common by a fixed-size sketch, and the order only has to be the same everywhere, so its
    errors cost time, never links. Index lists hold prefixes; lists longer than a block are related to one
    leading set first. Where that leaves a list in several groups, the pairs between its groups are walked
    by blocks of positions, and their answers derived from those of the leading set as far as they follow.

    Null or empty texts have no shingles and link with nothing; other columns are ignored; a repeated
    doc_id gives a row each time. A row with a null doc_id is in the group of texts equal to its own, if
    any, else its component_id is null. No rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = described = materialize(docs.mapInArrow(_describe(k), "doc_id long, n long, fp_hi long, fp_lo long, map binary, slice int, counts binary"), "described")
    slices = described.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add_slices, "slice int, counts binary").collect()
    sketch = np.zeros((SLICES, (SKETCH_ROWS << SKETCH_BITS) // SLICES), np.int32)
    for row in slices:  # 64 rows, 8 MB whatever the input
        sketch[row["slice"]] = np.frombuffer(row["counts"], "<i4")
    sketch = spark.sparkContext.broadcast(sketch.reshape(SKETCH_ROWS, -1))

    sizes = described.where("slice is null").select("doc_id", "n", "fp_hi", "fp_lo")
    copies = sizes.where("n > 0").groupBy("fp_hi", "fp_lo", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    rep = F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).alias("rep")
    members = sizes.join(copies, ["fp_hi", "fp_lo", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), rep)
    members = materialize(members, "members")
    # copies that slip through the filter are sets like others, so they cost work and change nothing
    marked = Marked(members.where("rep = doc_id").select("rep"))

    docs = docs.where("doc_id IS NOT NULL")
    described = described.where("doc_id IS NOT NULL AND n > 0")
    made = [table]
    walked = _candidates(docs, k, percent, sketch, marked, salt_above, made)
    groups = components(_links(docs, described, walked, k, percent, made))
    release(*made)
    found = members.join(groups.toDF("rep", "component"), "rep", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _candidates(docs: DataFrame, k: int, percent: int, sketch, marked: Marked, salt_above: int, made: list) -> DataFrame:
    """The rows that the walk along the index lists gives; places of a salted list are related by their leaders."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    form = "kind int, a long, b long, leader long, n int, p int"
    postings = docs.mapInArrow(_postings(k, percent, sketch, marked, salt_above), "token long, salt int, h long, p int, n int, doc long")
    lists = postings.repartition(width, "token", "salt").sortWithinPartitions("token", "salt", "h", "doc").select("token", "salt", "p", "n", "doc")
    walked = materialize(lists.mapInArrow(_index(percent, BLOCK), form), "walked")
    made.append(walked)
    heads = walked.where("kind = 2").select(F.col("a").alias("token"), F.lit(0).alias("salt"), "p", "n", F.col("b").alias("doc"))
    heads = heads.repartition(width, "token").sortWithinPartitions("token", F.xxhash64("doc")).mapInArrow(_index(percent, BLOCK), form).where("kind = 0")
    return walked.where("kind < 2").unionByName(heads)


def _links(docs: DataFrame, described: DataFrame, walked: DataFrame, k: int, percent: int, made: list) -> DataFrame:
    """The links that decide the groups, (a, b): those of short lists and leaders, then those between groups.

    One link between two groups is enough, so each set first tries its nearest candidates in other groups, then,
    where groups are still apart, more of them, at last all.
    """
    pairs = materialize(walked.where("kind = 0").select("a", "b").distinct(), "pairs")
    answers = _answers(docs, pairs, described, k, percent)
    longer = materialize(walked.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("doc"), "leader", "n", "p"), "longer")
    made += [pairs, answers, longer]
    for cap in TRIES:
        links = answers.where("linked").select("a", "b")
        met = _between(longer, answers, components(links), described, percent, cap)
        made.append(met)
        rest = met.where("near >= 0").select(F.least("held", "other").alias("a"), F.greatest("held", "other").alias("b")).distinct()
        rest = materialize(rest.join(answers.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        sure = met.where("near < 0").select(F.least("held", "other").alias("a"), F.greatest("held", "other").alias("b"), "near", F.lit(None).cast("long"), F.lit(True))
        more = _answers(docs, rest, described, k, percent) if rest.limit(1).count() else rest.selectExpr("a", "b", "0L", "0L", "false")
        made += [rest, more] if hasattr(more, "_written_to") else [rest]
        answers = answers.unionAll(more).unionAll(sure.distinct())
        if not met.where("more").limit(1).count():
            break
    return answers.where("linked").select("a", "b")


def _between(longer: DataFrame, answers: DataFrame, groups: DataFrame, described: DataFrame, percent: int, cap: int | None) -> DataFrame:
    """Candidates between different groups of a long list: (held, other, near, more), at most cap for each held set."""
    spark = longer.sparkSession
    known = materialize(longer.join(groups.toDF("doc", "g"), "doc", "left").withColumn("g", F.coalesce("g", "doc")), "known")
    counts = known.groupBy("token", "g").agg(F.count(F.lit(1)).alias("c"))
    lists = counts.groupBy("token").agg(F.max(F.struct("c", "g")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    lists = lists.select("token", F.col("top.g").alias("best"), F.ceil((F.col("all") - F.col("top.c")) / HELD_ROWS).cast("int").alias("places"))
    mixed = known.join(lists, "token").withColumn("a", F.least("leader", "doc")).withColumn("b", F.greatest("leader", "doc"))
    of_leader = F.col("doc") == F.col("leader")
    bounds = answers.where("low >= 0").groupBy("a", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    mixed = mixed.join(bounds, ["a", "b"], "left").join(described.select(F.col("doc_id").alias("doc"), "map"), "doc")
    low, high = F.when(of_leader, 0).otherwise(F.coalesce("low", F.lit(0))), F.when(of_leader, 0).otherwise(F.coalesce("high", F.lit(-1)))
    columns = ["doc", "n", "p", "g", "leader", low.cast("long").alias("low"), high.cast("long").alias("high"), (F.col("g") == F.col("best")).alias("top"), "map"]
    mixed = materialize(mixed.select("token", "places", *columns), "mixed")
    held = mixed.where("NOT top").select("token", F.pmod(F.xxhash64("doc"), "places").cast("int").alias("place"), F.lit(0).alias("kind"), *mixed.columns[2:])
    passing = mixed.select("token", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(1).alias("kind"), *mixed.columns[2:])
    dealt = held.unionByName(passing).repartition(shuffle_width(spark), "token", "place").sortWithinPartitions("token", "place", "kind")
    met = dealt.mapInArrow(_open(percent, BLOCK, cap), "held long, other long, near long, more boolean")
    met = met.groupBy("held", "other").agg(F.min("near").alias("near"), F.max("more").alias("more"))
    if cap:
        of_set = Window.partitionBy("held")
        met = met.withColumn("more", F.max("more").over(of_set) | (F.count(F.lit(1)).over(of_set) > cap)).withColumn("_rank", F.row_number().over(of_set.orderBy("near", "other"))).where(F.col("_rank") <= cap).drop("_rank")
    met = materialize(met, "open")
    release(known, mixed)
    return met


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each group, with its own columns.

    Documents without shingles are in no group and stay. Of rows with one doc_id, one stays; all rows with a null
    doc_id stay.
    """
    grouped = ngram_groups(docs, k, percent).select("doc_id", "component_id")
    later = materialize(grouped.where("doc_id != component_id").select("doc_id").distinct(), "later")
    kept = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL")) if repeated else kept


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
