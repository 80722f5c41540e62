"""Language identification by unigram piece models that sum over all segmentations of each word."""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import bounded_batches, gathered, utf8_column

VOCABULARY = "piece_bpe_32k.model"
#: Weight of a character that no piece has, and counts added to each piece.
UNKNOWN, SMOOTHING = 1e-7, 0.05
#: Characters from which sums of training are kept as logarithms, and from which a word is scored by itself.
SHORT_WORD, LONG_WORD = 60, 400
#: Words whose scores, and (language, word) pairs whose counts, a worker holds.
HELD_WORDS, HELD_PAIRS = 150_000, 300_000
_LETTER = regex.compile(r"\p{L}")


class Pieces:
    """A fixed public vocabulary: piece to number; words carry the mark of a word's start."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        usable = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.number = {p: k for k, p in enumerate(dict.fromkeys(model.id_to_piece(i) for i in usable))}
        self.size = len(self.number)
        self.longest = max(map(len, self.number))
        self.keys = np.array([self._key(p) for p in self.number], np.uint64)
        # two tables of places by hash; the second one takes the pieces whose place in the first is taken
        self.tables, left = [], np.arange(self.size)
        while len(left):
            table = np.zeros(1 << self.BITS, np.int32)
            at = self._places(self.keys[left], len(self.tables))
            table[at[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[at] != left]

    #: Places of a table of pieces, and the factor of the rolling hash of a piece's characters.
    BITS, BASE = 19, 0x9E3779B97F4A7C15

    def _key(self, piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * self.BASE + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _places(self, keys: np.ndarray, table: int) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * table)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these 64-bit keys, -1 for none."""
        out = np.full(keys.shape, -1, np.int32)
        for i, table in enumerate(self.tables):
            found = table[self._places(keys, i)]
            hit = self.keys[found] == keys
            out[hit] = found[hit]
        return out

    def grid(self, words: list[str], n: int) -> np.ndarray:
        """words of n characters -> [word, end, length-1] piece numbers; size: a lone unknown character; -1: none."""
        longest = min(self.longest, n)
        out = np.full((len(words), n + 1, longest), -1, np.int32)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        keys = codes
        for k in range(1, longest + 1):
            if k > 1:
                keys = keys[:, :-1] * np.uint64(self.BASE) + codes[:, k - 1 :]
            out[:, k:, k - 1] = self._numbers(keys)
        lone = out[:, 1:, 0]
        lone[lone < 0] = self.size
        return out


_pieces: dict[str, Pieces] = {}


def pieces(name: str = VOCABULARY) -> Pieces:
    if name not in _pieces:
        _pieces[name] = Pieces(name)
    return _pieces[name]


def forward(grid: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """grid [word, end, length-1], weights [piece + 1, language] -> log of the sum over segmentations [word, language]."""
    count, ends, longest = grid.shape
    if count == 1 and ends > LONG_WORD:
        return _forward_one(grid[0], weights)
    languages = weights.shape[1]
    alpha = np.zeros((ends, count, languages))
    alpha[0] = 1.0
    scale = np.zeros((count, languages))
    for j in range(1, ends):
        for k in range(1, min(j, longest) + 1):
            numbers = grid[:, j, k - 1]
            has = np.flatnonzero(numbers >= 0)
            if len(has):
                alpha[j, has] += alpha[j - k, has] * weights[numbers[has]]
        recent = alpha[max(0, j - longest + 1) : j + 1]
        top = recent.max(axis=0)
        if (top < 1e-150).any():
            recent /= np.where(top > 0, top, 1)
            scale += np.log(np.where(top > 0, top, 1))
    with np.errstate(divide="ignore"):
        return np.log(alpha[-1]) + scale


def _forward_one(grid: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The same for one long word, [end, length-1], with all pieces of an end at once."""
    ends, longest = grid.shape
    recent = np.zeros((longest, weights.shape[1]))  # row k - 1: the sum up to k characters back
    recent[0] = 1.0
    scale = np.zeros(weights.shape[1])
    for j in range(1, ends):
        has = np.flatnonzero(grid[j, : min(j, longest)] >= 0)
        new = (recent[has] * weights[grid[j, has]]).sum(axis=0)
        recent[1:] = recent[:-1]
        recent[0] = new
        if (new < 1e-150).any():
            top = recent.max(axis=0)
            recent /= np.where(top > 0, top, 1)
            scale += np.log(np.where(top > 0, top, 1))
    with np.errstate(divide="ignore"):
        return (np.log(recent[0]) + scale)[None]


def expected(grid: np.ndarray, weights: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of pieces over all segmentations, by forward and backward sums: (numbers, amounts).

    The sums of longer words are kept as logarithms, so words of any length are looked at whole.
    """
    count, ends, longest = grid.shape
    logs = ends > SHORT_WORD
    nothing, one = (-np.inf, 0.0) if logs else (0.0, 1.0)
    plus, mul = (np.logaddexp, np.add) if logs else (np.add, np.multiply)
    alpha, beta = np.full((ends, count), nothing), np.full((ends, count), nothing)
    alpha[0] = beta[-1] = one
    spans = []  # end, length, the words with a piece there, its number and its weight
    for j in range(1, ends):
        for k in range(1, min(j, longest) + 1):
            has = np.flatnonzero(grid[:, j, k - 1] >= 0)
            if len(has):
                numbers = grid[has, j, k - 1]
                p = np.log(weights[numbers]) if logs else weights[numbers]
                spans.append((j, k, has, numbers, p))
                alpha[j, has] = plus(alpha[j, has], mul(alpha[j - k, has], p))
    amounts = []
    for j, k, has, _, p in reversed(spans):
        # all spans that start at j come before in this order, so beta[j] is whole
        use = mul(mul(alpha[j - k, has], p), beta[j, has])
        amounts.append(np.exp(use - alpha[-1, has]) * times[has] if logs else use / np.maximum(alpha[-1, has], 1e-300) * times[has])
        beta[j - k, has] = plus(beta[j - k, has], mul(beta[j, has], p))
    return np.concatenate([s[3] for s in reversed(spans)]), np.concatenate(amounts)


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _count_words(batches):
    """(lang, word, n), summed over as much of a task as fits."""
    import pyarrow as pa

    counts: Counter = Counter()

    def emit():
        langs, words = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), utf8_column(batch, "text"), strict=True):
            for word, n in Counter(_words(text)).items():
                counts[lang, word] += n
        if len(counts) > HELD_PAIRS:
            yield emit()
            counts.clear()
    if counts:
        yield emit()


def _expect(name: str):
    """(lang, piece, n): expected uses with all pieces alike, summed over a task."""

    def run(batches):
        import pyarrow as pa

        vocabulary = pieces(name)
        # equal weights; each character carries a factor that keeps the sums near one
        base = np.array([32.0 ** len(p) / vocabulary.size for p in vocabulary.number] + [UNKNOWN])
        total: dict[str, np.ndarray] = {}
        for batch in gathered(batches, 40_000):
            groups: dict[tuple[str, int], list[tuple[str, int]]] = {}
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                groups.setdefault((lang, len(word) + 1), []).append(("▁" + word, n))
            for (lang, n), listed in groups.items():
                sums = total.setdefault(lang, np.zeros(vocabulary.size + 1))
                step = max(1, min(4000, 2_000_000 // n))
                for at in range(0, len(listed), step):
                    words, times = zip(*listed[at : at + step], strict=True)
                    numbers, amounts = expected(vocabulary.grid(list(words), n), base, np.array(times, float))
                    sums += np.bincount(numbers, weights=amounts, minlength=len(sums))
        for lang, sums in total.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["lang", "piece", "n"])

    return run


class LanguageModels:
    """Piece probabilities of each language and the log share of its texts."""

    def __init__(self, languages: list[str], weights: np.ndarray, priors: np.ndarray, name: str):
        self.languages, self.weights, self.priors, self.name = languages, weights, priors, name
        self._known: dict[bytes, int] = {}
        self._rows: list[np.ndarray] = []

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_rows": []}

    def score(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """The best language of each text and its posterior; `und` and 0 without a letter or a language."""
        vocabulary = pieces(self.name)
        listed = [_words(t) for t in texts]
        if len(self._known) > HELD_WORDS:
            self._known, self._rows = {}, []
        fresh = set().union(*map(set, listed)) - self._known.keys() if listed else set()
        by_length: dict[int, list[bytes]] = {}
        for w in fresh:
            by_length.setdefault(len(w.decode("utf-8", "replace")) + 1, []).append(w)
        for n, words in by_length.items():
            size = max(1, 2_000_000 // ((n + 1) * max(1, len(self.languages)) * 8))
            for at in range(0, len(words), size):
                part = words[at : at + size]
                scores = forward(vocabulary.grid(["▁" + w.decode("utf-8", "replace") for w in part], n), self.weights)
                self._known.update(zip(part, range(len(self._known), len(self._known) + len(part)), strict=True))
                self._rows.append(scores)
        if len(self._rows) > 1:
            self._rows = [np.vstack(self._rows)]
        out = []
        for text, words in zip(texts, listed, strict=True):
            if not words or not self.languages or not _LETTER.search(text.decode("utf-8", "replace")):
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
            total = self._rows[0][at].sum(axis=0) + self.priors
            total = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.languages[best], float(total[best] / total.sum())))
        return out


def train(docs: DataFrame, name: str = VOCABULARY) -> LanguageModels:
    """docs (lang, text) -> models of all languages, from every text with a language.

    Words are counted by language first, so each distinct word is segmented once. What reaches the driver is
    at most a number for each piece and language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    uses = counted.mapInArrow(_expect(name), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(shares)
    size = pieces(name).size
    weights = np.full((size + 1, len(languages)), SMOOTHING)
    place = {x: i for i, x in enumerate(languages)}
    for r in uses:
        if r["piece"] < size:
            weights[r["piece"], place[r["lang"]]] += r["n"]
    weights[size] = 0
    weights /= np.maximum(weights.sum(axis=0, keepdims=True), 1e-300)
    weights[size] = UNKNOWN
    priors = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values()))) if languages else np.empty(0)
    return LanguageModels(languages, weights, priors, name)


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced. Row by row.

    Null texts and texts without a letter (Unicode category L) are `und`; equal scores go to the first language by
    name; repeated rows and rows with a null doc_id get their result like others.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = docs.columns

    def run(batches):
        for batch in batches:
            found = shared.value.score(utf8_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    models = train(docs.where("NOT held_out").select("lang", "text"))
    return identify(docs.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "lang_pred", "score")
