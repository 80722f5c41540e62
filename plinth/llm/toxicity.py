"""Toxicity by a classifier chain: linear models in sequence, each fed the earlier ones' probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import CACHE_WORDS, bounded_batches, materialize, utf8_column

#: Labelled documents that the models are fitted on at most, taken in the order of a hash of doc_id.
TRAIN_ROWS = 8000
FOLDS = 3
#: A word becomes a feature when its share differs between the classes by so many standard errors.
MIN_Z, MIN_DOCS = 4.0, 5
THRESHOLD = 0.5
#: Marks cut from the ends of words.
MARKS = ".,;:!?'\"()[]{}<>*#$%&|-_"
#: Lengths of the beginnings of words that count as features of their own, for inflected words.
STEMS = (4, 6, 8)
#: Categories in chain order: name, label column, label value that means yes.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


class WordFeatures(dict):
    """A lower-cased word to the 64-bit hashes of the word, without marks at its ends, and of its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS // 2:
            self.clear()
        plain = word.strip(MARKS)
        value = self[word] = (xxhash.xxh64_intdigest(plain), *(xxhash.xxh64_intdigest(plain[:n], seed=n) for n in STEMS if len(plain) > n))
        return value


_FEATURES = WordFeatures()


def word_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the words of a text and of their beginnings."""
    words = set(text.decode("utf-8", "replace").lower().split()) if text else ()
    found = set().union(*map(_FEATURES.__getitem__, words))
    return np.sort(np.fromiter(found, np.uint64, len(found)))


@dataclass
class Link:
    """One model of the chain: word weights, weights of the earlier probabilities, and a bias."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, sets: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        out = np.full(len(sets), self.bias)
        if before.size:
            out += before @ self.earlier
        if len(self.words):
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            worth = np.where(self.words[at] == flat, self.weights[at], 0.0)
            out += np.bincount(np.repeat(np.arange(len(sets)), sizes), weights=worth, minlength=len(sets))
        return out

    def probability(self, sets: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(sets, before), -40, 40)))


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """A column of probabilities for each category, each model seeing those before it."""
        found = np.empty((len(sets), 0))
        for link in self.links:
            found = np.column_stack([found, link.probability(sets, found)])
        return found


def fit_link(sets: list[np.ndarray], before: np.ndarray, y: np.ndarray, rounds: int = 200) -> Link:
    """Logistic regression with an L2 penalty on chosen words and the earlier probabilities, by Nesterov steps.

    Without both classes the model is a constant.
    """
    k = before.shape[1]
    if not 0 < y.sum() < len(y):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Link(np.empty(0, np.uint64), np.empty(0), np.zeros(k), float(np.log(rate / (1 - rate))))
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    words, column, docs = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    yes = np.bincount(column, weights=y[rows], minlength=len(words))
    rate = y.mean()
    z = (yes - docs * rate) / np.sqrt(np.maximum(docs * rate * (1 - rate), 1e-9))
    chosen = np.flatnonzero((np.abs(z) >= MIN_Z) & (docs >= MIN_DOCS))
    new = np.full(len(words), -1)
    new[chosen] = np.arange(len(chosen))
    kept = new[column] >= 0
    rows, column = rows[kept], new[column][kept]
    m, n = len(chosen), len(sets)
    per_row = np.bincount(rows, minlength=n)
    step = 1 / (0.25 * (per_row.max(initial=0) + k + 1) + 1e-3)
    w, last, t = np.zeros(m + k + 1), np.zeros(m + k + 1), 1.0
    # each coordinate is scaled by the number of its rows, so that rare words move as fast as common ones
    weight = np.concatenate([1.0 / np.maximum(np.bincount(column, minlength=m), 1), np.full(k, 1.0 / n), [1.0 / n]])
    for _ in range(rounds):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + (t - 1) / t_next * (w - last)
        last, t = w, t_next
        logit = np.bincount(rows, weights=v[column], minlength=n) + v[-1] + (before @ v[m : m + k] if k else 0)
        error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y
        gradient = np.concatenate([np.bincount(column, weights=error[rows], minlength=m), before.T @ error if k else [], [error.sum()]])
        gradient[:-1] += 0.1 * v[:-1]
        w = v - 4 * step * weight * gradient
    return Link(words[chosen], w[:m], w[m : m + k], float(w[-1]))


def common_only(sets: list[np.ndarray], least: int = MIN_DOCS, step: int = 400) -> list[np.ndarray]:
    """The sets without the features of fewer than `least` sets, which no model would choose; counted part by part."""
    words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(sets), step):
        part, n = np.unique(np.concatenate(sets[at : at + step]), return_counts=True)
        merged, place = np.unique(np.concatenate([words, part]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(merged)).astype(np.int64)
        words = merged
    kept = words[counts >= least]
    if not len(kept):
        return [s[:0] for s in sets]
    return [s[kept[np.minimum(np.searchsorted(kept, s), len(kept) - 1)] == s] for s in sets]


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: a 0/1 column for each category. Later models learn from out-of-fold probabilities of earlier ones."""
    sets = common_only(sets)
    chain, before = Chain(), np.empty((len(sets), 0))
    fold = np.arange(len(sets)) % folds
    for y in labels.T:
        chain.links.append(fit_link(sets, before, y))
        out = np.zeros(len(sets))
        for i in range(folds):
            inside, outside = np.flatnonzero(fold != i), np.flatnonzero(fold == i)
            if len(outside):
                link = fit_link([sets[j] for j in inside], before[inside], y[inside]) if len(inside) else chain.links[-1]
                out[outside] = link.probability([sets[j] for j in outside], before[outside])
        before = np.column_stack([before, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Chain:
    """A chain from at most `limit` labelled documents; rows with a null label or text are not learned from.

    The ids of the sample, a bounded number, go to the texts, so no text is shuffled. Of repeated rows of a
    document one counts. Without labelled rows all probabilities are 1/2.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    columns = [column for _, column, _ in CATEGORIES]
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna().join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            sets = [word_set(t).tobytes() for t in utf8_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *[batch.column(2 + i).cast(pa.int32()) for i in range(len(columns))]], names=["doc_id", "words", *columns])

    form = "doc_id long, words binary, " + ", ".join(f"{c} int" for c in columns)
    seen = materialize(rows.select("doc_id", "text", *columns).mapInArrow(run, form), "features")
    # partition by partition, so that the driver's JVM never holds the whole sample
    found = {r["doc_id"]: (np.frombuffer(r["words"], np.uint64), [float(r[column] == yes) for _, column, yes in CATEGORIES]) for r in seen.toLocalIterator()}
    ordered = [found[i] for i in sorted(found, key=lambda i: xxhash.xxh64_intdigest(str(i)))]
    table = np.array([y for _, y in ordered]).reshape(len(ordered), len(CATEGORIES))
    return fit_chain([s for s, _ in ordered], table)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a probability p_<category> each and `is_toxic` (the last category reaches the threshold).

    A null or empty text has no words, probability 0 throughout, and is never toxic. Columns of docs with
    these names are replaced. Row by row, without a shuffle.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    names = [f"p_{name}" for name, _, _ in CATEGORIES]
    docs = docs.drop(*names, "is_toxic")
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            sets = [word_set(t) for t in utf8_column(batch, "text")]
            p = shared.value.predict(sets)
            p[[not len(s) for s in sets]] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= threshold)], names=[*kept, *names, "is_toxic"])

    made = [*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("is_toxic", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema, *made]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    whole = docs.select("text", F.struct(*docs.columns).alias("_own"))
    return score(whole, train(docs, labels)).where("NOT is_toxic").select("_own.*")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("is_toxic").alias("toxic"))
