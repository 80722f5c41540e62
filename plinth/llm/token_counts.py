"""Token counts by greedy longest match, from a linear automaton that never builds the pieces."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import CACHE_WORDS, bounded_batches, utf8_column

VOCABULARY = "piece_bpe_32k.model"
#: Fixed value: the mark that a word starts with in the vocabulary.
START = "▁"


class Automaton:
    """A trie of pieces with failure links; each link knows how many pieces are popped on the way.

    Greedy longest match cuts a word from the left into the longest piece each time. While the trie can go on,
    nothing is decided; where it can't, the failure link of the node leads to the node for what is left of the
    text read, after the pieces that greedy matching is by then sure of. So each character is read once.
    `mark` is what pieces inside a word begin with ("##" in some vocabularies, here none).
    """

    def __init__(self, vocabulary, mark: str = ""):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]

        def add(text: str) -> int:
            node = 0
            for ch in text:
                child = self.next[node].get(ch)
                if child is None:
                    child = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            return node

        for piece in vocabulary:
            if piece and piece != mark:
                ends[add(piece)] = True
        self.inside = add(mark)
        self.fail: list[int] = [-1] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        queue = deque([0] if self.inside == 0 else [0, self.inside])
        seen = set(queue)
        while queue:
            node = queue.popleft()
            for ch, child in self.next[node].items():
                if child in seen:
                    continue
                if ends[child]:
                    self.fail[child], self.pops[child] = self.inside, 1
                else:
                    back, popped = self.fail[node], self.pops[node]
                    while back != -1 and ch not in self.next[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back != -1:
                        self.fail[child], self.pops[child] = self.next[back][ch], popped
                seen.add(child)
                queue.append(child)

    def count(self, word: str) -> int | None:
        """Pieces of a word, or None where greedy matching gets stuck."""
        node, n = 0, 0
        following, fail, pops = self.next, self.fail, self.pops
        for ch in word:
            child = following[node].get(ch)
            while child is None:
                if fail[node] == -1:
                    return None
                n += pops[node]
                node = fail[node]
                child = following[node].get(ch)
            node = child
        while node != self.inside and node != 0:
            if fail[node] == -1:
                return None
            n += pops[node]
            node = fail[node]
        return n


class WordCounts(dict):
    """Word bytes to pieces; characters that the vocabulary lacks count as the bytes that stand for them."""

    def __init__(self, automaton: Automaton, alphabet: set[str], start: str = START):
        self.automaton, self.alphabet, self.start = automaton, alphabet, start

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n, part = 0, self.start
        for ch in word.decode("utf-8", "replace"):
            if ch in self.alphabet:
                part += ch
                continue
            n += (self.automaton.count(part) or 0) + len(ch.encode("utf-8", "replace"))
            part = ""
        value = self[word] = n + (self.automaton.count(part) or 0)
        return value


_counts: dict[str, WordCounts] = {}


def word_counts(name: str) -> WordCounts:
    """The automaton of a public vocabulary in which every character is a piece too, built once in a worker."""
    if name not in _counts:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        usable = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _counts[name] = WordCounts(Automaton(usable), {p for p in usable if len(p) == 1})
    return _counts[name]


def count_tokens(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """docs (text) -> docs with n_words, n_pieces and max_pieces (of a word), as long; null and empty texts have 0.

    Words are runs of bytes other than space and 0x09-0x0D. Columns of these names are replaced. Row by row.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    made = ["n_words", "n_pieces", "max_pieces"]
    docs = docs.drop(*made)
    kept = docs.columns

    def run(batches):
        of = word_counts(name).__getitem__
        for batch in batches:
            rows = []
            for text in utf8_column(batch, "text"):
                counts = list(map(of, text.split())) if text else []
                rows.append((len(counts), sum(counts), max(counts, default=0)))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*kept, *made])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in made]]))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
