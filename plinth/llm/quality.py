"""Quality rules from counts and from divergence to language references, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import materialize

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be as with by at from this are".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
LANGUAGES = list(COMMON_WORDS)
EVERY_WORD = sorted({x for words in COMMON_WORDS.values() for x in words})
#: White space between words, and symbols counted.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOL = "[#*$%&|<>]+"
#: Character classes, each of the characters that no earlier one has; the last takes what is left.
CLASSES = {"lower": "[a-z]+", "space": SPACE, "upper": "[A-Z]+", "digit": "[0-9]+", "punct": "[.,;:!?'\"()\\-]+", "beyond_ascii": "[^\\x00-\\x7F]+", "symbol": None}
#: Below MIN_WORDS words a text is too short for a histogram to say anything; from LONG_WORDS it can say more.
MIN_WORDS, LONG_WORDS = 50, 100
#: Share of symbols over which a text does not count towards the references.
MAX_REFERENCE_SYMBOLS = 0.01
#: Distances, 0 to 1, over which a text counts as unlike every language reference.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_SHORT_DISTANCE = 0.175, 0.30, 0.30


#: Columns that the rules add.
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _where(df: DataFrame, test: Column) -> DataFrame:
    """df.where(test), not pushed below the projections that make what the test reads.

    Pushed down, a filter computes its counts anew for each use. The partition's number, never below 0,
    counts as not deterministic, and a filter stays above a column made with it.
    """
    return df.withColumn("_test", test & (F.spark_partition_id() >= 0)).where("_test").drop("_test")


def words_of(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, by sorting the windows' hashes with their places."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, j: F.coalesce(F.least(F.get(starts, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def starts(ranked: Column) -> Column:
        same = lambda e, other: F.coalesce(other["h"] == e["h"], F.lit(False))
        hit = F.filter(ranked, lambda e, j: F.when(j > 0, same(e, F.get(ranked, j - 1))).otherwise(False) | same(e, F.get(ranked, j + 1)))
        return F.sort_array(F.transform(hit, lambda e: e["i"]))

    def counted(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(_let(ranked, starts), covered))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(_let(words, windows), counted))


def histograms(docs: DataFrame) -> DataFrame:
    """Adds _text, _words, n_words, _classes (characters in each of CLASSES) and _common (uses of each of EVERY_WORD).

    A null text counts as none. Common words are counted as written in lower case.
    """
    out = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumns({"_words": words_of(F.col("_text")), "_rest": F.col("_text")})
    counts = []
    for name, pattern in CLASSES.items():
        if pattern is None:
            counts.append(F.length("_rest"))
            break
        out = out.withColumn("_less", F.regexp_replace("_rest", pattern, "")).withColumn(f"_n_{name}", F.length("_rest") - F.length("_less")).withColumn("_rest", F.col("_less"))
        counts.append(F.col(f"_n_{name}"))
    out = out.withColumn("_classes", F.array(*[c.cast("long") for c in counts])).drop("_rest", "_less", *[f"_n_{name}" for name in CLASSES])
    known = F.filter("_words", lambda w: w.isin(EVERY_WORD))
    uses = _let(known, lambda k: F.transform(F.array(*map(F.lit, EVERY_WORD)), lambda x: F.size(k) - F.size(F.array_remove(k, x))))
    return out.withColumns({"_common": uses, "n_words": F.size("_words").cast("long")})


def features(docs: DataFrame) -> DataFrame:
    """Adds the base counts, _classes and _common; columns of docs with the names of MADE are replaced."""
    out = histograms(docs.drop(*MADE))
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    out = out.withColumn("_lines", lines).withColumns(
        {
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOL, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        }
    )
    return out.drop("_text", "_words", "_lines")


def references(counted: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Class and common-word shares of each language over all its documents of MIN_WORDS words or more and few symbols.

    counted has lang and the columns of histograms(). Grouping is by the languages of COMMON_WORDS alone, so
    at most four rows reach the driver; a language without documents has no reference.
    """
    symbol, chars = F.get("_classes", F.lit(len(CLASSES) - 1)), F.aggregate("_classes", F.lit(0).cast("long"), lambda s, x: s + x)
    usable = F.col("lang").isin(LANGUAGES) & (F.col("n_words") >= MIN_WORDS) & (symbol <= MAX_REFERENCE_SYMBOLS * chars)
    rows = _where(counted.select("lang", "n_words", "_classes", "_common"), usable)
    classes = [F.sum(F.get("_classes", F.lit(i))) for i in range(len(CLASSES))]
    common = [F.sum(F.get("_common", F.lit(i))) for i in range(len(EVERY_WORD))]
    found = {}
    for r in rows.groupBy("lang").agg(F.sum("n_words").alias("n"), F.array(*classes).alias("classes"), F.array(*common).alias("common")).collect():
        listed = [r["common"][EVERY_WORD.index(x)] / r["n"] for x in COMMON_WORDS[r["lang"]]]
        found[r["lang"]] = {"classes": [c / sum(r["classes"]) for c in r["classes"]], "words": [*listed, max(0.0, 1 - sum(listed))]}
    return found


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance with base 2, 0 to 1, between an array of shares and a list of them."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), lambda p, q: term(p, q) + term(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(counted: DataFrame, found: dict[str, dict[str, list[float]]]) -> DataFrame:
    """features() -> adds base_failed, class_distance, word_distance (to the nearest reference, null without one), kept.

    A text is kept unless base_failed, or it is long enough and a distance is over its bound. Null and empty
    texts have all counts 0 and are base_failed. Works row by row, without a shuffle.
    """
    n = F.col("n_words")
    chars, total = F.greatest(F.aggregate("_classes", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1)), F.greatest(n, F.lit(1))
    out = counted.withColumn("_shares", _let(chars, lambda c: F.transform("_classes", lambda x: x / c)))
    by_class, by_word = [F.lit(None).cast("double")] * 2, [F.lit(None).cast("double")] * 2
    for lang, reference in sorted(found.items()):
        listed = F.array(*[F.get("_common", F.lit(EVERY_WORD.index(x))) / total for x in COMMON_WORDS[lang]])
        whole = _let(listed, lambda u: F.array_append(u, 1 - F.aggregate(u, F.lit(0.0), lambda s, x: s + x)))
        by_class.append(js_distance(F.col("_shares"), reference["classes"]))
        by_word.append(js_distance(whole, reference["words"]))
    out = out.withColumns({"class_distance": F.least(*by_class), "word_distance": F.least(*by_word), "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)})
    unlike = (n >= LONG_WORDS) & ((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE))
    unlike |= (n >= MIN_WORDS) & (F.col("class_distance") > MAX_SHORT_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(unlike, F.lit(False))).drop("_classes", "_common", "_shares")


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id and the columns of MADE, against references learned from all of docs.

    The texts are read once: the counts are kept, and references and verdicts come from them.
    """
    counted = materialize(features(docs.select("doc_id", "text", "lang")).drop("text"), "counts")
    return judge(counted, references(counted)).select("doc_id", *MADE)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns; the texts are read twice, and never shuffled."""
    rows = docs.select("*", F.struct(*docs.columns).alias("_own"))
    judged = judge(features(rows), references(histograms(docs.select("text", "lang"))))
    return _where(judged, F.col("kept")).select("_own.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
