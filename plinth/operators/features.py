"""Fitted feature operators: fit() reads a table in one aggregation, the fitted object rewrites columns of any table."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.order import quantiles


@dataclass
class Fitted:
    """Column expressions by output name, and columns to leave out. Small, explicit, and the same on any table."""

    outputs: dict[str, Column]
    drop: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.outputs).drop(*self.drop)


def _one(df: DataFrame, aggregates: dict[str, Column]):
    return df.agg(*[c.alias(n) for n, c in aggregates.items()]).first().asDict()


def standard(df: DataFrame, columns: list[str]) -> Fitted:
    """(x - mean) / population deviation; a constant column becomes 0."""
    s = _one(df, {f"{k}{c}": f(c) for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    return Fitted({c: (F.col(c) - F.lit(s[f"m{c}"])) / F.lit(s[f"s{c}"] or 1.0) for c in columns})


def minmax(df: DataFrame, columns: list[str]) -> Fitted:
    s = _one(df, {f"{k}{c}": f(c).cast("double") for c in columns for k, f in (("a", F.min), ("b", F.max))})
    return Fitted({c: (F.col(c) - F.lit(s[f"a{c}"])) / F.lit((s[f"b{c}"] - s[f"a{c}"]) or 1.0) for c in columns})


def robust(df: DataFrame, columns: list[str]) -> Fitted:
    """(x - median) / (q75 - q25), exact quantiles."""
    s = quantiles(df, dict.fromkeys(columns, [0.25, 0.5, 0.75]))
    return Fitted({c: (F.col(c) - F.lit(s[c][1])) / F.lit((s[c][2] - s[c][0]) or 1.0) for c in columns})


def quantile_uniform(df: DataFrame, columns: list[str], steps: int = 100) -> Fitted:
    """Place of a value among fitted quantiles, interpolated, 0 to 1."""
    grid = [i / steps for i in range(steps + 1)]
    s = quantiles(df, dict.fromkeys(columns, grid))

    def place(c: str) -> Column:
        edges = F.array(*map(F.lit, s[c]))
        at = F.size(F.filter(edges, lambda e: e <= F.col(c)))
        low, high = F.get(edges, at - 1), F.get(edges, at)
        inside = (at - 1 + F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))) / steps
        return F.when(at == 0, 0.0).when(at > steps, 1.0).otherwise(inside)

    return Fitted({c: place(c) for c in columns})


def choose_scaler(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Per column: robust over 10 % outliers, none within [0, 1], quantile with |skew| > 2, else standard."""
    q = quantiles(df, dict.fromkeys(columns, [0.25, 0.75]))
    out = {}
    tests = {}
    for c in columns:
        a, b = q[c]
        span = 1.5 * (b - a)
        tests |= {f"o{c}": F.avg(F.when((F.col(c) < a - span) | (F.col(c) > b + span), 1.0).otherwise(0.0)), f"a{c}": F.min(c), f"b{c}": F.max(c), f"k{c}": F.skewness(c)}
    s = _one(df, tests)
    for c in columns:
        if s[f"o{c}"] > 0.1:
            out[c] = "robust"
        elif s[f"a{c}"] >= 0 and s[f"b{c}"] <= 1:
            out[c] = "none"
        else:
            out[c] = "quantile" if abs(s[f"k{c}"] or 0) > 2 else "standard"
    return out


def auto_scale(df: DataFrame, columns: list[str]) -> Fitted:
    chosen = choose_scaler(df, columns)
    out = {}
    for kind, fit in (("robust", robust), ("quantile", quantile_uniform), ("standard", standard)):
        if named := [c for c in columns if chosen[c] == kind]:
            out |= fit(df, named).outputs
    return Fitted(out)


def unit_rows(columns: list[str]) -> Fitted:
    """Rows scaled to length 1; a zero row stays zero."""
    squares = [F.col(c) * F.col(c) for c in columns]
    norm = F.sqrt(sum(squares[1:], squares[0]))
    return Fitted({c: F.coalesce(F.try_divide(F.col(c), norm), F.lit(0.0)) for c in columns})


#: Distinct values that a column may have to be encoded value by value; more raise an error.
MAX_VALUES = 10_000


def _values(df: DataFrame, column: str) -> list:
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_VALUES + 1).collect()
    if len(found) > MAX_VALUES:
        raise ValueError(f"{column} has more than {MAX_VALUES} values; use target, frequency or hash encoding")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, column: str, drop_first: bool = False) -> Fitted:
    """A 0/1 column for each fitted value; unknown values are all zeros. For columns of few values."""
    values = _values(df, column)[1 if drop_first else 0 :]
    return Fitted({f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in values}, [column])


def label(df: DataFrame, column: str, out: str | None = None) -> Fitted:
    """Codes in sorted order; unknown values get -1."""
    values = F.array(*map(F.lit, _values(df, column)))
    return Fitted({out or column: F.array_position(values, F.col(column)) - 1})


def target(df: DataFrame, column: str, y: str, smoothing: float = 0.0, unseen: float | None = None) -> DataFrame:
    """(value, code): the mean of y, pulled to the global mean by `smoothing` rows. A table, to be joined."""
    base = _one(df, {"m": F.avg(y)})["m"]
    g = df.groupBy(column).agg(F.avg(y).alias("_m"), F.count(y).alias("_n"))
    return g.select(column, ((F.col("_m") * F.col("_n") + base * smoothing) / (F.col("_n") + smoothing)).alias("code"))


def target_encode(df: DataFrame, codes: DataFrame, column: str, unseen: float = 0.0) -> DataFrame:
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(unseen)))


def target_encode_folds(df: DataFrame, fold: str, column: str, y: str, unseen: float = 0.0) -> DataFrame:
    """df with code: the mean of y over rows of the same value in all other folds, so no row sees its own y."""
    parts = df.groupBy(fold, column).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    every = Window.partitionBy(column)
    codes = parts.select(fold, column, F.try_divide(F.sum("_s").over(every) - F.col("_s"), F.sum("_n").over(every) - F.col("_n")).alias("code"))
    return df.join(codes, [fold, column], "left").withColumn("code", F.coalesce("code", F.lit(unseen)))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, count), to be joined."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))


def hash_buckets(column: str, buckets: int = 32) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def group_rare(df: DataFrame, column: str, share: float, other: str = "other") -> Fitted:
    """Values below a share of the rows become one."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    n = _one(g, {"n": F.sum("n")})["n"] or 0
    kept = [r[0] for r in g.where(F.col("n") >= share * n).select(column).collect()]  # at most 1 / share values
    return Fitted({column: F.when(F.col(column).isin(kept), F.col(column)).otherwise(other)})


def equal_width(df: DataFrame, column: str, bins: int, out: str) -> Fitted:
    """Bins 1..n over the fitted range, right-closed, the lowest value in bin 1."""
    s = _one(df, {"a": F.min(column).cast("double"), "b": F.max(column).cast("double")})
    width = (s["b"] - s["a"]) or 1.0
    return Fitted({out: F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(column) - s["a"]) * bins / width))).cast("long")})


def quantile_bins(df: DataFrame, column: str, bins: int, out: str) -> Fitted:
    """Bins 1..n by exact quantile edges, right-closed, the lowest edge included; repeated edges make one."""
    edges = quantiles(df, {column: [i / bins for i in range(1, bins)]})[column]
    over = [F.when(F.col(column) > e, 1).otherwise(0) for e in sorted(set(edges))]
    return Fitted({out: (sum(over[1:], over[0]) + 1).cast("long")})


def cut(column: str, edges: list[float], labels: list) -> Column:
    """Label of the band (a, b] that holds the value; null outside."""
    out = None
    for a, b, name in zip(edges, edges[1:], labels, strict=False):
        test = (F.col(column) > a) & (F.col(column) <= b)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def polynomial(columns: list[str], degree: int = 2, bias: bool = False) -> dict[str, Column]:
    """All products of up to `degree` columns, names like `a b` and `a^2`, in order of degree."""
    out = {"1": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for group in combinations_with_replacement(columns, d):
            name = " ".join(c if group.count(c) == 1 else f"{c}^{group.count(c)}" for c in dict.fromkeys(group))
            product = F.col(group[0])
            for c in group[1:]:
                product = product * F.col(c)
            out[name] = product
    return out


def pairwise(columns: list[str], kinds=("multiply", "add", "subtract", "ratio")) -> dict[str, Column]:
    f = {"multiply": lambda a, b: a * b, "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "divide": F.try_divide, "ratio": F.try_divide}
    return {f"{a}_{k}_{b}": f[k](F.col(a), F.col(b)) for a, b in combinations(columns, 2) for k in kinds}


def unskew(df: DataFrame, columns: list[str], over: float = 1.0) -> Fitted:
    """log1p of columns that are skewed and not negative, the square root's sign-kept form of skewed others."""
    s = _one(df, {f"{k}{c}": f(c) for c in columns for k, f in (("k", F.skewness), ("a", F.min))})
    out = {}
    for c in columns:
        if abs(s[f"k{c}"] or 0) > over:
            out[f"{c}_log" if s[f"a{c}"] >= 0 else f"{c}_root"] = F.log1p(c) if s[f"a{c}"] >= 0 else F.signum(c) * F.sqrt(F.abs(c))
    return Fitted(out)


def anova_f(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, f): one-way ANOVA of each column by class, from sums in one pass."""
    aggs = [x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"))]
    g = df.groupBy(y).agg(*aggs)
    rows = []
    for c in columns:
        n, s, q = F.sum(f"n_{c}"), F.sum(f"s_{c}"), F.sum(f"q_{c}")
        between = F.sum(F.col(f"s_{c}") * F.col(f"s_{c}") / F.col(f"n_{c}")) - s * s / n
        within = q - F.sum(F.col(f"s_{c}") * F.col(f"s_{c}") / F.col(f"n_{c}"))
        k = F.count(F.lit(1))
        rows.append(F.struct(F.lit(c).alias("feature"), F.try_divide(between / F.nullif(k - 1, F.lit(0)), within / (n - k)).alias("f")))
    return g.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def regression_f(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, f): r^2 / (1 - r^2) * (n - 2) of each column with y, in one pass."""
    rows = [F.struct(F.lit(c).alias("feature"), (F.pow(F.corr(c, y), F.lit(2)) / (1 - F.pow(F.corr(c, y), F.lit(2))) * (F.count(F.lit(1)) - 2)).alias("f")) for c in columns]
    return df.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def low_variance(df: DataFrame, columns: list[str], least: float = 0.0) -> list[str]:
    """Columns whose population variance is over a bound."""
    s = _one(df, {c: F.var_pop(c) for c in columns})
    return [c for c in columns if (s[c] or 0) > least]


def uncorrelated(df: DataFrame, columns: list[str], most: float = 0.9) -> list[str]:
    """Columns left after each one that correlates over a bound with an earlier kept one goes; one pass."""
    pairs = list(combinations(columns, 2))
    s = _one(df, {f"{a}|{b}": F.corr(a, b) for a, b in pairs}) if pairs else {}
    kept: list[str] = []
    for c in columns:
        if all(abs(s[f"{k}|{c}"] or 0) <= most for k in kept):
            kept.append(c)
    return kept


def datetime_parts(column: str) -> dict[str, Column]:
    """Calendar parts, Monday being 0, month edges, cyclic month and weekday, and days since 1970."""
    c, two_pi = F.col(column), 2 * math.pi
    flag = lambda test: F.when(test, 1).otherwise(0)
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "weekday": F.weekday(c), "dayofyear": F.dayofyear(c), "quarter": F.quarter(c)}
    parts |= {"is_weekend": flag(F.weekday(c) >= 5), "month_start": flag(F.dayofmonth(c) == 1), "month_end": flag(F.to_date(c) == F.last_day(c))}
    parts |= {"month_sin": F.sin(two_pi * F.month(c) / 12), "month_cos": F.cos(two_pi * F.month(c) / 12), "weekday_sin": F.sin(two_pi * F.weekday(c) / 7), "weekday_cos": F.cos(two_pi * F.weekday(c) / 7)}
    return parts | {"days": F.datediff(c, F.lit("1970-01-01").cast("date"))}


def tf_idf(df: DataFrame, key: str, text: str, most: int = 1000, grams: tuple[int, int] = (1, 2), stop: list[str] | None = None) -> DataFrame:
    """(key, term, n, tfidf) of the most frequent terms, smoothed idf, each key's values of l2 norm 1; long format.

    Words are runs of two or more letters, digits or underscores, lower-cased, without stop words, Spark's English
    ones unless given. Terms are runs of grams[0] to grams[1] words left. The vocabulary is at most `most` rows.
    """
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("(?U)\\b\\w\\w+\\b"), 0)
    words = df.select(key, F.filter(words, lambda w: ~w.isin(list(stop))).alias("_words"))
    runs = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    found = words.select(key, F.explode(F.concat(*[F.col("_words") if n == 1 else runs(n) for n in range(grams[0], grams[1] + 1)])).alias("term"))
    terms = found.groupBy("term").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "term").limit(most).select("term")
    terms = df.sparkSession.createDataFrame(terms.collect(), terms.schema)  # found is read again, so the choice is made once
    counts = found.join(F.broadcast(terms), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    docs = df.agg(F.count(F.lit(1)).alias("_docs"))
    idf = F.ln((1 + F.col("_docs")) / (1 + F.col("df"))) + 1
    raw = counts.join(F.broadcast(spread), "term").join(F.broadcast(docs)).select(key, "term", "n", (F.col("n") * idf).alias("_raw"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "n", (F.col("_raw") / norm).alias("tfidf"))


def unite(blocks: dict[str, Fitted], weights: dict[str, float] | None = None, when: dict[str, bool] | None = None) -> Fitted:
    """Blocks side by side, names prefixed, each times its weight; blocks whose condition is false are left out.

    Spark runs the blocks of a projection in one pass, so a parallel union needs nothing more.
    """
    out = {}
    for name, block in blocks.items():
        if (when or {}).get(name, True):
            w = (weights or {}).get(name, 1.0)
            out |= {f"{name}__{c}": e * w for c, e in block.outputs.items()}
    return Fitted(out)


def impute_numbers(df: DataFrame, columns: list[str], how: str = "mean", value: float = 0.0, indicator: bool = False) -> Fitted:
    """Mean, exact median, most frequent (the smallest of ties) or a constant for nulls."""
    if how == "mean":
        s = _one(df, {c: F.avg(c) for c in columns})
    elif how == "median":
        s = {c: q[0] for c, q in quantiles(df, dict.fromkeys(columns, [0.5])).items()}
    elif how == "constant":
        s = dict.fromkeys(columns, value)
    elif how == "most_frequent":
        s = {c: mode(df, c) for c in columns}
    else:
        raise ValueError(f"unknown strategy {how!r}")
    marks = {f"{c}_missing": F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns} if indicator else {}
    return Fitted(marks | {c: F.coalesce(F.col(c), F.lit(s[c])) for c in columns})


def mode(df: DataFrame, column: str, default=None):
    """The most frequent value, the smallest of ties; the default where all are null."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    found = g.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column)))).first()[0]
    return default if found is None else found


def fill_along(df: DataFrame, columns: list[str], keys: list[str], order: list[str], back: bool = False) -> DataFrame:
    """The last value before (or the next after) within a key where a column is null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if back:
        return df.withColumns({c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in columns})
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})


def zscore_outlier(df: DataFrame, columns: list[str], over: float = 3.0) -> Column:
    """Whether any column is more than `over` population deviations from its mean."""
    scaled = standard(df, columns).outputs
    tests = [F.abs(e) > over for e in scaled.values()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def iqr_fences(df: DataFrame, columns: list[str], times: float = 1.5) -> dict[str, tuple[float, float]]:
    q = quantiles(df, dict.fromkeys(columns, [0.25, 0.75]))
    return {c: (a - times * (b - a), b + times * (b - a)) for c, (a, b) in q.items()}
