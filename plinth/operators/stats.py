"""Summary statistics, and distributions of test statistics without other libraries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import order


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value; the total comes from the counts, not from another scan."""
    from pyspark.sql.window import Window


    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def quantiles(df: DataFrame, column: str, ps: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, a row each."""
    found = order.quantiles(df, {column: ps})[column]
    return df.sparkSession.createDataFrame(list(zip(map(float, ps), found, strict=True)), "p double, v double")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, sample std, min, quartiles, max of each column a row each."""
    rows, found = [], order.quantiles(df, dict.fromkeys(columns, [0.25, 0.5, 0.75]))
    for c in columns:
        q = [F.lit(x).cast("double") for x in found[c]]
        cells = [F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), *[q[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))], F.max(c).cast("double").alias("high")]
        rows.append(F.struct(*cells))
    return df.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of each pair of columns in one pass, (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs])
    return df.agg(rows.alias("_all")).select(F.inline("_all"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the largest value, left-closed, the last one closed; empty bins give no row."""
    edge = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins))
    return df.select(column).join(F.broadcast(edge)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + term / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t for a two-sided level p, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > p else (low, mid)
    return (low + high) / 2


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper_one(x: float) -> float:
    """P(X >= x) of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0) / 2))


def binomial_two_sided(k: int, n: int) -> float:
    """2 * P(X <= min(k, n-k)) for fair coins, at most 1."""
    low = min(k, n - k)
    total = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
    return min(1.0, 2 * total)


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    if not n or not m:
        return 1.0
    e = math.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def cohen_label(d: float) -> str:
    """negligible, small, medium or large by the bounds 0.2, 0.5 and 0.8."""
    return next((name for bound, name in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium")) if abs(d) < bound), "large")


def paired_t(df: DataFrame, a: str, b: str) -> dict:
    """Paired t-test, Cohen's d with pooled sample deviations, and its label; nulls are left out in pairs."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.col(a) - F.col(b)
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb")).first()
    if r["n"] < 2 or not r["s"]:
        return {"n": r["n"], "t": 0.0, "p": 1.0, "d": 0.0, "effect": "negligible"}
    t = r["m"] / (r["s"] / math.sqrt(r["n"]))
    pooled = math.sqrt((r["va"] + r["vb"]) / 2)
    effect = r["m"] / pooled if pooled else 0.0
    return {"n": r["n"], "t": t, "p": t_two_sided(t, r["n"] - 1), "d": effect, "effect": cohen_label(effect)}


def mcnemar(df: DataFrame, right_a, right_b) -> dict:
    """McNemar's test of two boolean columns: exact below 25 disagreements, else chi-square with continuity correction."""
    r = df.agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c")).first()
    b, c = r["b"], r["c"]
    if b + c < 25:
        return {"b": b, "c": c, "statistic": float(min(b, c)), "p": binomial_two_sided(b, b + c) if b + c else 1.0}
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return {"b": b, "c": c, "statistic": x, "p": chi2_upper_one(x)}


def mean_interval(df: DataFrame, column: str, level: float = 0.95) -> dict:
    """Mean with its t confidence interval."""
    r = df.agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    if r["n"] < 2:
        return {"n": r["n"], "mean": r["m"], "low": r["m"], "high": r["m"]}
    half = t_quantile(1 - level, r["n"] - 1) * r["s"] / math.sqrt(r["n"])
    return {"n": r["n"], "mean": r["m"], "low": r["m"] - half, "high": r["m"] + half}


def ks_two_sample(df: DataFrame, value: str, group) -> dict:
    """Two-sample Kolmogorov-Smirnov distance of the rows where `group` holds and where it doesn't.

    Counts of distinct values are cumulated in value order; ranges of values are summed first, so no single
    task orders all rows.
    """
    from pyspark.sql.window import Window

    g = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.when(group, 1).otherwise(0).alias("g"))
    each = g.groupBy("v").agg(F.sum("g").alias("a"), F.sum(1 - F.col("g")).alias("b"))
    parts = each.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    sums = parts.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("part", F.coalesce(F.sum("pa").over(before), F.lit(0)).alias("sa"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("sb"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n = each.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not n["a"] or not n["b"]:
        return {"d": 0.0, "p": 1.0, "n": n["a"] or 0, "m": n["b"] or 0}
    gap = F.abs((F.sum("a").over(inside) + F.col("sa")) / F.lit(n["a"]) - (F.sum("b").over(inside) + F.col("sb")) / F.lit(n["b"]))
    d = parts.join(F.broadcast(shift), "part").select(gap.alias("gap")).agg(F.max("gap")).first()[0]
    return {"d": d, "p": ks_p_value(d, n["a"], n["b"]), "n": n["a"], "m": n["b"]}


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of a value, ties sharing their mean rank; ranks come from counts of distinct values.

    Distinct values are ranged and their counts cumulated range by range, so no task orders all rows.
    """
    from pyspark.sql.window import Window

    each = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    parts = each.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    sums = parts.groupBy("_part").agg(F.sum("_n").alias("_s"))
    shift = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.join(F.broadcast(shift), "_part").select(column, (F.col("_s") + upto - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranked, column, "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho): Pearson r of average ranks."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_ranks(average_ranks(rows, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def wilcoxon(df: DataFrame, a: str, b: str) -> dict:
    """Signed-rank test of pairs, zero differences left out, normal approximation."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d IS NOT NULL AND d <> 0").select("d", F.abs("d").alias("m"))
    r = average_ranks(d, "m", "r").agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum("r").alias("all"), F.count(F.lit(1)).alias("n")).first()
    n = r["n"]
    if not n:
        return {"n": 0, "statistic": 0.0, "p": 1.0}
    low = min(r["up"], r["all"] - r["up"])
    z = (low - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return {"n": n, "statistic": low, "p": normal_two_sided(z)}


def chi2_upper(x: float, k: int) -> float:
    """P(X >= x) of chi-square with k degrees of freedom, by the incomplete gamma function's series and fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
        return max(0.0, 1 - front * total)
    f = 0.0
    for i in range(500, 0, -1):
        f = i * (i - a) / (x + 2 * i + 1 - a - f)
    return front / (x + 1 - a - f)


def friedman(df: DataFrame, block: str, columns: list[str]) -> dict:
    """Friedman test of k related columns: ranks within a row, ties sharing the mean; one aggregation."""
    k = len(columns)
    values = F.array(*columns)
    rank = lambda c: F.size(F.filter(values, lambda v: v < F.col(c))) + (F.size(F.filter(values, lambda v: v == F.col(c))) + 1) / 2
    ranks = [rank(c) for c in columns]
    r = df.dropna(subset=columns).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(c) for e, c in zip(ranks, columns, strict=True)]).first()
    n = r["n"]
    if not n or k < 2:
        return {"n": n, "statistic": 0.0, "p": 1.0}
    x = 12 / (n * k * (k + 1)) * sum(r[c] ** 2 for c in columns) - 3 * n * (k + 1)
    return {"n": n, "statistic": x, "p": chi2_upper(x, k - 1)}


def bootstrap_difference(df: DataFrame, keys: list[str], a: str, b: str, rounds: int = 200, seed: int = 42) -> dict:
    """Mean of a - b over Poisson bootstrap rounds: interval of the middle 95 %, and a two-sided p of at most 1."""
    from plinth.operators.splits import bootstrap

    m = bootstrap(df, keys, rounds, seed).groupBy("round").agg(F.avg(F.col(a) - F.col(b)).alias("m"))
    r = m.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("low")).first()
    return {"low": r["q"][0], "median": r["q"][1], "high": r["q"][2], "p": min(1.0, 2 * min(r["low"], 1 - r["low"]))}
