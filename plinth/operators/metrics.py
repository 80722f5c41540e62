"""Evaluation metrics as aggregations: confusion counts, curves, regression errors, calibration, ranking, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _div(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) from one count of (y, p) pairs; 0 where undefined."""
    pairs = df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)
    a = pairs.groupBy(F.col(y).alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    b = pairs.groupBy(F.col(p).alias("class")).agg(F.sum("n").alias("predicted"))
    c = a.join(b, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    c = c.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"), "precision": _div(F.col("tp"), F.col("predicted")), "recall": _div(F.col("tp"), F.col("support"))})
    return c.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("predicted")


def averages(df: DataFrame, y: str, p: str) -> DataFrame:
    """(average, precision, recall, f1, accuracy) for macro, weighted and micro, from per_class."""
    c = per_class(df, y, p)
    n, right = F.sum("support"), F.sum("tp")
    accuracy = _div(right, n)
    means = {m: (F.avg(m), _div(F.sum(F.col(m) * F.col("support")), n)) for m in ("precision", "recall", "f1")}
    rows = [F.struct(F.lit(name).alias("average"), *[means[m][i].alias(m) for m in means], accuracy.alias("accuracy")) for i, name in enumerate(("macro", "weighted"))]
    micro_p, micro_r = _div(right, right + F.sum("fp")), _div(right, n)
    rows.append(F.struct(F.lit("micro").alias("average"), micro_p.alias("precision"), micro_r.alias("recall"), _div(2 * micro_p * micro_r, micro_p + micro_r).alias("f1"), accuracy.alias("accuracy")))
    return c.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def detection(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts of a 0/1 prediction and precision, recall, specificity, false positive rate, F1, F2; 0 where undefined."""
    a, b = F.col(y) == 1, F.col(p) == 1
    c = df.agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "specificity": _div(tn, tn + fp), "fpr": _div(fp, fp + tn), "f1": _div(2 * tp, 2 * tp + fp + fn), "f2": _div(5 * tp, 5 * tp + 4 * fn + fp)})


def curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC and PR points at each distinct score, from high to low: (score, tp, fp, tpr, fpr, precision).

    Rows are first summed by score, and sums of score ranges are shifted, so no task orders all scores.
    """
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    parts = g.repartitionByRange(F.desc("score")).withColumn("_part", F.spark_partition_id())
    every = Window.partitionBy()
    sums = parts.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_sp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_sn"), F.sum("_p").over(every).alias("_tp"), F.sum("_n").over(every).alias("_tn"))
    inside = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = parts.join(F.broadcast(shift), "_part").withColumns({"tp": F.sum("p").over(inside) + F.col("_sp"), "_seen": F.sum("n").over(inside) + F.col("_sn")})
    c = c.withColumn("fp", F.col("_seen") - F.col("tp"))
    return c.select("score", "tp", "fp", F.try_divide("tp", "_tp").alias("tpr"), F.try_divide("fp", F.col("_tn") - F.col("_tp")).alias("fpr"), F.try_divide("tp", "_seen").alias("precision"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(auc): the chance that a positive scores higher than a negative, ties counting half; null without both classes."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    parts = g.repartitionByRange("s").withColumn("_part", F.spark_partition_id())
    neg = F.col("n") - F.col("p")
    sums = parts.groupBy("_part").agg(F.sum(neg).alias("_q"))
    shift = sums.select("_part", F.coalesce(F.sum("_q").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    below = F.coalesce(F.sum(neg).over(Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_s")
    w = parts.join(F.broadcast(shift), "_part").select("p", neg.alias("q"), (F.col("p") * (below + neg / 2)).alias("u"))
    return w.agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("q").cast("double")).alias("auc"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """mse, rmse, mae, r2, explained variance, mape (null with a zero target), smape, residual statistics, correlation."""
    e, t = F.col(y) - F.col(p), F.col(y)
    zero = F.count_if(t == 0) > 0
    mse = F.avg(e * e)
    return df.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(t))).alias("r2"), (1 - F.try_divide(F.var_pop(e), F.var_pop(t))).alias("explained"),
        F.when(~zero, F.avg(F.abs(F.try_divide(e, t)))).alias("mape"), F.avg(F.coalesce(F.try_divide(2 * F.abs(e), F.abs(t) + F.abs(F.col(p))), F.lit(0.0))).alias("smape"),
        F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"), F.min(e).alias("residual_min"), F.max(e).alias("residual_max"), F.percentile(e, F.lit(0.25)).alias("residual_q25"), F.percentile(e, F.lit(0.75)).alias("residual_q75"), F.corr(y, p).alias("correlation"),
    )


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): right-closed bins (lo, hi], a probability of 0 is in none."""
    b = F.ceil(F.col(p) * bins).cast("long")
    return df.where(F.col(p) > 0).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def brier_and_ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(brier, log_loss, ece)."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    one = df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.avg(-F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"), F.count(F.lit(1)).alias("_n"))
    gap = calibration(df, y, p, bins).agg(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("_g"))
    return one.join(F.broadcast(gap)).select("brier", "log_loss", (F.col("_g") / F.col("_n")).alias("ece"))


def fairness(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """(group, n, accuracy, positive_rate, parity_gap): the gap is the largest less the smallest positive rate of all."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.avg((F.col(p) == 1).cast("double")).alias("positive_rate"))
    every = Window.partitionBy()
    return g.withColumn("parity_gap", F.max("positive_rate").over(every) - F.min("positive_rate").over(every))


def ranking(df: DataFrame, user: str, rank: str, relevant: str, k: int) -> DataFrame:
    """(user, precision, recall, f1, ndcg) at k; rank from 1, relevance 0 or 1, discount log2(rank + 1)."""
    top = F.col(rank) <= k
    gain = F.sum(F.when(top & (F.col(relevant) == 1), 1 / F.log2(F.col(rank) + 1)).otherwise(0.0))
    hits, total = F.sum(F.when(top, F.col(relevant)).otherwise(0)), F.sum(relevant)
    g = df.groupBy(user).agg(hits.alias("hits"), total.alias("total"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p, r = F.col("hits") / k, _div(F.col("hits"), F.col("total"))
    return g.select(user, p.alias("precision"), r.alias("recall"), _div(2 * p * r, p + r).alias("f1"), F.when(F.col("total") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def clustering_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari, nmi, homogeneity, completeness, v_measure) of two labelings, from their contingency counts."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = c.withColumns({"na": F.sum("n").over(Window.partitionBy(a)), "nb": F.sum("n").over(Window.partitionBy(b))})
    pair = lambda x: x * (x - 1) / 2
    total = F.sum("n").alias("t")
    s = c.agg(F.sum(pair(F.col("n"))).alias("ij"), total, F.sum(F.col("n") * (F.col("na") - 1) / 2).alias("i"), F.sum(F.col("n") * (F.col("nb") - 1) / 2).alias("j"), F.sum(F.col("n") * F.ln("n")).alias("hij"), F.sum(F.col("n") * F.ln("na")).alias("ha"), F.sum(F.col("n") * F.ln("nb")).alias("hb"))
    t = F.col("t")
    ha, hb, hij = F.ln("t") - F.col("ha") / t, F.ln("t") - F.col("hb") / t, F.ln("t") - F.col("hij") / t
    mutual = ha + hb - hij
    expected = F.col("i") * F.col("j") / pair(t)
    h, k = F.coalesce(F.try_divide(mutual, ha), F.lit(1.0)), F.coalesce(F.try_divide(mutual, hb), F.lit(1.0))
    return s.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected), F.lit(1.0)).alias("ari"), F.coalesce(F.try_divide(2 * mutual, ha + hb), F.lit(1.0)).alias("nmi"), h.alias("homogeneity"), k.alias("completeness"), _div(2 * h * k, h + k).alias("v_measure"))


def cluster_quality(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(calinski_harabasz, davies_bouldin, clusters) from cluster centres; noise (label -1) is left out."""
    rows = df.where(F.col(label) != -1)
    long = rows.select(label, F.posexplode(vector).alias("i", "x"))
    centre = long.groupBy(label, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    packed = centre.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"), F.max("n").alias("n"), F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")).alias("within"))
    distance = lambda u, v: F.sqrt(F.aggregate(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = rows.join(F.broadcast(packed.select(label, "c")), label).groupBy(label).agg(F.avg(distance(F.transform(vector, lambda x: x.cast("double")), F.col("c"))).alias("s"))
    p = packed.join(spread, label)
    a, b = p.select(F.col(label).alias("la"), F.col("c").alias("ca"), F.col("s").alias("sa")), p.select(F.col(label).alias("lb"), F.col("c").alias("cb"), F.col("s").alias("sb"))
    worst = a.join(F.broadcast(b), F.col("la") != F.col("lb")).groupBy("la").agg(F.max((F.col("sa") + F.col("sb")) / distance(F.col("ca"), F.col("cb"))).alias("w"))
    whole = long.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("x")) - F.count(F.lit(1)) * F.pow(F.avg("x"), F.lit(2))).alias("t")).agg(F.sum("t").alias("t"))
    sums = packed.agg(F.sum("within").alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).join(F.broadcast(whole)).join(F.broadcast(worst.agg(F.avg("w").alias("db"))))
    ch = ((F.col("t") - F.col("w")) / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return sums.select(ch.alias("calinski_harabasz"), F.col("db").alias("davies_bouldin"), F.col("k").alias("clusters"))


def returns(df: DataFrame, column: str) -> DataFrame:
    """Sharpe ratio (x sqrt 252, population deviation), win rate, 5 % value at risk of a column of returns."""
    return df.agg((F.try_divide(F.avg(column), F.stddev_pop(column)) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg((F.col(column) > 0).cast("double")).alias("win_rate"), F.percentile(column, F.lit(0.05)).alias("var5"))


def best_threshold(df: DataFrame, y: str, score: str) -> DataFrame:
    """(youden, f1): the score to cut at by Youden's index and by F1; ties go to the higher score."""
    c = curve(df, y, score)
    f1 = _div(2 * F.col("tpr") * F.col("precision"), F.col("tpr") + F.col("precision"))
    return c.agg(F.max_by("score", F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), "score")).alias("youden"), F.max_by("score", F.struct(F.round(f1, 12), "score")).alias("f1"))


def disagreement(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """(disagreement, yule_q, kappa) of two classifiers."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    c = df.agg(F.count_if(ra & rb).alias("n11"), F.count_if(~ra & ~rb).alias("n00"), F.count_if(ra & ~rb).alias("n10"), F.count_if(~ra & rb).alias("n01"), F.count(F.lit(1)).alias("n"), F.avg((F.col(a) != F.col(b)).cast("double")).alias("disagreement"))
    good, bad = F.col("n11") * F.col("n00"), F.col("n01") * F.col("n10")
    expect = ((F.col("n11") + F.col("n10")) * (F.col("n11") + F.col("n01")) + (F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10"))) / (F.col("n") * F.col("n"))
    return c.select("disagreement", _div(good - bad, good + bad).alias("yule_q"), _div((F.col("n11") + F.col("n00")) / F.col("n") - expect, 1 - expect).alias("kappa"))
