"""Evaluation reports: residuals, forecasts, comparisons of results, stability, uncertainty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators.order import quantiles


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mean, population deviation, least, greatest and quartiles of y - p, and the correlation of y and p."""
    e = F.col(y) - F.col(p)
    low, high = quantiles(df.select(e.alias("e")), {"e": [0.25, 0.75]})["e"]
    return df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("low"), F.max(e).alias("high"), F.lit(low).cast("double").alias("q25"), F.lit(high).cast("double").alias("q75"), F.corr(y, p).alias("correlation"))


def series_errors(df: DataFrame, y: str, p: str, season: Column) -> DataFrame:
    """One row: mse, rmse, mae, r2, mape (null if any y is 0) and mase, scaled by |y - season| where season is known."""
    e = F.col(y) - F.col(p)
    rows = df.select(y, p, e.alias("_e"), F.abs(F.col(y) - season).alias("_naive"))
    one = rows.agg(F.avg(F.col("_e") * F.col("_e")).alias("mse"), F.avg(F.abs("_e")).alias("mae"), (1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.var_pop(y) * F.count(y))).alias("r2"), F.avg(F.abs(F.try_divide(F.col("_e"), F.col(y)))).alias("_mape"), F.count_if(F.col(y) == 0).alias("_zeros"), F.avg("_naive").alias("_scale"))
    return one.select("mse", F.sqrt("mse").alias("rmse"), "mae", "r2", F.when(F.col("_zeros") == 0, F.col("_mape")).alias("mape"), F.try_divide("mae", "_scale").alias("mase"))


def forecast_accuracy(df: DataFrame, y: str, p: str, last_y: Column, last_p: Column) -> DataFrame:
    """One row in percent: mape, smape, accuracy (100 - mape, 0 at least), directional; and mase against the value before."""
    gap = F.abs(F.col(y) - F.col(p))
    rows = df.select(F.abs(F.try_divide(gap, F.col(y))).alias("a"), F.try_divide(2 * gap, F.abs(y) + F.abs(p)).alias("s"), gap.alias("g"), F.abs(F.col(y) - last_y).alias("naive"), (F.signum(F.col(y) - last_y) == F.signum(F.col(p) - last_p)).cast("double").alias("way"))
    one = rows.agg((100 * F.avg("a")).alias("mape"), (100 * F.avg("s")).alias("smape"), F.try_divide(F.avg("g"), F.avg("naive")).alias("mase"), (100 * F.avg("way")).alias("directional"))
    return one.select("mape", "smape", "mase", F.greatest(F.lit(0.0), 100 - F.col("mape")).alias("accuracy"), "directional")


def overfitting(df: DataFrame, train: Column, test: Column) -> DataFrame:
    """One row: the mean of a score on training rows, on test rows, and the difference."""
    one = df.agg(F.avg(train).alias("train"), F.avg(test).alias("test"))
    return one.withColumn("gap", F.col("train") - F.col("test"))


def compare(results: DataFrame, metric: str, larger_is_better: bool = True) -> DataFrame:
    """Results with their place by a metric, the missing last; ties go by name. Made for a table of models."""
    order = F.desc_nulls_last(metric) if larger_is_better else F.asc_nulls_last(metric)
    return results.withColumn("place", F.row_number().over(Window.orderBy(order, "name")).cast("long"))


def multi_criteria(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Results with score, the sum of signed weights times metrics, and the place by it."""
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in weights.items()])
    return compare(results.withColumn("score", score), "score")


def stability(df: DataFrame, column: str) -> DataFrame:
    """One row over finite values: mean, population deviation, variation, least, greatest, range."""
    x = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))
    one = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    return one.select("mean", "std", F.try_divide("std", F.abs("mean")).alias("cv"), "low", "high", (F.col("high") - F.col("low")).alias("range"))


def utility(report: DataFrame, weights: dict[str, float], heavy: float = 0.7) -> DataFrame:
    """Weighted mean over classes of F-beta, beta 2 for classes that weigh more than `heavy`, else 1; from (class, precision, recall)."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("class").cast("string")), F.lit(0.5))
    b = F.when(w > heavy, 4.0).otherwise(1.0)
    score = F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0))
    return report.agg(F.try_divide(F.sum(w * score), F.sum(w)).alias("utility"))


def ensemble_uncertainty(probabilities: list[str]) -> dict[str, Column]:
    """Of binary members' probabilities: mean, population variance, and mutual information (entropy of the mean less mean entropy)."""
    n = len(probabilities)
    cells = [F.col(c) for c in probabilities]
    mean = reduce(lambda a, b: a + b, cells) / n
    plogp = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    entropy = lambda p: plogp(p) + plogp(1 - p)
    return {"mean": mean, "variance": reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cells]) / n, "information": entropy(mean) - reduce(lambda a, b: a + b, [entropy(c) for c in cells]) / n}


def extra_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row of binary labels and predictions: balanced accuracy, and explained variance of p taken as a number."""
    one = df.agg(F.avg(F.when(F.col(y) == 1, (F.col(p) == 1).cast("double"))).alias("a"), F.avg(F.when(F.col(y) == 0, (F.col(p) == 0).cast("double"))).alias("b"), F.var_pop(F.col(y) - F.col(p)).alias("e"), F.var_pop(y).alias("v"))
    return one.select(((F.col("a") + F.col("b")) / 2).alias("balanced_accuracy"), (1 - F.try_divide("e", "v")).alias("explained_variance"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision times the step of recall, from a curve (score, tpr, precision) of one row a distinct score."""
    step = F.col("tpr") - F.coalesce(F.lag("tpr").over(Window.orderBy(F.desc("score"))), F.lit(0.0))
    return curve.select((step * F.col("precision")).alias("s")).agg(F.sum("s").alias("average_precision"))


def summary(results: dict[str, float | None]) -> str:
    """Metrics as lines of text, N/A for missing ones."""
    return "\n".join(f"{k}: {'N/A' if v is None else format(v, '.4f')}" for k, v in results.items())
