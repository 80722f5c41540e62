"""What predictions are worth: churn, fraud, quality, maintenance, credit. Each gives one row of sums and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(y: str, p: str) -> list[Column]:
    on = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    return [on(1, 1).alias("tp"), on(0, 1).alias("fp"), on(1, 0).alias("fn"), on(0, 0).alias("tn")]


def _at_least_one(x: str) -> Column:
    return F.greatest(F.col(x), F.lit(1))


def churn(df: DataFrame, y: str, p: str, value: float = 1200.0, campaign: float = 25.0, success: float = 0.7) -> DataFrame:
    """Money saved from churners that were found, lost with those missed, costs of the campaign, and its return in percent."""
    c = df.agg(*_cells(y, p))
    saved, cost = F.col("tp") * value * success, (F.col("tp") + 2 * F.col("fp")) * campaign
    return c.select("tp", "fp", "fn", "tn", saved.alias("saved"), (F.col("fn") * value).alias("lost"), ((F.col("tp") + F.col("fp")) * campaign).alias("campaign"), (saved - cost).alias("net"), F.coalesce(F.try_divide(saved - cost, cost) * 100, F.lit(0.0)).alias("roi"), (cost / _at_least_one("tp")).alias("cost_per_retained"))


def fraud(df: DataFrame, y: str, p: str, amount: str, investigation: float = 25.0, friction: float = 10.0) -> DataFrame:
    """Losses prevented and suffered at the mean amount of fraud, costs of alerts, and net savings."""
    c = df.agg(*_cells(y, p), F.coalesce(F.avg(F.when(F.col(y) == 1, F.col(amount))), F.lit(500.0)).alias("mean"))
    prevented, alerts, bother = F.col("tp") * F.col("mean"), (F.col("tp") + F.col("fp")) * investigation, F.col("fp") * friction
    return c.select("tp", "fp", "fn", prevented.alias("prevented"), (F.col("fn") * F.col("mean")).alias("losses"), (prevented - alerts - bother).alias("net"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("detection_rate"), ((alerts + bother) / _at_least_one("tp")).alias("cost_per_detection"), F.coalesce(F.try_divide(prevented - alerts - bother, prevented) * 100, F.lit(0.0)).alias("savings_rate"))


def quality(df: DataFrame, y: str, p: str, costs: dict[str, float], rework: dict[str, float], passed: str, inspection: float, false_rework: float) -> DataFrame:
    """Cost of items by true class without predictions, with them, and the savings; classes without rework are discarded."""
    of = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(0.0))
    good, kept = F.col(y) == passed, F.col(p) == passed
    spent = F.when(good & kept, 0.0).when(~good & ~kept, of(rework, y)).when(~good, of(costs, y)).otherwise(false_rework) + inspection
    saved = F.when(~good & ~kept, of(costs, y) - of(rework, y)).otherwise(0.0)
    c = df.agg(F.sum(of(costs, y)).alias("baseline"), F.sum(spent).alias("spent"), F.sum(saved).alias("caught"), F.count(F.lit(1)).alias("n"))
    total = F.col("baseline") - F.col("spent") + F.col("caught")
    return c.select("baseline", "spent", total.alias("savings"), F.coalesce(F.try_divide(total, "baseline"), F.lit(0.0)).alias("savings_rate"), F.try_divide("spent", "n").alias("cost_per_item"))


def maintenance(df: DataFrame, y: str, p: str, two_ahead: Column, failure: str, normal: str, alarms: list[str]) -> DataFrame:
    """Early warnings of failures, false alarms of normal states, warnings two rows before a failure, and a score of .6, .3, .1."""
    alarm = F.col(p).isin(alarms)
    early = (two_ahead == failure) & F.col(p).isin([a for a in alarms if a != failure]) & F.col(y).isin(normal, alarms[0])
    c = df.select(y, p, alarm.alias("alarm"), (two_ahead == failure).alias("window"), early.alias("early")).agg(
        F.count_if((F.col(y) == failure) & F.col("alarm")).alias("warned"), F.count_if(F.col(y) == failure).alias("failures"), F.count_if((F.col(y) == normal) & F.col("alarm")).alias("false_alarms"), F.count_if(F.col(y) == normal).alias("normal"), F.count_if("early").alias("effective"), F.count_if("window").alias("windows")
    )
    rates = c.select("warned", "false_alarms", (F.col("warned") / _at_least_one("failures")).alias("early_warning_rate"), (F.col("false_alarms") / _at_least_one("normal")).alias("false_alarm_rate"), (F.col("effective") / _at_least_one("windows")).alias("effectiveness"))
    return rates.withColumn("reliability", F.col("early_warning_rate") * 0.6 + (1 - F.col("false_alarm_rate")) * 0.3 + F.col("effectiveness") * 0.1)


def funnel(df: DataFrame, group: list[str], shown: Column, clicked: Column, bought: Column, revenue: Column, cost: float) -> DataFrame:
    """Click-through, conversion, and return on what showing cost, for each group."""
    g = df.groupBy(*group).agg(F.count_if(shown).alias("shown"), F.count_if(clicked).alias("clicked"), F.count_if(bought).alias("bought"), F.coalesce(F.sum(F.when(bought, revenue)), F.lit(0.0)).alias("revenue"))
    spent = F.col("shown") * cost
    return g.withColumns({"ctr": F.try_divide("clicked", "shown"), "conversion": F.try_divide("bought", "clicked"), "roi": F.try_divide(F.col("revenue") - spent, spent)})
