"""Model selection: curves, nested validation, halving, time budgets, boosting by weights, random spaces."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml import classification as K
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import learning as L
from plinth.operators.splits import hash_folds


def learning_curve(df: DataFrame, model: Estimator, keys: list[str], sizes=(0.1, 0.25, 0.5, 1.0), task: str = "classification", metric: str | None = None) -> list[dict]:
    """Train and validation scores on growing shares of the training rows; shares are nested by a hash."""
    e = L.evaluator(task, metric)
    u = F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(10_000)) / 10_000.0
    marked = hash_folds(df, keys, 5).withColumn("_u", u).cache()
    try:
        held, out = marked.where("fold = 0"), []
        for s in sizes:
            part = marked.where((F.col("fold") != 0) & (F.col("_u") < s))
            fitted = model.fit(part)
            out.append({"size": s, "train": e.evaluate(fitted.transform(part)), "valid": e.evaluate(fitted.transform(held))})
        return out
    finally:
        marked.unpersist()


def read_curve(curve: list[dict]) -> dict:
    """Bias high below .7, medium below .85; variance high over a gap of .1, medium over .05; whether more rows help."""
    last = curve[-1]
    gap = last["train"] - last["valid"]
    level = lambda high, medium: "high" if high else "medium" if medium else "low"
    return {
        "bias": level(last["valid"] < 0.7, last["valid"] < 0.85),
        "variance": level(gap > 0.1, gap > 0.05),
        "gap": gap,
        "largest_gap": max(c["train"] - c["valid"] for c in curve),
        "more_rows_help": len(curve) > 1 and curve[-1]["valid"] - curve[-2]["valid"] > 0.005,
    }


def validation_curve(df: DataFrame, name: str, parameter: str, values: list, keys: list[str], task: str = "classification", metric: str | None = None) -> dict:
    """Mean score of each value, the best one, and how far scores spread: high over .1, medium over .05."""
    rows = L.search(df, name, {parameter: values}, keys, task=task, metric=metric)
    spread = max(r["mean"] for r in rows) - min(r["mean"] for r in rows)
    return {"scores": {r["params"][parameter]: r["mean"] for r in rows}, "best": rows[0]["params"][parameter], "sensitivity": "high" if spread > 0.1 else "medium" if spread > 0.05 else "low"}


def nested(df: DataFrame, name: str, space: dict[str, list], keys: list[str], outer: int = 5, inner: int = 3, task: str = "classification", metric: str | None = None) -> list[dict]:
    """A search inside each outer fold, scored on rows that it never saw."""
    e, out = L.evaluator(task, metric), []
    marked = hash_folds(df, keys, outer, seed=7)
    for i in range(outer):
        inside = marked.where(F.col("fold") != i).drop("fold")
        best = L.search(inside, name, space, keys, folds=inner, task=task, metric=metric)[0]["params"]
        fitted = L.estimator(name, task, **best).fit(inside)
        out.append({"params": best, "score": e.evaluate(fitted.transform(marked.where(F.col("fold") == i)))})
    return out


def draw(space: dict[str, tuple], rng: random.Random) -> dict:
    """A setting from ("choice", values), ("int", low, high), ("float", low, high) and ("loguniform", low, high)."""
    kinds = {"choice": lambda v: rng.choice(v), "int": lambda a, b: rng.randint(a, b), "float": lambda a, b: rng.uniform(a, b), "loguniform": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b)))}
    return {k: kinds[v[0]](*v[1:]) for k, v in space.items()}


def optimise(objective: Callable[[dict], float], space: dict[str, tuple], trials: int = 20, seed: int = 42, warm: int = 8) -> tuple[dict, float]:
    """Maximise by Parzen estimates: after `warm` random trials, of 16 draws near good settings the one that is
    likelier among the best quarter than among the rest is tried; every fourth trial stays random."""
    rng, seen = random.Random(seed), []
    for i in range(trials):
        if i < warm or i % 4 == 0:
            setting = draw(space, rng)
        else:
            ranked = sorted(seen, key=lambda s: -s[1])
            good, rest = ranked[: max(2, len(ranked) // 4)], ranked[max(2, len(ranked) // 4) :]
            near = [{k: (_around(rng.choice(good)[0][k], space[k], rng) if rng.random() < 0.8 else draw({k: space[k]}, rng)[k]) for k in space} for _ in range(16)]
            likely = lambda s, group: sum(math.log(0.1 + sum(_close(s[k], g[0][k], space[k]) for g in group) / max(1, len(group))) for k in space)
            setting = max(near, key=lambda s: likely(s, good) - likely(s, rest))
        seen.append((setting, objective(setting)))
    return max(seen, key=lambda s: s[1])


def _around(value, kind: tuple, rng: random.Random):
    """A value near another one, within its bounds."""
    if kind[0] == "choice":
        return value
    low, high = kind[1:]
    if kind[0] == "loguniform":
        return min(high, max(low, value * math.exp(rng.gauss(0, 0.1 * math.log(high / low)))))
    moved = min(high, max(low, value + rng.gauss(0, 0.1 * (high - low))))
    return round(moved) if kind[0] == "int" else moved


def _close(a, b, kind: tuple) -> float:
    if kind[0] == "choice":
        return float(a == b)
    low, high = kind[1:]
    scale = (lambda x: math.log(x / low) / math.log(high / low)) if kind[0] == "loguniform" else (lambda x: (x - low) / max(high - low, 1e-12))
    return math.exp(-8 * (scale(a) - scale(b)) ** 2)


def halving(df: DataFrame, name: str, space: dict[str, list], keys: list[str], task: str = "classification", metric: str | None = None) -> dict:
    """All settings on a small hash sample, the better half on twice as many rows, until one is left."""
    import itertools

    settings = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    rounds = max(1, math.ceil(math.log2(len(settings))))
    e = L.evaluator(task, metric)
    u = F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(10_000)) / 10_000.0
    for i in range(rounds):
        share = 1 / 2 ** (rounds - 1 - i)
        marked = hash_folds(df.where(u < share), keys, 4)
        scores = [(e.evaluate(L.estimator(name, task, **s).fit(marked.where("fold <> 0")).transform(marked.where("fold = 0"))), s) for s in settings]
        scores.sort(key=lambda x: x[0], reverse=e.isLargerBetter())
        settings = [s for _, s in scores[: max(1, len(scores) // 2)]]
    return settings[0]


def within_budget(df: DataFrame, names: list[str], keys: list[str], seconds: float, task: str = "classification", metric: str | None = None) -> list[dict]:
    """Scores of as many models as the time allows, in the order given; later ones are left out when it is over."""
    began, out = time.monotonic(), []
    for name in names:
        if out and time.monotonic() - began > seconds:
            break
        at = time.monotonic()
        scores = L.cross_validate(df, L.estimator(name, task), keys, 3, task, metric)
        out.append({"model": name, "mean": sum(scores) / len(scores), "seconds": time.monotonic() - at})
    return sorted(out, key=lambda r: r["mean"], reverse=L.evaluator(task, metric).isLargerBetter())


class AdaBoost:
    """Boosted shallow trees on reweighted rows, two or more classes; staged predictions by the number of rounds."""

    def __init__(self, rounds: int = 5, depth: int = 2):
        self.rounds, self.depth, self.stages = rounds, depth, []

    def fit(self, df: DataFrame) -> AdaBoost:
        from plinth.sources.tables import durable

        classes = df.select("label").distinct().count()
        rows = durable(df.withColumn("_w", F.lit(1.0)))
        self.stages = []
        for i in range(self.rounds):
            model = K.DecisionTreeClassifier(maxDepth=self.depth, weightCol="_w", featuresCol="features", labelCol="label", seed=i).fit(rows)
            scored = model.transform(rows)
            s = scored.agg(F.sum(F.when(F.col("prediction") != F.col("label"), F.col("_w")).otherwise(0.0)).alias("e"), F.sum("_w").alias("t")).first()
            error = min(max((s["e"] or 0.0) / (s["t"] or 1.0), 1e-10), 1.0)
            if error >= 1 - 1 / max(classes, 2):
                break
            alpha = math.log((1 - error) / error) + math.log(max(classes - 1, 1))
            self.stages.append((model, alpha))
            if error <= 1e-9:
                break
            grown = F.when(F.col("prediction") != F.col("label"), F.col("_w") * math.exp(alpha)).otherwise(F.col("_w"))
            rows = durable(scored.withColumn("_w", grown / F.lit(s["t"])).select(*rows.columns))
        return self

    def transform(self, df: DataFrame, rounds: int | None = None) -> DataFrame:
        out = df.withColumn("_votes", F.array().cast("array<struct<c:double,a:double>>"))
        for model, alpha in self.stages[: rounds or len(self.stages)]:
            out = model.transform(out).withColumn("_votes", F.array_append("_votes", F.struct(F.col("prediction").alias("c"), F.lit(alpha).alias("a")))).drop("prediction", "probability", "rawPrediction")
        total = lambda c: F.aggregate(F.filter("_votes", lambda v: v["c"] == c), F.lit(0.0), lambda s, v: s + v["a"])
        best = F.array_max(F.transform(F.array_distinct(F.transform("_votes", lambda v: v["c"])), lambda c: F.struct(total(c).alias("a"), (-c).alias("m"))))
        return out.withColumn("prediction", -best["m"]).drop("_votes")


def uncertain(df: DataFrame, k: int, how: str = "least_confident", keys: list[str] = ()) -> DataFrame:
    """The k rows to label next, by least confidence, margin or entropy of `probability`."""
    p = vector_to_array("probability")
    ranked = F.sort_array(p, asc=False)
    scores = {"least_confident": 1 - ranked[0], "margin": -(ranked[0] - ranked[1]), "entropy": F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))}
    if how not in scores:
        raise ValueError(f"unknown strategy {how!r}")
    return df.withColumn("uncertainty", scores[how]).orderBy(F.desc("uncertainty"), *keys).limit(k)


class Registry:
    """Versions of models in a folder of JSON lines, with tags and the active one."""

    def __init__(self):
        self.entries: list[dict] = []

    def add(self, name: str, path: str, score: float, **tags) -> int:
        version = 1 + max((e["version"] for e in self.entries if e["name"] == name), default=0)
        self.entries.append({"name": name, "version": version, "path": path, "score": score, "tags": tags, "active": False})
        return version

    def activate(self, name: str, version: int) -> None:
        if not any(e["name"] == name and e["version"] == version for e in self.entries):
            raise KeyError(f"{name} has no version {version}")
        for e in self.entries:
            if e["name"] == name:
                e["active"] = e["version"] == version

    def best(self, name: str) -> dict:
        return max((e for e in self.entries if e["name"] == name), key=lambda e: e["score"])

    def dump(self) -> str:
        return "\n".join(json.dumps(e, sort_keys=True) for e in self.entries)
