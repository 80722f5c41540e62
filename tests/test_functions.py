"""Scalar expressions."""

import math

from pyspark.sql import functions as F

from plinth.functions import scalars as X


def test_scalars(spark):
    numbers = lambda *v: F.array(*map(F.lit, v))
    cases = [
        (X.entropy(numbers(0.5, 0.5, 0.0)), 1.0),
        (X.cosine(numbers(1.0, 0.0), numbers(1.0, 1.0)), math.sqrt(0.5)),
        (X.cosine(numbers(0.0), numbers(1.0)), None),
        (X.euclidean(numbers(0.0, 0.0), numbers(3.0, 4.0)), 5.0),
        (X.euclidean(numbers(0.0, 0.0), numbers(3.0, 4.0), [1.0, 0.0]), 3.0),
        (X.jaccard(numbers(1, 2), numbers(2, 3)), 1 / 3),
        (X.argmax(numbers(1, 9, 9)), 1),
        (X.safe_divide(F.lit(1.0), F.lit(0.0)), 0.0),
        (X.logistic(F.lit(0.0)), 0.5),
        (X.cyclic(F.lit(3), 12)[0], 1.0),
        (F.size(X.words(F.lit("Héllo, w"))), 2),
    ]
    row = spark.range(1).select(*[e.alias(f"c{i}") for i, (e, _) in enumerate(cases)]).first()
    for got, (_, want) in zip(row, cases, strict=True):
        assert got == want or abs(got - want) < 1e-12
