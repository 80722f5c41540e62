"""Column selections and row expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.order import quantiles

_KINDS = {"number": T.NumericType, "string": T.StringType, "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "bool": T.BooleanType}


def select(df: DataFrame, names=(), indexes=(), dtypes=(), pattern: str | None = None, where: Callable[[T.StructField], bool] | None = None, invert: bool = False) -> DataFrame:
    """Columns by name, place, kind (number, string, datetime, bool), regular expression or predicate, in table order."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    chosen = set(names) | {df.columns[i] for i in indexes}
    for f in df.schema:
        kinds = any(isinstance(f.dataType, _KINDS[k]) for k in dtypes)
        if kinds or (pattern and re.search(pattern, f.name)) or (where and where(f)):
            chosen.add(f.name)
    return df.select(*[c for c in df.columns if (c in chosen) != invert])


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a if isinstance(a, Column) else F.col(a), b if isinstance(b, Column) else F.col(b))


def flags(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A 0/1 column for each predicate; null counts as 0."""
    return df.withColumns({name: F.when(test, 1).otherwise(0) for name, test in tests.items()})


def quantile_flag(df: DataFrame, column: str, p: float, out: str) -> DataFrame:
    """1 where the column is over its exact quantile."""
    (edge,) = quantiles(df, {column: [p]})[column]
    return df.withColumn(out, F.when(F.col(column) > F.lit(edge), 1).otherwise(0))


def weighted(*parts: tuple[Column, float]) -> Column:
    """Sum of columns times weights."""
    terms = [c * w for c, w in parts]
    return sum(terms[1:], terms[0])


def points(rules: Iterable[tuple[Column, int]]) -> Column:
    """Sum of the points of the rules that hold."""
    terms = [F.when(test, F.lit(n)).otherwise(F.lit(0)).cast("long") for test, n in rules]
    return sum(terms[1:], terms[0])


def levels(column: str, over: list[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that the column is over."""
    out = F.when(F.col(column) > over[0][0], over[0][1])
    for bound, label in over[1:]:
        out = out.when(F.col(column) > bound, label)
    return out.otherwise(default)


def mapped(column: str, values: dict, default) -> Column:
    """The value that a dictionary gives, else the default."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default))


def overwrite(df: DataFrame, column: str, mask: Column, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(mask, value).otherwise(F.col(column)))


def rate(test: Column) -> Column:
    """Share of rows for which a predicate holds, null counting as no."""
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def clip(column: str, low=None, high=None) -> Column:
    out = F.col(column)
    out = out if low is None else F.greatest(out, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def row_sum(columns: list[str]) -> Column:
    terms = [F.coalesce(F.col(c), F.lit(0)) for c in columns]
    return sum(terms[1:], terms[0])


def row_min(columns: list[str]) -> Column:
    return F.least(*columns)


def row_max(columns: list[str]) -> Column:
    return F.greatest(*columns)


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes from 0 in the sorted order of the distinct values; null stays null. Made for columns of few values."""
    values = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct().agg(F.array_sort(F.collect_list(column)).alias("_values"))
    return df.join(F.broadcast(values)).withColumn(out, F.array_position("_values", F.col(column)) - 1).drop("_values")


def ordered_codes(column: str, order: list[str]) -> Column:
    """Place in a given order from 0; -1 for others."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(column)) - 1


def stress(df: DataFrame, column: str, shocks: dict[str, float]) -> DataFrame:
    """A row for each row and scenario, with the column moved by the scenario's relative shock."""
    scenarios = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("shock")) for k, v in shocks.items()]))
    return df.withColumn("_s", scenarios).select(*df.columns, "_s.scenario", (F.col(column) * (1 + F.col("_s.shock"))).alias("stressed"))
