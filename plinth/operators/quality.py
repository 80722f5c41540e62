"""Profiles, validation rules and schema checks of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUES = "severity string, category string, message string, column_name string, details map<string,string>"


def missing_profile(df: DataFrame) -> DataFrame:
    """(column_name, missing, pct) in one pass."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("missing"), (100 * F.avg(F.col(c).isNull().cast("double"))).alias("pct")) for c in df.columns]
    return df.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def roles(df: DataFrame) -> dict[str, str]:
    """Role of each column: empty, datetime, binary, text, categorical or numerical, from one pass."""
    aggs = []
    for f in df.schema:
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"n|{f.name}"), F.countDistinct(c).alias(f"d|{f.name}")]
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.avg(F.length(c)).alias(f"l|{f.name}"))
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.count_if(~c.isin(0, 1)).alias(f"o|{f.name}"))
    s = df.agg(*aggs).first().asDict()
    out = {}
    for f in df.schema:
        n, d = s[f"n|{f.name}"], s[f"d|{f.name}"]
        if not n:
            out[f.name] = "empty"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "datetime"
        elif isinstance(f.dataType, T.BooleanType) or (isinstance(f.dataType, T.NumericType) and d == 2 and not s[f"o|{f.name}"]):
            out[f.name] = "binary"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "numerical"
        elif d > 0.5 * n:
            out[f.name] = "text"
        elif d <= 20:
            out[f.name] = "categorical"
        else:
            out[f.name] = "text" if (s.get(f"l|{f.name}") or 0) > 20 else "categorical"
    return out


def task_type(df: DataFrame, target: str) -> str:
    """classification for at most 20 values of a whole-number, boolean or text target, or values under a tenth of the rows."""
    s = df.agg(F.countDistinct(target).alias("d"), F.count(target).alias("n")).first()
    whole = isinstance(df.schema[target].dataType, (T.IntegralType, T.BooleanType, T.StringType))
    return "classification" if s["d"] <= 20 and (whole or s["d"] < 0.1 * s["n"]) else "regression"


def size_class(rows: int, columns: int) -> tuple[str, str]:
    return ("small" if rows < 1000 else "medium" if rows < 10000 else "large"), ("high" if columns > 100 else "medium" if columns > 20 else "low")


def severity(share: float) -> str:
    """info below 5 % missing, warning below 20 %, error below 50 %, else critical."""
    return next((name for bound, name in ((0.05, "info"), (0.2, "warning"), (0.5, "error")) if share < bound), "critical")


def validate(df: DataFrame, target: str | None = None) -> list[tuple]:
    """Issues of a table as (severity, category, message, column, details), from three passes."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"m|{c}"), F.approx_count_distinct(c).alias(f"d|{c}")]
    for c in numbers:
        aggs.append(F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"i|{c}"))
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for c in texts:
        aggs.append(F.count_if(F.expr(f"try_cast(`{c}` AS double) IS NOT NULL")).alias(f"x|{c}"))
    s = df.agg(*aggs).first().asDict()
    n = s["_n"]
    if not n:
        return [("critical", "empty", "the table has no rows", None, {})]
    out = [("warning", "size", "small dataset", None, {"rows": str(n)})] if n < 50 else []
    for c in df.columns:
        if s[f"m|{c}"]:
            out.append((severity(s[f"m|{c}"] / n), "missing", "missing values", c, {"missing_count": str(s[f"m|{c}"])}))
        if s[f"d|{c}"] <= 1:
            out.append(("warning", "constant", "constant column", c, {}))
    for c in numbers:
        if s[f"i|{c}"]:
            out.append(("error", "infinite", "infinite values", c, {"infinite_count": str(s[f"i|{c}"])}))
    for c in texts:
        if s[f"d|{c}"] > 50:
            out.append(("info", "cardinality", "high cardinality", c, {"distinct": str(s[f"d|{c}"])}))
        if s[f"x|{c}"] and s[f"x|{c}"] == n - s[f"m|{c}"]:
            out.append(("info", "type", "numeric strings need type conversion", c, {}))
    extra = df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1)).first()[0]
    if extra:
        out.append(("warning", "duplicates", "duplicate rows", None, {"duplicate_count": str(extra)}))
    if target:
        g = df.groupBy(target).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("a"), F.max("count").alias("b")).first()
        if g["k"] == 1:
            out.append(("critical", "target", "a single class", target, {}))
        elif task_type(df, target) == "classification" and g["a"] / g["b"] < 0.1:
            out.append(("warning", "target", "class imbalance", target, {"ratio": f"{g['a'] / g['b']:.4f}"}))
    return out


def issues(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame(validate(df, target), ISSUES)


def check_schema(df: DataFrame, required: dict[str, str], ranges: dict[str, tuple[float, float]] | None = None, categories: dict[str, list] | None = None) -> list[str]:
    """Errors: missing columns, wrong types, values outside inclusive ranges or categories; extra columns are fine."""
    kinds = {"int": T.IntegralType, "float": (T.FractionalType, T.IntegralType), "object": T.StringType, "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "bool": T.BooleanType}
    out, tests = [], {}
    for c, kind in required.items():
        if c not in df.columns:
            out.append(f"missing column {c}")
        elif not isinstance(df.schema[c].dataType, kinds[kind]):
            out.append(f"column {c} is not {kind}")
    for c, (low, high) in (ranges or {}).items():
        if c in df.columns:
            tests[f"column {c} outside [{low}, {high}]"] = (F.col(c) < low) | (F.col(c) > high)
    for c, allowed in (categories or {}).items():
        if c in df.columns:
            tests[f"column {c} has unknown values"] = F.col(c).isNotNull() & ~F.col(c).isin(allowed)
    if tests:
        s = df.agg(*[F.count_if(t).alias(str(i)) for i, t in enumerate(tests.values())]).first()
        out += [f"{name}: {s[i]} rows" for i, name in enumerate(tests) if s[i]]
    return out
