"""Whole preparations in one call: encoders that choose by cardinality, preprocessors with a summary, stacked features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators import features as X


def _kinds(df: DataFrame, leave: tuple) -> tuple[list[str], list[str]]:
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave]
    return numbers, [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in leave]


def encoding_plan(df: DataFrame, columns: list[str], y: str | None = None, low: int = 10, high: int = 50) -> dict[str, str]:
    """onehot for at most `low` values, target (label without y) for at most `high`, label for more; one aggregation."""
    n = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first() if columns else {}
    return {c: "onehot" if n[c] <= low else "label" if n[c] > high or y is None else "target" for c in columns}


def bits(df: DataFrame, column: str) -> X.Fitted:
    """The bits of a value's label code, lowest first; unknown values are all zeros."""
    values = X._values(df, column)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0))
    return X.Fitted({f"{column}_{i}": F.shiftright(code, i).bitwiseAND(F.lit(1)).cast("int") for i in range(max(1, len(values).bit_length()))}, [column])


def codes(df: DataFrame, column: str, y: str) -> Column:
    """Mean of y by value as an expression, the global mean for unknown values; for columns of at most X.MAX_VALUES values."""
    g = df.groupBy(column).agg(F.avg(y).alias("m")).where(F.col(column).isNotNull()).limit(X.MAX_VALUES + 1).collect()
    if len(g) > X.MAX_VALUES:
        raise ValueError(f"{column} has too many values; use target()")
    base = F.lit(df.agg(F.avg(y)).first()[0])
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for r in g for x in (r[0], r[1])]), F.col(column)), base) if g else base


@dataclass
class Encoder:
    """Encodes string columns by the plan that fit() chose, kept in `strategies`."""

    strategy: str = "auto"
    low: int = 10
    high: int = 50
    strategies: dict[str, str] = field(default_factory=dict)
    steps: list[X.Fitted] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str], y: str | None = None) -> Encoder:
        self.strategies = encoding_plan(df, columns, y, self.low, self.high) if self.strategy == "auto" else dict.fromkeys(columns, self.strategy)
        make = {"onehot": lambda c: X.one_hot(df, c), "label": lambda c: X.label(df, c), "target": lambda c: X.Fitted({c: codes(df, c, y)}), "binary": lambda c: bits(df, c)}
        if unknown := set(self.strategies.values()) - set(make):
            raise ValueError(f"unknown strategies {sorted(unknown)}")
        self.steps = [make[s](c) for c, s in self.strategies.items()]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


@dataclass
class Preprocessor:
    """Impute, drop outlier rows (fit only), scale, encode, select: by flags; transform() never drops rows."""

    missing: str | None = "mean"
    scale: str | None = "standard"
    drop_outliers: bool = False
    encode: bool = True
    top: int | None = None
    summary: dict = field(default_factory=dict)
    steps: list = field(default_factory=list)
    chosen: list[str] | None = None

    def fit(self, df: DataFrame, y: str | None = None, leave: tuple = ()) -> Preprocessor:
        leave = (*leave, *([y] if y else []))
        numbers, strings = _kinds(df, leave)
        self.steps, self.summary = [], {"rows": df.count(), "numbers": numbers, "strings": strings}

        def add(step):
            nonlocal df
            self.steps.append(step)
            df = step.transform(df)

        if self.missing and numbers:
            add(X.impute_numbers(df, numbers, self.missing))
        if strings:
            add(X.Fitted({c: F.coalesce(F.col(c), F.lit(X.mode(df, c, "unknown"))) for c in strings}))
        if self.drop_outliers and numbers:
            df = df.where(~X.zscore_outlier(df, numbers))
            self.summary["outliers"] = self.summary["rows"] - df.count()
        if self.scale and numbers:
            add({"standard": X.standard, "minmax": X.minmax, "robust": X.robust}[self.scale](df, numbers))
        if self.encode and strings:
            encoder = Encoder().fit(df, strings, y)
            self.summary["strategies"] = encoder.strategies
            add(encoder)
        if self.top and y:
            names = [c for c, k in df.dtypes if c not in leave and k in ("double", "int", "bigint", "float")]
            link = df.agg(*[F.abs(F.corr(c, F.col(y).cast("double"))).alias(c) for c in names]).first()
            best = sorted(names, key=lambda c: (-(link[c] if link[c] is not None and link[c] == link[c] else -1.0), c))[: self.top]
            self.chosen = [c for c in df.columns if c in best or c in leave]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df.select(*self.chosen) if self.chosen else df


def adaptive_plan(df: DataFrame, leave: tuple = (), variance: float = 0.01, outliers: float = 0.1, cardinality: int = 50) -> dict[str, str]:
    """What to do with each column: drop (nearly constant), robust, standard, onehot or label."""
    numbers, strings = _kinds(df, leave)
    fences = X.iqr_fences(df, numbers) if numbers else {}
    tests = {c: F.avg((~F.col(c).between(*fences[c])).cast("double")) for c in numbers} | {f"{c} v": F.var_pop(c) for c in numbers} | {c: F.countDistinct(c) for c in strings}
    s = X._one(df, tests) if tests else {}
    plan = {c: "drop" if (s[f"{c} v"] or 0.0) < variance else "robust" if (s[c] or 0.0) > outliers else "standard" for c in numbers}
    return plan | {c: "drop" if s[c] < 2 else "onehot" if s[c] <= cardinality else "label" for c in strings}


def adapt(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    by = lambda kind: [c for c, k in plan.items() if k == kind]
    out = df
    for make, kind in ((X.robust, "robust"), (X.standard, "standard")):
        if by(kind):
            out = make(df, by(kind)).transform(out)
    for c in by("onehot"):
        out = X.one_hot(df, c).transform(out)
    for c in by("label"):
        out = X.label(df, c).transform(out)
    return out.drop(*by("drop"))


def dynamic_union(df: DataFrame, blocks: dict[str, X.Fitted], choose) -> X.Fitted:
    """The union of the blocks that choose(df), called once at fit, names."""
    names = set(choose(df))
    return X.unite({n: b for n, b in blocks.items() if n in names})


def stack(columns: list[str], out: str = "features") -> X.Fitted:
    """Columns as one array of doubles, nulls kept."""
    return X.Fitted({out: F.array(*[F.col(c).cast("double") for c in columns])})


def describe_flow(df: DataFrame, label: str | None = None) -> dict:
    """What passes a point of a pipeline: rows, columns, types, nulls, label counts; df itself is not changed."""
    s = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(1000).collect()} if label else None
    return {"rows": s.pop("_rows"), "columns": len(df.columns), "types": dict(df.dtypes), "nulls": s, "labels": counts}


def downcast_plan(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The smallest integer type that holds each column's values, from one pass."""
    s = X._one(df, {f"a{c}": F.min(c) for c in columns} | {f"b{c}": F.max(c) for c in columns})
    sizes = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))
    return {c: next(k for k, n in sizes if -(1 << n) <= (s[f"a{c}"] or 0) and (s[f"b{c}"] or 0) < 1 << n) for c in columns}


def zip_rows(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Rows of both tables side by side, by their places in given orders; the longer table's rest has nulls."""
    from plinth.operators.order import numbered

    return numbered(left, left_order, "place").join(numbered(right, right_order, "place"), "place", "full")


def update_rows(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns of rows whose key is in `changes` (keys distinct) replaced by the values there."""
    new = changes.select(key, F.struct(*columns).alias("_new"))
    out = df.join(new, key, "left").withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in columns})
    return out.select(*df.columns)
