"""Exact nearest neighbours, densities and imputation over all rows, grid clusters, and isolation forests.

Neighbours are sought in cells of a tree of cuts. Its cuts follow a bounded sample; all rows are in its cells and
each search ends only where no other cell can hold a nearer row. Isolation forests and `k_distances` see a hash
sample of rows, as their methods have it.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that `k_distances` compares.
LIMIT = 2000
#: Rows that the cuts of the cells are taken from, rows wanted in a cell, and the fewest rows of the sample in one.
CUT_ROWS, CELL_ROWS, LEAST_ROWS = 262_144, 1000, 16


def reference(df: DataFrame, keys: list[str], columns: list[str], limit: int = LIMIT, seed: int = 42) -> np.ndarray:
    """A deterministic sample of rows without nulls, as a matrix."""
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna().orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(limit)
    return rows.select(*columns).toPandas().to_numpy(dtype=float).reshape(-1, len(columns))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0))


def _with(df: DataFrame, columns: list[str], out: str, kind: str, f) -> DataFrame:
    schema = ", ".join([*[f"`{s.name}` {s.dataType.simpleString()}" for s in df.schema], f"`{out}` {kind}"])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: f(pdf[columns].to_numpy(dtype=float))})

    return df.mapInPandas(run, schema)


class Cells:
    """Boxes that cover the space, cut where a sample is halved."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.count = 0
        self.root = self._grow(sample, wanted)

    def _grow(self, x: np.ndarray, wanted: int):
        if wanted > 1 and len(x) >= 2 * LEAST_ROWS:
            j = int(np.argmax(np.ptp(x, axis=0)))
            cut = float(np.median(x[:, j]))
            left = x[:, j] < cut
            if left.any():
                return j, cut, self._grow(x[left], wanted // 2), self._grow(x[~left], wanted - wanted // 2)
        self.count += 1
        return self.count - 1

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells that a ball around each row meets; with radius 0 the one cell of the row."""
        rows, cells = [], []

        def walk(node, at):
            if not len(at):
                return
            if not isinstance(node, tuple):
                rows.append(at)
                cells.append(np.full(len(at), node))
                return
            j, cut, left, right = node
            walk(left, at[x[at, j] - radius[at] < cut])
            walk(right, at[x[at, j] + radius[at] >= cut])

        walk(self.root, np.arange(len(x)))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, int), np.empty(0, int))


def _closest(q: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, n: np.ndarray, k: int, same: bool):
    """Of each row of q the points of y that hold its k nearest rows, all of the last distance: blocks of (row, point, d, n, k-th d)."""
    step = max(1, 1_000_000 // max(1, len(y)))
    for at in range(0, len(q), step):
        x = q[at : at + step]
        d = sum((x[:, j, None] - y[None, :, j]) ** 2 for j in range(q.shape[1]))
        rows = np.broadcast_to(n, d.shape).copy()
        if same:
            rows -= own[at : at + step, None] == ids[None, :]
        order = np.argsort(d, axis=1, kind="stable")
        near, upto = np.take_along_axis(d, order, 1), np.cumsum(np.take_along_axis(rows, order, 1), axis=1)
        last = np.full(len(x), np.inf)
        full = upto[:, -1] >= k if len(y) else np.zeros(len(x), bool)
        last[full] = near[full, (upto[full] >= k).argmax(axis=1)]
        i, j = np.nonzero((d <= last[:, None]) & (rows > 0))
        yield at + i, j, np.sqrt(d[i, j]), rows[i, j], np.sqrt(last)


def nearest(queries: DataFrame, points: DataFrame, columns: list[str], k: int, same: bool = False) -> DataFrame:
    """(_q, _p, d, w): how the k rows nearest to each query are spread over points; exact, whatever the number of rows.

    queries: _q and columns; points: _p, _n and columns, where _n rows share a point; both written tables without
    nulls. Rows at the last distance share the places left equally, so no order among ties is needed. With same, _q
    and _p name the same points and a row isn't its own neighbour. Fewer than k rows: all of them.
    A first look into a query's own cell bounds its distance; then it visits the cells within that distance.
    """
    spark = points.sparkSession
    sample = reference(points, ["_p"], columns, CUT_ROWS)
    asked = sample if same else reference(queries, ["_q"], columns, CUT_ROWS)
    rows = points.count() + (0 if same else queries.count())
    tree = Cells(sample if same else np.concatenate([sample, asked]), -(-rows // CELL_ROWS))  # cut for queries too, so that no cell gathers them
    cells = spark.sparkContext.broadcast((tree, sample[:LIMIT]))
    xs = ", ".join(f"`{c}` double" for c in columns)

    def placed(batches):
        for pdf in batches:
            row, cell = cells.value[0].reached(pdf[columns].to_numpy(float), np.zeros(len(pdf)))
            yield pdf.iloc[row].assign(_cell=cell)

    def bounded(q, y):
        x, r = q[columns].to_numpy(float), [np.empty(0)]
        for *_, last in _closest(x, q["_q"].to_numpy(), y[columns].to_numpy(float), y["_p"].to_numpy(), y["_n"].to_numpy(), k, same):
            r.append(last)
        return q[["_q", *columns]].assign(_r=np.concatenate(r))

    def visits(batches):
        for pdf in batches:
            x, r = pdf[columns].to_numpy(float), pdf["_r"].to_numpy().copy()
            open_, rows = np.flatnonzero(np.isinf(r)), cells.value[1]
            if len(open_) and len(rows) > k:  # too few rows in its cell: the sample's rows bound the distance
                r[open_] = np.sort(_distances(x[open_], rows), axis=1)[:, k]
            row, cell = cells.value[0].reached(x, r * (1 + 1e-9) + 1e-9)
            yield pdf.iloc[row][["_q", *columns]].assign(_cell=cell)

    def found(q, y):
        out = [pd.DataFrame({"_q": q["_q"].to_numpy()[i], "_p": y["_p"].to_numpy()[j], "d": d, "n": n}) for i, j, d, n, _ in _closest(q[columns].to_numpy(float), q["_q"].to_numpy(), y[columns].to_numpy(float), y["_p"].to_numpy(), y["_n"].to_numpy(), k, same)]
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_p": [], "d": [], "n": []})

    there = points.select("_p", "_n", *columns).mapInPandas(placed, f"_p long, _n long, {xs}, _cell long").groupBy("_cell")
    first = queries.select("_q", *columns).mapInPandas(placed, f"_q long, {xs}, _cell long").groupBy("_cell")
    within = first.cogroup(there).applyInPandas(bounded, f"_q long, {xs}, _r double")
    sought = within.mapInPandas(visits, f"_q long, {xs}, _cell long").groupBy("_cell")
    pairs = sought.cogroup(there).applyInPandas(found, "_q long, _p long, d double, n long")
    at_d, before = F.sum("n").over(Window.partitionBy("_q", "d")), F.sum("n").over(Window.partitionBy("_q").orderBy("d"))
    ranked = pairs.withColumn("at_d", at_d).withColumn("before", before - F.col("at_d")).where(F.col("before") < k)
    return ranked.select("_q", "_p", "d", (F.col("n") * F.least("at_d", k - F.col("before")) / F.col("at_d")).alias("w"))


def _points(df: DataFrame, columns: list[str], name: str, *more) -> DataFrame:
    """The different points of df with numbers and, if wanted, sums over their rows; written."""
    from plinth.sources.tables import durable

    points = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), *more)
    return durable(points.withColumn(name, F.monotonically_increasing_id()))


def knn_impute(df: DataFrame, keys: list[str], columns: list[str], k: int = 5) -> DataFrame:
    """Nulls become the mean of the k rows without nulls that are nearest in the columns present.

    All rows are searched, ties at the last distance share its places (so keys aren't needed), and rows with no column
    present get the means. Without a row that has all columns, nulls stay. Columns become doubles.
    """
    wide = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    donors = wide.select(*columns).dropna()
    gaps = wide.select(*[F.col(c).isNull().alias(c) for c in columns]).distinct().collect()  # at most 2 to the number of columns
    out = wide.withColumns({f"_old_{c}": F.col(c) for c in columns})
    for gap in gaps:
        here, absent = [c for c in columns if not gap[c]], [c for c in columns if gap[c]]
        if not absent:
            continue
        if here:
            points = _points(donors, here, "_p", *[F.avg(c).alias(f"_new_{c}") for c in absent])
            queries = _points(wide.where(" AND ".join(f"`{c}` IS {'' if gap[c] else 'NOT '}NULL" for c in columns)).select(*here), here, "_q")
            near = nearest(queries, points, here, k).join(points.select("_p", *[f"_new_{c}" for c in absent]), "_p")
            fill = near.groupBy("_q").agg(*[(F.sum(F.col("w") * F.col(f"_new_{c}")) / F.sum("w")).alias(f"_new_{c}") for c in absent])
            fill = queries.join(fill, "_q").select(*[F.col(c).alias(f"_at_{c}") for c in here], *[f"_new_{c}" for c in absent])
        else:
            fill = donors.agg(*[F.avg(c).alias(f"_new_{c}") for c in absent])
        match = F.lit(True)
        for c in columns:
            match = match & (F.col(f"_old_{c}").isNull() if gap[c] else F.col(f"_old_{c}") == F.col(f"_at_{c}"))
        out = out.join(fill, match, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in absent})
        out = out.drop(*[f"_new_{c}" for c in absent], *[f"_at_{c}" for c in here])
    return out.select(*df.columns)


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = 3) -> DataFrame:
    """Nulls start as means; then each column is predicted from the others by linear regression, round after round.

    A regression needs only sums of products, so each is one aggregation.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    gaps = {c: F.col(c).isNull() for c in columns}
    out = df.withColumns({f"_gap_{c}": gaps[c] for c in columns}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})
    for _ in range(rounds):
        for c in columns:
            others = [o for o in columns if o != c]
            terms = [F.lit(1.0), *[F.col(o) for o in others]]
            known = out.where(~F.col(f"_gap_{c}"))
            sums = known.agg(*[F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)], *[F.sum(a * F.col(c)).alias(f"t{i}") for i, a in enumerate(terms)]).first()
            n = len(terms)
            a = np.array([[sums[f"s{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)]) + 1e-9 * np.eye(n)
            w = np.linalg.solve(a, np.array([sums[f"t{i}"] or 0.0 for i in range(n)]))
            fitted = sum((F.lit(float(x)) * t for x, t in zip(w[1:], terms[1:], strict=True)), F.lit(float(w[0])))
            out = out.withColumn(c, F.when(F.col(f"_gap_{c}"), fitted).otherwise(F.col(c)))
    return out.drop(*[f"_gap_{c}" for c in columns])


def local_outlier_factor(df: DataFrame, keys: list[str], columns: list[str], k: int = 20) -> DataFrame:
    """Adds lof: density of the k nearest rows over the row's own; about 1 inside, larger for outliers.

    All rows are searched; equal rows share a point and a result, and ties at the last distance share its places, so
    keys aren't needed. A row with a null has no lof; a row without neighbours has 1.
    """
    from plinth.sources.tables import durable

    wide = df.select("*", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    xs = [f"_x{i}" for i in range(len(columns))]
    points = _points(wide.select(*xs).dropna(), xs, "_p")
    near = durable(nearest(points.withColumnRenamed("_p", "_q"), points, xs, k, same=True))
    far = near.groupBy(F.col("_q").alias("_p")).agg(F.max("d").alias("far"))
    dense = durable(near.join(far, "_p").groupBy("_q").agg((1 / F.greatest(F.sum(F.col("w") * F.greatest("d", "far")) / F.sum("w"), F.lit(1e-12))).alias("own")))
    around = near.join(dense.select(F.col("_q").alias("_p"), F.col("own").alias("other")), "_p").groupBy("_q").agg((F.sum(F.col("w") * F.col("other")) / F.sum("w")).alias("other"))
    lof = around.join(dense, "_q").select(F.col("_q").alias("_p"), (F.col("other") / F.col("own")).alias("lof"))
    scored = points.join(lof, "_p", "left").select(*xs, F.coalesce("lof", F.lit(1.0)).alias("lof"))
    return wide.join(scored, xs, "left").select(*df.columns, "lof")


def isolation_forest(df: DataFrame, keys: list[str], columns: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds isolation, 0 to 1: close to 1 for rows that random cuts set apart early. Trees see small samples, as the method has it."""
    pool = reference(df, keys, columns, trees * sample // 4 or 1)
    rng = random.Random(seed)

    def grow(rows: np.ndarray, depth: int):
        if len(rows) <= 1 or depth >= math.ceil(math.log2(max(sample, 2))):
            return _average_path(len(rows))
        j = rng.randrange(len(columns))
        low, high = rows[:, j].min(), rows[:, j].max()
        if low == high:
            return _average_path(len(rows))
        at = rng.uniform(low, high)
        return (j, at, grow(rows[rows[:, j] < at], depth + 1), grow(rows[rows[:, j] >= at], depth + 1))

    size = min(sample, len(pool))
    forest = [grow(pool[rng.sample(range(len(pool)), size)], 0) for _ in range(trees)] if size else []
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(x):
        x = np.nan_to_num(x)
        total = np.zeros(len(x))

        def walk(node, at, depth):
            if not len(at):
                return
            if not isinstance(node, tuple):
                total[at] += depth + node
                return
            j, cut, left, right = node
            low = x[at, j] < cut
            walk(left, at[low], depth + 1)
            walk(right, at[~low], depth + 1)

        for tree in shared.value:
            walk(tree, np.arange(len(x)), 0)
        return 2 ** (-(total / max(1, len(shared.value))) / max(_average_path(size), 1e-9))

    return _with(df, columns, "isolation", "double", score)


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _square(gaps: list):
    return sum((g * g for g in gaps), F.lit(0.0))


def _gap(a: list, b: list):
    """The least square distance between boxes of (low, high) columns; rounding keeps it at most that of any two of their points."""
    return _square([F.greatest(F.lit(0.0), c - h, l - g) for (l, h), (c, g) in zip(a, b, strict=True)])


def _reach(a: list, b: list):
    """The largest square distance between boxes, at least that of any two of their points."""
    return _square([F.greatest(g - l, h - c) for (l, h), (c, g) in zip(a, b, strict=True)])


def _box(name: str, d: int) -> list:
    return [(F.col(f"{name}l{i}"), F.col(f"{name}h{i}")) for i in range(d)]


def _boxes(df: DataFrame, name: str, d: int, *more) -> DataFrame:
    return df.select(F.col("cell").alias(name), *[F.col(f"{e}{i}").alias(f"{name}{e}{i}") for i in range(d) for e in ("l", "h")], *more)


def _near(a: DataFrame, b: DataFrame, d: int, eps: float, width: float) -> DataFrame:
    """Boxes a and b, no wider than eps, between which points within eps may lie; they meet in a grid of width 2 eps or more."""
    for i in range(d):
        at = F.floor(F.col(f"al{i}") / width).cast("long")
        a, b = a.withColumn(f"g{i}", F.explode(F.array(at - 1, at, at + 1))), b.withColumn(f"g{i}", F.floor(F.col(f"bl{i}") / width).cast("long"))
    grid = [f"g{i}" for i in range(d)]
    return a.join(b, grid).where(_gap(_box("a", d), _box("b", d)) <= eps * eps).drop(*grid)


def _touch(x: np.ndarray, y: np.ndarray, square: float) -> bool:
    """Whether a point of x and one of y are near: halves of the boxes whose distances leave it open."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        (xl, xh), (yl, yh) = (x.min(0), x.max(0)), (y.min(0), y.max(0))
        if (np.maximum(0, np.maximum(yl - xh, xl - yh)) ** 2).sum() > square:
            continue
        if (np.maximum(yh - xl, xh - yl) ** 2).sum() <= square:
            return True
        if len(x) * len(y) <= 4096:
            if (sum((x[:, j, None] - y[None, :, j]) ** 2 for j in range(x.shape[1])) <= square).any():
                return True
            continue
        if len(x) < len(y):
            x, y = y, x
        order = np.argpartition(x[:, j := int(np.argmax(np.ptp(x, axis=0)))], len(x) // 2)
        halves = [x[order[: len(x) // 2]], x[order[len(x) // 2 :]]]
        near = sorted(halves, key=lambda h: -abs(h[:, j].mean() - y[:, j].mean()))
        todo += [(h, y) for h in near]  # the nearer half is looked at first
    return False


def _smallest(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """vertices (v), links (a, b) -> (v, l): the smallest vertex that each one reaches, by propagation with pointer jumping."""
    from plinth.sources.tables import durable

    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = vertices.select("v", F.col("v").alias("l"))
    while True:
        seen = both.join(label.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        moved = label.join(seen, "v", "left").select("v", "l", F.least("l", "m").alias("m"))
        jumped = moved.join(label.select(F.col("v").alias("m"), F.col("l").alias("far")), "m").select("v", "l", F.least("m", "far").alias("m"))
        jumped = durable(jumped)
        label = jumped.select("v", F.col("m").alias("l"))
        if jumped.where("l <> m").isEmpty():
            return label


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int) -> DataFrame:
    """(key, cluster): DBSCAN in few dimensions; noise is -1, clusters are named by their smallest core key.

    Exact, without pairs of dense places. Equal rows are one point. Any two points of a grid cell are within eps, so
    all points of a cell of `least` rows are core and the core points of a cell share a cluster. Only points of
    other cells, fewer than `least` in each, are compared with the points around them. Cells of core points are linked
    by the distances of their boxes and outermost points; where that leaves cells of different clusters open,
    their points are searched. A border point joins its nearest core point's cluster. Rows with a null are left out; a row at
    infinity is noise.
    """
    from plinth.sources.tables import durable

    d = len(columns)
    xs, square = [f"x{i}" for i in range(d)], eps * eps
    rows = durable(df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)]).dropna())
    finite = rows.where(" AND ".join(f"abs({x}) < double('Infinity')" for x in xs))
    points = durable(finite.groupBy(*xs).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")))
    most = points.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(x)) for x in xs]).alias("most")).first()["most"] or 0.0
    error = most * 2.0**-50  # of a quotient's floor, in the columns' unit
    side, width = eps / math.sqrt(d) * (1 - 1e-6) - error, 2 * (eps * (1 + 1e-6) + error)
    grid = [(F.floor(F.col(x) / side).cast("long") if side > eps / 1000 else F.col(x)).alias(f"c{i}") for i, x in enumerate(xs)]
    points = points.select("*", *grid)
    cs = [f"c{i}" for i in range(d)]
    edges = [f(x).alias(f"{e}{i}") for i, x in enumerate(xs) for e, f in (("l", F.min), ("h", F.max))]
    cells = durable(points.groupBy(*cs).agg(F.sum("n").alias("rows"), *edges).withColumn("cell", F.monotonically_increasing_id()))
    dense = F.col("rows") >= least
    placed = durable(points.join(cells.select(*cs, "cell", dense.alias("dense")), cs).select("cell", "dense", "n", "k", *xs).withColumn("p", F.monotonically_increasing_id()))
    others = placed.select(F.col("cell").alias("b"), F.col("n").alias("m"), F.col("p").alias("o"), *[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)])
    at, apart = [(F.col(x), F.col(x)) for x in xs], _square([F.col(x) - F.col(f"y{i}") for i, x in enumerate(xs)])

    around = durable(_near(_boxes(cells.where(~dense), "a", d), _boxes(cells, "b", d, "rows"), d, eps, width))
    visits = placed.where("NOT dense").select("cell", "p", *xs).join(around.withColumnRenamed("a", "cell"), "cell").where(_gap(at, _box("b", d)) <= square)
    whole = _reach(at, _box("b", d)) <= square
    counted = visits.where(whole).select("p", F.col("rows").alias("m")).unionByName(visits.where(~whole).join(others, "b").where(apart <= square).select("p", "m"))
    found = counted.groupBy("p").agg(F.sum("m").alias("m")).where(F.col("m") >= least).select("p", F.lit(True).alias("found"))
    placed = durable(placed.join(found, "p", "left").withColumn("core", F.col("dense") | F.coalesce("found", F.lit(False))).drop("dense", "found"))
    core = placed.where("core")

    point = F.array(*xs)
    signs = [[(1, -1)[n >> i & 1] for i in range(d)] for n in range(1 << d)] if d <= 3 else []
    ways = [*[s * F.col(x) for x in xs for s in (1, -1)], *[sum((s * F.col(x) for s, x in zip(sign, xs, strict=True)), F.lit(0.0)) for sign in signs]]
    cores = durable(core.groupBy("cell").agg(F.min("k").alias("k"), *edges, F.array_distinct(F.array(*[F.max_by(point, w) for w in ways])).alias("ends")))
    pairs = _near(_boxes(cores, "a", d, F.col("ends").alias("u")), _boxes(cores, "b", d, F.col("ends").alias("w")), d, eps, width).where("a < b")
    ends = F.exists("u", lambda u: F.exists("w", lambda w: _square([F.get(u, F.lit(i)) - F.get(w, F.lit(i)) for i in range(d)]) <= square))
    pairs = durable(pairs.withColumn("linked", (_reach(_box("a", d), _box("b", d)) <= square) | ends).drop("u", "w"))
    label = _smallest(cores.select(F.col("cell").alias("v")), pairs.where("linked"))
    name = lambda v, l: label.select(F.col("v").alias(v), F.col("l").alias(l))
    left = durable(pairs.where("NOT linked").join(name("a", "la"), "a").join(name("b", "lb"), "b").where("la <> lb"))
    if not left.isEmpty():
        between = ["la", "lb", "a", "b"]
        sides = [core.select(F.col("cell").alias(v), *xs).join(left, v).where(_gap(at, _box(o, d)) <= square).select(*[F.col(c).alias(f"{c}_{v}") for c in (*between, *xs)]) for v, o in (("a", "b"), ("b", "a"))]
        sides = [side.groupBy(*side.columns[:4]) for side in sides]

        def touching(x, y):
            hit = len(x) and len(y) and _touch(x.iloc[:, 4:].to_numpy(float), y.iloc[:, 4:].to_numpy(float), square)
            return pd.DataFrame({"a": x["la_a"][:1], "b": x["lb_a"][:1]} if hit else {"a": [], "b": []})

        joined = _smallest(label.select(F.col("l").alias("v")).distinct(), sides[0].cogroup(sides[1]).applyInPandas(touching, "a long, b long").distinct())
        label = label.join(joined.select(F.col("v").alias("l"), F.col("l").alias("to")), "l").select("v", F.col("to").alias("l"))
    named = label.join(cores.select(F.col("cell").alias("v"), "k"), "v")
    cluster = durable(named.join(named.groupBy("l").agg(F.min("k").alias("cluster")), "l").select(F.col("v").alias("cell"), "cluster"))

    visits = placed.where("NOT core").select("cell", "p", *xs).join(around.withColumnRenamed("a", "cell"), "cell").where(_gap(at, _box("b", d)) <= square)
    there = others.join(core.select(F.col("p").alias("o")), "o", "left_semi").join(cluster.withColumnRenamed("cell", "b"), "b")
    border = visits.drop("cell").join(there, "b").select(*xs, apart.alias("d"), "cluster").where(F.col("d") <= square)
    border = border.groupBy(*xs).agg(F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))
    known = core.join(cluster, "cell").select(*xs, "cluster").unionByName(border)
    return rows.join(known, xs, "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def k_distances(df: DataFrame, keys: list[str], columns: list[str], k: int = 5, limit: int = LIMIT) -> pd.DataFrame:
    """Sorted distances to the k-th neighbour within the reference sample, to read eps from the knee."""
    y = reference(df, keys, columns, limit)
    d = np.sort(_distances(y, y), axis=1)
    return pd.DataFrame({"rank": range(len(y)), "distance": np.sort(d[:, min(k, max(len(y) - 1, 0))])[::-1] if len(y) else []})
