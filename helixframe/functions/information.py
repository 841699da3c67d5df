"""Mutual information of two continuous variables, by Kraskov's estimator (2004), exact over all rows.

Coordinates are whole numbers: standardised values in units of 2^-44 with a little noise by the row's hash that breaks
ties. Distances and counts are then exact however rows are dealt, and one table gives one estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neighbours import FAR, KdTree, nearest_others
from .special import digamma
from .stages import cut

#: Coordinates in one standard deviation. Values stand within 2^15 deviations of the mean in tables of up to 10^9 rows.
UNIT = 1 << 44
#: Largest noise, in coordinates: about 2e-10 of a deviation.
NOISE = 1 << 12
#: Points that a cell has about, and how many cells' points a range of an axis has.
CELL = 20_000
RANGE = 5
#: Cells of all groups, whose borders are sent to all tasks; more groups get fewer cells each.
MOST_CELLS = 1 << 18
#: Points of one group on which borders are laid, at most; a 64th of it is the most cells of a group.
MOST_SAMPLE = 1 << 18
#: Roles of a row in a range: counted there, counted there and elsewhere, asks only.
ALONE, SHARED, ASKS = 0, 1, 2


def coordinates(v: np.ndarray, noise: np.ndarray) -> np.ndarray:
    return np.rint((v - v.mean()) / (v.std() or 1.0) * UNIT).astype(np.int64) + noise


def ksg(x, y, k: int = 3, seed: int = 42) -> float:
    """Estimate in nats, at least 0, of two arrays in memory, in n log n steps; seeded noise breaks ties."""
    n = len(x)
    if not n:
        return 0.0
    noise = np.random.default_rng(seed).integers(-NOISE, NOISE + 1, (2, n))
    return _estimate(coordinates(np.asarray(x, float), noise[0]), coordinates(np.asarray(y, float), noise[1]), k)


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The estimate of all points of a group in one place; 0 for k points or fewer."""
    n = len(a)
    if n <= k:
        return 0.0
    eps = np.maximum(nearest_others(a, b, k)[0][:, k - 1], 1)  # points at one place count each other
    terms = np.zeros(n)
    for c in (a, b):
        s = np.sort(c)
        terms += digamma(np.searchsorted(s, c + eps, "left") - np.searchsorted(s, c - eps, "right"))
    return float(max(0.0, digamma(np.array([float(k)]))[0] + digamma(np.array([float(n)]))[0] - terms.mean()))


@F.pandas_udf(T.DoubleType())
def _digamma(v: pd.Series) -> pd.Series:
    return pd.Series(digamma(v.to_numpy(float)))


def _integers(rows: DataFrame, group: str, x: str, y: str, key: str) -> DataFrame:
    """g, id, a, b: the rows with both values, as coordinates."""
    own = rows.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    s = own.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))

    def whole(v: str, m: str, s: str, axis: str) -> Column:
        at = F.round((F.col(v) - F.col(m)) / F.when(F.col(s) > 0, F.col(s)).otherwise(F.lit(1.0)) * UNIT).cast("long")
        return at + F.pmod(F.xxhash64(F.lit(axis), F.col("id").cast("string")), F.lit(2 * NOISE + 1)) - NOISE

    return own.join(F.broadcast(s), "g").select("g", "id", whole("x", "mx", "sx", "x").alias("a"), whole("y", "my", "sy", "y").alias("b"))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores by a hash of ``key``: searching takes far longer than moving a row, however few bytes there are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def _by_group(g: pd.Series) -> Iterator[tuple[object, np.ndarray]]:
    """(group, places of its rows in the column)."""
    codes, names = pd.factorize(g)
    order = np.argsort(codes, kind="stable")
    yield from zip(names, np.split(order, np.searchsorted(codes[order], np.arange(1, len(names)))), strict=True)


def _tree(a: np.ndarray, b: np.ndarray, leaves: int, k: int) -> tuple[list[int], list[int], list[int]]:
    """axis (-1: a leaf), cut and upper child of the nodes of a tree with ``leaves`` leaves, in preorder.

    A node is cut, along either axis, where the fewest squares of the points' k-th distances lie over the cut: not
    through equal values, which only their noise tells apart, nor across a side that is narrower than the distances.
    """
    d = np.minimum(nearest_others(a, b, k)[0][:, k - 1], FAR // 4)
    axis, cuts, upper = [], [], []
    todo = [(np.arange(len(a)), leaves, -1)]
    while todo:
        own, want, parent = todo.pop()
        if parent >= 0:
            upper[parent] = len(axis)
        best = None
        for ax, c in enumerate((a, b) if want > 1 and len(own) > 1 else ()):
            v = np.sort(c[own])
            at = np.unique(v[np.unique((len(v) * np.linspace(0.25, 0.75, 17)).astype(int))])
            at = at[at > v[0]]
            over = np.searchsorted(np.sort(c[own] - d[own]), at, "left") - np.searchsorted(np.sort(c[own] + d[own]), at, "left")
            below = np.searchsorted(v, at, "left")
            cost = over + 0.05 * np.abs(below - len(v) / 2)
            if len(at) and (best is None or cost.min() < best[0]):
                i = int(cost.argmin())
                best = (cost[i], ax, int(at[i]), below[i] / len(v))
        axis.append(-1 if best is None else best[1])
        cuts.append(0 if best is None else best[2])
        upper.append(-1)
        if best is not None:
            low = (a, b)[best[1]][own] < best[2]
            first = min(want - 1, max(1, round(want * best[3])))
            todo += [(own[~low], want - first, len(axis) - 1), (own[low], first, -1)]
    return axis, cuts, upper


def _grid(v: np.ndarray, parts: int) -> list[int]:
    """Borders of about ``parts`` equal ranges; where equal values fill several, also borders beside their noise."""
    at = np.unique(np.quantile(v, np.arange(1, parts) / parts, method="nearest").astype(np.int64)) if parts > 1 else np.zeros(0, np.int64)
    close = np.flatnonzero(np.diff(at) <= 2 * NOISE)
    return np.unique(np.concatenate([at, at[close] - 2 * NOISE - 1, at[close + 1] + 2 * NOISE + 1])).tolist()


class _Cells:
    """The cells of all groups, numbered through: trees of cuts along a or b, and each axis' ranges of values."""

    def __init__(self, trees: list):
        self.root, self.ranges, at = {}, {}, 0
        for t in trees:
            self.root[t["g"]] = at
            self.ranges[t["g"]] = tuple(np.array(t[c], np.int64) for c in ("along", "across"))
            at += len(t["axis"])
        whole = lambda c: np.concatenate([np.array(t[c], np.int64) for t in trees])
        self.axis, self.cut, self.upper = whole("axis"), whole("cuts"), whole("upper")
        self.upper += np.repeat(list(self.root.values()), [len(t["axis"]) for t in trees])

    def of(self, g: pd.Series, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        node = g.map(self.root).to_numpy(np.int64)
        while (inner := np.flatnonzero(self.axis[node] >= 0)).size:
            at = node[inner]
            v = np.where(self.axis[at] == 0, a[inner], b[inner])
            node[inner] = np.where(v < self.cut[at], at + 1, self.upper[at])
        return node

    def touched(self, g: object, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell): the cells that the square of half side d around each point of a group meets."""
        point, node = np.arange(len(a)), np.full(len(a), self.root[g])
        p, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(point):
            leaf = self.axis[node] < 0
            p.append(point[leaf])
            c.append(node[leaf])
            point, node = point[~leaf], node[~leaf]
            v, cut_ = np.where(self.axis[node] == 0, a[point], b[point]), self.cut[node]
            low, high = v - d[point] < cut_, v + d[point] >= cut_
            point, node = np.concatenate([point[low], point[high]]), np.concatenate([node[low] + 1, self.upper[node[high]]])
        return np.concatenate(p), np.concatenate(c)


def _partition(points: DataFrame, sizes: DataFrame, kind: str, k: int) -> _Cells:
    """The cells of every group, of about CELL points, and ranges of about RANGE * CELL.

    Borders only say which task has which points, every point counts wherever they are: so they are laid on some points
    of each group, at most MOST_SAMPLE, and only borders come to the driver, at most MOST_CELLS over all groups.
    """
    most = max(1, min(MOST_SAMPLE // 64, MOST_CELLS // max(1, sizes.count())))
    parts = sizes.withColumn("leaves", F.least(F.ceil(F.col("n") / CELL), F.lit(most)).cast("int"))
    parts = parts.withColumn("share", F.least(F.greatest(F.col("leaves") * 256, F.lit(1 << 13)), F.lit(MOST_SAMPLE)) / F.col("n"))
    some = points.join(F.broadcast(parts), "g").filter(F.pmod(F.xxhash64(F.lit("border"), F.col("id").cast("string")), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def lay(f: pd.DataFrame) -> pd.DataFrame:
        a, b, leaves = f["a"].to_numpy(), f["b"].to_numpy(), int(f["leaves"].iloc[0])
        tree, ranges = _tree(a, b, leaves, k), -(-leaves // RANGE)
        return pd.DataFrame({"g": f["g"].head(1), **{n: _lists([v]) for n, v in zip(("axis", "cuts", "upper", "along", "across"), (*tree, _grid(a, ranges), _grid(b, ranges)), strict=True)}})

    laid = some.select("g", "a", "b", "leaves").groupBy("g").applyInPandas(lay, f"g {kind}, axis array<long>, cuts array<long>, upper array<long>, along array<long>, across array<long>")
    trees = {t["g"]: t for t in laid.collect()}
    none = {"axis": [-1], "cuts": [0], "upper": [-1], "along": [], "across": []}  # no row was taken: one cell
    return _Cells([trees.get(r["g"], none | {"g": r["g"]}) for r in sizes.select("g").collect()])


def _lists(arrays: list) -> pd.Series:
    """A column of arrays, of lists even where there are none."""
    return pd.Series(arrays, index=range(len(arrays)), dtype=object)


def _kth(points: DataFrame, cells: _Cells, kind: str, key: str, k: int) -> DataFrame:
    """g, id, a, b, eps: the distance of every point to its k-th nearest other point of the group.

    Each cell finds the k nearest of its own points; where the square so far found leaves the cell, the point asks the
    cells that it meets, and the least k of all answers count. Only points that ask are moved for it.
    """
    shape = f"g {kind}, id {key}, a long, b long"

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cell=cells.of(f["g"], f["a"].to_numpy(), f["b"].to_numpy()))

    dealt = cut(_dealt(points.mapInPandas(deal, f"{shape}, cell long"), "cell"))

    def own(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f["a"].to_numpy(), f["b"].to_numpy()
        d, _ = nearest_others(a, b, k)
        far = np.minimum(d[:, k - 1], FAR // 4)
        point, cell = cells.touched(f["g"].iloc[0], a, b, far)
        other = cell != f["cell"].iloc[0]
        point, cell = point[other], cell[other]
        order = np.argsort(point, kind="stable")
        asking, first = np.unique(point[order], return_index=True)
        found, asks = np.full(len(f), None, object), np.full(len(f), None, object)
        for i, c in zip(asking, np.split(cell[order], first[1:]), strict=False):
            found[i], asks[i] = d[i], c
        return f[["g", "id", "a", "b"]].reset_index(drop=True).assign(eps=d[:, k - 1], found=found, asks=asks)

    local = cut(_dealt(dealt, "cell").groupBy("cell").applyInPandas(own, f"{shape}, eps long, found array<long>, asks array<long>"))
    border = local.filter("asks is not null")
    asks = border.select("g", "id", "a", "b", "eps", F.explode("asks").alias("cell"))

    def answer(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return q[["g", "id"]].head(0).assign(found=_lists([]))
        tree = KdTree(p["a"].to_numpy(), p["b"].to_numpy())
        d = tree.nearest(q["a"].to_numpy(), q["b"].to_numpy(), k, q["eps"].to_numpy())
        some = d[:, 0] < q["eps"].to_numpy()
        return q.loc[some, ["g", "id"]].reset_index(drop=True).assign(found=_lists(list(d[some])))

    more = asks.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInPandas(answer, f"g {kind}, id {key}, found array<long>")
    every = border.select("g", "id", "a", "b", "found").unionByName(more, allowMissingColumns=True)
    least = F.element_at(F.sort_array(F.flatten(F.collect_list("found"))), k)
    met = every.groupBy("g", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"), least.alias("eps"))
    return local.filter("asks is null").select("g", "id", "a", "b", "eps").unionByName(met)


def _range_sizes(points: DataFrame, cells: _Cells, kind: str) -> dict:
    """(g, axis): least and largest value of each range, how many points it has, and how many are in those before it."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, rows in _by_group(f["g"]):
                for axis, name in enumerate(("a", "b")):
                    v = f[name].to_numpy()[rows]
                    v = pd.Series(v).groupby(np.searchsorted(cells.ranges[g][axis], v, "right")).agg(["min", "max", "size"])
                    yield pd.DataFrame({"g": g, "axis": axis, "range": v.index, "low": v["min"], "high": v["max"], "c": v["size"]})

    rows = points.select("g", "a", "b").mapInPandas(measure, f"g {kind}, axis int, range long, low long, high long, c long")
    out = {}
    for g, cuts in cells.ranges.items():
        for axis in (0, 1):
            m = len(cuts[axis]) + 1
            out[g, axis] = [np.full(m, FAR), np.full(m, -FAR), np.zeros(m, np.int64), np.zeros(m, np.int64)]
    for r in rows.groupBy("g", "axis", "range").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("c").alias("c")).collect():  # a row a range
        for column, v in zip(out[r["g"], r["axis"]], (r["low"], r["high"], r["c"]), strict=False):
            column[r["range"]] = v
    for columns in out.values():
        columns[3] = np.cumsum(columns[2]) - columns[2]
    return out


def _counts(eps: DataFrame, cells: _Cells, kind: str) -> DataFrame:
    """g, m, times: how many points have m points (itself counts) nearer than eps on an axis, both axes together.

    Axes are cut into ranges of values. A point is counted in its own range; of the ranges beyond, sizes are known, and
    only where a bound lies among the values of another range the point asks that one.
    """
    sizes = _range_sizes(eps, cells, kind)
    first = dict(zip(sizes, np.cumsum([0] + [len(s[0]) for s in sizes.values()]).tolist(), strict=False))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, rows in _by_group(f["g"]):
                e = np.maximum(f["eps"].to_numpy()[rows], 1)  # points at one place count each other
                row = f["_row"].to_numpy()[rows]
                for axis, name in enumerate(("a", "b")):
                    v, cuts, at = f[name].to_numpy()[rows], cells.ranges[g][axis], first[g, axis]
                    low, high, c, before = sizes[g, axis]
                    home, base, asking = np.searchsorted(cuts, v, "right"), np.zeros(len(v), np.int64), np.zeros(len(v), bool)
                    ends = []
                    # points under the upper bound less those up to the lower one
                    for sign, bound in ((1, v + e), (-1, v - e + 1)):
                        there = np.searchsorted(cuts, bound, "right")
                        away = there != home
                        ends.append(np.where(away, sign * FAR, bound))
                        within = away & (bound > low[there]) & (bound <= high[there])
                        # ranges between, and the bound's own where it lies above all values there
                        known = before[there] + np.where(~within & (bound > high[there]), c[there], 0)
                        base += np.where(away, sign * (known - before[home] - (c[home] if sign > 0 else 0)), 0)
                        asking |= within
                        if within.any():
                            b, none = bound[within], np.full(within.sum(), -FAR)
                            out.append((g, axis, at + there[within], b, b if sign > 0 else none, none if sign > 0 else b, np.zeros(len(b), np.int64), row[within], np.full(len(b), ASKS)))
                    out.append((g, axis, at + home, v, *ends, base, row, np.where(asking, SHARED, ALONE)))
            if out:
                names = ("place", "at", "up", "down", "base", "row", "role")
                sizes_ = [len(o[2]) for o in out]
                group = pd.Series([o[0] for o in out]).repeat(sizes_).reset_index(drop=True)
                yield pd.DataFrame({"g": group, "axis": np.repeat([o[1] for o in out], sizes_), **{n: np.concatenate([o[i] for o in out]) for i, n in enumerate(names, 2)}})

    def count(f: pd.DataFrame) -> pd.DataFrame:
        role = f["role"].to_numpy()
        v = np.sort(f["at"].to_numpy()[role != ASKS])
        m = np.searchsorted(v, f["up"].to_numpy(), "left") - np.searchsorted(v, f["down"].to_numpy(), "left") + f["base"].to_numpy()
        whole, times = np.unique(m[role == ALONE], return_counts=True)
        rest = f["row"].to_numpy()[role != ALONE]
        return pd.DataFrame({"axis": f["axis"].iloc[0], "row": np.append(np.full(len(whole), -1), rest), "m": np.append(whole, m[role != ALONE]), "times": np.append(times, np.ones(len(rest), np.int64))}).assign(g=f["g"].iloc[0])

    numbered = eps.withColumn("_row", F.monotonically_increasing_id()).select("g", "_row", "a", "b", "eps")
    marks = numbered.mapInPandas(bounds, f"g {kind}, axis int, place long, at long, up long, down long, base long, row long, role int")
    counted = cut(_dealt(marks, "place").groupBy("place").applyInPandas(count, f"g {kind}, axis int, row long, m long, times long"))
    shared = counted.filter("row >= 0").groupBy("g", "axis", "row").agg(F.sum("m").alias("m")).select("g", "m", F.lit(1).cast("long").alias("times"))
    return counted.filter("row < 0").select("g", "m", "times").unionByName(shared).groupBy("g", "m").agg(F.sum("times").alias("times"))


def mutual_information(rows: DataFrame, group: str, x: str, y: str, key: str, k: int = 3) -> DataFrame:
    """``group`` and mi, the estimate in nats between ``x`` and ``y`` over all rows of each value of ``group``.

    ``key`` is unique within a group. Rows with a null or NaN in x or y don't count; a group with at most k others has 0.
    Cells hold about CELL points, or more where a group has over CELL * MOST_SAMPLE / 64.
    """
    kind, ident = dict(rows.dtypes)[group], dict(rows.dtypes)[key]
    points = cut(_integers(rows, group, x, y, key))
    sizes = cut(points.groupBy("g").agg(F.count("*").alias("n")))
    # a group that fits one cell is estimated there; the value is the same as by steps
    whole = lambda f: pd.DataFrame({"g": f["g"].head(1), "mi": [_estimate(f["a"].to_numpy(), f["b"].to_numpy(), k)]})
    small = points.join(F.broadcast(sizes.filter(F.col("n") <= CELL)), "g", "left_semi")
    small = _dealt(small, "g").groupBy("g").applyInPandas(whole, f"g {kind}, mi double")
    wide = sizes.filter(F.col("n") > CELL)
    if not wide.limit(1).count():
        return small.withColumnRenamed("g", group)
    many = points.join(F.broadcast(wide), "g", "left_semi")
    cells = _partition(many, wide, kind, k)
    terms = _counts(cut(_kth(many, cells, kind, ident, k)), cells, kind).groupBy("g").agg(F.sum(_digamma(F.col("m").cast("double")) * F.col("times")).alias("t"))
    mi = F.greatest(F.lit(0.0), _digamma(F.lit(float(k))) + _digamma(F.col("n").cast("double")) - F.col("t") / F.col("n"))
    return small.unionByName(wide.join(terms, "g").select("g", mi.alias("mi"))).withColumnRenamed("g", group)
