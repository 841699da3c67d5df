"""Exact nearest neighbours and silhouettes by metric partitioning.

Neighbours: points belong to the nearest of some pivots; a cell is asked only by points for which the triangle
inequality cannot rule it out, given the distance of the k-th neighbour in their own block. Silhouettes: labels whose
mean distance is bounded away from the least one by their moments are left out. Equal vectors are one vector with a
count, so copies never meet each other. Where the bounds rule out little, blocks meet in a square of tasks whose side is
the number of groups of GROUP blocks: a point is moved so many times, not once a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stages import cut

#: Points of a block, and the blocks of a group; two groups meet in one task.
BLOCK = 2000
GROUP = 25
#: A pivot for a quarter of a block of vectors, at most so many: they are sent to all tasks.
MOST_PIVOTS = 1024
#: Neighbours are compared by distances rounded to so many places, then by id.
PLACES = 6


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, float) for a in column])


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All distances; those within rounding of 0 are worked out anew from differences."""
    d = _squares(p, q)
    return np.sqrt(d, out=d)


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    pp, qq = (p * p).sum(1)[:, None], (q * q).sum(1)
    d = (-2 * p) @ q.T
    d += pp
    d += qq
    if d.size and d.min() < 1e-6 * (pp.max() + qq.max()):
        i, j = np.nonzero(d < 1e-6 * (pp + qq))
        d[i, j] = ((p[i] - q[j]) ** 2).sum(1)
        np.maximum(d, 0, out=d)
    return d


def _groups(df: DataFrame, n: int) -> int:
    """Groups of at most GROUP blocks of ``n`` points; enough that all cores have pairs of them."""
    return int(max(np.ceil(n / (GROUP * BLOCK)), np.ceil((2 * df.sparkSession.sparkContext.defaultParallelism) ** 0.5)))


def _every(groups: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))


def _units(*keys: np.ndarray) -> list[np.ndarray]:
    """The places of each distinct combination of ``keys``."""
    if not len(keys[0]):
        return []
    order = np.lexsort(keys)
    new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return np.split(order, np.flatnonzero(new) + 1)


def _lists(rows: list) -> pd.Series:
    return pd.Series(rows, dtype=object)


def _least(d: np.ndarray, ids: list, labels: list, k: int) -> list[tuple[list, list, list]]:
    """Per row of ``d`` (rounded) the k nearest members by distance, then id, as (distances, ids, labels). ``ids`` and
    ``labels`` have the members of each column's vector."""
    m = min(k, d.shape[1])
    limit = np.partition(d, m - 1, axis=1)[:, m - 1]
    out = []
    for row, most in zip(d, limit):
        near = np.flatnonzero(row <= most)
        each = sorted((row[j], i, lab) for j in near for i, lab in zip(ids[j], labels[j]))[:k]
        out.append(tuple(map(list, zip(*each))))
    return out


_NEAR = "found array<double>, ids array<long>, labels array<int>, seen long"


def nearest(points: DataFrame, k: int) -> DataFrame:
    """rep, found, ids, labels, seen: of every distinct vector of ``points`` (vec_id, embedding, label) the k
    nearest members of the table, itself among them, by rounded distance, then id; a row for each block that was asked
    (``seen`` distances were worked out there), the least of them together count.
    """
    # the first k ids of a vector are all that any point can need of it
    place = F.row_number().over(W.partitionBy("embedding", "_part").orderBy("vec_id"))
    thinned = points.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_p", place).filter(F.col("_p") <= k)
    members = thinned.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "label"))), 1, k).alias("m"))
    vectors = cut(members.select(F.col("m")[0]["vec_id"].alias("rep"), "embedding", F.col("m.vec_id").alias("ids"), F.col("m.label").alias("labels")))
    n = vectors.count()
    count = int(min(MOST_PIVOTS, max(1, n // max(1, BLOCK // 4))))
    chosen = vectors.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(count).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], f"rep long, {_NEAR}")
    pivots = np.array([r["embedding"] for r in chosen], float)

    def assign(frames):
        for f in frames:
            if len(f):
                d = _distances(_stack(f["embedding"]), pivots)
                cell = d.argmin(axis=1)
                yield f.assign(cell=cell, r=d[np.arange(len(f)), cell])

    shape = "rep long, embedding array<double>, ids array<long>, labels array<int>"
    dealt = cut(vectors.mapInPandas(assign, f"{shape}, cell long, r double"))
    cells = dealt.groupBy("cell").agg(F.max("r").alias("far"), F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    far, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in cells.collect():  # a row a pivot at most
        far[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
    own = cut(dealt.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts"))
    slack = 2 * 10.0**-PLACES
    # blocks are dealt to groups in turn; reached[c, g]: cell c has a block in group g
    groups = _groups(points, n)
    parts = -(-sizes // BLOCK)
    begin = np.cumsum(parts) - parts
    reached = np.array([[(g - b) % groups < m for g in range(groups)] for b, m in zip(begin, parts)])

    def bounds(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots, and the least that a member of each cell can have: by its radius, or by the plane
        between its pivot and the point's own."""
        to = _distances(x, pivots)
        least = np.maximum(to - far, (to - r[:, None]) / 2)
        least[:, sizes == 0] = np.inf
        return to, least

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        x = _stack(f["embedding"])
        d = np.round(_distances(x, x), PLACES)
        best = _least(d, list(f["ids"]), list(f["labels"]), k)
        limit = np.array([b[0][-1] if len(b[0]) == k else np.inf for b in best])
        to, least = bounds(x, f["r"].to_numpy())
        for i in np.flatnonzero(limit == np.inf):  # a small block: so near are k vectors in any case
            most = np.where(sizes > 0, to[i] + far, np.inf)
            order = np.argsort(most)
            enough = np.flatnonzero(np.cumsum(sizes[order]) >= k)
            limit[i] = most[order[enough[0]]] if len(enough) else np.inf
        asks = (least <= limit[:, None] + slack) @ reached
        group = int((begin[f["cell"].iloc[0]] + f["part"].iloc[0]) % groups)
        return f.assign(group=group, limit=limit, found=_lists([b[0] for b in best]), near=_lists([b[1] for b in best]), theirs=_lists([b[2] for b in best]), seen=len(f), asks=_lists([np.flatnonzero(r) for r in asks]))

    first = cut(own.groupBy("cell", "part").applyInPandas(inside, f"{shape}, cell long, r double, part long, group long, limit double, found array<double>, near array<long>, theirs array<int>, seen long, asks array<long>"))
    asking = first.select("rep", "embedding", "cell", "part", "r", "limit", "found", "near", "theirs", "group", F.explode("asks").alias("to"))
    # other names on this side: a cogroup of one table with itself mixes up columns that both sides share
    asked = first.select(*[F.col(c).alias(f"p_{c}") for c in ("ids", "labels", "embedding", "cell", "part")], F.col("group").alias("p_to"), _every(groups).alias("p_group"))

    def answer(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            theirs = _stack(p["p_embedding"])
            blocks = [_Block(p, theirs, at) for at in _units(p["p_part"].to_numpy(), p["p_cell"].to_numpy())]
            for at in _units(q["part"].to_numpy(), q["cell"].to_numpy()):
                f = q.iloc[at]
                x = _stack(f["embedding"])
                _, least = bounds(x, f["r"].to_numpy())
                best = _Best(f, k)
                # near cells first, so that limits fall early
                for b in sorted(blocks, key=lambda b: least[:, b.cell].min()):
                    if (b.cell, b.part) != (f["cell"].iloc[0], f["part"].iloc[0]):
                        best.ask(x, np.flatnonzero(least[:, b.cell] <= best.limit + slack), b)
                out.append(best.rows(f["rep"].to_numpy()))
        return pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, np.int64), "found": _lists([]), "ids": _lists([]), "labels": _lists([]), "seen": np.zeros(0, np.int64)})

    more = asking.groupBy("group", "to").cogroup(asked.groupBy("p_group", "p_to")).applyInPandas(answer, f"rep long, {_NEAR}")
    return first.select("rep", "found", F.col("near").alias("ids"), F.col("theirs").alias("labels"), "seen").unionByName(more)


class _Block:
    """Vectors of one block with their members."""

    def __init__(self, f: pd.DataFrame, x: np.ndarray, at: np.ndarray):
        self.cell, self.part, self.x = int(f["p_cell"].iloc[at[0]]), int(f["p_part"].iloc[at[0]]), x[at]
        ids, labels = f["p_ids"].to_numpy()[at], f["p_labels"].to_numpy()[at]
        self.count = np.array([len(i) for i in ids])
        self.start = np.cumsum(self.count) - self.count
        self.ids, self.labels = np.concatenate(ids).astype(np.int64), np.concatenate(labels).astype(np.int32)


class _Best:
    """The k nearest members so far of some points, by distance, then id; ``new`` are those of blocks that were asked."""

    def __init__(self, f: pd.DataFrame, k: int):
        self.k, self.limit, self.seen = k, f["limit"].to_numpy(float, copy=True), np.zeros(len(f), np.int64)
        self.row = np.repeat(np.arange(len(f)), [len(d) for d in f["found"]])
        self.d, self.id = np.concatenate(list(f["found"])).astype(float), np.concatenate(list(f["near"])).astype(np.int64)
        self.label, self.new = np.concatenate(list(f["theirs"])).astype(np.int32), np.zeros(len(self.row), bool)

    def ask(self, x: np.ndarray, rows: np.ndarray, block: _Block) -> None:
        if not len(rows):
            return
        self.seen[rows] += len(block.x)
        square = _squares(x[rows], block.x)
        most = (self.limit[rows] + 10.0**-PLACES) ** 2
        short = np.flatnonzero(np.bincount(self.row, minlength=len(x))[rows] < self.k)
        if len(short) and square.shape[1] > self.k:  # without k members yet: k of this block are as near
            kth = np.sqrt(np.partition(square[short], self.k - 1, axis=1)[:, self.k - 1])
            most[short] = np.minimum(most[short], (kth + 10.0**-PLACES) ** 2)
        i, j = np.nonzero(square <= most[:, None])
        if not len(i):
            return
        n = block.count[j]
        at = np.repeat(block.start[j] + n - np.cumsum(n), n) + np.arange(n.sum())
        touched = np.zeros(len(x), bool)
        touched[rows[i]] = True
        own = touched[self.row]
        row, new = np.append(self.row[own], np.repeat(rows[i], n)), np.append(self.new[own], np.ones(len(at), bool))
        d = np.append(self.d[own], np.repeat(np.round(np.sqrt(square[i, j]), PLACES), n))
        ident, label = np.append(self.id[own], block.ids[at]), np.append(self.label[own], block.labels[at])
        order = np.lexsort((ident, d, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
        last = order[place == self.k - 1]
        self.limit[row[last]] = np.minimum(self.limit[row[last]], d[last])
        order = order[place < self.k]
        rest = ~own
        self.row, self.d = np.append(self.row[rest], row[order]), np.append(self.d[rest], d[order])
        self.id, self.label, self.new = np.append(self.id[rest], ident[order]), np.append(self.label[rest], label[order]), np.append(self.new[rest], new[order])

    def rows(self, rep: np.ndarray) -> pd.DataFrame:
        own = np.flatnonzero(self.new)
        own = own[np.argsort(self.row[own], kind="stable")]
        ends = np.searchsorted(self.row[own], np.arange(1, len(rep)))
        each = lambda v: _lists(np.split(v[own], ends))
        return pd.DataFrame({"rep": rep, "found": each(self.d), "ids": each(self.id), "labels": each(self.label), "seen": self.seen})


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """rep, near: of every distinct vector the k nearest members (d, id, label) in order, itself among them; seen: the
    distances worked out for it."""
    each = nearest(points, k).select("rep", "seen", F.arrays_zip(F.col("found").alias("d"), F.col("ids").alias("id"), F.col("labels").alias("label")).alias("near"))
    return each.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("seen").alias("seen"))


def label_shares(points: DataFrame, k: int) -> DataFrame:
    """vec_id and share: of each point's k nearest others, those of its label."""
    near = neighbours(points, k + 1)
    reps = points.groupBy("embedding").agg(F.min("vec_id").alias("rep"))
    others = F.slice(F.filter("near", lambda m: m["id"] != F.col("vec_id")), 1, k)
    own = points.select("vec_id", "label", "embedding").join(reps, "embedding").join(near, "rep").select("vec_id", "label", others.alias("o")).filter(F.size("o") > 0)
    return own.select("vec_id", (F.size(F.filter("o", lambda m: m["label"] == F.col("label"))) / F.size("o")).alias("share"))


def _moments(points: DataFrame) -> dict[int, tuple[int, np.ndarray, float]]:
    """label -> (points, mean, mean squared distance from it): a vector a label is on the driver."""
    at = points.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()
    out: dict = {}
    for r in sorted(at, key=lambda r: (r["label"], r["i"])):
        n, mean, spread = out.setdefault(r["label"], (r["n"], [], []))
        mean.append(r["m"])
        spread.append(r["s"])
    return {k: (n, np.array(m), float(sum(s))) for k, (n, m, s) in out.items()}


def silhouettes(points: DataFrame) -> DataFrame:
    """label, embedding, copies, s and seen of every distinct (label, embedding) of ``points``; s is 0 for a point alone in its label.

    The mean distance to a label is at least that to its mean, and at most the root of that squared and its spread, so
    only labels that can be the nearest are compared point by point.
    """
    own = cut(points.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep")))
    moments = _moments(points)
    names = np.array(sorted(moments), np.int64)
    if not len(names):
        return own.select("label", "embedding", "copies", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("seen"))
    means, spreads = np.stack([moments[c][1] for c in names]), np.array([moments[c][2] for c in names])

    def wanted(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        low = _distances(x, means)
        high = np.sqrt(low**2 + spreads)
        mine = label[:, None] == names
        least = np.where(mine, np.inf, high).min(axis=1)
        return mine | (low <= least[:, None] * (1 + 1e-9) + 1e-9)

    groups = _groups(points, own.count())
    dealt = own.withColumn("group", F.pmod(F.xxhash64("label", "rep"), F.lit(groups)))
    left = dealt.select("rep", "label", "embedding", "group", _every(groups).alias("to"))
    right = dealt.select(F.col("label").alias("other"), F.col("embedding").alias("p_embedding"), F.col("copies").alias("p_copies"), F.col("group").alias("p_to"), _every(groups).alias("p_group"))

    def add(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            theirs, copies = _stack(p["p_embedding"]), p["p_copies"].to_numpy(float)
            blocks = [(p["other"].iloc[at[0]], [(theirs[i], copies[i]) for i in np.array_split(at, -(-len(at) // BLOCK))]) for at in _units(p["other"].to_numpy())]
            for start in range(0, len(q), BLOCK):
                f = q.iloc[start : start + BLOCK]
                x, label = _stack(f["embedding"]), f["label"].to_numpy()
                want = wanted(x, label)
                for other, parts in blocks:
                    rows = np.flatnonzero(want[:, np.searchsorted(names, other)])
                    if len(rows):
                        total = sum(_distances(x[rows], y) @ c for y, c in parts)
                        out.append(pd.DataFrame({"rep": f["rep"].to_numpy()[rows], "label": label[rows], "other": other, "sum": total, "seen": sum(len(c) for _, c in parts)}))
        return pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, np.int64), "label": np.zeros(0, np.int32), "other": np.zeros(0, np.int32), "sum": np.zeros(0), "seen": np.zeros(0, np.int64)})

    sums = left.groupBy("group", "to").cogroup(right.groupBy("p_group", "p_to")).applyInPandas(add, "rep long, label int, other int, sum double, seen long")
    totals = F.broadcast(points.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n")))
    each = sums.groupBy("rep", "label", "other").agg(F.sum("sum").alias("sum"), F.sum("seen").alias("seen")).join(totals, "other")
    same = F.col("label") == F.col("other")
    mean = F.when(same, F.col("sum") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("sum") / F.col("n"))
    per = each.groupBy("rep", "label").agg(F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"), F.sum("seen").alias("seen"))
    s = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return own.join(per, ["rep", "label"]).select("label", "embedding", "copies", s.alias("s"), "seen")
