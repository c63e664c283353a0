"""Random forest regression without a depth limit (M5), kept as rows in a table.

A tree starts as one node over the rows that its bootstrap draws. While a node holds more rows than
one task should, it is split by histograms that all tasks add up (a pass a level over the rows, for a
batch of trees at once). A node that is small enough becomes a *part*: its rows go to one task, which
finishes the subtree with exact splits and no further pass. A fully grown tree has nearly two nodes a
row, so moving each drawn row once is in proportion to the model itself, and no more than the few
upper nodes ever reach the driver. Batches of trees are written to the shared folder, two at a time, so
neither the shuffle files nor a lost executor's work grow with the number of trees.

Equal rows count as one row of higher weight. A tree draws a Poisson number of each row by a hash of
the row's content, so a fit is the same under any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from regressa.functions.columns import col
from regressa.session import shared_path

#: Numbers (rows x features) that one task takes for a part, trees fitted at once (more where these give
#: fewer than ``TURNS`` parts a core), bins of a feature in the histograms of the upper nodes.
PART_CELLS, BATCH, TURNS, BINS = 4_000_000, 10, 4, 256
#: Batches that run at once.
IN_FLIGHT = 2
#: Shuffle partitions a part, so that few parts share one, and how many of them where parts are many.
SPREAD, MOST = 8, 400
#: Bytes of a forest up to which scoring sends it to every task; larger ones meet the rows in a join.
BROADCAST_BYTES = 64 << 20
#: Rows that meet a part at once when scoring by a join.
SCORE_ROWS = 100_000
_NODE_BYTES = 24
#: Rank of NaN: above all values, but no cut lies before it.
MISSING = 2 ** 31 - 1

PACKED = ("tree int, part long, feature array<int>, threshold array<double>, left array<int>, "
          "value array<double>, gain array<double>, rows array<long>")


@dataclass(frozen=True)
class Growth:
    """When a node stays a leaf, and how many features a split looks at (None: all)."""

    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    seed: int = 42


# --------------------------------------------------------------------------
# One subtree in memory
# --------------------------------------------------------------------------

@dataclass
class Nodes:
    """Nodes as arrays; children of a split are ``left`` and ``left + 1``, a leaf has ``left`` -1."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    rows: list = field(default_factory=list)

    def add(self, *level: np.ndarray) -> None:
        """Nodes of a level; the arrays may still be filled in."""
        for kept, some in zip((self.feature, self.threshold, self.left, self.value, self.gain, self.rows),
                              level, strict=True):
            kept.append(some)

    def packed(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in (self.feature, self.threshold, self.left, self.value,
                                            self.gain, self.rows)]


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values[places]`` for places that exist: 'clip' spares the check of each, most of the time it takes."""
    return values.take(places, mode="clip")


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, how: Growth, depth: int, key: int) -> Nodes:
    """Grows the subtree of weighted rows by exact splits, one level at a time: rows stay sorted by
    every feature inside their node, so a level is a few running sums over each feature. Values are
    compared by their ranks; only cuts between different values are scored, and rows of leaves are
    left out of what follows. Rows lie node by node in the order of the first feature, so that a
    node's numbers are close together however deep it is."""
    n, p = x.shape
    rng = np.random.Generator(np.random.Philox(key=[how.seed & (2 ** 64 - 1), key & (2 ** 64 - 1)]))
    middle = float(np.average(y, weights=w))
    y = y - middle  # sums of small numbers keep their digits
    wy = w * y
    order, rank, values = [], [], []
    for f in range(p):
        o = np.argsort(x[:, f], kind="stable")
        v = x[o, f]
        rises = np.concatenate([[False], v[:-1] < v[1:]])
        steps = np.cumsum(rises)
        steps[np.isnan(v)] = MISSING
        r = np.empty(n, np.int32)
        r[o] = steps
        rises[0] = True
        order.append(o)
        rank.append(r)
        values.append(v[rises])
    first = order[0]
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    order = [_at(place, o) for o in order[1:]]  # of the first feature the rows' own places
    rank = [_at(r, first) for r in rank]
    y, w, wy = _at(y, first), _at(w, first), _at(wy, first)
    out, made = Nodes(), 1
    sizes = np.array([n])
    weight, total, may = _node_sums(y, w, wy, np.zeros(1, np.int64), how, depth)
    while True:
        k = len(sizes)
        left, feature = np.full(k, -1, np.int32), np.full(k, -1, np.int32)
        threshold, gain = np.full(k, np.nan), np.zeros(k)
        out.add(feature, threshold, left, total / weight + middle, gain, weight.astype(np.int64))
        if not may.any():
            return out
        # Leaves drop out; what is left keeps its order.
        inside = np.flatnonzero(may)
        sizes, weight, total = sizes[inside], weight[inside], total[inside]
        best, cut, above = _best_cuts(order, rank, w, wy, sizes, weight, total, how.min_samples_leaf)
        if how.max_features is not None and how.max_features < p:
            # A draw for every node, leaves included.
            dice = np.where(np.isfinite(best), rng.random((k, p))[inside], 2.0)
            last = np.partition(dice, how.max_features - 1, axis=1)[:, how.max_features - 1]
            best[dice > last[:, None]] = -np.inf
        chosen = best.argmax(axis=1)
        score = best[np.arange(len(inside)), chosen]
        split = np.flatnonzero(np.isfinite(score))
        count = len(split)
        if not count:
            return out
        by, here = chosen[split], inside[split]
        low, high = cut[split, by], above[split, by]
        feature[here], left[here] = by, made + 2 * np.arange(count)
        made += 2 * count
        for f in np.unique(by):
            own = by == f
            threshold[here[own]] = _between(values[f][low[own]], values[f][high[own]])
        gain[here] = np.maximum(score[split] - total[split] ** 2 / weight[split], 0.0)
        order, rank, y, w, wy, sizes, weight, total, may = _descend(
            order, rank, y, w, wy, sizes, split, by, low, how, depth + 1)
        depth += 1


def _node_sums(y, w, wy, starts, how: Growth, depth: int) -> tuple[np.ndarray, ...]:
    """Weight and sum of each node, and whether it may be split."""
    weight, total = np.add.reduceat(w, starts), np.add.reduceat(wy, starts)
    if how.max_depth is not None and depth >= how.max_depth:
        return weight, total, np.zeros(len(starts), bool)
    varied = np.maximum.reduceat(y, starts) > np.minimum.reduceat(y, starts)
    return weight, total, varied & (weight >= how.min_samples_split) & (weight >= 2 * how.min_samples_leaf)


def _best_cuts(order, rank, w, wy, sizes, weight, total, least) -> tuple[np.ndarray, ...]:
    """Per node and feature the best cut: sum of the sides' squared sums over their weights (-inf
    where none is allowed), and the ranks of the values that it lies between."""
    k, p, m = len(sizes), len(rank), len(w)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    node = np.repeat(np.arange(k), sizes)
    before = np.cumsum(weight) - weight
    inner = np.ones(m, bool)
    inner[ends - 1] = False
    best = np.full((k, p), -np.inf)
    cut, above = np.zeros((k, p), np.int32), np.zeros((k, p), np.int32)
    for f, (o, ranks) in enumerate(zip([None, *order], rank, strict=True)):
        r = ranks if o is None else _at(ranks, o)
        ok = np.zeros(m, bool)
        np.less(r[:-1], r[1:], out=ok[:-1])
        ok &= inner
        ok[:-1] &= r[1:] != MISSING
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        of = _at(node, at)
        sums = wy if o is None else _at(wy, o)
        first = sums[starts]
        sums = np.cumsum(sums)
        ls = _at(sums, at) - _at(sums[starts] - first, of)
        lw = _at(np.cumsum(w if o is None else _at(w, o)), at) - _at(before, of)
        rw, rs = _at(weight, of) - lw, _at(total, of) - ls
        if least > 1:
            good = (lw >= least) & (rw >= least)
            at, of, ls, lw, rs, rw = at[good], of[good], ls[good], lw[good], rs[good], rw[good]
            if not len(at):
                continue
        ls *= ls
        ls /= lw
        rs *= rs
        rs /= rw
        score = ls + rs
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        has, top = of[edge], np.maximum.reduceat(score, edge)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(edge, len(of)))))[::-1]
        place = np.zeros(k, np.int64)
        place[of[hit]] = at[hit]  # the first of equal cuts is written last
        best[has, f] = top
        cut[has, f], above[has, f] = r[place[has]], r[place[has] + 1]
    return best, cut, above


def _between(v: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        cut = v / 2 + after / 2
    # Rounding must not carry the cut onto the upper value.
    return np.where((cut >= v) & (cut < after), cut, v)


def _descend(order, rank, y, w, wy, sizes, split, by, low, how: Growth, depth: int) -> tuple:
    """Rows of the nodes ``split`` move to their children: orders, ranks, labels, weights and weighted
    labels of the rows in open children, then sizes, weights, sums of all children and whether they may
    be split."""
    goes = np.zeros(len(sizes), bool)
    goes[split] = True
    rows = np.flatnonzero(np.repeat(goes, sizes))
    sizes = sizes[split]
    asked, bound = np.repeat(by, sizes), np.repeat(low, sizes)
    high = np.zeros(len(rows), bool)
    for f in np.unique(by):
        some = np.flatnonzero(asked == f)
        high[some] = _at(rank[f], _at(rows, some)) > _at(bound, some)
    highs = np.add.reduceat(high, np.cumsum(sizes) - sizes, dtype=np.int64)
    child = np.column_stack([sizes - highs, highs]).ravel()
    # In every order the children's rows take the same places.
    upper = np.repeat(np.tile([False, True], len(sizes)), child)
    new = np.empty(len(rows), np.int64)
    new[np.flatnonzero(~upper)] = _at(rows, np.flatnonzero(~high))
    new[np.flatnonzero(upper)] = _at(rows, np.flatnonzero(high))
    total_rows = len(y)
    y, w, wy = _at(y, new), _at(w, new), _at(wy, new)
    weight, total, may = _node_sums(y, w, wy, np.cumsum(child) - child, how, depth)
    open_ = np.flatnonzero(np.repeat(may, child))
    if not len(open_):
        return [], [], y[:0], w[:0], wy[:0], child, weight, total, may
    new, upper, y, w, wy = (_at(a, open_) for a in (new, upper, y, w, wy))
    to = np.full(total_rows, MISSING)  # the row's new place, ~place in an upper child
    to[new] = np.arange(len(new)) ^ -upper.astype(np.int64)
    lows, highs, out = np.flatnonzero(~upper), np.flatnonzero(upper), []
    for o in order:
        of = _at(to, o)
        moved = np.empty(len(new), np.int64)
        moved[lows] = _at(of, np.flatnonzero((of >= 0) & (of != MISSING)))
        moved[highs] = ~_at(of, np.flatnonzero(of < 0))
        out.append(moved)
    return out, [_at(r, new) for r in rank], y, w, wy, child, weight, total, may


def walk(x: np.ndarray, feature, threshold, left, goal: np.ndarray) -> np.ndarray:
    """``goal`` of the leaf that each row of ``x`` falls into."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows := rows[left[at[rows]] >= 0]):
        here = at[rows]
        at[rows] = left[here] + ~(x[rows, feature[here]] <= threshold[here])
    return goal[at]


# --------------------------------------------------------------------------
# Rows that a tree draws
# --------------------------------------------------------------------------

def draws(mark: np.ndarray, copies: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws each row: a Poisson number with the row's copies as its mean, from a
    hash of the row's mark and the tree (``tree`` -1: every copy once)."""
    if tree < 0:
        return copies.astype(np.int64)
    z = mark.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2 ** 53
    out = np.zeros(len(mark), np.int64)
    for m in np.unique(copies).tolist():
        some = copies == m
        if m > 500:  # a normal number with the same mean and variance
            from statistics import NormalDist

            normal = NormalDist(m, math.sqrt(m))
            out[some] = [max(0, round(normal.inv_cdf(min(max(a, 1e-16), 1 - 1e-16)))) for a in u[some]]
            continue
        terms = np.cumsum([math.exp(i * math.log(m) - m - math.lgamma(i + 1))
                           for i in range(m + 12 * math.isqrt(m) + 30)])
        out[some] = np.searchsorted(terms, u[some], side="right")
    return out


def _points(data: DataFrame, x: Column, y: Column, seed: int) -> DataFrame:
    """Distinct rows (x, y) with their copies and a mark; written once, read by every pass."""
    spark = data.sparkSession
    rows = data.select(x.alias("x"), y.cast("double").alias("y")).where("y IS NOT NULL")
    rows = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")) \
        .withColumn("mark", F.xxhash64("x", "y", F.lit(seed)))
    path = shared_path(spark, "points")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


# --------------------------------------------------------------------------
# Upper nodes by histograms
# --------------------------------------------------------------------------

class Upper:
    """The nodes of one tree above its parts. A leaf of it is a part, numbered like that leaf; a
    leaf of more rows that may not be split any further is ``final``."""

    def __init__(self):
        self.nodes: list[dict] = [{"depth": 0, "left": -1}]

    def arrays(self) -> tuple[np.ndarray, ...]:
        n = self.nodes
        return (np.array([a.get("feature", -1) for a in n]), np.array([a.get("at", np.nan) for a in n]),
                np.array([a["left"] for a in n]), np.arange(len(n)))

    def final(self) -> list[int]:
        return [i for i, a in enumerate(self.nodes) if "value" in a and a["left"] < 0]

    def split(self, node: int, feature: int, at: float, gain: float) -> None:
        a = self.nodes[node]
        a.update(feature=feature, at=at, gain=gain, left=len(self.nodes))
        self.nodes += [{"depth": a["depth"] + 1, "left": -1}, {"depth": a["depth"] + 1, "left": -1}]


def _grow_upper(points: DataFrame, trees: list[int], width: int, how: Growth, limit: int,
                distinct: int, bins: int) -> dict[int, Upper]:
    """Splits nodes of more than ``limit`` drawn rows, a level of all ``trees`` a pass."""
    uppers = {t: Upper() for t in trees}
    if distinct <= limit:
        return uppers  # no tree draws more rows than there are
    probs = [i / bins for i in range(1, bins)]
    edges = points.agg(*[F.percentile_approx(F.col("x")[f], probs, 10_000).alias(f"c{f}")
                         for f in range(width)]).first()
    common = [np.unique(np.array(edges[f"c{f}"] or [], float)) for f in range(width)]
    open_ = {t: {0: None} for t in trees}  # node -> None (common edges) or the ranges of its features
    schema = "tree int, node long, f int, bin int, w double, s double, n long, low double, high double"
    while any(open_.values()):
        walks = {t: uppers[t].arrays() for t in trees if open_[t]}

        def count(batches: Iterator[pa.RecordBatch], walks=walks, open_=open_) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch, width)
                y = batch.column("y").to_numpy()
                mark, copies = batch.column("mark").to_numpy(), batch.column("m").to_numpy()
                for t, nodes in walks.items():
                    w = draws(mark, copies, t)
                    leaf = walk(x, *nodes)
                    for node, ranges in open_[t].items():
                        some = np.flatnonzero((leaf == node) & (w > 0))
                        if not len(some):
                            continue
                        for f in range(width):
                            v = x[some, f]
                            cuts = common[f] if ranges is None else _even(ranges[f], bins)
                            b = np.searchsorted(cuts, v, side="left")
                            size = len(cuts) + 1
                            n = np.bincount(b, minlength=size)
                            ws = np.bincount(b, w[some], minlength=size)
                            ys = np.bincount(b, w[some] * y[some], minlength=size)
                            has = np.flatnonzero(n)
                            full = np.full(len(has), 1)
                            yield pa.RecordBatch.from_arrays([
                                pa.array(full * t, pa.int32()), pa.array(full * node, pa.int64()),
                                pa.array(full * f, pa.int32()), pa.array(has, pa.int32()),
                                pa.array(ws[has]), pa.array(ys[has]), pa.array(n[has], pa.int64()),
                                pa.array(full * float(np.nanmin(v, initial=np.inf))),
                                pa.array(full * float(np.nanmax(v, initial=-np.inf)))],
                                names=["tree", "node", "f", "bin", "w", "s", "n", "low", "high"])

        bars = points.mapInArrow(count, schema).groupBy("tree", "node", "f", "bin").agg(
            F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("n").alias("n"),
            F.min("low").alias("low"), F.max("high").alias("high"))
        per = Window.partitionBy("tree", "node", "f")
        run = per.orderBy("bin")
        cuts = bars.select(
            "tree", "node", "f", "bin", F.sum("w").over(run).alias("lw"), F.sum("s").over(run).alias("ls"),
            F.sum("n").over(run).alias("ln"), F.sum("w").over(per).alias("tw"),
            F.sum("s").over(per).alias("ts"), F.sum("n").over(per).alias("tn"),
            F.min("low").over(per).alias("low"), F.max("high").over(per).alias("high"))
        allowed = (F.col("lw") >= how.min_samples_leaf) & (F.col("tw") - F.col("lw") >= how.min_samples_leaf) \
            & (F.col("ln") < F.col("tn"))
        score = F.when(allowed, F.col("ls") ** 2 / F.col("lw") + (F.col("ts") - F.col("ls")) ** 2
                       / (F.col("tw") - F.col("lw")))
        dice = F.xxhash64("tree", "node", "f", F.lit(how.seed))
        found = cuts.withColumn("score", score).groupBy("tree", "node", "f").agg(
            F.max_by(F.struct("score", F.col("bin").alias("bin")), F.struct("score", -F.col("bin"))).alias("b"),
            *[F.first(c).alias(c) for c in ("tw", "ts", "tn", "low", "high")]).withColumn("dice", dice)
        best: dict[tuple, list] = {}
        for r in found.collect():  # one row a node and feature
            best.setdefault((r["tree"], r["node"]), []).append(r)
        following: dict[int, dict] = {t: {} for t in trees}
        for (t, node), rows in sorted(best.items()):
            rows.sort(key=lambda r: r["f"])
            tw, ts, tn = rows[0]["tw"], rows[0]["ts"], rows[0]["tn"]
            if tn <= limit:
                continue
            here = uppers[t].nodes[node]
            here.update(value=ts / tw, rows=int(tw))
            if tw < how.min_samples_split or here["depth"] == how.max_depth:
                continue
            ranges = open_[t][node]
            can = [r for r in rows if r["b"]["score"] is not None]
            if how.max_features is not None:
                can = sorted(can, key=lambda r: r["dice"])[:how.max_features]
            if not can:
                spans = [(r["low"], r["high"]) for r in rows]
                if spans != ranges and any(lo < hi for lo, hi in spans):
                    following[t][node] = spans  # the common edges do not part it: even bins do
                continue
            top = max(can, key=lambda r: (r["b"]["score"], -r["f"]))
            f = top["f"]
            edges_f = common[f] if ranges is None else _even(ranges[f], bins)
            uppers[t].split(node, f, float(edges_f[top["b"]["bin"]]),
                            max(top["b"]["score"] - ts * ts / tw, 0.0))
            first = uppers[t].nodes[node]["left"]
            following[t][first] = following[t][first + 1] = None
        open_ = following
    return uppers


def _even(span: tuple, bins: int) -> np.ndarray:
    """Edges that cut a range evenly; the first lies at its low end, so a cut always parts it."""
    low, high = span
    if not low < high:
        return np.zeros(0)
    edges = low + (high - low) * (np.arange(bins - 1) / (bins - 1))
    return np.unique(edges[edges < high])


# --------------------------------------------------------------------------
# Fit
# --------------------------------------------------------------------------

def fit_forest(data: DataFrame, x: Column, y: Column, width: int, trees: int, how: Growth,
               part_cells: int = PART_CELLS, batch: int | None = None, bins: int = BINS) -> ForestModel:
    """A forest of ``trees`` trees on the rows of ``data`` whose ``y`` is known; ``x`` is an
    array<double> of ``width`` features. A tree of equal labels, or of one row, is a leaf."""
    spark = data.sparkSession
    points = _points(data, x, y, how.seed)
    distinct = points.count()
    if not distinct:
        raise ValueError("a forest needs rows with a label")
    limit = max(2, part_cells // max(width, 1))
    path = shared_path(spark, "forest")
    batch = batch or _batch(trees, -(-distinct // limit), spark.sparkContext.defaultParallelism)
    turns = [list(range(first, min(first + batch, trees))) for first in range(0, trees, batch)]

    def fit(some: list[int]) -> str:
        own = f"{path}/from{some[0]}"  # jobs that append to one folder at once would end each other
        _fit_batch(points, some, width, how, limit, distinct, bins, own)
        return own

    def read(paths: list[str]) -> ForestModel:
        return ForestModel.read(spark.read.schema(PACKED).parquet(*paths), width)

    # While the last parts of a batch are grown, the other cores begin with the next one.
    with ThreadPoolExecutor(IN_FLIGHT) as pool:
        paths = list(pool.map(fit, turns))
    model = read(paths) if paths else None
    if model is None or not model.trees:  # of very few rows, no tree may have drawn one
        model = read([*paths, fit([-1])])
    return model


def _batch(trees: int, parts: int, cores: int) -> int:
    """Trees fitted at once, about as many in every batch."""
    most = max(BATCH, -(-TURNS * cores // parts))
    return -(-trees // -(-trees // most)) if trees else 1


def _fit_batch(points, trees, width, how, limit, distinct, bins, path) -> dict[int, Upper]:
    spark = points.sparkSession
    uppers = _grow_upper(points, trees, width, how, limit, distinct, bins)
    walks = {t: u.arrays() for t, u in uppers.items()}
    depths = {t: [a["depth"] for a in u.nodes] for t, u in uppers.items()}
    final = {t: u.final() for t, u in uppers.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            y = batch.column("y").to_numpy()
            mark, copies = batch.column("mark").to_numpy(), batch.column("m").to_numpy()
            for t, nodes in walks.items():
                w = draws(mark, copies, t)
                leaf = walk(x, *nodes)
                for part in np.setdiff1d(leaf[w > 0], final[t]).tolist():
                    some = np.flatnonzero((leaf == part) & (w > 0))
                    block = np.column_stack([mark[some].view(float), w[some].astype(float), y[some], x[some]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t], pa.int32()), pa.array([part], pa.int64()),
                         pa.array([block.tobytes()], pa.binary())], names=["tree", "part", "block"])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        t, part = (k.as_py() for k in key)
        rows = np.concatenate([np.frombuffer(b.as_py()).reshape(-1, width + 3)
                               for b in table.column("block")])
        # One order whatever the partitions: sums then agree to the last bit.
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0].copy().view(np.int64)))]
        made = grow(np.ascontiguousarray(rows[:, 3:]), rows[:, 2].copy(), rows[:, 1].copy(), how,
                    depths[t][part], (t << 32) + part)
        return _packed(t, part, made.packed())

    parts = sum(a["left"] < 0 for u in uppers.values() for a in u.nodes)
    dealt = points.mapInArrow(deal, "tree int, part long, block binary") \
        .repartition(max(parts, min(SPREAD * parts, MOST)), "tree", "part")
    # Hardly a number of a grown tree occurs twice: a dictionary would be tried in vain.
    dealt.groupBy("tree", "part").applyInArrow(finish, PACKED).write.mode("append") \
        .option("parquet.enable.dictionary", "false").parquet(path)
    tops = [(t, u) for t, u in uppers.items() if len(u.nodes) > 1 or final[t]]
    if tops:
        rows = []
        for t, u in tops:  # part -1: the nodes above the parts
            n = u.nodes
            rows.append((t, -1, [a.get("feature", -1) for a in n], [a.get("at", math.nan) for a in n],
                         [a["left"] for a in n], [a.get("value", 0.0) for a in n],
                         [a.get("gain", 0.0) for a in n], [a.get("rows", 0) for a in n]))
            rows += [(t, i, [-1], [math.nan], [-1], [n[i]["value"]], [0.0], [n[i]["rows"]])
                     for i in final[t]]
        spark.createDataFrame(rows, PACKED).write.mode("append").parquet(path)
    return uppers


def _packed(tree: int, part: int, arrays: list[np.ndarray]) -> pa.Table:
    names = ["feature", "threshold", "left", "value", "gain", "rows"]
    kinds = [pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    return pa.table({"tree": pa.array([tree], pa.int32()), "part": pa.array([part], pa.int64()),
                     **{n: pa.ListArray.from_arrays([0, len(a)], pa.array(a, k))
                        for n, a, k in zip(names, arrays, kinds, strict=True)}})


# --------------------------------------------------------------------------
# The fitted forest
# --------------------------------------------------------------------------

@dataclass
class ForestModel:
    """A forest as a table: one row a part (``PACKED``); ``nodes`` shows one row a node."""

    packed: DataFrame
    width: int
    trees: int
    size: int

    @staticmethod
    def read(packed: DataFrame, width: int) -> ForestModel:
        r = packed.agg(F.count_distinct("tree").alias("t"),
                       F.coalesce(F.sum(F.size("left")), F.lit(0)).alias("n")).first()
        return ForestModel(packed, width, r["t"], r["n"])

    def nodes(self) -> DataFrame:
        """(tree, part, node, feature, threshold, left, right, value, gain, rows); a leaf's feature,
        threshold and children are null. Rows of part -1 are the nodes above the parts; a leaf
        there is the root of the part of its number."""
        z = F.arrays_zip("feature", "threshold", "left", "value", "gain", "rows")
        flat = self.packed.select("tree", "part", F.posexplode(z).alias("node", "z")) \
            .select("tree", "part", "node", "z.*")
        inner = F.col("left") >= 0
        return flat.select("tree", "part", "node", *[F.when(inner, F.col(c)).alias(c)
                                                      for c in ("feature", "threshold", "left")],
                           F.when(inner, F.col("left") + 1).alias("right"), "value", "gain", "rows")

    def importance_rows(self) -> DataFrame:
        """(feature, importance): squared error that the splits on a feature remove, as a share of
        the tree's, averaged over the trees that split at all."""
        width = self.width

        def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, feature, gain in zip(*(batch.column(c) for c in ("tree", "feature", "gain")), strict=True):
                    by = feature.values.to_numpy()
                    inner = by >= 0
                    g = np.bincount(by[inner], gain.values.to_numpy()[inner], minlength=width)
                    has = np.flatnonzero(np.bincount(by[inner], minlength=width))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(has), t.as_py(), np.int32)), pa.array(has, pa.int32()),
                         pa.array(g[has])], names=["tree", "feature", "g"])

        per = self.packed.select("tree", "feature", "gain").mapInArrow(
            gains, "tree int, feature int, g double").groupBy("tree", "feature").agg(F.sum("g").alias("g"))
        share = F.try_divide(F.col("g"), F.sum("g").over(Window.partitionBy("tree")))
        shares = per.select("feature", F.coalesce(share, F.lit(0.0)).alias("s")) \
            .groupBy("feature").agg(F.sum("s").alias("s"))
        return shares.select("feature", F.coalesce(F.try_divide(
            "s", F.sum("s").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)).alias("importance"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name that Spark's models use)
        out = np.zeros(self.width)
        for r in self.importance_rows().collect():  # one row a feature
            out[r["feature"]] = r["importance"]
        return DenseVector(out)

    def transform(self, df: DataFrame, x: Column, name: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees' values as ``name``; ``x`` as in the fit."""
        if self.size * _NODE_BYTES <= BROADCAST_BYTES:
            return self._by_broadcast(df, x, name)
        return self._by_join(df, x, name)

    def _uppers(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {r["tree"]: (np.array(r["feature"]), np.array(r["threshold"]), np.array(r["left"]),
                            np.arange(len(r["left"])))
                for r in self.packed.where("part = -1").collect()}

    def _by_broadcast(self, df: DataFrame, x: Column, name: str) -> DataFrame:
        uppers, width, trees = self._uppers(), self.width, self.trees
        parts: dict[int, dict] = {}
        for r in self.packed.where("part >= 0").select(
                "tree", "part", "feature", "threshold", "left", "value").collect():
            parts.setdefault(r["tree"], {})[r["part"]] = (
                np.array(r["feature"], np.int32), np.array(r["threshold"]),
                np.array(r["left"], np.int32), np.array(r["value"]))

        @F.pandas_udf(DoubleType())
        def predict(features: pd.Series) -> pd.Series:
            m = np.stack(features.to_list()).reshape(-1, width).astype(float) if len(features) else \
                np.zeros((0, width))
            total = np.zeros(len(m))
            for t, own in sorted(parts.items()):  # one order of the sum
                if t not in uppers:
                    total += walk(m, *own[0])
                    continue
                leaf = walk(m, *uppers[t])
                for part in np.unique(leaf).tolist():
                    some = np.flatnonzero(leaf == part)
                    total[some] += walk(m[some], *own[part])
            return pd.Series(total / max(trees, 1))

        return df.withColumn(name, predict(x))

    def _by_join(self, df: DataFrame, x: Column, name: str) -> DataFrame:
        """Distinct feature rows meet the parts that they fall into, in blocks: a part is joined with
        as many salts as its share of the rows asks for."""
        spark, width, trees = df.sparkSession, self.width, self.trees
        path = shared_path(spark, "scored")
        df.select(x.alias("x")).distinct().withColumn("id", F.monotonically_increasing_id()) \
            .write.parquet(path)
        rows = spark.read.parquet(path)
        uppers = self._uppers()
        parts = max(1, self.packed.where("part >= 0").count() // max(trees, 1))
        salts = max(1, math.ceil(rows.count() / parts / SCORE_ROWS))
        all_trees = [r["tree"] for r in self.packed.select("tree").distinct().collect()]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            turn = TaskContext.get().partitionId()
            for batch in batches:
                if not batch.num_rows:
                    continue
                turn += 1
                m, ids = _matrix(batch, width), batch.column("id").to_numpy()
                for t in all_trees:
                    leaf = walk(m, *uppers[t]) if t in uppers else np.zeros(len(m), np.int64)
                    for part in np.unique(leaf).tolist():
                        some = np.flatnonzero(leaf == part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t], pa.int32()), pa.array([part], pa.int64()),
                             pa.array([(turn + part) % salts], pa.int32()),
                             pa.array([ids[some].tobytes()], pa.binary()),
                             pa.array([m[some].tobytes()], pa.binary())],
                            names=["tree", "part", "salt", "ids", "x"])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, values = [np.zeros(0, np.int64)], [np.zeros(0)]
            if left.num_rows and right.num_rows:
                own = [right.column(c)[0].values.to_numpy(zero_copy_only=False)
                       for c in ("feature", "threshold", "left", "value")]
                for i, m in zip(left.column("ids"), left.column("x"), strict=True):
                    ids.append(np.frombuffer(i.as_py(), np.int64))
                    values.append(walk(np.frombuffer(m.as_py()).reshape(-1, width), *own))
            return pa.table({"id": np.concatenate(ids), "v": np.concatenate(values)})

        blocks = rows.mapInArrow(deal, "tree int, part long, salt int, ids binary, x binary")
        keys = ["tree", "part", "salt"]
        own = self.packed.where("part >= 0").select(
            "tree", "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
            "feature", "threshold", "left", "value")
        sums = blocks.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(meet, "id long, v double") \
            .groupBy("id").agg((F.sum("v") / trees).alias(name))
        by_x = rows.join(sums, "id").select(F.col("x").alias("__x"), F.col(name).alias("__value"))
        kept = [col(c) for c in df.columns if c != name]
        return df.withColumn("__key", x).join(by_x, F.col("__key") == F.col("__x")) \
            .select(*kept, F.col("__value").alias(name))


def feature_array(df: DataFrame, features: str, names) -> Column:
    """The features of a frame as array<double>: its assembled vector, or the columns ``names``."""
    if features in df.columns:
        return vector_to_array(F.col(features))
    return F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in names])


def read_model(spark: SparkSession, path: str, width: int) -> ForestModel:
    return ForestModel.read(spark.read.schema(PACKED).parquet(path), width)
