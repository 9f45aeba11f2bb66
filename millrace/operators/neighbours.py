"""Approximate nearest neighbours of all rows at once, and a two-dimensional layout that keeps them together.

Rows of equal vectors are one point, so copies cost one. A forest of random hyperplanes deals the
points to leaves; the upper part of each tree is grown on ``SAMPLE`` points of least hash and has
``LEAVES`` leaves at most, so what is broadcast is bounded; a leaf's task splits it further into
blocks and compares within blocks only. Rounds of neighbour descent then let the neighbours of a
point, and a bounded number of those that point to it, meet each other. A point never meets all
others.

The layout moves ``landmarks`` points (all, if there are fewer) by sampled edges of their neighbour
graph, pulled together, and random other points, pushed apart. Every other point is put by its
nearest landmarks, and then half way to the middle of its neighbours.

Null vectors have no neighbours and no place; vectors must be of one length. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workers import cut, importable

SAMPLE, LEAVES, LEAF, BLOCK = 20_000, 1024, 4096, 256


def points_of(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(p, v, key): distinct vectors by a hash of theirs, with the least key that has each."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), F.col(key).alias("key"))
    return rows.groupBy(F.xxhash64("v").alias("p")).agg(F.min_by("v", "key").alias("v"), F.min("key").alias("key"))


def split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A hyperplane half way between two of the points, moved to the median, so that halves are even."""
    a, b = rng.choice(len(x), 2, replace=False)
    direction = x[a] - x[b]
    if not direction.any():
        direction = rng.normal(size=x.shape[1])
    return direction, float(np.median(x @ direction))


def grown(x: np.ndarray, leaves: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, int, int]]:
    """A tree as nodes (direction, offset, left, right); negative children are leaves, -1 - leaf."""
    nodes: list = []
    made = 0

    def grow(at: np.ndarray, share: int) -> int:
        nonlocal made
        if share < 2 or len(at) < 4:
            made += 1
            return -made
        direction, offset = split(x[at], rng)
        right = x[at] @ direction > offset
        me = len(nodes)
        nodes.append(None)
        children = grow(at[~right], share // 2), grow(at[right], share - share // 2)
        nodes[me] = (direction, offset, *children)
        return me

    grow(np.arange(len(x)), leaves)
    return nodes


def leaf_of(x: np.ndarray, nodes: list) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(x), dtype=np.int64)
    held = [(0, np.arange(len(x)))] if nodes else []
    while held:
        me, at = held.pop()
        direction, offset, left, right = nodes[me]
        side = x[at] @ direction > offset
        for child, part in ((left, at[~side]), (right, at[side])):
            if child < 0:
                out[part] = -1 - child
            elif len(part):
                held.append((child, part))
    return out


def blocks_of(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of the rows, in blocks of at most ``size`` near ones."""
    done, held = [], [np.arange(len(x))]
    while held:
        at = held.pop()
        if len(at) <= size:
            done.append(at)
            continue
        direction, offset = split(x[at], rng)
        right = x[at] @ direction > offset
        if right.all() or not right.any():  # ties at the median
            right = np.arange(len(at)) * 2 < len(at)
        held += [at[~right], at[right]]
    return done


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, squared distance) of the k nearest others of each row, by all pairs of a block."""
    norm = (x**2).sum(1)
    d = np.maximum(norm[:, None] - 2 * x @ x.T + norm, 0)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    if k < 1:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(x)), k)
    return row, near.ravel(), d[row, near.ravel()]


EDGES = "a long, b long, d double"


def edge_frame(p: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    row, other, d = nearest(x, k)
    return pd.DataFrame({"a": p[row], "b": p[other], "d": d})


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a, each once; ties by b."""
    once = edges.groupBy("a", "b").agg(F.min("d").alias("d"))
    lists = once.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, k).alias("near"))  # as many as trees and rounds have offered
    return lists.select("a", F.inline("near")).select("a", "b", "d")


def forest_edges(points: DataFrame, k: int, trees: int, seed: int) -> DataFrame:
    """Edges within blocks of each tree."""
    spark = points.sparkSession
    importable(spark)
    n = points.count()
    leaves = max(1, min(LEAVES, n // LEAF))
    sample = np.array([r.v for r in points.orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(SAMPLE).collect()], dtype=np.float64) if leaves > 1 else None
    grown_trees = [grown(sample, leaves, np.random.default_rng([seed, t])) if leaves > 1 else [] for t in range(trees)]
    shared = spark.sparkContext.broadcast(grown_trees)

    def deal(frames):
        for f in frames:
            x = np.array(f["v"].tolist(), dtype=np.float64)
            for t, nodes in enumerate(shared.value):
                yield pd.DataFrame({"tree": np.int32(t), "leaf": leaf_of(x, nodes) if len(f) else [], "p": f["p"], "v": f["v"]})

    def meet(f):
        x, p = np.array(f["v"].tolist(), dtype=np.float64), f["p"].to_numpy()
        order = np.argsort(p)  # alike however rows are dealt
        x, p = x[order], p[order]
        rng = np.random.default_rng([seed, int(f["tree"].iloc[0]), int(f["leaf"].iloc[0])])
        return pd.concat([edge_frame(p[at], x[at], k) for at in blocks_of(x, BLOCK, rng)])

    dealt = points.select("p", "v").mapInPandas(deal, "tree int, leaf long, p long, v array<double>")
    return dealt.groupBy("tree", "leaf").applyInPandas(meet, EDGES)


#: Numbers of a batch's vectors, and of its distances, that a task holds at once.
HELD = 1 << 21


def meetings(a: np.ndarray, p: np.ndarray, x: np.ndarray, reach: np.ndarray, k: int) -> pd.DataFrame:
    """Edges among the rows of each group of a (rows in order of a, p): the k nearest of each row, as far as its reach."""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    sizes = np.diff(np.r_[starts, len(a)])
    out = []
    for n in np.unique(sizes[sizes > 1]).tolist():  # groups of a size at once
        of = starts[sizes == n]
        step = max(1, HELD // (n * (n + x.shape[1])))
        for i in range(0, len(of), step):
            at = of[i : i + step, None] + np.arange(n)
            y = x[at]
            norm = (y**2).sum(2)
            d = np.maximum(norm[:, :, None] - 2 * y @ y.transpose(0, 2, 1) + norm[:, None], 0)
            d[:, np.arange(n), np.arange(n)] = np.inf
            near = np.argpartition(d, min(k, n - 1) - 1, axis=2)[:, :, : min(k, n - 1)]
            far = np.take_along_axis(d, near, 2)
            g, row, col = np.nonzero(far <= reach[at][:, :, None])
            out.append(pd.DataFrame({"a": p[at[g, row]], "b": p[at[g, near[g, row, col]]], "d": far[g, row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "d": np.zeros(0)})


def descended(edges: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """One round: what a point's neighbours, and the k nearest of those that it is a neighbour of, find among each other.

    Each point brings its reach, the distance of its k-th neighbour so far: what is farther can't
    enter its list, and stays in the task.
    """
    back = best(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), k)
    own = edges.select("a", F.col("a").alias("b")).distinct()
    members = edges.select("a", "b").unionByName(back.select("a", "b")).unionByName(own).distinct()
    reach = edges.groupBy(F.col("a").alias("b")).agg(F.when(F.count("*") >= k, F.max("d") * (1 + 1e-9) + 1e-9).alias("reach"))

    def meet(frames):
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f])
            last = f["a"].to_numpy() == f["a"].iloc[-1] if len(f) else np.zeros(0, bool)
            held = f[last]  # the group may go on in the next batch
            yield from found(f[~last])
        if held is not None:
            yield from found(held)

    def found(f):
        if len(f):
            x = np.frombuffer(b"".join(f["v"]), dtype=np.float64).reshape(len(f), -1)
            yield meetings(f["a"].to_numpy(), f["p"].to_numpy(), x, f["reach"].fillna(np.inf).to_numpy(), k)

    met = members.join(packed(points).select(F.col("p").alias("b"), "v").join(reach, "b", "left"), "b").select("a", F.col("b").alias("p"), "v", "reach")
    dealt = met.repartition("a").sortWithinPartitions("a", "p")
    return best(edges.unionByName(dealt.mapInPandas(meet, EDGES)), k)


def packed(points: DataFrame) -> DataFrame:
    """(p, v): points with their vectors as bytes."""

    def pack(frames):
        for f in frames:
            yield pd.DataFrame({"p": f["p"], "v": [np.asarray(v, dtype=np.float64).tobytes() for v in f["v"]]})

    return points.select("p", "v").mapInPandas(pack, "p long, v binary")


def knn_graph(df: DataFrame, key: str, vec: str, k: int = 10, trees: int = 4, rounds: int = 2, seed: int = 0) -> DataFrame:
    """(key, neighbour, distance): about the k nearest other points of each point, both named by the least key of their vector."""
    points = cut(points_of(df, key, vec))
    edges = point_edges(points, k, trees, rounds, seed)
    named = lambda c, to: points.select(F.col("p").alias(c), F.col("key").alias(to))
    return edges.join(named("a", key), "a").join(named("b", "neighbour"), "b").select(key, "neighbour", F.sqrt("d").alias("distance"))


def point_edges(points: DataFrame, k: int, trees: int, rounds: int, seed: int) -> DataFrame:
    edges = cut(best(forest_edges(points, k, trees, seed), k))
    for _ in range(rounds):
        edges = cut(descended(edges, points, k))
    return edges


#: The curve of closeness in the layout, 1 / (1 + a d^2b), for points that touch at a tenth of the unit.
CURVE_A, CURVE_B = 1.577, 0.895


def memberships(near: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Weights of edges: 1 for a row's nearest, falling with distance so that they add up to log2 k."""
    k = d.shape[1]
    first = d.min(1, keepdims=True)
    lo, hi = np.full((len(d), 1), 1e-12), np.full((len(d), 1), max(d.max(initial=0), 1e-9) * 4)
    for _ in range(40):
        mid = (lo + hi) / 2
        much = np.exp(-(d - first) / mid).sum(1, keepdims=True) > max(np.log2(k), 1.0)
        hi, lo = np.where(much, mid, hi), np.where(much, lo, mid)
    return np.exp(-(d - first) / hi)


def sampled_layout(x: np.ndarray, k: int, epochs: int, seed: int) -> np.ndarray:
    """Places of points in the plane, from their principal axes, by sampled edges and pushes."""
    rng, n = np.random.default_rng(seed), len(x)
    middle = x - x.mean(0)
    axes = np.linalg.svd(middle, full_matrices=False)[2][:2] if n > 1 else np.zeros((1, x.shape[1]))
    y = np.zeros((n, 2))
    y[:, : len(axes)] = middle @ axes.T
    y *= 10 / max(np.abs(y).max(), 1e-12)
    k = min(k, n - 1)
    if k < 1:
        return y
    row, other, d = nearest(x, k)
    w = memberships(other.reshape(n, k), np.sqrt(d).reshape(n, k)).ravel()
    for e in range(epochs):
        step = 1 - e / epochs
        take = rng.random(len(w)) < w
        i, j = row[take], other[take]
        gap = y[i] - y[j]
        far = (gap**2).sum(1)
        pull = np.where(far > 0, -2 * CURVE_A * CURVE_B * np.maximum(far, 1e-12) ** (CURVE_B - 1) / (1 + CURVE_A * far**CURVE_B), 0)
        move = np.clip(pull[:, None] * gap, -4, 4) * step
        np.add.at(y, i, move)
        np.add.at(y, j, -move)
        for _ in range(5):
            j = rng.integers(0, n, len(i))
            gap = y[i] - y[j]
            far = (gap**2).sum(1)
            push = 2 * CURVE_B / ((0.001 + far) * (1 + CURVE_A * far**CURVE_B))
            np.add.at(y, i, np.clip(push[:, None] * gap, -4, 4) * step * (i != j)[:, None])
    return y


#: Rows that are held against all landmarks at once.
PLACED = 256


def place_of(x: np.ndarray, at: np.ndarray, norm: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of rows by their three nearest landmarks; ties by the landmarks' order."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ at.T + norm, 0)
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    w = 1 / (np.take_along_axis(d, near, 1) + 1e-12)
    return (y[near] * w[:, :, None]).sum(1) / w.sum(1, keepdims=True)


def layout(df: DataFrame, key: str, vec: str, k: int = 15, landmarks: int = 2000, epochs: int = 200, seed: int = 0) -> DataFrame:
    """(key, x, y) of every row with a vector; rows of equal vectors stand in one place."""
    spark = df.sparkSession
    importable(spark)
    points = cut(points_of(df, key, vec))
    first = points.orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(landmarks).collect()
    kind = df.schema[key].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{key}` {kind}, x double, y double")
    marks = np.array([r.v for r in first], dtype=np.float64)
    shared = spark.sparkContext.broadcast((np.array([r.p for r in first]), marks, sampled_layout(marks, k, epochs, seed)))

    def put(frames):
        names, at, y = shared.value
        known, norm = set(names.tolist()), (at**2).sum(1)
        for f in frames:
            if not len(f):
                continue
            x = np.array(f["v"].tolist(), dtype=np.float64)
            place = np.concatenate([place_of(x[i : i + PLACED], at, norm, y) for i in range(0, len(x), PLACED)])
            yield pd.DataFrame({"p": f["p"], "x": place[:, 0], "y": place[:, 1], "fixed": [p in known for p in f["p"].tolist()]})

    placed = cut(points.select("p", "v").mapInPandas(put, "p long, x double, y double, fixed boolean"))
    if len(first) == landmarks:  # there may be others, which stand by their neighbours
        edges = point_edges(points, k, 4, 1, seed)
        around = edges.join(placed.select(F.col("p").alias("b"), "x", "y"), "b").groupBy(F.col("a").alias("p")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        mid = lambda c, m: F.when(F.col("fixed") | F.col(m).isNull(), F.col(c)).otherwise((F.col(c) + F.col(m)) / 2).alias(c)
        placed = placed.join(around, "p", "left").select("p", mid("x", "mx"), mid("y", "my"))
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key), F.xxhash64(F.col(vec).cast("array<double>")).alias("p"))
    return rows.join(placed.select("p", "x", "y"), "p").select(key, "x", "y")
