"""K-means fits of many groups, k, subsamples and starts at once, over rows that stay in their partitions.

A step is one pass: a task meets a block of rows with some fits, adds up the rows' sums by nearest
centre for every fit that still moves, and what many tasks added for the same fits meets in a
shuffle, so the driver holds centres only. Where there are fewer blocks than cores, fits are dealt
too; where one block of BYTES holds all rows, its tasks take their fits through all steps. First centres are drawn by k-means++ from at most SEEDS rows of least hash of a group;
every step and every figure covers all rows. A row is in a subsample if the hash of its key and
vector, mixed with the seed, k and the resample's number, says so.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.workers import importable

SEEDS, PARTS, STEPS, FULL = 2000, 32, 100, -1
#: Bytes of a partition's vectors; rows and centres that are compared at once; centres that move in one pass; tasks of a pass for each core.
BYTES, TILE, CENTRES, PASS, TASKS = 32 << 20, 1024, 512, 32_768, 4


class Blocks(NamedTuple):
    """made: (group, vectors less the middle, each with a 1 and its square, hashes), one of a group and partition; sizes and rows to seed from by group."""

    made: RDD
    sizes: dict[int, int]
    first: dict[int, np.ndarray]
    middle: np.ndarray


def blocks(df: DataFrame, key: str, vec: str, group: str | None = None) -> Blocks:
    """The rows of a table that has some."""
    spark = df.sparkSession
    importable(spark)
    rows = df.select((F.lit(0) if group is None else F.col(group)).cast("long").alias("p"), F.xxhash64(key, vec).alias("h"), F.col(vec).cast("array<double>").alias("v"))
    sizes = {r.p: r["count"] for r in rows.groupBy("p").count().collect()}
    seeds = (rows.orderBy("h").limit(SEEDS) if group is None else least_by_group(rows)).select("p", "v").toPandas()
    every = np.array(seeds["v"].tolist(), dtype=np.float64)
    middle = every.mean(0)
    first = {p: every[seeds["p"].to_numpy() == p] - middle for p in sizes}

    def pack(frames):
        import pandas as pd

        held: dict[int, list] = {}
        for f in frames:
            for p, g in f.groupby("p"):
                held.setdefault(p, []).append((with_square(g["v"], middle), g["h"].to_numpy(np.int64)))
        for p, parts in held.items():
            x, h = (np.concatenate(side) for side in zip(*parts, strict=True))
            yield pd.DataFrame({"p": [p], "x": [x.tobytes()], "h": [h.tobytes()]})

    d = len(middle)
    parts = max(1, -(-sum(sizes.values()) * d * 4 // BYTES))
    packed = rows.repartition(parts).mapInPandas(pack, "p long, x binary, h binary").rdd
    made = packed.map(lambda r: (r.p, np.frombuffer(r.x, np.float32).reshape(-1, d + 2), np.frombuffer(r.h, np.uint64)))
    return Blocks(made.persist(StorageLevel.MEMORY_AND_DISK), sizes, first, middle)


def least_by_group(rows: DataFrame) -> DataFrame:
    """The SEEDS rows of least hash of each group, in that order: first of each of PARTS parts of a group, so a task meets SEEDS * PARTS rows of a group at most."""
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("h"))
    some = rows.withColumn("at", rank("p", F.pmod("h", F.lit(PARTS)))).where(F.col("at") <= SEEDS)
    return some.withColumn("at", rank("p")).where(F.col("at") <= SEEDS).orderBy("p", "at")


def with_square(vectors, middle: np.ndarray) -> np.ndarray:
    x = (np.array(vectors.tolist(), dtype=np.float64) - middle).astype(np.float32)
    return np.concatenate([x, np.ones((len(x), 1), np.float32), (x**2).sum(1)[:, None]], 1)


def inside(h: np.ndarray, seed: int, k: int, boots: np.ndarray, share: float) -> np.ndarray:
    """Whether a row (across) is in a resample (down); all rows are in FULL."""
    salt = np.array([np.random.SeedSequence([seed, k, int(b) + 1]).generate_state(1, np.uint64)[0] for b in boots], dtype=np.uint64)
    z = salt[:, None] ^ h
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return (z < np.uint64(int(share * 2**64) if share < 1 else 2**64 - 1)) | (boots == FULL)[:, None]


def tiles(x: np.ndarray, c: np.ndarray, keep: np.ndarray):
    """(slice of rows, whether a centre is the first nearest of a row, by centre, fit, row) of a block; keep: whether a row (across) counts for a fit (down)."""
    k, j, d = c.shape
    by = np.concatenate([-2 * c, (c**2).sum(2)[..., None], np.zeros((k, j, 1), c.dtype)], 2).reshape(k * j, d + 2)
    for a in range(0, len(x), TILE):
        at = slice(a, a + TILE)
        far = (by @ x[at].T).reshape(k, j, -1)
        best, free, one = far.min(0), keep[:, at].copy(), np.empty(far.shape, bool)
        for i in range(k):
            np.equal(far[i], best, out=one[i])
            one[i] &= free
            free ^= one[i]
        yield at, one


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centre of each row."""
    every = np.ones((1, len(x)), bool)
    return np.concatenate([one[:, 0].argmax(0) for _, one in tiles(x, c[:, None], every)])


def added(a: tuple, b: tuple) -> tuple:
    return tuple(u + v for u, v in zip(a, b, strict=True))


def total(made: RDD, items: list[tuple], work: Callable, finish: Callable | None = None) -> list:
    """Of each item, finish(item, sums) of work's tuples over the blocks of its group; items start with their group."""
    sc = made.context
    sent, parts = sc.broadcast(items), made.getNumPartitions()
    hands = max(1, min(len(items), -(-TASKS * sc.defaultParallelism // parts)))

    def run(pairs):
        sums: dict[int, tuple] = {}
        for (p, x, h), hand in pairs:
            for i in range(hand, len(sent.value), hands):
                if sent.value[i][0] == p:
                    got = work(sent.value[i], x, h)
                    sums[i] = added(sums[i], got) if i in sums else got
        yield from sums.items()

    sums = made.cartesian(sc.parallelize(range(hands), hands)).mapPartitions(run)
    if parts > 1:
        sums = sums.reduceByKey(added, min(len(items), sc.defaultParallelism))
    out = dict((sums if finish is None else sums.map(lambda s: (s[0], finish(sent.value[s[0]], s[1])))).collect())
    sent.destroy()
    return [out[i] for i in range(len(items))]


def batches(runs: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Runs of one group and k each, of at most CENTRES centres."""
    out = []
    for p, k in sorted({r[:2] for r in runs}):
        of, n = [r for r in runs if r[:2] == (p, k)], max(1, CENTRES // k)
        out += [of[a : a + n] for a in range(0, len(of), n)]
    return out


def waves(jobs: list[tuple[int, int, int]], starts: int) -> list[list[tuple[int, int, int]]]:
    """Jobs whose fits have at most PASS centres together."""
    out, held = [], PASS
    for job in jobs:
        if held + starts * job[1] > PASS:
            out.append([])
            held = 0
        out[-1].append(job)
        held += starts * job[1]
    return out


def fit(rows: Blocks, jobs: list[tuple[int, int, int]], starts: int, seed: int, share: float) -> dict[tuple[int, int, int], np.ndarray]:
    """The centres of least inertia of each (group, k, resample)."""
    out = {}
    for wave in waves(jobs, starts):
        out |= fit_at_once(rows, wave, starts, seed, share)
    return out


def fit_at_once(rows: Blocks, jobs: list[tuple[int, int, int]], starts: int, seed: int, share: float) -> dict[tuple[int, int, int], np.ndarray]:
    from .clustering import plus_plus

    sc = rows.made.context
    sent = sc.broadcast(rows.first)
    runs = [(*job, s) for job in jobs for s in range(starts)]
    begin = sc.parallelize(runs, min(len(runs), 4 * sc.defaultParallelism)).map(lambda r: plus_plus(sent.value[r[0]], r[1], np.random.default_rng([seed, r[1], r[2] + 1, r[3]])).astype(np.float32)).collect()
    sent.destroy()
    now, cost = dict(zip(runs, begin, strict=True)), {}
    still = {p: max(float(f.std()), 1e-30) * 1e-6 for p, f in rows.first.items()}

    def work(item, x, h):
        _, k, boots, c = item
        each, at = np.unique(boots, return_inverse=True)
        keep = inside(h, seed, k, each, share)[at]
        sums = np.zeros((k * len(boots), x.shape[1]))
        for part, one in tiles(x, c, keep):
            sums += one.reshape(len(sums), -1).astype(np.float32) @ x[part]
        return (sums.reshape(k, len(boots), -1),)

    def moved(item, sums):
        """(centres, whether they moved, inertia before it) of the fits of an item."""
        (s,), c = sums, item[3]
        size, square, s = s[..., -2], s[..., -1].sum(0), s[..., :-2]
        new = np.where(size[..., None] > 0, s / np.maximum(size, 1)[..., None], c).astype(np.float32)
        wide = c.astype(np.float64)
        return new, np.abs(new - c).max((0, 2)) > still[item[0]], square + (size * (wide**2).sum(2) - 2 * (wide * s).sum(2)).sum(0)

    def settled(item, x, h):
        """moved, repeated until nothing does; of a block that is all there is."""
        p, k, boots, c = item
        c, spent, left = c.copy(), np.zeros(len(boots)), np.arange(len(boots))
        for _ in range(STEPS):
            now = (p, k, boots[left], c[:, left])
            c[:, left], more, spent[left] = moved(now, work(now, x, h))
            left = left[more]
            if not len(left):
                break
        return c, np.zeros(len(boots), bool), spent

    alone = rows.made.getNumPartitions() == 1
    for _ in range(STEPS):
        groups = batches(runs)
        items = [(*g[0][:2], np.array([r[2] for r in g]), np.stack([now[r] for r in g], 1)) for g in groups]
        runs = []
        for g, (new, more, inertia) in zip(groups, total(rows.made, items, settled) if alone else total(rows.made, items, work, moved), strict=True):
            for i, r in enumerate(g):
                now[r], cost[r] = new[:, i], inertia[i]
                if more[i]:
                    runs.append(r)
        if not runs:
            break
    return {job: now[min(((*job, s) for s in range(starts)), key=lambda r: cost[r])] for job in jobs}


def agreement(rows: Blocks, best: dict[tuple[int, int, int], np.ndarray], asked: list[tuple[int, int]], boots: int, seed: int, share: float) -> list[tuple]:
    """Of each (group, k): adjusted Rand indices of all pairs of resamples, over the rows of both, and sizes, sums and sums of squares of the whole fit's clusters."""
    from .clustering import ari_of

    def work(item, x, h):
        _, k, c = item
        keep = inside(h, seed, k, np.arange(FULL, boots), share)
        both, full = np.zeros((k * boots, k * boots)), np.zeros((k, x.shape[1]))
        for part, one in tiles(x, c, keep):
            full += one[:, 0].astype(np.float32) @ x[part]
            flat = one[:, 1:].reshape(k * boots, one.shape[2]).astype(np.float32)
            both += flat @ flat.T
        return both, full

    items = [(p, k, np.stack([best[p, k, b] for b in range(FULL, boots)], 1)) for p, k in asked]
    out = []
    for (_, k), (both, full) in zip(asked, total(rows.made, items, work), strict=True):
        m = both.reshape(k, boots, k, boots)
        out.append(([ari_of(m[:, a, :, b]) for a, b in combinations(range(boots), 2)], full[:, -2], full[:, :-2], full[:, -1]))
    return out


def scan(df: DataFrame, key: str, vec: str, ks: list[int], boots: int, share: float, starts: int, seed: int) -> list[tuple]:
    """Rows (k, silhouette, davies_bouldin, ari_mean, ari_std, n_pairs).

    The silhouette is that of squared distances: a row's mean squared distance to a cluster follows
    from the cluster's size, sum and sum of squares, so it takes one pass and no pairs of rows.
    """
    rows = blocks(df, key, vec)
    best = fit(rows, [(0, k, b) for k in ks for b in range(FULL, boots)], starts, seed, share)
    facts = agreement(rows, best, [(0, k) for k in ks], boots, seed, share)

    def spreads(item, x, _h):
        _, c, n, s, q = item
        x64 = x[:, :-2].astype(np.float64)
        return spread_of(x64, (x64**2).sum(1), nearest(x, c), n, s, q)

    spread = total(rows.made, [(0, best[0, k, FULL], *f[1:]) for k, f in zip(ks, facts, strict=True)], spreads)
    rows.made.unpersist()
    out = []
    for k, (aris, size, centre, _), (away, score) in zip(ks, facts, spread, strict=True):
        used = size > 0
        s, c = away[used] / size[used], centre[used] / size[used][:, None]
        apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        r = (s[:, None] + s[None]) / np.where(apart > 0, apart, np.inf)
        bouldin = float(r.max(1).mean()) if used.sum() > 1 else 0.0
        out.append((k, float(score / size.sum()), bouldin, float(np.mean(aris)) if aris else None, float(np.std(aris)) if aris else None, len(aris) or None))
    return out


def splits(df: DataFrame, key: str, vec: str, group: str, least: int, ks: tuple[int, ...], gate: float, boots: int, share: float, starts: int, seed: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """(by group the centres, that of most rows first, of the largest k whose clusters are big enough and stable, if any; the middle)."""
    rows = blocks(df, key, vec, group)
    asked = [(p, k) for p in sorted(rows.sizes) if rows.sizes[p] >= 2 * least for k in sorted(ks)]
    out = {}
    if asked:
        best = fit(rows, [(p, k, FULL) for p, k in asked], starts, seed, share)
        asked = [at for at, f in zip(asked, agreement(rows, best, asked, 0, seed, share), strict=True) if f[1].min() >= least]
    if asked:
        best |= fit(rows, [(p, k, b) for p, k in asked for b in range(boots)], starts, seed, share)
        for (p, k), (aris, size, *_) in zip(asked, agreement(rows, best, asked, boots, seed, share), strict=True):
            if aris and np.mean(aris) >= gate:
                out[p] = best[p, k, FULL][np.argsort(-size, kind="stable")]
    rows.made.unpersist()
    return out, rows.middle


def spread_of(x: np.ndarray, norm: np.ndarray, label: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(sums of distances to the own cluster's mean by cluster, sum of silhouettes) of rows; n, s, q: sizes, sums and sums of squares of the clusters."""
    rows, used = np.arange(len(x)), np.maximum(n, 1)
    far = np.maximum(norm[:, None] - 2 * x @ (s / used[:, None]).T + q / used, 0)
    own = far[rows, label] * n[label] / np.maximum(n[label] - 1, 1)
    far[:, n == 0] = np.inf
    far[rows, label] = np.inf
    other = far.min(1)
    most = np.maximum(own, other)
    fine = (n[label] > 1) & (most > 0) & np.isfinite(other)
    score = float(((other - own)[fine] / most[fine]).sum())
    away = np.sqrt(((x - (s / used[:, None])[label]) ** 2).sum(1))
    return np.bincount(label, away, len(n)), score


def labels(df: DataFrame, key: str, vec: str, k: int, starts: int, seed: int) -> DataFrame:
    """(key, c) of the best of the starts; no rows give none."""
    kind = df.schema[key].dataType.simpleString()
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, c int")
    rows = blocks(df, key, vec)
    c, middle = fit(rows, [(0, k, FULL)], starts, seed, 1.0)[0, k, FULL], rows.middle
    rows.made.unpersist()

    def run(frames):
        for f in frames:
            if len(f):
                yield f[[key]].assign(c=nearest(with_square(f["v"], middle), c).astype(np.int32))

    return df.select(key, F.col(vec).cast("array<double>").alias("v")).mapInPandas(run, f"{key} {kind}, c int")
