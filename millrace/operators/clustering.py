"""Segments: k-means with restarts, stability, choice of k, naming, two-dimensional view.

Fits of any number of rows, and of the children of all parents, go through ``spread``, whose steps
are passes over the partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.workers import importable

from . import aggregates as A
from . import resample, spread

STARTS = 10


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c, norm = x[[rng.integers(len(x))]], (x**2).sum(1)
    near = np.full(len(x), np.inf)
    for _ in range(1, k):
        near = np.minimum(near, np.maximum(norm - 2 * x @ c[-1] + (c[-1] ** 2).sum(), 0))
        c = np.vstack([c, x[rng.choice(len(x), p=near / near.sum() if near.sum() > 0 else None)]])
    return c


def kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 0) -> DataFrame:
    """(key, cluster_id) with clusters numbered by size, ties by their least key."""
    got = spread.labels(df, key, vec, k, STARTS, seed)
    size = got.groupBy("c").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    rank = size.withColumn("cluster_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "least")) - 1)
    return got.join(F.broadcast(rank.select("c", "cluster_id")), "c").select(key, "cluster_id")


def k_scan(df: DataFrame, key: str, vec: str, ks: Iterable[int], boots: int = 20, share: float = 0.8, seed: int = 0) -> DataFrame:
    """One row a k: silhouette of squared distances, Davies-Bouldin, mean and spread of pairwise ARI of subsample fits; null figures without rows."""
    spark, ks = df.sparkSession, list(ks)
    rows = spread.scan(df, key, vec, ks, boots, share, STARTS, seed) if not df.isEmpty() else [(k, *[None] * 5) for k in ks]
    return spark.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, ari_mean double, ari_std double, n_pairs long")


def choose_k(scan: DataFrame, gate: float = 0.6, margin: float = 1.0) -> int:
    """The largest k whose mean less its spread is stable; else the best silhouette, then Davies-Bouldin."""
    rows = scan.orderBy("k").collect()
    ok = [r.k for r in rows if r.ari_mean is not None and r.ari_mean - margin * r.ari_std >= gate]
    return max(ok) if ok else min(rows, key=lambda r: (-r.silhouette, r.davies_bouldin, r.k)).k


def split_parents(df: DataFrame, key: str, vec: str, parent: str, least: int = 30, ks: tuple[int, ...] = (2, 3, 4), gate: float = 0.6, boots: int = 20, seed: int = 0) -> DataFrame:
    """(key, subcluster_id = parent * 10 + child): the largest k whose children are big enough and stable, else one child.

    The fits of all parents move in the same passes, so no parent has to fit in a task; a resample has
    a row with a chance of 0.8, by its hash.
    """
    from pandas import DataFrame as P

    kind = df.schema[key].dataType.simpleString()
    importable(df.sparkSession)
    df = df.where(F.col(parent) >= 0).select(key, vec, parent)
    chosen, middle = spread.splits(df, key, vec, parent, least, ks, gate, boots, 0.8, STARTS, seed) if not df.isEmpty() else ({}, None)

    def run(frames):
        for f in frames:
            child = np.zeros(len(f), dtype=int)
            for p, at in f.groupby(parent).indices.items():
                if p in chosen:
                    child[at] = spread.nearest(spread.with_square(f[vec].iloc[at], middle), chosen[p])
            yield P({key: f[key], "subcluster_id": f[parent] * 10 + child})

    return df.mapInPandas(run, f"{key} {kind}, subcluster_id int")


def ari(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index over rows that both label."""
    at = (a >= 0) & (b >= 0)
    a, b = a[at], b[at]
    n = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(n, (a, b), 1)
    return ari_of(n)


def ari_of(n: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts."""
    c = lambda v: (v * (v - 1) / 2).sum()
    most = (c(n.sum(0)) + c(n.sum(1))) / 2
    pairs = c(np.array([n.sum()]))
    expected = c(n.sum(0)) * c(n.sum(1)) / pairs if pairs else most
    return 1.0 if most == expected else (c(n) - expected) / (most - expected)


def name_by_marker(terms: dict[int, list[str]], names: list[tuple[str, str]]) -> dict[int, tuple[str, bool]]:
    """Cluster id to (name, provisional): the first free (marker, name) whose marker is among its terms, ids ascending."""
    taken, out = set(), {}
    for c in sorted(terms):
        found = next((n for m, n in names if n not in taken and m in terms[c]), None)
        taken.add(found)
        out[c] = (found, False) if found else (" / ".join(terms[c][:3]) or f"Cluster {c}", True)
    return out


def project(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, x, y): principal components, by MLlib."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    p = vector_to_array(F.col("pc"))
    return PCA(k=2, inputCol="features", outputCol="pc").fit(v).transform(v).select(key, p[0].alias("x"), p[1].alias("y"))


def bootstrap_ci(df: DataFrame, value: str, boots: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(mean, lo, hi) by the percentile bootstrap; see ``resample`` for other statistics."""
    return resample.interval(df, value, resample.Mean(), boots, level, seed).withColumnRenamed("point", "mean")


def is_flat(silhouettes: list[float], within: float = 0.05) -> bool:
    """Whether no number of clusters stands out."""
    return max(silhouettes) - min(silhouettes) < within if silhouettes else True


def subcluster_id(cluster: int, child: int) -> int:
    """One id for parent and child; users without a cluster have one of their own."""
    if cluster < 0:
        return V.NO_SUBCLUSTER
    if not 0 <= child <= 9:
        raise ValueError(f"child {child} of cluster {cluster} has no place in one digit")
    return cluster * 10 + child


def mean_axes(df: DataFrame, *cols: str) -> DataFrame:
    """df with the z-scores of the columns and unmet_need, the mean of those that are not null."""
    for c in cols:
        df = df.withColumn(f"z_{c}", A.zscore(c))
    return df.withColumn("unmet_need", A.mean_of(*[f"z_{c}" for c in cols]))
