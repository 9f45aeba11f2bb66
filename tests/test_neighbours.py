"""Neighbours against all pairs, and layouts by trustworthiness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering as K
from millrace.operators import neighbours as N


def squares(x):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return d


def trustworthiness(x, y, k=10):
    n = len(x)
    rank = np.argsort(np.argsort(squares(x), 1), 1) + 1
    near = np.argsort(squares(y), 1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


@pytest.fixture(scope="module")
def given(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").cache()
    rows = df.orderBy("vec_id").collect()
    return df, [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)


def recall(edges, ids, x, k=10):
    place = {i: n for n, i in enumerate(ids)}
    exact = np.argsort(squares(x), 1)[:, :k]
    got = {}
    for r in edges:
        got.setdefault(place[r[0]], set()).add(place[r[1]])
    return np.mean([len(got.get(i, set()) & set(exact[i])) / k for i in range(len(x))])


def test_recall_of_given_vectors(given, monkeypatch):
    df, ids, x = given
    edges = N.knn_graph(df, "vec_id", "embedding").collect()
    assert recall(edges, ids, x) >= 0.9
    own = {i: n for n, i in enumerate(ids)}
    assert all(abs(r.distance - np.linalg.norm(x[own[r.vec_id]] - x[own[r.neighbour]])) < 1e-6 for r in edges)
    assert np.bincount([own[r.vec_id] for r in edges]).max() <= 10


def test_small_blocks_and_upper_trees(spark, monkeypatch):
    """Blocks far smaller than the input, so that trees and descent have to find the neighbours; any partitioning gives the same edges."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 4
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))
    monkeypatch.setattr(N, "LEAF", 150)
    monkeypatch.setattr(N, "BLOCK", 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    edges = N.knn_graph(df.repartition(3), "k", "v").collect()
    assert recall(edges, list(range(900)), x) >= 0.9
    assert {tuple(r) for r in N.knn_graph(df.repartition(5), "k", "v", rounds=0).collect()} == {tuple(r) for r in N.knn_graph(df.coalesce(1), "k", "v", rounds=0).collect()}


def test_copies_nulls_and_tiny_tables(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(500, [1.0, 3.0]), (501, None), (502, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = sorted(tuple(r)[:2] for r in N.knn_graph(df, "k", "v").collect())
    assert got == [(0, 500), (0, 502), (500, 0), (500, 502), (502, 0), (502, 500)]
    placed = {r.k: (r.x, r.y) for r in N.layout(df, "k", "v").collect()}
    assert placed.keys() == set(range(503)) - {501} and len(set(placed.values())) == 3
    for n in (0, 1, 2):
        few = df.where(F.col("k").isin([0, 502][:n]))
        assert N.knn_graph(few, "k", "v").count() == (2 if n == 2 else 0) and N.layout(few, "k", "v").count() == n


def test_layout_keeps_neighbours_better_than_axes(given):
    df, ids, x = given
    y = np.array([(r.x, r.y) for r in N.layout(df, "vec_id", "embedding").orderBy("vec_id").collect()])
    axes = np.array([(r.x, r.y) for r in K.project(df, "vec_id", "embedding").orderBy("vec_id").collect()])
    assert y.shape == (len(x), 2) and np.isfinite(y).all()
    assert trustworthiness(x, y) > trustworthiness(x, axes)


def test_layout_by_landmarks(spark):
    """Points that are no landmarks stand by their neighbours."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 10)) * 5
    x = centres[rng.integers(0, 9, 600)] + rng.normal(size=(600, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    y, axes = (np.array([(r.x, r.y) for r in made.orderBy("k").collect()]) for made in (N.layout(df, "k", "v", landmarks=200), K.project(df, "k", "v")))
    assert trustworthiness(x, y) > max(0.9, trustworthiness(x, axes))


def test_groups_meet_within_reach_only(monkeypatch):
    """Every edge of a group that its row's reach lets through, by brute force, in pieces of one group too; none beyond."""
    rng = np.random.default_rng(2)
    sizes = [1, 2, 5, 5, 9, 1]
    a = np.repeat(np.arange(len(sizes)), sizes)
    x, p = rng.normal(size=(len(a), 3)), np.arange(len(a)) * 10
    reach = np.where(rng.random(len(a)) < 0.3, np.inf, 4.0)
    want = set()
    for i in range(len(a)):
        others = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(len(a)) if a[j] == a[i] and j != i)[:3]
        want |= {(p[i], p[j]) for d, j in others if d <= reach[i]}
    for held in (1, 1 << 21):
        monkeypatch.setattr(N, "HELD", held)
        got = N.meetings(a, p, x, reach, 3)
        assert len(got) == len(want) and set(zip(got["a"], got["b"], strict=True)) == want
        assert all(abs(((x[i // 10] - x[j // 10]) ** 2).sum() - d) < 1e-9 for i, j, d in got.itertuples(index=False))


def test_places_take_few_rows_by_all_landmarks():
    """A batch of 10,000 rows against 2,000 landmarks was 160 MB an array."""
    assert N.PLACED * 2000 * 8 <= 8 << 20
    at, y = np.array([[0.0], [1.0], [5.0], [9.0]]), np.array([[0.0, 0.0], [2.0, 0.0], [4.0, 4.0], [8.0, 8.0]])
    got = N.place_of(np.array([[1.0], [9.0]]), at, (at**2).sum(1), y)
    assert np.allclose(got, [[2, 0], [8, 8]], atol=1e-6)


def test_graph_is_alike_for_any_batch(spark):
    x = np.random.default_rng(6).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    found = []
    for n in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        found.append({(r.k, r.neighbour) for r in N.knn_graph(df, "k", "v", k=5, trees=2, rounds=1).collect()})
    assert found[0] == found[1] and len(found[0]) == 1500
