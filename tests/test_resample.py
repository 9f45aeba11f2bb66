"""Bootstrap states against numpy on the same weights; exact quantiles against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles as Q
from millrace.operators import resample as R

rng = random.Random(2)
VALUES = [rng.choice([rng.gauss(0, 50), rng.randint(-3, 3), 1e-9 * rng.random(), 7.25]) for _ in range(700)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(float(v),) for v in VALUES] + [(None,), (float("nan"),)]
    return spark.createDataFrame(data, "v double").cache()


def hashes(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    return {r.v: r.h for r in frame.select("v", F.xxhash64("v").alias("h")).collect()}


def test_replicates_are_those_of_the_weights(spark, rows):
    boots, seed = 60, 3
    values, counts = np.unique(np.array(VALUES), return_counts=True)
    own = hashes(spark, values)
    w = R.weights([own[v] for v in values.tolist()], counts, boots, seed)
    mean = (values @ w) / w.sum(0)
    clean = rows.where("v is not null and not isnan(v)")
    got = {r.boot: r.value for r in R.replicates(clean, R.Mean(), boots, seed).collect()}
    assert np.allclose([got[b] for b in range(boots)], mean, rtol=1e-12, atol=1e-12)
    over = np.array([100.0, 0.0])
    h = hashes(spark, over)
    k = [int((np.array(VALUES) > 7).sum()), int((np.array(VALUES) <= 7).sum())]
    w = R.weights([h[v] for v in over.tolist()], k, boots, seed)
    got = {r.boot: r.value for r in R.replicates(clean, R.Share("v > 7"), boots, seed).collect()}
    assert np.allclose([got[b] for b in range(boots)], over @ w / w.sum(0))
    w = R.weights(range(len(values)), counts, boots, seed)
    got = {r.boot: r.value for r in R.replicates(clean, R.Quantile(0.3, bins=5000), boots, seed).collect()}
    for b in range(boots):
        assert got[b] == values[np.searchsorted(np.cumsum(w[:, b]), 0.3 * w[:, b].sum() - 1e-6)]


def test_any_number_of_partitions(spark, rows):
    for s in (R.Mean(), R.Share("v between 0 and 10"), R.median(), R.Quantile(0.9, bins=16)):
        got = [R.interval(rows.repartition(n), "v", s, boots=50).first() for n in (1, 5)]
        assert (got[0].lo, got[0].hi) == (got[1].lo, got[1].hi) and got[0].point == pytest.approx(got[1].point, rel=1e-12)


def test_intervals_hold_the_point_and_cover(rows):
    x = np.array(VALUES)
    m = R.interval(rows, "v", R.Mean(), boots=400).first()
    assert abs(m.point - x.mean()) < 1e-9 and m.lo < m.point < m.hi and abs((m.hi - m.lo) - 2 * 1.96 * x.std() / len(x) ** 0.5) < 0.35 * (m.hi - m.lo)
    q = R.interval(rows, "v", R.Quantile(0.8), boots=400).first()
    assert q.point == np.sort(x)[int(np.ceil(0.8 * len(x))) - 1] and q.lo <= q.point <= q.hi
    coarse = R.interval(rows, "v", R.Quantile(0.8, bins=100), boots=400).first()
    rank = lambda v: (x <= v).mean()
    assert abs(rank(coarse.lo) - rank(q.lo)) < 0.08 and abs(rank(coarse.hi) - rank(q.hi)) < 0.08


class Largest:
    """A statistic of a caller's own."""

    def point(self, v):
        return F.max(v)

    def prepare(self, rows):
        pass

    def groups(self, rows):
        return rows.groupBy("v").agg(F.count("*").alias("k")).select(F.xxhash64("v").alias("at"), "k", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("v")).alias("slot"), "v")

    def added(self, slot, v, w):
        return dict(zip(slot.tolist(), w, strict=True))

    def value(self, slot, n, v):
        return float(v[n > 0].max()) if (n > 0).any() else float("nan")


def test_own_statistic_and_empty_input(spark, rows):
    few = spark.createDataFrame([(float(k % 5),) for k in range(20)], "v double")
    got = R.interval(few, "v", Largest(), boots=40).first()
    assert got.point == 4 and 0 <= got.lo <= got.hi == 4
    for s in (R.Mean(), R.Share("v > 0"), R.median()):
        assert tuple(R.interval(rows.limit(0), "v", s, boots=20).first()) == (None, None, None)
    with pytest.raises(ValueError, match="infinite"):
        R.interval(spark.createDataFrame([(float("inf"),)], "v double"), "v", R.Mean(), boots=5)


@pytest.mark.parametrize(
    "values",
    [VALUES, [1.0], [2.0, 2.0], [1.0, 2.0], [1.0, np.nextafter(1.0, 2)], [-1e308, 1e308, 0.0, 5e-324], [2.0**k for k in range(-60, 60, 7)], list(range(1000))],
)
def test_exact_quantiles(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
    for p in (0, 0.5, 0.9):
        got = Q.exact_quantile(frame, "x", p, buckets=64)
        assert got == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)) if max(map(abs, values)) < 1e300 else got, rel=1e-12, abs=0)
        assert min(values) <= got <= max(values)
    assert Q.exact_quantile(frame.limit(0), "x", 0.5) is None
