"""Bootstrap intervals of any statistic, by one pass and mergeable states.

A statistic says how rows are summed up (groups of rows that it can't tell apart, with how many they
are), what a weighted group adds to each replicate, and how the sums become a value. A group of k
rows gets a Poisson(k) weight a replicate, drawn by the seed and the group's own number: what k rows
with a Poisson(1) weight each would get. Sums are whole numbers, so intervals are the same however
rows are dealt. To add a statistic, write its class; nothing else changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.workers import importable

LIMBS, LIMB = 3, 20


class Mean:
    """The mean. Values are scaled to whole numbers of 60 bits by a power of two; relative errors stay under 2**-58 of the largest value."""

    def point(self, v: Column) -> Column:
        return F.avg(v)

    def prepare(self, rows: DataFrame) -> None:
        most = rows.agg(F.max(F.abs("v"))).first()[0] or 0.0
        if not np.isfinite(most):
            raise ValueError("an infinite value has no mean")
        self.shift = int(LIMBS * LIMB - 2 - np.frexp(most)[1])

    def groups(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("v").agg(F.count("*").alias("k")).select(F.xxhash64("v").alias("at"), "k", F.lit(0).alias("slot"), "v")

    def added(self, slot: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
        """By slot: 0 the weights, 1 to LIMBS the weighted limbs of the scaled values."""
        whole = np.rint(np.ldexp(v, self.shift)).astype(np.int64)
        out = {0: w.sum(0)}
        for i in range(LIMBS):
            part = whole >> (LIMB * i)
            out[i + 1] = ((part & (1 << LIMB) - 1 if i < LIMBS - 1 else part)[:, None] * w).sum(0)
        return out

    def value(self, slot: np.ndarray, n: np.ndarray, v: np.ndarray) -> float:
        sums = dict(zip(slot.tolist(), n.tolist(), strict=True))
        total = sum(sums.get(i + 1, 0) << (LIMB * i) for i in range(LIMBS))
        return float(np.ldexp(total / sums[0], -self.shift)) if sums.get(0) else np.nan


class Share(Mean):
    """The share of rows, in a hundred, for which a condition over the value holds (SQL, by the name v)."""

    def __init__(self, condition: str):
        self.condition = condition

    def met(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False)).cast("double") * 100

    def point(self, v: Column) -> Column:
        return F.avg(self.met())

    def groups(self, rows: DataFrame) -> DataFrame:
        return super().groups(rows.select(self.met().alias("v")))

    def prepare(self, rows: DataFrame) -> None:
        self.shift = LIMBS * LIMB - 2 - 7


class Quantile:
    """The least value with at least a share p of the weight at or below it.

    Rows are grouped in at most ``bins`` ranges, each standing for its largest value: exact where the
    column has fewer distinct values, else a replicate's rank is off by one range at most. Ranges end
    at the distinct values of least hash, which are alike however rows are dealt.
    """

    def __init__(self, p: float = 0.5, bins: int = 1024):
        if not 0 < p < 1 or bins < 2:
            raise ValueError("a share between 0 and 1, and two ranges at least")
        self.p, self.bins = p, bins

    def point(self, v: Column) -> Column:
        return F.expr(f"percentile_disc({self.p}) within group (order by v)")

    def prepare(self, rows: DataFrame) -> None:
        ends = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(self.bins - 1).collect()
        self.ends = np.sort(np.array([r.v for r in ends], dtype=np.float64))

    def groups(self, rows: DataFrame) -> DataFrame:
        ends = self.ends

        def place(frames):
            for f in frames:
                yield f.assign(slot=np.searchsorted(ends, f["v"].to_numpy(np.float64)).astype(np.int32))

        binned = rows.groupBy("v").agg(F.count("*").alias("k")).mapInPandas(place, "v double, k long, slot int")
        return binned.groupBy("slot").agg(F.sum("k").alias("k"), F.max("v").alias("v")).select(F.col("slot").cast("long").alias("at"), "k", "slot", "v")

    def added(self, slot: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
        return dict(zip(slot.tolist(), w, strict=True))

    def value(self, slot: np.ndarray, n: np.ndarray, v: np.ndarray) -> float:
        order = np.argsort(slot)
        upto = np.cumsum(n[order])
        if not len(upto) or not upto[-1]:
            return np.nan
        return float(v[order][np.searchsorted(upto, self.p * upto[-1] - 1e-9 * upto[-1])])


def median() -> Quantile:
    return Quantile(0.5)


def weights(at: np.ndarray, k: np.ndarray, boots: int, seed: int) -> np.ndarray:
    """Poisson weights of groups (down) by replicate (across)."""
    return np.stack([np.random.Generator(np.random.Philox(key=[seed, int(a) & (1 << 64) - 1])).poisson(n, boots) for a, n in zip(at, k, strict=True)]).astype(np.int64)


def replicates(rows: DataFrame, statistic, boots: int, seed: int) -> DataFrame:
    """(boot, value): the statistic of each resample of rows (v)."""
    import pandas as pd

    importable(rows.sparkSession)
    statistic.prepare(rows)
    groups = statistic.groups(rows)

    def add(frames):
        total: dict[int, np.ndarray] = {}
        shown: dict[int, float] = {}
        for f in frames:
            for s in range(0, len(f), 256):
                g = f.iloc[s : s + 256]
                for slot, n in statistic.added(g["slot"].to_numpy(), g["v"].to_numpy(np.float64), weights(g["at"], g["k"], boots, seed)).items():
                    total[slot] = total[slot] + n if slot in total else n
                shown.update(zip(g["slot"].tolist(), g["v"].tolist(), strict=True))
        for slot, n in total.items():
            yield pd.DataFrame({"slot": np.int32(slot), "boot": np.arange(boots, dtype=np.int32), "n": n, "v": shown.get(slot, 0.0)})

    def finish(f):
        f = f.sort_values("slot")
        return pd.DataFrame({"boot": f["boot"].iloc[:1].to_numpy(), "value": [statistic.value(f["slot"].to_numpy(), f["n"].to_numpy(), f["v"].to_numpy())]})

    sums = groups.mapInPandas(add, "slot int, boot int, n long, v double").groupBy("boot", "slot").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    return sums.groupBy("boot").applyInPandas(finish, "boot int, value double")


def interval(df: DataFrame, value: str, statistic=None, boots: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(point, lo, hi) of a statistic of a column by the percentile bootstrap; null and NaN are left out, and all three are null without values."""
    statistic = statistic or Mean()
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    tail = (1 - level) / 2
    made = replicates(rows, statistic, boots, seed).where("not isnan(value)")
    ci = made.agg(F.percentile("value", F.lit(tail)).alias("lo"), F.percentile("value", F.lit(1 - tail)).alias("hi"))
    return rows.agg(statistic.point(F.col("v")).alias("point")).join(F.broadcast(ci))
