"""Exact quantiles with a state of fixed size: histogram passes that narrow in on a rank.

``percentile`` keeps every distinct value. Here a pass counts rows in ``buckets`` ranges of the
values still in question, with the least and largest value of each; the range that holds the rank
is the next pass's whole. Passes end when a range has one value; each makes ranges ``buckets`` times
finer at least, so three are enough for most columns. Counts are partial sums; a pass's rows on the
driver are ``buckets`` at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def at_rank(rows: DataFrame, rank: int, lo: float, hi: float, below: int, buckets: int) -> float:
    """The value of a rank (from 0) among rows (v), known to lie in lo to hi, with ``below`` rows under lo."""
    while lo < hi:
        wide = hi / 2 - lo / 2  # the range itself may be too large for a double
        place = F.floor((F.col("v") / 2 - lo / 2) / F.lit(wide) * buckets) if wide else F.when(F.col("v") > lo, buckets - 1).otherwise(0)
        inside = rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        counts = inside.groupBy(F.least(F.greatest(place, F.lit(0)), F.lit(buckets - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for c in sorted(counts, key=lambda c: c.lo):
            if rank < below + c.n:
                if (c.lo, c.hi) == (lo, hi):  # neighbours that no division tells apart
                    least = rows.where(F.col("v") == lo).count()
                    return lo if rank < below + least else hi
                lo, hi = c.lo, c.hi
                break
            below += c.n
    return lo


def exact_quantile(df: DataFrame, value: str, p: float, buckets: int = BUCKETS) -> float | None:
    """The quantile with linear interpolation between ranks, as ``percentile`` gives it; null and NaN are left out, None without values."""
    if not 0 <= p <= 1 or buckets < 2:
        raise ValueError("a share from 0 to 1, and two buckets at least")
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    if math.isinf(lo) or math.isinf(hi):
        raise ValueError("an infinite value")
    place = p * (n - 1)
    first = at_rank(rows, math.floor(place), lo, hi, 0, buckets)
    if place == math.floor(place):
        return first
    second = at_rank(rows, math.floor(place) + 1, lo, hi, 0, buckets)
    return (math.ceil(place) - place) * first + (place - math.floor(place)) * second
