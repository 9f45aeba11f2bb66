"""Target-distribution importance resampling: external sort-count.

Texts become features, runs of 1 to ``order`` words, and features become buckets. A task writes its
documents as packed streams of uint16 buckets with each document's offset, about ``chunk`` features
a row, to the shared folder. Counts come from the streams: each is sorted and run-length encoded,
and the runs are summed by bucket within a task before they are shuffled, so 65,536 rows a task are
the most. A bucket's gain says how much more often the target has it than the documents. A second
reading of the streams gathers gains and sums them from offset to offset with np.add.reduceat.

A document's score is its weight and a Gumbel draw from its id, so the highest scores are a sample
without replacement by weight. Ranks are exact: narrow rows are sorted by ranges of the score, and
a row's rank is its place in its range after the counts of the ranges before; no task gets all rows.

Both counts, of at most ``buckets`` rows, and the gains made of them are all that passes through the
driver. A feature counts as often as it stands in a text. Null texts and texts without words have
no features and weight 0; a null id is hashed as an empty one, and is ordered last among equal
scores; repeated rows each get a rank; an empty target has every bucket zero times, an empty table
gives no rows. Texts are read whole. Other columns than id and text are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, plain
from .fmindex import words_of
from .jaccard import mark_of

STREAM = "ids array<{id}>, marks binary, words binary, offsets binary, buckets binary"


class Bucketer:
    """Buckets of a text's features; remembers those of words."""

    def __init__(self, order: int, buckets: int, keep: int = 200_000):
        self.order, self.buckets, self.keep = order, buckets, keep

        class Known(dict):
            def __missing__(self, w):
                b = self[w] = zlib.crc32(w) % buckets
                return b

        self.known = Known()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.keep:  # only saves repeats
            self.known.clear()
        out = [np.fromiter(map(self.known.__getitem__, words), dtype=np.uint16, count=len(words))]
        for k in range(2, self.order + 1):
            n = max(0, len(words) - k + 1)
            out.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) % self.buckets for i in range(n)), dtype=np.uint16, count=n))
        return np.concatenate(out) if len(out) > 1 else out[0]


def streams(df: DataFrame, id_col: str, text_col: str, order: int, buckets: int, chunk: int) -> DataFrame:
    """Packed rows: ids, marks and word counts of documents, where each one's features begin and the last end, and the features' buckets."""

    def start():
        bucketer = Bucketer(order, buckets)
        ids, marks, words, sizes, held, n = [], [], [], [], [], 0

        def row():
            nonlocal ids, marks, words, sizes, held, n
            out = (ids, np.array(marks, dtype=np.int64), np.array(words, dtype=np.int64), np.cumsum([0, *sizes], dtype=np.int64), np.concatenate(held))
            ids, marks, words, sizes, held, n = [], [], [], [], [], 0
            return {c: [x if c == "ids" else x.tobytes()] for c, x in zip(("ids", "marks", "words", "offsets", "buckets"), out, strict=True)}

        def step(i, m, texts):
            nonlocal n
            if i is None:
                if ids:
                    yield row()
                return
            for d, mark, t in zip(i, m, texts, strict=True):
                w = words_of(t)
                f = bucketer.of(w)
                for to, x in ((ids, d), (marks, mark), (words, len(w)), (sizes, len(f)), (held, f)):
                    to.append(x)
                n += len(f)
                if n >= chunk or len(ids) >= 50_000:
                    yield row()

        return step

    return arrow_map(df, [id_col, mark_of(text_col), text_col], STREAM.format(id=df.schema[id_col].dataType.simpleString()), start)


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a stream in order, and how often each stands in it: sorted, then run-length encoded."""
    s = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=np.int64)
    return s[head], np.diff(np.r_[head, len(s)])


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in all streams."""

    def start():
        total = np.zeros(buckets, dtype=np.int64)

        def step(parts):
            if parts is None:
                used = np.flatnonzero(total)
                yield {"bucket": used, "n": total[used]}
                return
            for p in parts:
                value, n = runs(np.frombuffer(p, dtype=np.uint16))
                total[value] += n

        return step

    out = np.zeros(buckets, dtype=np.int64)
    for r in arrow_map(packed, ["buckets"], "bucket int, n long", start).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[r.bucket] = r.n
    return out


def gains_of(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    k, total, aim = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + k) / ((s + 1.0) * (aim + k)))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], dtype=np.int64)


def gathered(gains: np.ndarray, stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of gains of each document; 0 where it has no feature."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(gains[stream], offsets[full])
    return out


def gumbel(name: str, seed: int) -> int:
    """A draw from a row's id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(packed: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(id, mark, n_words, n_features, weight, score) of every document."""
    shared = packed.sparkSession.sparkContext.broadcast(gains)

    def start():
        def step(ids, marks, words, offsets, buckets):
            for i, m, w, o, b in zip(ids or (), marks or (), words or (), offsets or (), buckets or (), strict=True):
                o = np.frombuffer(o, dtype=np.int64)
                weight = gathered(shared.value, np.frombuffer(b, dtype=np.uint16), o)
                draw = np.array([gumbel("" if d is None else str(d), seed) for d in i], dtype=np.int64)
                yield {"id": i, "mark": np.frombuffer(m, dtype=np.int64), "n_words": np.frombuffer(w, dtype=np.int64), "n_features": np.diff(o), "weight": weight, "score": weight + draw}

        return step

    kind = packed.schema["ids"].dataType.elementType.simpleString()
    return arrow_map(packed, list(packed.columns), f"id {kind}, mark long, n_words long, n_features long, weight long, score long", start)


def with_rank(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows with rank: their places in the order, from 1, where that is at most ``most``, else null. rows: written already, since they are read more than once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    ranges = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("__millrace_part"), place.bitwiseAND((1 << 33) - 1).alias("__millrace_place")))
    sizes = dict(ranges.groupBy("__millrace_part").count().collect())  # a row a range
    before, first = 1, []
    for k in range(max(sizes, default=-1) + 1):
        first.append(before)
        before += sizes.get(k, 0)
    starts = rows.sparkSession.createDataFrame(list(enumerate(first)), "__millrace_part long, __millrace_first long")
    rank = F.col("__millrace_first") + F.col("__millrace_place")
    numbered = ranges.join(F.broadcast(starts), "__millrace_part").withColumn("rank", F.when(rank <= most, rank))
    return numbered.drop("__millrace_part", "__millrace_place", "__millrace_first")


def scored(df: DataFrame, target: DataFrame, percent: int, min_words: int, order: int, buckets: int, seed: int, id_col: str, text_col: str, target_text_col: str, chunk: int) -> DataFrame:
    """(id, mark, n_words, n_features, weight, score, rank) of every document; rank of those drawn."""
    if not 1 <= buckets <= 1 << 16 or order < 1 or not 0 <= percent <= 100:
        raise ValueError("65,536 buckets at most, features of one word or more, a percentage")
    packed = cut(streams(df, id_col, text_col, order, buckets, chunk))
    aimed = streams(target.select(F.lit(0).alias("i"), plain(target_text_col).alias("t")), "i", "t", order, buckets, chunk)
    gains = gains_of(bucket_counts(packed, buckets), bucket_counts(aimed, buckets))
    rows = cut(weighed(packed, gains, seed))
    able = F.col("n_words") >= min_words
    most = percent * rows.where(able).count() // 100
    drawn = with_rank(rows.where(able), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("mark")], most)
    return drawn.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, order: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", chunk: int = 1_000_000) -> DataFrame:
    """id, n_features, weight, score, rank of every document: the highest scores among those of min_words words or more are drawn, percent of them; rank is null for the rest."""
    rows = scored(df, target, percent, min_words, order, buckets, seed, id_col, text_col, target_text_col, chunk)
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_rows(df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, order: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", chunk: int = 1_000_000) -> DataFrame:
    """The rows of df that are drawn, with their columns; rows equal in id and text are drawn together."""
    rows = scored(df, target, percent, min_words, order, buckets, seed, id_col, text_col, target_text_col, chunk)
    picked = rows.where("rank is not null").select(F.col("id").alias("__millrace_id"), F.col("mark").alias("__millrace_mark"))
    key = (mark_of(text_col) == F.col("__millrace_mark")) & plain(id_col).eqNullSafe(F.col("__millrace_id"))
    return df.join(cut(picked), key, "left_semi")
