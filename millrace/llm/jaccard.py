"""N-gram Jaccard join: token-combination prefixes.

Documents with equal shingle sets form a class, named by a hash of the set; all that follows is
about classes, so exact copies cost one. Shingles are ordered globally: rare ones first, by hash,
then frequent ones. Two sets with 100 * intersection >= threshold * union share a shingle within
both prefixes of size n - ceil(threshold% of n) + 1. If any shared shingle is rare, the smallest
is, and single rare shingles of the prefixes index it. Otherwise all shared shingles are frequent:
the prefix is extended until it holds more shared shingles than a similar set can interrupt, so
``k`` consecutive frequent shingles stand in both, and only these combinations are indexed.
Every pair that is similar therefore shares a key; there is no cap on a key's classes.

Frequent are shingles of ``frequent`` documents or more (of more than that where the input is so
large that they would fill the bitmap), counted over all, up to collisions in a bitmap of 2 to 32
MB; that affects the number of candidates only.

A key's classes are not paired all with all. A round links each class to its key's leader and
finds components. A pair is first held against sketches, shingle counts in 256 ranges of hashes,
which bound the intersection from above; pairs that can still be similar are verified exactly, on
the whole sets. Then only classes of a key that are in different components are paired. A key of
few classes pairs them in one task. Hot keys whose classes are much the same become one group; its
classes outside the largest component meet all others in packed blocks of whole sets, a pair of
blocks a task, where intersections are counted exactly and only links that join components come
out, never pairs. Keys with equal classes are merged first. A key that is frequent inside one task
is spread by the task, so no task receives a hot key's classes.

Links inside a component aren't counted, since most are never looked at.

Null and empty texts, and texts without words, have no shingles, link with nothing and are
components of their own; a null id names a component only if no document there has another, and
links like any; ids that stand with several texts are documents of their own; repeated rows are
copies of each other. Other columns are never read. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, plain, sweep

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
SMALL_SET = 40


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[2]
    return h ^ (h >> np.uint64(32))


#: Words of more bytes than LONG are hashed one by one, others by sums over PIECE bytes at a time.
LONG, PIECE = 64, 1 << 16
POWER = np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, MIX[1])])
INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, pow(int(MIX[1]), -1, 1 << 64), dtype=np.uint64)])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a lower-cased text: polynomials of its letters, from sums up to its end and up to its start."""
    letters = np.frombuffer(raw, dtype=np.uint8)
    gap = letters - np.uint8(9) < 5  # the white space of bytes.split()
    gap |= letters == 32
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(int(np.searchsorted(ends, first + PIECE, "right")), i + 1)
        value = letters[first : min(ends[j - 1], first + PIECE)].astype(np.uint64)  # what is cut off is of a long word
        value *= POWER[: len(value)]
        total, s, e = np.cumsum(value), starts[i:j] - first, np.minimum(ends[i:j] - first, PIECE) - 1
        out[i:j] = (total[e] - total[s] + value[s]) * INVERSE[s]
        i = j
    out = mix(out)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out, starts


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int = 5):
        self.size = size

    def shingles(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The set of each text; short texts are hashed together."""
        held, n = [], 0
        for t in texts:
            held.append(t.encode("utf-8", "surrogatepass").lower() if t else b"")
            n += len(held[-1]) + 1
            if n >= PIECE:
                yield from self.together(held)
                held, n = [], 0
        yield from self.together(held)

    def together(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        w, starts = word_hashes(b" ".join(raws))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
        h = w[: max(len(w) - self.size + 1, 0)]
        for i in range(1, self.size):
            h = h * MIX[0] + w[i : len(h) + i]
        h = mix(h)  # those across two texts are left out
        for raw, lo, hi in zip(raws, bounds, bounds[1:], strict=False):
            if hi - lo < self.size:
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join(raw.split()), seed=hi - lo)] if hi > lo else [], dtype=np.uint64)
                continue
            s = np.sort(h[lo : hi - self.size + 1])
            new = s[1:] != s[:-1]
            yield s if new.all() else np.concatenate([s[:1], s[1:][new]])


def least_overlap(n: int, threshold: int) -> int:
    return (threshold * n + 99) // 100


def index_keys(s: np.ndarray, heavy: np.ndarray, threshold: int, k: int) -> tuple[np.ndarray, int]:
    """The keys of a sorted set: rare shingles of the prefix, and combinations of k frequent ones; how many are of the first kind."""
    n = len(s)
    rare, often = s[~heavy], s[heavy]
    spare = n - least_overlap(n, threshold)
    single = rare[: spare + 1]
    if len(rare) > spare:  # its prefix is rare throughout
        return single, len(single)
    breaks = n * (100 - threshold) // threshold  # shingles that either set has alone
    out = [single]
    for j in sorted({2, k}):  # small sets may not share enough for k > 2; similar sets agree on one of the two
        if j < k and n >= SMALL_SET * 8 // 5 or j > 2 and n < SMALL_SET:
            continue
        within = often[: spare + (j - 1) * (breaks + 1) + 1 - len(rare)]
        if len(within) >= j:
            combo = within[: len(within) - j + 1]
            for i in range(1, j):
                combo = combo * MIX[1] + within[i : len(within) - j + 1 + i]
            out.append(np.unique(mix(combo + MIX[2] * np.uint64(j - 1))))
    return np.concatenate(out), len(single)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Shingles in each of 256 ranges of hashes; 255 stands for that many or more."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8)


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """At least the size of the intersection of the sets of two sketches."""
    low = np.minimum(a, b)
    return 1 << 40 if (low == 255).any() else int(low.sum())


def similar(common: int, n: int, m: int, threshold: int) -> bool:
    return 100 * common >= threshold * (n + m - common)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def input_chars(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.length(plain(text_col)))).first()[0] or 0


def map_bits(chars: int) -> int:
    """Bits of a place in a bitmap: 2**24 places (2 MB) at least, more with the input, 2**28 (32 MB) at most."""
    return min(28, max(24, (chars // 64).bit_length()))


def least_frequent(frequent: int, chars: int) -> int:
    """From how many documents on a shingle is frequent: so that those can't fill a quarter of the largest bitmap."""
    return max(frequent, chars // 6 * 4 >> 28)


def deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, by its upper bits, so that a bucket is a range of the bitmap."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def has_bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def place_of(h: np.ndarray, bits: int) -> np.ndarray:
    """A hash's place: its upper bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


BITS_A_BLOCK = 1 << 16


class Blocks:
    """Set bits of a bitmap by blocks of 8 KB."""

    def __init__(self):
        self.held: dict[int, np.ndarray] = {}

    def add(self, at: np.ndarray) -> None:
        at = np.unique(at)
        block = at // BITS_A_BLOCK
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(at) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            b = int(block[i])
            if b not in self.held:
                self.held[b] = np.zeros(BITS_A_BLOCK, dtype=bool)
            self.held[b][at[i:j] % BITS_A_BLOCK] = True

    def rows(self) -> dict[str, list]:
        out = {"block": list(self.held), "bits": [np.packbits(x).tobytes() for x in self.held.values()]}
        self.held = {}
        return out


def assembled(blocks: DataFrame, bits: int) -> np.ndarray:
    """The packed bitmap of (block, bits) rows: of fixed size, however large the input."""
    out = np.zeros(max(1 << bits, BITS_A_BLOCK) // 8, dtype=np.uint8)
    for r in blocks.toLocalIterator():
        x = slice(r.block * BITS_A_BLOCK // 8, (r.block + 1) * BITS_A_BLOCK // 8)
        out[x] |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def shingle_counts(df: DataFrame, text_col: str, size: int, buckets: int, most: int, chunk: int = 1_000_000) -> DataFrame:
    """(bucket, keys, counts): documents with each shingle, by 32 bits of its hash, summed within a task; about two bytes a shingle. Sums of most and over stand for each other."""
    kind = np.uint8 if most <= 255 else np.uint32

    def start():
        shingler, held, n = Shingler(size), [], 0

        def flush():
            nonlocal held, n
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                cuts = np.searchsorted(deal(keys.astype(np.uint64) << np.uint64(32), buckets), np.arange(buckets + 1))
                used = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                squeeze = zstandard.ZstdCompressor(level=1).compress
                parts = [slice(cuts[b], cuts[b + 1]) for b in used]
                yield {"bucket": used, "keys": [squeeze(np.diff(keys[x], prepend=np.uint32(0)).tobytes()) for x in parts], "counts": [squeeze(np.minimum(counts[x], most).astype(kind).tobytes()) for x in parts]}
            held, n = [], 0

        def step(texts):
            nonlocal n
            if texts is None:
                yield from flush()
                return
            for s in shingler.each(texts):
                if len(s) > 1:
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    n += len(s)
                    if n >= chunk:
                        yield from flush()

        return step

    return arrow_map(df, [text_col], "bucket int, keys binary, counts binary", start)


def heavy_bits(counts: DataFrame, frequent: int, partitions: int, bits: int) -> np.ndarray:
    """A packed bitmap, set where a shingle is frequent."""
    kind = np.uint8 if frequent <= 255 else np.uint32

    def start():
        keys, sums, now, blocks = [], [], None, Blocks()

        def summed():
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate(sums))
            blocks.add((u[total >= frequent] >> np.uint32(32 - bits)).astype(np.int64))

        def step(bucket, k, c):
            nonlocal keys, sums, now
            if bucket is None:
                if keys:
                    summed()
                yield blocks.rows()
                return
            spread = zstandard.ZstdDecompressor().decompress
            for b, x, y in zip(bucket, k, c, strict=True):
                if now != b and keys:
                    summed()
                    keys, sums = [], []
                now = b
                keys.append(np.cumsum(np.frombuffer(spread(x), dtype=np.uint32), dtype=np.uint32))
                sums.append(np.frombuffer(spread(y), dtype=kind))

        return step

    dealt = counts.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return assembled(arrow_map(dealt, ["bucket", "keys", "counts"], "block int, bits binary", start), bits)


PARTS = "kind int, bucket int, ids array<{id}>, marks binary, keys binary, cls binary, n binary, sketch binary"


def mark_of(text_col: str) -> Column:
    """A hash that names a text, so that rows are told apart without their ids."""
    return F.xxhash64(plain(text_col))


def index(df: DataFrame, id_col: str, text_col: str, threshold: int, size: int, k: int, packed: np.ndarray, bits: int, buckets: int, chunk: int = 500_000, hot: int = 16) -> DataFrame:
    """Packed rows. kind 0: documents' ids, marks, classes and sizes; 1: keys by bucket; 2: keys already known to have several classes."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def start():
        shingler, heavy = Shingler(size), shared.value
        ids, marks, classes, sizes, held, able, owners, sketches, n = [], [], [], [], [], [], [], [], 0

        def flush():
            nonlocal ids, marks, classes, sizes, held, able, owners, sketches, n
            if not ids:
                return
            cls, sz = np.array(classes, dtype=np.uint64), np.array(sizes, dtype=np.int64)
            rows = {c: [] for c in ("kind", "bucket", "ids", "marks", "keys", "cls", "n", "sketch")}

            def row(kind, bucket, i, marked, keys, at, n, sketch=None):
                for c, v in zip(rows, (kind, bucket, i, marked, keys, cls[at].tobytes(), n.tobytes(), sketch), strict=True):
                    rows[c].append(v)

            row(0, 0, ids, np.array(marks, dtype=np.int64).tobytes(), None, np.arange(len(ids)), sz, np.concatenate(sketches).tobytes())
            if held:
                key = np.concatenate(held)
                at = np.repeat(np.array(owners), [len(x) for x in held])
                order = np.lexsort((cls[at], key))
                key, at, most = key[order], at[order], np.concatenate(able)[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (cls[at[1:]] != cls[at[:-1]])]
                key, at, packed = key[new], at[new], (sz[at] << 32 | most << 1)[new]
                head = np.r_[True, key[1:] != key[:-1]]
                count = np.diff(np.r_[np.flatnonzero(head), len(key)])
                many = np.repeat(count >= hot, count)
                if many.any():
                    row(2, 0, None, None, key[many].tobytes(), at[many], packed[many])
                send = ~many | head
                key, at, packed = key[send], at[send], packed[send] | many[send]
                cuts = np.searchsorted(deal(key, buckets), np.arange(buckets + 1))
                for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    x = slice(cuts[b], cuts[b + 1])
                    row(1, b, None, None, key[x].tobytes(), at[x], packed[x])
            ids, marks, classes, sizes, held, able, owners, sketches, n = [], [], [], [], [], [], [], [], 0
            yield rows

        def step(i, named, texts):
            nonlocal n
            if i is None:
                yield from flush()
                return
            for d, m, s in zip(i, named, shingler.each(texts), strict=True):
                ids.append(d)
                marks.append(m)
                classes.append(class_of(s))
                sizes.append(len(s))
                sketches.append(sketch_of(s))
                if len(s) > 1:
                    often = has_bit(heavy, place_of(s, bits))
                    keys, single = index_keys(s, often, threshold, k)
                    held.append(keys)
                    able.append(np.r_[np.full(single, len(s)), np.full(len(keys) - single, np.count_nonzero(often))])
                    owners.append(len(ids) - 1)
                    n += len(keys) + 8
                if n >= chunk or len(ids) >= 100_000:
                    yield from flush()

        return step

    return arrow_map(df, [id_col, mark_of(text_col), text_col], PARTS.format(id=df.schema[id_col].dataType.simpleString()), start)


def shared_keys(parts: DataFrame, partitions: int) -> DataFrame:
    """(key, cls, n, most) of keys that several classes have; keys with equal classes become one.

    most: shingles that can be shared with another class of the key: all, or the frequent ones for
    a combination, since sets that share a rare shingle too have a key of its own in common.
    """

    def start():
        keys, classes, sizes = [], [], []

        def step(kind, k, c, n):
            if kind is None:
                if keys:
                    yield from joined()
                return
            for t, x, y, z in zip(kind, k, c, n, strict=True):
                x, y, z = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64), np.frombuffer(z, dtype=np.int64)
                if t == 2:
                    yield {"key": x, "cls": y, "n": z >> 32, "most": (z & 0xFFFFFFFF) >> 1}
                else:
                    keys.append(x)
                    classes.append(y)
                    sizes.append(z)

        def joined():
            key, cls, n = (np.concatenate(x) for x in (keys, classes, sizes))
            for x in (keys, classes, sizes):
                x.clear()  # a worker holds one form of a bucket's rows at a time
            order = np.lexsort((cls, key))
            key, cls, n = key[order], cls[order], n[order]
            flag, most, n = n & 1, (n & 0xFFFFFFFF) >> 1, n >> 32
            head = np.r_[True, key[1:] != key[:-1]]
            at = np.flatnonzero(head)
            lists = np.cumsum(head) - 1
            new = head | np.r_[True, cls[1:] != cls[:-1]]
            several = np.add.reduceat(new.astype(np.int64), at) > 1
            flagged = np.maximum.reduceat(flag, at) > 0
            keep = new & (several | flagged)[lists]
            if not keep.any():
                return
            # keys with equal classes get one name; those that other rows belong to keep their own
            member = mix(cls.view(np.uint64) * MIX[0] + MIX[1]) * new.astype(np.uint64)
            name = mix(np.add.reduceat(member, at)).view(np.int64)
            name = np.where(flagged, key[at], name)[lists][keep]
            cls, n, most = cls[keep], n[keep], most[keep]
            order = np.lexsort((-most, cls, name))
            name, cls, n, most = name[order], cls[order], n[order], most[order]
            new = np.r_[True, (name[1:] != name[:-1]) | (cls[1:] != cls[:-1])]
            for s in range(0, int(new.sum()), 100_000):
                x = slice(s, s + 100_000)
                yield {"key": name[new][x], "cls": cls[new][x], "n": n[new][x], "most": most[new][x]}

        return step

    dealt = parts.where("kind > 0").repartition(partitions, F.when(F.col("kind") == 1, F.col("bucket")).otherwise(F.xxhash64("keys")))
    every = arrow_map(dealt, ["kind", "keys", "cls", "n"], "key long, cls long, n long, most long", start)
    return every.groupBy("key", "cls", "n").agg(F.max("most").alias("most"))


def documents_of(parts: DataFrame, id_kind: str) -> DataFrame:
    """(id, mark, cls, n) of every document."""

    def start():
        def step(ids, marks, cls, n):
            for i, m, c, z in zip(ids or (), marks or (), cls or (), n or (), strict=True):
                yield {"id": i, "mark": np.frombuffer(m, dtype=np.int64), "cls": np.frombuffer(c, dtype=np.int64), "n": np.frombuffer(z, dtype=np.int64)}

        return step

    return arrow_map(parts.where("kind = 0"), ["ids", "marks", "cls", "n"], f"id {id_kind}, mark long, cls long, n long", start)


def sketches_of(parts: DataFrame) -> DataFrame:
    """(cls, n, sketch) of every class."""

    def start():
        def step(cls, n, sketch):
            for c, z, k in zip(cls or (), n or (), sketch or (), strict=True):
                c, at = np.unique(np.frombuffer(c, dtype=np.int64), return_index=True)
                yield {"cls": c, "n": np.frombuffer(z, dtype=np.int64)[at], "sketch": [k[256 * i : 256 * (i + 1)] for i in at.tolist()]}

        return step

    return arrow_map(parts.where("kind = 0"), ["cls", "n", "sketch"], "cls long, n long, sketch binary", start).dropDuplicates(["cls"])


PLACES = 1 << 20


def sets_of(df: DataFrame, docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """(cls, n, shingles): the sorted set of each class in wanted, from one text of it.

    Texts are found by their marks, so ids play no part; those that can't be wanted are left out by PLACES hashes at most, and no text is shuffled.
    """
    one = cut(docs.join(wanted.distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("mark").alias("mark")))
    place = lambda c: F.pmod(c, F.lit(PLACES)).alias("__millrace_place")
    places = F.broadcast(one.select(place(F.col("mark"))).distinct())
    rows = df.select(mark_of(text_col).alias("mark"), plain(text_col).alias("t")).withColumn("__millrace_place", place(F.col("mark"))).join(places, "__millrace_place", "left_semi")

    def start():
        shingler, seen = Shingler(size), set()

        def step(marks, texts):
            if marks is None:
                return
            out = {"cls": [], "n": [], "shingles": []}
            new = []
            for m, t in zip(marks, texts, strict=True):
                if m in seen:  # a copy
                    continue
                if len(seen) > 500_000:  # only saves repeats
                    seen.clear()
                seen.add(m)
                new.append(t)
            for s in shingler.each(new):
                for c, v in zip(out, (np.uint64(class_of(s)).astype(np.int64), len(s), s.tobytes()), strict=True):
                    out[c].append(v)
                if len(out["cls"]) >= 2_000:
                    yield out
                    out = {c: [] for c in out}
            yield out

        return step

    every = arrow_map(rows, ["mark", "t"], "cls long, n long, shingles binary", start)
    return every.join(one.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def paired(pairs: DataFrame, of: DataFrame, *cols: str) -> DataFrame:
    """pairs (a, b) with the columns of class a under their names and an x, of class b with a y."""
    out = pairs
    for side, mark in (("a", "x"), ("b", "y")):
        out = out.join(of.select(F.col("cls").alias(side), *[F.col(c).alias(c + mark) for c in cols]), side)
    return out


def possible(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs that their sketches don't rule out."""

    def start():
        def step(a, b, n, m, x, y):
            if a is None:
                return
            ok = [similar(most_common(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), i, j, threshold) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield {"a": [v for v, k in zip(a, ok, strict=True) if k], "b": [v for v, k in zip(b, ok, strict=True) if k]}

        return step

    both = paired(pairs, sketches, "n", "sketch")
    return arrow_map(both, ["a", "b", "nx", "ny", "sketchx", "sketchy"], "a long, b long", start)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""

    def start():
        def step(a, b, x, y):
            if a is None:
                return
            ok = []
            for t, u in zip(x, y, strict=True):
                p, q = np.frombuffer(t, dtype=np.uint64), np.frombuffer(u, dtype=np.uint64)
                ok.append(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), threshold))
            yield {"a": [v for v, k in zip(a, ok, strict=True) if k], "b": [v for v, k in zip(b, ok, strict=True) if k]}

        return step

    return arrow_map(paired(pairs, sets, "shingles"), ["a", "b", "shinglesx", "shinglesy"], "a long, b long", start)


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the least class reachable, for every class with a link. Contracts until no link is left."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(links)
    names = edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct().withColumn("comp", F.col("cls"))
    while not edges.isEmpty():
        parent = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p"))
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = cut(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")))

        def raised(df: DataFrame, c: str, parent=parent) -> DataFrame:
            return df.join(parent.withColumnRenamed("u", c), c, "left").withColumn(c, F.coalesce("p", c)).drop("p")

        names = cut(raised(names, "comp").select("cls", "comp"))
        edges = raised(raised(edges, "a"), "b").where("a <> b")
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return names


def with_components(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members of keys whose classes are in several components."""
    if comps is None:
        return members.withColumn("comp", F.col("cls"))
    every = members.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = every.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return every.join(mixed, "key")


def near(threshold: int) -> Column:
    """Whether sizes, and what a key leaves to be shared, allow the pair; classes of one component need no other link."""
    sizes = 100 * F.least("n", "m") >= threshold * F.greatest("n", "m")
    shared = (100 + threshold) * F.least("most", "most2") >= threshold * (F.col("n") + F.col("m"))
    return sizes & shared & (F.col("comp") != F.col("other"))


#: A key of more classes is hot: its classes meet in packed blocks of at most so many shingles and classes.
HOT = 64
BLOCK_SHINGLES, BLOCK_CLASSES = 1_000_000, 8192


def within_keys(left: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Possible pairs (a, b) of the classes, in different components, of keys that have HOT classes at most."""
    rows = left.join(sketches.select("cls", "sketch"), "cls")
    dealt = rows.repartition("key").sortWithinPartitions("key", "cls")

    def start():
        now, held, told = None, [], set()

        def pairs():
            cls, n, most, comp = (np.array([h[i] for h in held], dtype=np.int64) for i in range(4))
            sketch = np.frombuffer(b"".join(h[4] for h in held), dtype=np.uint8).reshape(-1, 256)
            a, b = [], []
            for i in range(len(cls)):
                j = np.arange(i + 1, len(cls))
                ok = comp[j] != comp[i]
                ok &= 100 * np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i])
                ok &= (100 + threshold) * np.minimum(most[j], most[i]) >= threshold * (n[j] + n[i])
                j = j[ok]
                if not len(j):
                    continue
                low = np.minimum(sketch[j], sketch[i])
                bound = np.where((low == 255).any(axis=1), 1 << 40, low.sum(axis=1, dtype=np.int64))
                for x in cls[j[100 * bound >= threshold * (n[j] + n[i] - bound)]].tolist():
                    p = (min(x, int(cls[i])), max(x, int(cls[i])))
                    if p not in told:
                        told.add(p)
                        a.append(p[0])
                        b.append(p[1])
            if len(told) > 500_000:  # only saves repeats
                told.clear()
            return {"a": a, "b": b}

        def step(key, cls, n, most, comp, sketch):
            nonlocal now, held
            for row in zip(key or (), cls or (), n or (), most or (), comp or (), sketch or (), strict=True):
                if now != row[0]:
                    if len(held) > 1:
                        yield pairs()
                    now, held = row[0], []
                held.append(row[1:])
            if key is None and len(held) > 1:
                yield pairs()

        return step

    return arrow_map(dealt, ["key", "cls", "n", "most", "comp", "sketch"], "a long, b long", start).distinct()


class Packed:
    """Classes with their components and whole sets, in order of size; a shingle's code is its place among the distinct ones."""

    def __init__(self, cls, comp, sizes, known, codes):
        self.cls, self.comp, self.sizes, self.known, self.codes = cls, comp, sizes, known, codes

    @classmethod
    def of(cls, rows: list[tuple[int, int, bytes]]) -> Packed:
        rows = sorted(rows, key=lambda r: (len(r[2]), r[0]))
        known, codes = np.unique(np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint64), return_inverse=True)
        return cls(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), np.array([len(r[2]) // 8 for r in rows], dtype=np.int64), known, codes.astype(np.uint32))

    def dump(self) -> list[bytes]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return [squeeze(x.tobytes()) for x in (self.cls, self.comp, self.sizes, self.known, self.codes)]

    @classmethod
    def load(cls, parts: list[bytes]) -> Packed:
        spread = zstandard.ZstdDecompressor().decompress
        return cls(*(np.frombuffer(spread(x), dtype=k) for x, k in zip(parts, (np.int64, np.int64, np.int64, np.uint64, np.uint32), strict=True)))


TILE, DENSE = 2048, 200


def common_counts(p: np.ndarray, po: np.ndarray, rows: int, q: np.ndarray, qo: np.ndarray, cols: int, codes: int) -> np.ndarray:
    """How many codes each of the rows has in common with each of the cols; p, q: codes below codes; po, qo: their owners.

    Codes that many have on both sides are counted by a matrix product, the others pair by pair.
    """
    out = np.zeros((rows, cols), dtype=np.float32)
    fp, fq = np.bincount(p, minlength=codes), np.bincount(q, minlength=codes)
    dense = np.flatnonzero(fp.astype(np.float64) * fq > rows * cols / DENSE)
    slot = np.full(codes, -1, dtype=np.int64)
    slot[dense] = np.arange(len(dense))
    sp, sq = slot[p], slot[q]
    for lo in range(0, len(dense), TILE):
        width = min(TILE, len(dense) - lo)
        a, b = np.zeros((rows, width), dtype=np.float32), np.zeros((cols, width), dtype=np.float32)
        i, j = (sp >= lo) & (sp < lo + width), (sq >= lo) & (sq < lo + width)
        a[po[i], sp[i] - lo] = 1
        b[qo[j], sq[j] - lo] = 1
        out += a @ b.T
    few = (slot < 0) & (fp > 0) & (fq > 0)
    i, j = np.flatnonzero(few[p]), np.flatnonzero(few[q])
    if len(i) and len(j):
        j = j[np.argsort(q[j], kind="stable")]
        first, n = np.searchsorted(q[j], p[i]), fq[p[i]]
        ends = np.cumsum(n)
        flat = out.reshape(-1)
        for s in range(0, int(ends[-1]), 1 << 22):
            e = np.arange(s, min(s + (1 << 22), int(ends[-1])))
            k = np.searchsorted(ends, e, side="right")
            np.add.at(flat, po[i[k]] * cols + qo[j[first[k] + e - (ends[k] - n[k])]], np.float32(1))
    return out


def spanning_links(x: Packed, y: Packed, threshold: int) -> list[tuple[int, int]]:
    """Similar pairs of classes of x and y in different components: as many as it takes to join all components that any such pair joins. x may be y."""
    same = x is y
    known = x.known if same else np.intersect1d(x.known, y.known, assume_unique=True)
    sides = []
    for z in (x, y):
        at = np.searchsorted(known, z.known)
        at[at == len(known)] = 0
        new = np.where(known[at] == z.known, at, -1) if len(known) else np.full(len(z.known), -1)
        owner = np.repeat(np.arange(len(z.cls)), z.sizes)
        code = new[z.codes]
        sides.append((owner[code >= 0], code[code >= 0]))
    every, both = np.unique(np.concatenate([x.comp, y.comp]), return_inverse=True)
    name = np.arange(len(every))  # the component that each has been joined to
    cx, cy = both[: len(x.comp)], both[len(x.comp) :]
    links = []

    def root(i: int) -> int:
        while name[i] != i:
            name[i] = name[name[i]]
            i = int(name[i])
        return i

    for a in range(0, len(x.cls), TILE):
        rows = slice(a, min(a + TILE, len(x.cls)))
        p = slice(*np.searchsorted(sides[0][0], [rows.start, rows.stop]))
        for b in range(a if same else 0, len(y.cls), TILE):
            cols = slice(b, min(b + TILE, len(y.cls)))
            n, m = x.sizes[rows], y.sizes[cols]
            if 100 * n[-1] < threshold * m[0] or 100 * m[-1] < threshold * n[0]:  # both in order of size
                continue
            label = np.array([root(i) for i in range(len(every))]) if len(links) else name
            lx, ly = label[cx[rows]], label[cy[cols]]
            if (lx == lx[0]).all() and (ly == lx[0]).all():
                continue
            q = slice(*np.searchsorted(sides[1][0], [cols.start, cols.stop]))
            common = common_counts(sides[0][1][p], sides[0][0][p] - rows.start, len(n), sides[1][1][q], sides[1][0][q] - cols.start, len(m), len(known))
            near = (100 + threshold) * common >= threshold * (n[:, None] + m[None, :])
            while True:
                near &= lx[:, None] != ly[None, :]
                hit = np.flatnonzero(near.any(axis=1))
                if not len(hit):
                    break
                for i, j in zip(hit.tolist(), near[hit].argmax(axis=1).tolist(), strict=True):
                    u, v = root(int(cx[rows][i])), root(int(cy[cols][j]))
                    if u != v:
                        name[max(u, v)] = min(u, v)
                        links.append((int(x.cls[rows][i]), int(y.cls[cols][j])))
                label = np.array([root(i) for i in range(len(every))])
                lx, ly = label[cx[rows]], label[cy[cols]]
    return links


BLOB = "g long, minor int, block int, parts array<binary>"


def packed_blocks(rows: DataFrame) -> DataFrame:
    """(g, minor, block, parts): the classes of each block in one row."""

    def start():
        now, held = None, []

        def row():
            return {"g": [now[0]], "minor": [now[1]], "block": [now[2]], "parts": [Packed.of(held).dump()]}

        def step(g, minor, block, cls, comp, shingles):
            nonlocal now, held
            for at in zip(g or (), minor or (), block or (), cls or (), comp or (), shingles or (), strict=True):
                if now != at[:3]:
                    if held:
                        yield row()
                    now, held = at[:3], []
                held.append(at[3:])
            if g is None and held:
                yield row()

        return step

    dealt = rows.repartition("g", "minor", "block").sortWithinPartitions("g", "minor", "block")
    return arrow_map(dealt, ["g", "minor", "block", "cls", "comp", "shingles"], BLOB, start)


def both_classes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls"))


def across_blocks(left: DataFrame, sets: DataFrame, threshold: int, first: bool) -> DataFrame | None:
    """Links (a, b) between classes, in different components, of hot keys; None if there is nothing to look at.

    left: (g, cls, comp). The classes outside a group's largest component meet each other and those
    inside, block by block; no pair within the largest component is looked at. first: only groups of
    many blocks, and of these the first block of the largest component, which leaves few classes to the rest.
    """
    sized = left.join(sets.select("cls", "n"), "cls")
    parts = cut(sized.groupBy("g", "comp").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")))
    blocks = lambda c, s: F.greatest(F.ceil(F.sum(c) / BLOCK_CLASSES), F.ceil(F.sum(s) / BLOCK_SHINGLES), F.lit(0)).cast("int")
    top = parts.groupBy("g").agg(F.max_by("comp", F.struct("classes", "comp")).alias("top"))
    outside = F.col("comp") != F.col("top")
    group = parts.join(top, "g").withColumn("c", F.when(outside, F.col("classes")).otherwise(0)).withColumn("s", F.when(outside, F.col("shingles")).otherwise(0))
    group = group.groupBy("g").agg(F.first("top").alias("top"), blocks("c", "s").alias("minors"), blocks(F.col("classes") - F.col("c"), F.col("shingles") - F.col("s")).alias("bulks"))
    group = cut(group.where("minors + bulks > 2 and minors > 0" if first else "minors > 0"))
    if group.isEmpty():
        return None
    rows = sized.join(group, "g").withColumn("minor", outside.cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(outside, F.col("minors")).otherwise(F.col("bulks"))).cast("int"))
    if first:
        rows = rows.where("minor = 1 or block = 0")
    blobs = cut(packed_blocks(rows.select("g", "minor", "block", "cls", "comp").join(sets.select("cls", "shingles"), "cls")))
    # a unit of work: a block outside, and another outside or inside; lo = -1 - j names the inside block j
    spread = group.withColumn("bulks", F.lit(1)) if first else group
    whole = blobs.join(spread.select("g", "minors", "bulks"), "g")
    others = F.sequence(F.lit(0), F.col("minors") - 1)
    inside = F.transform(others, lambda i: F.struct((-1 - F.col("block")).alias("lo"), i.alias("hi")))
    met = F.transform(F.sequence(F.lit(1), F.col("bulks")), lambda j: F.struct((-j).alias("lo"), F.col("block").alias("hi")))
    own = F.array().cast("array<struct<lo:int,hi:int>>") if first else F.transform(others, lambda i: F.struct(F.least(i, "block").alias("lo"), F.greatest(i, "block").alias("hi")))
    units = whole.select("g", "minor", "block", "parts", F.explode(F.when(F.col("minor") == 0, inside).otherwise(F.concat(met, own))).alias("unit"))
    dealt = units.select("g", "unit.lo", "unit.hi", "minor", "block", "parts").repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "minor", "block")

    def start():
        now, held = None, []

        def links():
            x = Packed.load(held[0])
            found = spanning_links(x, Packed.load(held[1]) if len(held) > 1 else x, threshold)
            return {"a": [min(p) for p in found], "b": [max(p) for p in found]}

        def step(g, lo, hi, parts):
            nonlocal now, held
            for *at, part in zip(g or (), lo or (), hi or (), parts or (), strict=True):
                if now != at:
                    if held and (len(held) > 1 or now[1] == now[2]):
                        yield links()
                    now, held = at, []
                held.append(part)
            if g is None and held and (len(held) > 1 or now[1] == now[2]):
                yield links()

        return step

    return arrow_map(dealt, ["g", "lo", "hi", "parts"], "a long, b long", start)


def groups_of(hot: DataFrame) -> DataFrame:
    """(g, cls) of hot keys; keys whose classes are much the same get one group, by their class of least hash."""
    least = hot.groupBy("key").agg(F.min_by("cls", F.xxhash64("cls")).alias("g"))
    return hot.join(least, "key").select("g", "cls").distinct()


def named_documents(df: DataFrame, id_col: str, text_col: str, threshold: int, size: int, k: int, frequent: int, rounds: int, bucket_chars: int) -> DataFrame:
    """(id, mark, n, cls, g, component) of every row; g: the least class linked to its own. Without words cls and g are 0, and component is the id."""
    if k not in (2, 3) or threshold < 80 or rounds < 1:
        raise ValueError("combinations of 2 or 3 shingles, for thresholds of 80 or more, and one round at least")
    chars = input_chars(df, text_col)
    buckets, bits, frequent = max(8, min(1 << 15, chars // bucket_chars)), map_bits(chars), least_frequent(frequent, chars)
    heavy = heavy_bits(shingle_counts(df, text_col, size, buckets, frequent), frequent, buckets, bits)
    sweep(df.sparkSession)
    parts = cut(index(df, id_col, text_col, threshold, size, k, heavy, bits, buckets))
    kind = df.schema[id_col].dataType.simpleString()
    docs = documents_of(parts, kind)
    members = cut(shared_keys(parts, buckets))
    sweep(df.sparkSession)
    sketches = sketches_of(parts)
    comps, links = None, None

    def linked(*found: DataFrame | None) -> None:
        nonlocal comps, links
        new = [cut(f) for f in found if f is not None]
        for f in new:
            links = f if links is None else links.unionByName(f)
        if new or comps is None:
            comps = components(links)
        sweep(df.sparkSession)

    for r in range(rounds):  # each class against its key's leader, another one each round
        left = with_components(members, comps)
        first = left.groupBy("key").agg(F.min_by(F.struct("cls", "n", "comp", "most"), F.struct(F.xxhash64("cls", F.lit(r)), "cls")).alias("l"))
        leaders = first.select(F.col("key").alias("key2"), F.col("l.cls").alias("with"), F.col("l.n").alias("m"), F.col("l.comp").alias("other"), F.col("l.most").alias("most2"))
        met = left.join(leaders, (F.col("key") == F.col("key2")) & (F.col("cls") != F.col("with")) & near(threshold))
        pairs = cut(possible(met.select(F.least("cls", "with").alias("a"), F.greatest("cls", "with").alias("b")).distinct(), sketches, threshold))
        linked(verified(pairs, cut(sets_of(df, docs, both_classes(pairs), text_col, size)), threshold))
    left = cut(with_components(members, comps))
    wide = left.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > HOT).select("key")
    hot = cut(groups_of(left.join(wide, "key", "left_semi").select("key", "cls")))
    few = cut(within_keys(left.join(wide, "key", "left_anti"), sketches, threshold))
    sets = cut(sets_of(df, docs, both_classes(few).unionByName(hot.select("cls")), text_col, size))

    def joined() -> DataFrame:
        return hot.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    linked(verified(few, sets, threshold), across_blocks(joined(), sets, threshold, True))
    linked(across_blocks(joined(), sets, threshold, False))
    return with_names(docs, comps)


def with_names(docs: DataFrame, comps: DataFrame) -> DataFrame:
    """docs (id, mark, cls, n) with g, the least class linked to theirs, and component, the least id of those classes."""
    classes = docs.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(comps, "cls", "left")
    least = classes.where("comp is not null").groupBy("comp").agg(F.min("least").alias("joint"))
    named = cut(classes.join(least, "comp", "left").select("cls", "copies", F.coalesce("comp", "cls").alias("g"), F.coalesce("joint", "least").alias("component")))
    total = named.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * 100 > total  # a hundred classes at most
    words = docs.where("n > 0")
    common = words.join(F.broadcast(named.where(often).drop("copies")), "cls")
    rest = words.join(F.broadcast(named.where(often).select("cls")), "cls", "left_anti").join(named.where(~often).drop("copies"), "cls")
    alone = docs.where("n = 0").withColumn("g", F.col("cls")).withColumn("component", F.col("id"))
    cols = ["id", "mark", "n", "cls", "g", "component"]
    return common.select(*cols).unionByName(rest.select(*cols)).unionByName(alone.select(*cols))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, size: int = 5, k: int = 2, frequent: int = 16, rounds: int = 1, bucket_chars: int = 8_000_000) -> DataFrame:
    """id, n_shingles, component (least id reachable by links), one row per input row."""
    named = named_documents(df, id_col, text_col, threshold, size, k, frequent, rounds, bucket_chars)
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, size: int = 5, k: int = 2, frequent: int = 16, rounds: int = 1, bucket_chars: int = 8_000_000) -> DataFrame:
    """One row of each group of linked documents, with the columns of df: of the least id, and of equal ids the least text hash.

    Rows are told apart by id and text, so null ids and ids that stand with several texts lose
    nothing; of rows equal in both one stays. Rows without words all stay.
    """
    named = named_documents(df, id_col, text_col, threshold, size, k, frequent, rounds, bucket_chars).where("n > 0")
    rows = cut(named.groupBy("id", "mark").agg(F.min("g").alias("g"), F.count("*").alias("copies")))
    order = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    stays = rows.groupBy("g").agg(F.min(order).alias("first")).select(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"), F.lit(True).alias("stays"))
    both = (F.col("a.mark") == F.col("b.mark")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    judged = cut(rows.alias("a").join(stays.alias("b"), both, "left").where("stays is null or copies > 1").select("a.id", "a.mark", "copies", F.coalesce("stays", F.lit(False)).alias("stays")))
    key = (mark_of(text_col) == F.col("b.mark")) & F.col(id_col).eqNullSafe(F.col("b.id"))
    out = df.join(judged.alias("b"), key, "left_anti")
    again = judged.where("stays")
    if not again.isEmpty():  # repeated rows of a kept document
        some = df.withColumn("__millrace_mark", mark_of(text_col)).join(again.alias("b"), key, "left_semi")
        out = out.unionByName(some.dropDuplicates([id_col, "__millrace_mark"]).drop("__millrace_mark"))
    return out
