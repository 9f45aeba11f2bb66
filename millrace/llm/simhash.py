"""SimHash near-dedup: anchor-point covering.

A document's fingerprint has a bit set where more than half of its shingles' hashes have. Documents
of equal fingerprints are one point; all that follows is about points, so copies cost one.

Two points within ``distance`` bits of each other are near in one half: with distances of
``distance // 2`` in the lower 32 bits and ``(distance - 1) // 2`` in the upper ones, a pair beyond
both would differ in more than ``distance`` bits. Each half has its own anchors: the words of the
Hamming code of 31 bits, a covering code of radius 1 in which every word is within one bit of one
anchor, its home (bits 31 and 63 are left to the comparison). A point goes to its home and to every
anchor within the covering radius plus the half's distance: for distance 4, 156 anchors within 3
bits and 16 within 2, found by syndrome. So if x and y are near in a half, y meets x at x's home.
A map of homes, of bounded size, first keeps away visits to anchors where nobody is at home; full,
it only lets all of them through. Per anchor, those at home are compared with all others, and a
spanning set of links comes out, never all pairs.

An anchor of more than ``most`` points is split. Its points are first linked to one hub, and points
of equal homes in both halves, at most 4 bits apart, to each other; what then lies outside the
anchor's largest component meets the rest block by block, rings of distances from the hub that
differ by more than ``distance`` left out. No bucket, hot or not, is cut: all links are found, up to
those implied by others.

Null and empty texts, and texts without words, have fingerprint zero and link like others; a text
of fewer words than a shingle is one shingle. A null id names a component only if no document there
has another; ids that stand with several texts, and repeated rows, are rows of their own; an empty
table gives no rows. Only id and text are read, so other columns may have any name. Texts of any
length are read whole, in runs of shingles.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, plain
from .jaccard import Blocks, assembled, components, has_bit, mark_of, mix, place_of, with_names

SEED = 42
RUN = 1 << 16


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits; bit j is set if it is in more than half of the XXH64 values of the shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for s in range(0, len(starts), RUN):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[s : s + RUN].tolist(), ends[s : s + RUN].tolist(), strict=True)]
        ones += np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, mark, fp) of every row; mark tells rows of one id apart by their texts."""

    def start():
        def step(ids, marks, texts):
            if ids is not None:
                yield {"id": ids, "mark": marks, "fp": np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)}

        return step

    return arrow_map(df, [id_col, mark_of(text_col), text_col], f"id {df.schema[id_col].dataType.simpleString()}, mark long, fp long", start)


class HammingAnchors:
    """The Hamming code of 31 bits as anchors. Bit i has syndrome i + 1; a word's syndrome names the one error that leads to its home."""

    BITS, RADIUS = 31, 1
    WORD = (1 << BITS) - 1

    def __init__(self, reach: int):
        """reach: the distance of the anchors to list."""
        self.checks = [sum(1 << i for i in range(self.BITS) if (i + 1) >> b & 1) for b in range(5)]
        by: list[list[int]] = [[] for _ in range(self.BITS + 1)]
        for weight in range(reach + 1):
            for bits in itertools.combinations(range(self.BITS), weight):
                syndrome = 0
                for i in bits:
                    syndrome ^= i + 1
                by[syndrome].append(sum(1 << i for i in bits))
        self.errors = [np.array(x, dtype=np.int64) for x in by]  # by weight, the home's first

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for b, mask in enumerate(self.checks):
            out |= (np.bitwise_count(words & mask).astype(np.int64) & 1) << b
        return out

    def homes(self, words: np.ndarray) -> np.ndarray:
        s = self.syndromes(words)
        return words ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)

    def near(self, words: np.ndarray):
        """(places of words, anchors within reach): one row a word, its home first; by syndrome."""
        s = self.syndromes(words)
        for k in np.unique(s).tolist():
            at = np.flatnonzero(s == k)
            yield at, words[at, None] ^ self.errors[k][None, :]


def halves(distance: int) -> list[tuple[int, int, int]]:
    """(number, shift, reach) of the halves, reach being the covering radius plus the half's distance."""
    return [(h, 32 * h, HammingAnchors.RADIUS + d) for h, d in enumerate((distance // 2, (distance - 1) // 2)) if d >= 0]


def anchor_key(half: int, anchors: np.ndarray) -> np.ndarray:
    return anchors | half << HammingAnchors.BITS


def home_keys(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    code = HammingAnchors(0)
    return [anchor_key(h, code.homes(fps >> shift & code.WORD)) for h, shift, _ in halves(distance)]


def cell_of(fps: np.ndarray) -> np.ndarray:
    """Both halves at home, the two bits beside them kept: points of one cell differ in 4 bits at most, and are 1,024 at most."""
    code = HammingAnchors(0)
    low, high = code.homes(fps & code.WORD), code.homes(fps >> 32 & code.WORD)
    return (fps & ~(code.WORD | code.WORD << 32)) | low | high << 32


def home_bits(points: DataFrame, distance: int, bits: int) -> np.ndarray:
    """A packed bitmap of the anchors, by hash, where a point is at home."""

    def start():
        blocks = Blocks()

        def step(fps):
            if fps is None:
                yield blocks.rows()
                return
            for keys in home_keys(np.array(fps, dtype=np.int64), distance):
                blocks.add(place_of(mix(keys.view(np.uint64)), bits))

        return step

    return assembled(arrow_map(points, ["fp"], "block int, bits binary", start), bits)


def map_bits(points: int) -> int:
    """64 places a home, 2**28 (32 MB) at most."""
    return min(28, max(16, (128 * points).bit_length()))


def replicated(points: DataFrame, distance: int, packed: np.ndarray, bits: int, chunk: int = 8192) -> DataFrame:
    """(anchor, fp, home): each point at its homes, and as a visitor at the anchors in reach that the map has."""
    shared = points.sparkSession.sparkContext.broadcast(packed)

    def start():
        codes, known = [(h, shift, HammingAnchors(reach)) for h, shift, reach in halves(distance)], shared.value

        def step(fps):
            every = np.array(fps or (), dtype=np.int64)
            for s in range(0, len(every), chunk):
                part = every[s : s + chunk]
                for h, shift, code in codes:
                    for at, anchors in code.near(part >> shift & code.WORD):
                        keys = anchor_key(h, anchors)
                        row, col = np.nonzero(has_bit(known, place_of(mix(keys.view(np.uint64)), bits)))
                        yield {"anchor": keys[row, col], "fp": part[at][row], "home": col == 0}

        return step

    return arrow_map(points, ["fp"], "anchor long, fp long, home boolean", start)


def spanning(fps: np.ndarray, seekers: np.ndarray, label: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between seekers and any others that are near: as many as join all components that such links join. label: components so far."""
    label, links, bits = label.copy(), [], fps.view(np.uint64)
    for i in seekers.tolist():
        near = np.flatnonzero((np.bitwise_count(bits ^ bits[i]) <= distance) & (label != label[i]))
        if len(near):
            other, first = np.unique(label[near], return_index=True)
            links += [(int(fps[i]), int(fps[near[j]])) for j in first.tolist()]
            label[np.isin(label, other)] = label[i]
    return links


def grouped(rows: DataFrame, keys: list[str], cols: list[str], links_of) -> DataFrame:
    """(a, b): links_of(arrays of cols) for every group of equal keys; a task holds the groups of one batch at a time."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    names = [*keys, *cols]

    def start():
        held: list[list[np.ndarray]] = []

        def links(parts):
            values = [np.concatenate(x) for x in zip(*parts, strict=True)]
            edge = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in values[: len(keys)]], axis=0), True])
            found = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a > 1:
                    found += links_of(*(v[a:b] for v in values[len(keys) :]))
            return {"a": [min(p) for p in found], "b": [max(p) for p in found]}

        def step(*columns):
            nonlocal held
            if columns[0] is None:
                if held:
                    yield links(held)
                return
            now = [np.array(c) for c in columns]
            last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in now[: len(keys)]], axis=0)) if len(now[0]) > 1 else []
            if held and any(h[-1] != n[0] for h, n in zip(held[-1][: len(keys)], now, strict=False)):
                yield links(held)
                held = []
            if len(last):
                cut_at = int(last[-1]) + 1
                yield links([*held, [c[:cut_at] for c in now]])
                held, now = [], [c[cut_at:] for c in now]
            held.append(now)

        return step

    return arrow_map(dealt, names, "a long, b long", start)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def cell_links(points: DataFrame) -> DataFrame:
    """(a, b): each point of a cell and its least point."""

    def start():
        def step(fps):
            if fps is not None:
                yield {"fp": fps, "cell": cell_of(np.array(fps, dtype=np.int64))}

        return step

    cells = arrow_map(points, ["fp"], "fp long, cell long", start)
    least = cells.groupBy("cell").agg(F.min("fp").alias("least"))
    return cells.join(least, "cell").where("fp <> least").select(*pair("fp", "least"))


def split_links(members: DataFrame, links: DataFrame, distance: int, most: int) -> DataFrame:
    """(a, b): links within anchors of many points, in blocks of about ``most``; links: those found so far."""
    hubs = cut(members.where("home").groupBy("anchor").agg(F.min_by("fp", F.xxhash64("fp")).alias("hub")))
    ringed = cut(members.join(hubs, "anchor").withColumn("ring", differing(F.col("fp"), F.col("hub"))))
    star = ringed.where((F.col("ring") > 0) & (F.col("ring") <= distance)).select(*pair("fp", "hub"))
    found = [links, star] + ([cell_links(members.select("fp").distinct())] if distance >= 4 else [])
    so_far = found[0]
    for more in found[1:]:
        so_far = so_far.unionByName(more)
    so_far = cut(so_far.distinct())
    named = ringed.join(components(so_far).withColumnRenamed("cls", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    sizes = cut(named.groupBy("anchor", "comp", "ring").agg(F.count("*").alias("n")))
    whole = sizes.groupBy("anchor", "comp").agg(F.sum("n").alias("n"))
    top = whole.groupBy("anchor").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    outside = (F.col("comp") != F.col("top")).cast("int").alias("outside")
    blocks = sizes.join(top, "anchor").groupBy("anchor", "ring", outside).agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
    blocks = cut(blocks.select("anchor", "ring", "outside", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    left, right = (blocks.select("anchor", *[F.col(c).alias(f"{c}{k}") for c in ("ring", "outside", "block")]) for k in (1, 2))
    order = F.col("outside2") == 0
    order |= F.struct("ring1", "block1") <= F.struct("ring2", "block2")
    met = left.where("outside1 = 1").join(right, "anchor").where((F.abs(F.col("ring1") - F.col("ring2")) <= distance) & order)
    units = cut(met.withColumn("unit", F.xxhash64("anchor", "ring1", "outside1", "block1", "ring2", "outside2", "block2")))
    one, two = (units.select("anchor", "unit", F.lit(k == 1).alias("seeks"), *[F.col(f"{c}{k}").alias(c) for c in ("ring", "outside", "block")]) for k in (1, 2))
    own = F.struct("ring1", "outside1", "block1") == F.struct("ring2", "outside2", "block2")  # a block with itself: once is enough
    two = two.join(units.where(own).select("unit"), "unit", "left_anti")
    placed = named.join(top, "anchor").withColumn("outside", outside).join(blocks.select("anchor", "ring", "outside", "blocks").distinct(), ["anchor", "ring", "outside"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).select("anchor", "ring", "outside", "block", "fp", "comp")
    rows = placed.join(one.unionByName(two), ["anchor", "ring", "outside", "block"])
    across = grouped(rows.select("unit", "fp", "comp", "seeks"), ["unit"], ["fp", "comp", "seeks"], lambda fp, comp, seeks: spanning(fp, np.flatnonzero(seeks), comp, distance))
    return so_far.unionByName(across)


#: An anchor of more points is split.
MOST = 8192


def near_links(points: DataFrame, distance: int, most: int) -> DataFrame:
    """(a, b): links between points (fp) that differ in ``distance`` bits at most, enough to join all that such links join."""
    bits = map_bits(points.count())
    rows = cut(replicated(points, distance, home_bits(points, distance, bits), bits))
    hot = cut(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor"))
    split = not hot.isEmpty()
    few = rows.join(hot, "anchor", "left_anti") if split else rows
    links = cut(grouped(few, ["anchor"], ["fp", "home"], lambda fp, home: spanning(fp, np.flatnonzero(home), fp, distance)).distinct())
    return split_links(rows.join(hot, "anchor"), links, distance, most) if split else links


def named_documents(df: DataFrame, id_col: str, text_col: str, distance: int, size: int, most: int) -> DataFrame:
    """(id, mark, cls, component, g) of every row: cls its fingerprint, g the least fingerprint linked to it."""
    if not 0 <= distance <= 6:
        raise ValueError("distances of 0 to 6 bits")
    docs = cut(fingerprints(df, id_col, text_col, size))
    points = cut(docs.select("fp").distinct())
    comps = components(near_links(points, distance, most))
    return with_names(docs.select("id", "mark", F.col("fp").alias("cls"), F.lit(1).cast("long").alias("n")), comps)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, size: int = 4, most: int = MOST) -> DataFrame:
    """id, fingerprint (16 hex digits), component (least id reachable by links), one row per input row."""
    named = named_documents(df, id_col, text_col, distance, size, most)
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("cls")), 16, "0").alias("fingerprint"), "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, size: int = 4, most: int = MOST) -> DataFrame:
    """The rows of the document that stays of each group, with their columns: of the least id (a null id last), then of the least text hash. Rows equal in id and text stay or go together."""
    named = named_documents(df, id_col, text_col, distance, size, most)
    order = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    stays = named.groupBy("g").agg(F.min(order).alias("first")).select(F.col("first.id").alias("__millrace_id"), F.col("first.mark").alias("__millrace_mark"))
    key = (mark_of(text_col) == F.col("__millrace_mark")) & plain(id_col).eqNullSafe(F.col("__millrace_id"))
    return df.join(cut(stays), key, "left_semi")
