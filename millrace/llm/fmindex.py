"""Benchmark decontamination: an FM-index per training shard.

A task indexes its documents in shards of about ``shard_words`` words. Words become symbols; a
word that occurs in no test phrase is a separator, and a stretch between separators that is
shorter than the shortest phrase is left out, since no occurrence can touch it. The index of a
shard is a full suffix order (prefix doubling, separators ordered by place), its Burrows-Wheeler
transform in a wavelet matrix, and suffix positions sampled at every ``rate``-th place and at
stretch starts. All phrases are searched backward together, symbol by symbol, through wavelet
ranks; occurrences are located by walking to a sampled position; their spans are merged.

Nothing is shuffled. The phrases are broadcast in blocks of ``block_chars`` characters of items at
most; a task searches each of its shards for one block after another and merges spans by the
row's place, so that ids play no part and results are the same for any number of blocks. A shard
doesn't cross an Arrow batch.

Null text has no words and is clean; items without words are never found; repeated items each
count; null and repeated ids, and repeated rows, are each judged by their own text; an empty table
of either kind gives clean rows or none. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, plain

WINDOW = 13
#: Bytes that words hold (digits, letters, all but ASCII) to themselves, A-Z lower-cased, the rest to a space.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols that end in a 0; zeros are distinct, ordered by place, and end comparison."""
    n = len(s)
    zero = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(zero)
    rank[zero] = np.arange(len(zero))
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    head = np.r_[True, r[1:] != r[:-1]]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        tied = ~head
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)  # only suffixes whose place isn't settled yet are sorted again
        if not len(at):
            return order
        who = order[at]
        key = rank[who] * (n + 1) + rank[who + k]  # a tied suffix is longer than k: its first zero would have settled it
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[at] = who
        fresh = np.r_[True, key[1:] != key[:-1]]
        head[at] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
        k *= 2


class WaveletMatrix:
    """rank(symbol, i) over a sequence, for arrays of symbols and places."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def ranks(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c stands before lo and before hi."""
        first = np.zeros_like(lo)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one, z = self.ones[level], self.zeros[level]
            bit = ((c >> b) & 1) == 1
            first, lo, hi = (np.where(bit, z + one[x], x - one[x]) for x in (first, lo, hi))
        return lo - first, hi - first

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        c, first = np.zeros_like(i), np.zeros_like(i)
        for level in range(self.bits):
            one, z = self.ones[level], self.zeros[level]
            bit = one[i + 1] > one[i]
            c = c * 2 + bit
            first, i = (np.where(bit, z + one[x], x - one[x]) for x in (first, i))
        return c, i - first


class FMIndex:
    def __init__(self, s: np.ndarray, rate: int = 8):
        """s: symbols over 0, which it begins and ends with; 0 separates stretches."""
        order = suffix_order(s)
        n = len(s)
        bits = max(1, int(s.max()).bit_length())
        self.wavelet = WaveletMatrix(s[order - 1], bits)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=1 << bits))]
        self.n = n
        sampled = order % rate == 0
        sampled |= s[order - 1] == 0  # a walk never crosses a separator
        self.place = np.r_[0, np.cumsum(sampled, dtype=np.int64)]
        self.sampled, self.values = sampled, order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with each phrase; phrases: one a row, filled with -1 on the left."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.flatnonzero(phrases.max(axis=1, initial=0) < len(self.before) - 1)  # others hold a symbol that the text lacks
        hi[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for back in range(1, phrases.shape[1] + 1):
            live = live[(hi[live] > lo[live]) & (lengths[live] >= back)]
            if not len(live):
                break
            c = phrases[live, -back]
            a, b = self.wavelet.ranks(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps, left = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows[left]]
            fin = left[done]
            out[fin] = self.values[self.place[rows[fin]]] + steps
            left = left[~done]
            c, k = self.wavelet.at(rows[left])
            rows[left] = self.before[c] + k
            steps += 1
        return out


class Phrases:
    """Distinct windows of the items as symbol rows, and the items that each stands for; arrays, so that a block is small in a worker."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            code = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            for i in range(max(1, len(code) - window + 1) if code else 0):
                held = owners.setdefault(tuple(code[i : i + window]), [])
                if not held or held[-1] != k:
                    held.append(k)
        self.lengths = np.array([len(p) for p in owners], dtype=np.int64)
        self.first = np.r_[0, np.cumsum([len(o) for o in owners.values()], dtype=np.int64)]
        self.owner = np.array([k for o in owners.values() for k in o], dtype=np.int64)
        self.codes = np.full((len(owners), window), -1, dtype=np.int32)
        for r, p in enumerate(owners):
            self.codes[r, window - len(p) :] = p
        self.shortest = int(self.lengths.min()) if owners else 0

    def items(self, which: np.ndarray) -> list[int]:
        """Numbers of the items that have any of these windows."""
        return sorted({k for p in np.unique(which).tolist() for k in self.owner[self.first[p] : self.first[p + 1]].tolist()})


def stretches(code: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """Places of the words in runs of test words, within a document, of at least the shortest phrase."""
    inside = code > 0
    joined = inside[1:] & inside[:-1] & (doc[1:] == doc[:-1])
    begins = np.flatnonzero(inside & np.r_[True, ~joined])
    ends = np.flatnonzero(inside & np.r_[~joined, True]) + 1
    long = ends - begins >= shortest
    begins, sizes = begins[long], (ends - begins)[long]
    return np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(begins) else begins


def shard_hits(code: np.ndarray, doc: np.ndarray, phrases: Phrases, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of first word, phrase) of every occurrence in the shard."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not phrases.shortest or not len(code):
        return none
    where = stretches(code, doc, phrases.shortest)
    if not len(where):
        return none
    gap = np.r_[True, (where[1:] != where[:-1] + 1) | (doc[where[1:]] != doc[where[:-1]])]
    place = np.arange(len(where)) + np.cumsum(gap)  # a separator stands before each stretch
    s = np.zeros(place[-1] + 2, dtype=np.int64)
    s[place] = code[where]
    index = FMIndex(s, rate)
    lo, hi = index.search(phrases.codes, phrases.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    back = np.zeros(len(s), dtype=np.int64)
    back[place] = where
    return back[index.locate(rows)], which


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[new].tolist(), b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]].tolist(), strict=True))


def search_texts(texts: list[str | None], phrases: Phrases, shard_words: int, rate: int):
    """(number of words, merged word spans, item numbers) of each text."""
    i = 0
    while i < len(texts):
        sizes, codes, total, j = [], [], 0, i
        get = phrases.symbol.get
        while j < len(texts) and (j == i or total < shard_words):
            w = words_of(texts[j])
            sizes.append(len(w))
            total += len(w)
            codes.append(np.fromiter(map(get, w, [0] * len(w)), dtype=np.int64, count=len(w)))
            j += 1
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at, which = shard_hits(np.concatenate(codes), doc, phrases, rate)
        first = np.r_[0, np.cumsum(sizes)]
        owner = doc[at] if len(at) else at
        order = np.argsort(owner, kind="stable")
        at, which, owner = at[order], which[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
        for d, n in enumerate(sizes):
            a, b = cuts[d], cuts[d + 1]
            if a == b:
                yield n, [], []
                continue
            begin = at[a:b] - first[d]
            yield n, merged(begin, begin + phrases.lengths[which[a:b]]), phrases.items(which[a:b])
        i = j


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of a bounded size, each read on its own; one block at least."""
    total = items.agg(F.sum(F.length(plain(text_col)))).first()[0] or 0
    n = -(-max(total, 1) // block_chars)
    rows = items.select(plain(id_col).cast("string").alias("i"), plain(text_col).alias("t"))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield [(r.i, r.t) for r in part.collect()]


class Search:
    """Searches texts for the items of all blocks; holds one block at a time where there are several."""

    def __init__(self, shared: list, shard_words: int, rate: int):
        self.shared, self.shard_words, self.rate = shared, shard_words, rate

    def __call__(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(words, merged spans, item ids) of each text, by its place."""
        out = None
        for block in self.shared:
            phrases = block.value
            found = [(n, spans, [phrases.ids[k] for k in items]) for n, spans, items in search_texts(texts, phrases, self.shard_words, self.rate)]
            out = found if out is None else [(n, joined(a, b), sorted([*x, *y], key=str)) for (n, a, x), (_, b, y) in zip(out, found, strict=True)]
            if len(self.shared) > 1:
                block.__dict__.pop("_value", None)  # the worker reads it again from its broadcast file
        return out


def joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return merged(np.array([x for x, _ in a + b]), np.array([y for _, y in a + b])) if a and b else a or b


def searcher(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, shard_words: int, rate: int, block_chars: int) -> Search:
    sc = docs.sparkSession.sparkContext
    return Search([sc.broadcast(Phrases(b, window)) for b in blocks(items, item_col, item_text_col, block_chars)], shard_words, rate)


HITS = "id {id}, n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = 1_000_000, rate: int = 8, block_chars: int = 2_000_000) -> DataFrame:
    """id, n_words, merged word spans (end exclusive) and item ids found, per row."""
    search = searcher(docs, items, item_col, item_text_col, window, shard_words, rate, block_chars)

    def start():
        def step(ids, texts):
            if ids is None:
                return
            found = search(texts)
            yield {"id": ids, "n_words": [n for n, _, _ in found], "spans": [[{"a": a, "b": b} for a, b in s] for _, s, _ in found], "items": [x for _, _, x in found]}

        return step

    return arrow_map(docs, [id_col, text_col], HITS.format(id=docs.schema[id_col].dataType.simpleString()), start).withColumnRenamed("id", id_col)


def with_verdict(found: DataFrame) -> DataFrame:
    """found with n_hit and contaminated: some words hit, and at least a twentieth of all."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s.b - s.a)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = 1_000_000, rate: int = 8, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns; each row is judged by its own text."""
    names = docs.columns
    search = searcher(docs, items, item_col, item_text_col, window, shard_words, rate, block_chars)

    def start():
        def step(*columns):
            if columns[0] is None:
                return
            hits = ((n, sum(b - a for a, b in spans)) for n, spans, _ in search(columns[names.index(text_col)]))
            clean = [not (hit and 20 * hit >= n) for n, hit in hits]
            yield {c: [x for x, ok in zip(v, clean, strict=True) if ok] for c, v in zip(names, columns, strict=True)}

        return step

    return arrow_map(docs, names, docs.schema, start)
