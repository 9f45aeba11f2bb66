"""Packing: sum-of-squares online packing.

Each document's ids are cut into whole windows and a rest; the rest goes to the fill level
(or to an empty window) that leaves the sum of squared counts of partially filled windows
least, the fuller level on ties. The counts stand in a level array of one entry per fill.
Every task packs what it reads, online, so nothing is shuffled. Open windows hold their ids
until they close; where more than ``max_open`` are open, and at the end, the emptiest are cut
up to fill the fullest, so at most one window a task stays partial. That last one is split
into windows of powers of two, which need no padding.

Null text counts as empty and yields one piece, the end id; null and repeated ids are kept;
an input without rows yields none.
"""

from __future__ import annotations

import base64
from zlib import crc32

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map

WINDOW, END_ID = 2048, 1


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, by a tokenizers file.

    With ``ranks_path``, the same vocabulary as tiktoken ranks, most texts are encoded by tiktoken,
    which takes a quarter of the time; texts with the file's special tokens are not, and one text
    of every batch is encoded by both, so that files of different vocabularies are noticed.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tok, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.fast or not texts:
            return self.slow(texts)
        ids = [b"" if any(s in t for s in self.special) else self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]
        whole = [k for k, (t, b) in enumerate(zip(texts, ids, strict=True)) if t and not b]
        for k, b in zip(whole, self.slow([texts[k] for k in whole]), strict=True):
            ids[k] = b
        probe = min(range(len(texts)), key=lambda k: abs(len(texts[k]) - 500))
        if self.slow([texts[probe]]) != [ids[probe]]:
            raise ValueError("the tokenizer's file and the ranks differ")
        return ids


_encoders: dict[tuple, Encoder] = {}


def encoder(*files: str | None) -> Encoder:
    """One per Python worker."""
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]


class Packer:
    """Places documents into windows; pieces come out when their window closes."""

    def __init__(self, window: int = WINDOW, max_open: int = 1024, first_id: int = 0):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.counts = np.zeros(window + 1, dtype=np.int64)  # windows at each fill level
        self.cost = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by fill: windows, each a list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def level(self, r: int) -> int:
        """The fill level to put r ids on: sum of squares least, then fullest."""
        c, top = self.counts, self.window - r
        change = np.where(c[: top + 1] > 0, 1 - 2 * c[: top + 1], np.iinfo(np.int64).max // 2)
        change[0] = 0
        change[:top] += 2 * c[r : self.window] + 1  # a full window is no longer counted
        return top - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        whole = total - total % w
        for s in range(0, whole, w):
            self.close([(doc, s, ids[4 * s : 4 * (s + w)], total)])
        if whole < total:
            self.put([(doc, whole, ids[4 * whole :], total)], total - whole)

    def put(self, pieces: list, r: int) -> None:
        level = self.level(r)
        if level:
            pieces = self.open[level].pop() + pieces
            self.counts[level] -= 1
            self.n_open -= 1
        if level + r == self.window:
            self.close(pieces)
            return
        self.keep(pieces, level + r)
        if self.n_open > self.max_open:
            for left, n in self.merge():
                self.keep(left, n)

    def keep(self, pieces: list, fill: int) -> None:
        self.open[fill].append(pieces)
        self.counts[fill] += 1
        self.n_open += 1

    def merge(self) -> list[tuple[list, int]]:
        """Fills the fullest open windows with what the emptiest hold; returns the one that stays partial."""
        rows = [[pieces, fill] for fill, windows in enumerate(self.open) for pieces in windows]
        self.open, self.n_open = [[] for _ in range(self.window)], 0
        self.counts[:] = 0
        lo, hi = 0, len(rows) - 1
        while lo < hi:
            to, source = rows[hi], rows[lo]
            doc, start, ids, total = source[0].pop()
            n = min(len(ids) // 4, self.window - to[1])
            to[0].append((doc, start, ids[: 4 * n], total))
            to[1] += n
            source[1] -= n
            if 4 * n < len(ids):
                source[0].append((doc, start + n, ids[4 * n :], total))
            if to[1] == self.window:
                self.close(to[0])
                hi -= 1
            if not source[0]:
                lo += 1
        return [(rows[i][0], rows[i][1]) for i in range(lo, hi + 1) if rows[i][0]]

    def finish(self) -> None:
        for pieces, fill in self.merge():
            for bit in range(fill.bit_length() - 1, -1, -1):
                if fill >> bit & 1:
                    taken, left = [], 1 << bit
                    while left:
                        doc, start, ids, total = pieces.pop(0)
                        n = min(left, len(ids) // 4)
                        taken.append((doc, start, ids[: 4 * n], total))
                        if 4 * n < len(ids):
                            pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                        left -= n
                    self.close(taken)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, window: int = WINDOW, end_id: int = END_ID, max_open: int = 1024) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        task = TaskContext.get()
        packer = Packer(window, max_open, (task.partitionId() if task else 0) << 36)

        def rows():
            got = packer.take()
            if got:
                yield dict(zip(PIECES, map(list, zip(*got, strict=True)), strict=True))

        def step(ids, texts):
            if ids is None:
                packer.finish()
                yield from rows()
                return
            codes = encoder(tokenizer_path, ranks_path, pattern)
            for i in range(0, len(ids), 512):
                for doc, b in zip(ids[i : i + 512], codes.encode([t or "" for t in texts[i : i + 512]]), strict=True):
                    packer.add(doc, b + end)
                yield from rows()

        return step

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return arrow_map(df, [id_col, text_col], schema, start).withColumnRenamed("doc_id", id_col)
