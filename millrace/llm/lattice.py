"""LM scoring: subword lattice likelihood.

The vocabulary is a public tokenizer's pieces. Its file ranks them; a piece's first weight falls
with its rank (Zipf), and one expectation step over the training words turns these weights into
unigram probabilities. A word's probability is the sum over all its segmentations into pieces
(characters outside the vocabulary go by bytes), by a forward recursion in log space; pieces never
cross white space, so a text's log probability is the sum of its words' and its end's.

Tokens are looked up without a row per token: a task turns about ``chunk_words`` words into a
chunk, codes into a dictionary of its own; dictionaries are dealt by word hash, get totals and
lattice scores there, and go back to the chunk. All counts are over all training texts. A frequent
word is one entry of each chunk's dictionary, so no key gathers rows with its frequency.

Null and empty texts are one end token; null ids are kept; repeated rows count and score each;
without training rows every count is 0 and the file's ranks alone weight the pieces.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, plain

END = b""  # no word is empty, so this is the end token
LONG_WORD = 48  # longer words are worked out alone; the results are the same


def tokens_of(text: str | None) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass").lower().split() if text else []) + [END]


class Pieces:
    """The vocabulary: text pieces, byte pieces and the end, each with a log weight."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: dict[str, int] = {}
        self.byte = np.zeros(256, dtype=np.int64)
        self.n = sp.get_piece_size()
        rank = np.full(self.n, float(self.n))
        for i in range(self.n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif piece == "</s>":
                self.end = i
                rank[i] = 10.0
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and "▁" not in piece[1:]:
                self.text[piece] = i
                rank[i] = max(1.0, 1.0 - max(sp.get_score(i), -float(self.n)))
        self.longest = max(map(len, self.text), default=1)
        share = 1 / (rank + 10.0)
        self.prior = share / share.sum()

    def log_weights(self, expected: np.ndarray | None) -> np.ndarray:
        """Log probabilities: expected counts plus one share of a count a piece, spread by rank."""
        p = self.prior * self.n
        if expected is not None:
            p = expected + p * 0.1
        return np.log(p / p.sum())


B = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Marginal log probabilities of words under piece weights, many words at a time."""

    BITS = 18

    def __init__(self, pieces: Pieces, lp: np.ndarray):
        self.p, self.lp = pieces, lp
        self.powers = np.array([pow(int(B), i, 1 << 64) for i in range(LONG_WORD + 2)], dtype=np.uint64)
        left = [(self.hash_of(t), i) for t, i in pieces.text.items()]
        self.tables = []
        for mult in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
            keys, ids, more = np.zeros(1 << self.BITS, dtype=np.uint64), np.full(1 << self.BITS, -1, dtype=np.int64), []
            for h, i in left:
                slot = (h * mult & (1 << 64) - 1) >> (64 - self.BITS)
                if ids[slot] < 0:
                    keys[slot], ids[slot] = h, i
                else:
                    more.append((h, i))
            self.tables.append((np.uint64(mult), keys, ids))
            left = more
        if left:
            raise ValueError("pieces left without a slot")

    @staticmethod
    def hash_of(t: str) -> int:
        h = 0
        for c in t:
            h = (h * int(B) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, -1 for none."""
        out = np.full(h.shape, -1, dtype=np.int64)
        for mult, keys, ids in self.tables:
            slot = (h * mult) >> np.uint64(64 - self.BITS)
            out = np.where((keys[slot] == h) & (ids[slot] >= 0), ids[slot], out)
        return out

    def bytes_lp(self, code: np.ndarray) -> np.ndarray:
        u, back = np.unique(code, return_inverse=True)
        each = [sum(self.lp[self.p.byte[b]] for b in chr(c).encode("utf-8", "surrogatepass")) for c in u.tolist()]
        return np.array(each)[back].reshape(code.shape)

    def same_length(self, words: list[str], counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        m, size = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, size)
        h = np.zeros((size + 1, m), dtype=np.uint64)
        for j in range(size):
            h[j + 1] = h[j] * B + (code[:, j].astype(np.uint64) + np.uint64(1))
        raw = self.bytes_lp(code).T
        fwd = np.full((size + 1, m), -np.inf)
        fwd[0] = 0.0
        arcs = []
        for j in range(1, size + 1):
            acc = fwd[j - 1] + raw[j - 1]
            for i in range(max(0, j - self.p.longest), j):
                ids = self.find(h[j] - h[i] * self.powers[j - i])
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    acc[hit] = np.logaddexp(acc[hit], fwd[i, hit] + self.lp[ids[hit]])
                    if expected is not None:
                        arcs.append((i, j, hit, ids[hit]))
            fwd[j] = acc
        if expected is not None:
            self.backward(size, m, fwd, raw, arcs, code, counts, expected)
        return fwd[size]

    def backward(self, size, m, fwd, raw, arcs, code, counts, expected) -> None:
        """Adds each piece's expected count, by posteriors of the arcs."""
        bwd = np.full((size + 1, m), -np.inf)
        bwd[size] = 0.0
        at = len(arcs) - 1
        total = fwd[size]
        for j in range(size, 0, -1):
            through = fwd[j - 1] + raw[j - 1] + bwd[j] - total
            points, back = np.unique(code[:, j - 1], return_inverse=True)
            for c, x in zip(points.tolist(), np.bincount(back, weights=counts * np.exp(through)).tolist(), strict=True):
                for b in chr(c).encode("utf-8", "surrogatepass"):
                    expected[self.p.byte[b]] += x
            bwd[j - 1] = np.logaddexp(bwd[j - 1], raw[j - 1] + bwd[j])
            while at >= 0 and arcs[at][1] == j:
                i, _, hit, ids = arcs[at]
                w = self.lp[ids] + bwd[j, hit]
                expected += np.bincount(ids, weights=counts[hit] * np.exp(fwd[i, hit] + w - total[hit]), minlength=len(expected))
                bwd[i, hit] = np.logaddexp(bwd[i, hit], w)
                at -= 1

    def one(self, word: str, count: float = 0.0, expected: np.ndarray | None = None) -> float:
        """A long word alone, of any length: it keeps a number a character, and finds the arcs anew on the way back."""
        get, lp, longest, size = self.p.text.get, self.lp, self.p.longest, len(word)
        bytes_of: dict[str, list[int]] = {}

        def raw(c: str) -> list[int]:
            if c not in bytes_of:
                bytes_of[c] = [int(self.p.byte[b]) for b in c.encode("utf-8", "surrogatepass")]
            return bytes_of[c]

        def total(best: list[float]) -> float:
            top = max(best)
            return top + math.log(sum(math.exp(x - top) for x in best))

        fwd = np.zeros(size + 1)
        for j in range(1, size + 1):
            best = [fwd[j - 1] + sum(lp[b] for b in raw(word[j - 1]))]
            for i in range(max(0, j - longest), j):
                k = get(word[i:j])
                if k is not None:
                    best.append(fwd[i] + lp[k])
            fwd[j] = total(best)
        if expected is not None and count:
            bwd = np.zeros(size + 1)
            for i in range(size - 1, -1, -1):
                own = raw(word[i])
                weight = sum(lp[b] for b in own) + bwd[i + 1]
                best = [weight]
                for b in own:
                    expected[b] += count * math.exp(fwd[i] + weight - fwd[size])
                for j in range(i + 1, min(size, i + longest) + 1):
                    k = get(word[i:j])
                    if k is not None:
                        best.append(lp[k] + bwd[j])
                        expected[k] += count * math.exp(fwd[i] + best[-1] - fwd[size])
                bwd[i] = total(best)
        return float(fwd[size])

    def score(self, words: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word; adds to expected the counts of pieces, if given."""
        out = np.zeros(len(words))
        groups: dict[int, list[int]] = {}
        texts = []
        for k, w in enumerate(words):
            t = "" if w == END else "▁" + w.decode("utf-8", "surrogatepass")
            texts.append(t)
            groups.setdefault(len(t), []).append(k)
        for size, at in groups.items():
            if not size:
                out[at] = self.lp[self.p.end]
                if expected is not None:
                    expected[self.p.end] += counts[at].sum()
            elif size > LONG_WORD:
                out[at] = [self.one(texts[k], 0.0 if counts is None else float(counts[k]), expected) for k in at]
            else:
                for s in range(0, len(at), 20_000):
                    part = at[s : s + 20_000]
                    out[part] = self.same_length([texts[k] for k in part], None if counts is None else counts[part], expected)
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per Python worker."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def squeeze(words: list[bytes]) -> bytes:
    """Words hold no white space, so a line each will do; the end token is an empty line."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def spread(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def pack_ints(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack_ints(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


CHUNK = "chunk long, bucket int, ids array<{id}>, held array<boolean>, sizes binary, codes binary, words binary, counts binary"
DEAL = 512
REFS = 8_000_000


def to_chunks(df: DataFrame, id_col: str, text_col: str, held: Column, chunk_words: int, buckets: int) -> DataFrame:
    """Chunks: a row of coded documents, and a row of the dictionary's words for each bucket."""

    def start():
        task = TaskContext.get()
        base, n = (task.partitionId() if task else 0) << 32, 0
        ids, out, words, codes, size = [], [], {}, [], 0

        def flush():
            nonlocal n, ids, out, words, codes, size
            if not ids:
                return
            counts = np.zeros(len(words), dtype=np.int64)
            for c, h in zip(codes, out, strict=True):
                if not h:
                    counts += np.bincount(c, minlength=len(words)) if len(c) > len(words) // 8 else 0
                    if len(c) <= len(words) // 8:
                        np.add.at(counts, c, 1)
            names = list(words)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in names), dtype=np.int64, count=len(names))
            order = np.argsort(bucket, kind="stable")
            new = np.zeros(len(names), dtype=np.int32)
            new[order] = np.arange(len(names))
            rows = {k: [] for k in ("chunk", "bucket", "ids", "held", "sizes", "codes", "words", "counts")}

            def row(**x):
                for k, v in rows.items():
                    v.append(x.get(k))

            sizes = np.array([len(c) for c in codes], dtype=np.int32)
            row(chunk=base + n, bucket=-1, ids=ids, held=out, sizes=pack_ints(sizes), codes=pack_ints(new[np.concatenate(codes)]))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    row(chunk=base + n, bucket=b, words=squeeze([names[k] for k in at.tolist()]), counts=pack_ints(counts[at]))
            n += 1
            ids, out, words, codes, size = [], [], {}, [], 0
            yield rows

        def step(i, texts, is_held):
            nonlocal size
            if i is None:
                yield from flush()
                return
            for k, t, h in zip(i, texts, is_held, strict=True):
                w = tokens_of(t)
                for x in w:
                    if x not in words:
                        words[x] = len(words)
                ids.append(k)
                out.append(bool(h))
                codes.append(np.fromiter(map(words.__getitem__, w), dtype=np.int32, count=len(w)))
                size += len(w)
                if size >= chunk_words:
                    yield from flush()

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(plain(id_col).alias("i"), plain(text_col).alias("t"), held.alias("h"))
    return arrow_map(rows, ["i", "t", "h"], CHUNK.format(id=kind), start)


def total_up(dictionaries: DataFrame, partitions: int) -> DataFrame:
    """(bucket, words, totals, refs); refs: (chunk, places of its words) of each chunk. A row of words a bucket, and rows of refs alone, as many as its chunks need."""

    def start():
        now, known, totals, refs, held = None, {}, [], [], 0

        def row():
            return {"bucket": [now], "words": [squeeze(list(known))], "totals": [pack_ints(np.array(totals, dtype=np.int64))], "refs": [refs]}

        def step(bucket, chunk, words, counts):
            nonlocal now, known, totals, refs, held
            if bucket is None:
                if known:
                    yield row()
                return
            for b, c, w, k in zip(bucket, chunk, words, counts, strict=True):
                if now != b:
                    if known:
                        yield row()
                    now, known, totals, refs, held = b, {}, [], [], 0
                at = []
                for x, n in zip(spread(w), unpack_ints(k, np.int64).tolist(), strict=True):
                    i = known.get(x)
                    if i is None:
                        i = known[x] = len(totals)
                        totals.append(0)
                    totals[i] += n
                    at.append(i)
                refs.append({"chunk": c, "at": pack_ints(np.array(at, dtype=np.int32))})
                held += len(refs[-1]["at"]) + 64
                if held >= REFS:
                    yield {"bucket": [b], "words": [None], "totals": [None], "refs": [refs]}
                    refs, held = [], 0

        return step

    dealt = dictionaries.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk")
    return arrow_map(dealt, ["bucket", "chunk", "words", "counts"], "bucket int, words binary, totals binary, refs array<struct<chunk:long,at:binary>>", start)


def expect(totals: DataFrame, path: str) -> DataFrame:
    """(piece, n): expected counts of pieces over all training words, one row a piece."""

    def start():
        lattice, expected = None, None

        def step(words, counts):
            nonlocal lattice, expected
            if words is None:
                if expected is not None:
                    at = np.flatnonzero(expected)
                    yield {"piece": at.tolist(), "n": expected[at].tolist()}
                return
            if lattice is None:
                p = pieces(path)
                lattice, expected = Lattice(p, p.log_weights(None)), np.zeros(p.n)
            for w, c in zip(words, counts, strict=True):
                if w is None:
                    continue
                n = unpack_ints(c, np.int64)
                used = np.flatnonzero(n)
                w = spread(w)
                lattice.score([w[i] for i in used.tolist()], n[used].astype(float), expected)

        return step

    return arrow_map(totals, ["words", "totals"], "piece int, n double", start).groupBy("piece").agg(F.sum("n").alias("n"))


def look_up(totals: DataFrame, path: str, expected: np.ndarray | None) -> DataFrame:
    """(chunk, bucket, c, lp): what each chunk's dictionary needs."""
    shared = totals.sparkSession.sparkContext.broadcast(expected)  # a number a piece of the vocabulary

    def start():
        lattice, n, lp = None, None, None

        def step(bucket, words, counts, refs):
            nonlocal lattice, n, lp
            if bucket is None:
                return
            if lattice is None:
                p = pieces(path)
                lattice = Lattice(p, p.log_weights(shared.value))
            for b, w, c, r in zip(bucket, words, counts, refs, strict=True):
                if w is not None:  # the bucket's first row
                    n, lp = unpack_ints(c, np.int64), lattice.score(spread(w))
                for x in r:
                    at = unpack_ints(x["at"], np.int32)
                    yield {"chunk": [x["chunk"]], "bucket": [b], "c": [pack_ints(n[at])], "lp": [pack_ints(lp[at])]}

        return step

    ordered = totals.sortWithinPartitions("bucket", F.col("words").isNull())  # a bucket's rows stand in one partition
    return arrow_map(ordered, ["bucket", "words", "totals", "refs"], "chunk long, bucket int, c binary, lp binary", start)


def add_up(coded: DataFrame, found: DataFrame, id_kind: str, n_all: int, v_all: int, partitions: int) -> DataFrame:
    """Scores of each chunk's documents: its dictionary's rows come first, then its codes."""
    none = F.lit(None)
    a = found.select("chunk", F.lit(0).alias("kind"), "bucket", none.cast(f"array<{id_kind}>").alias("ids"), none.cast("array<boolean>").alias("held"), F.col("c").alias("x"), F.col("lp").alias("y"))
    b = coded.select("chunk", F.lit(1).alias("kind"), "bucket", "ids", "held", F.col("sizes").alias("x"), F.col("codes").alias("y"))
    dealt = a.unionByName(b).repartition(partitions, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    z = math.log10(n_all + v_all + 1)

    def start():
        c_parts, lp_parts = [], []

        def step(chunk, kind, bucket, ids, held, x, y):
            nonlocal c_parts, lp_parts
            if chunk is None:
                return
            for k, i, h, p, q in zip(kind, ids, held, x, y, strict=True):
                if k == 0:
                    c_parts.append(unpack_ints(p, np.int64))
                    lp_parts.append(unpack_ints(q, np.float64))
                    continue
                c, lp = np.concatenate(c_parts), np.concatenate(lp_parts) / math.log(10)
                c_parts, lp_parts = [], []
                sizes, code = unpack_ints(p, np.int32), unpack_ints(q, np.int32)
                begin = np.r_[0, np.cumsum(sizes)[:-1]]
                base = np.log10(c + 1.0) - z
                yield {
                    "id": i, "held_out": h, "n_tokens": sizes.tolist(), "n_known": np.add.reduceat((c > 0).astype(np.int64)[code], begin).tolist(),
                    "train_tokens": [n_all] * len(i), "base_score": np.add.reduceat(base[code], begin).tolist(), "score": np.add.reduceat(lp[code], begin).tolist(),
                }

        return step

    schema = f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return arrow_map(dealt, ["chunk", "kind", "bucket", "ids", "held", "x", "y"], schema, start)


def score_texts(df: DataFrame, path: str, held: Column, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 1_500_000, bucket_words: int = 1_000_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text."""
    chars = df.agg(F.sum(F.length(plain(text_col)))).first()[0] or 0
    buckets = int(min(DEAL * 64, max(16, chars // (6 * bucket_words))))  # grows with the input: a bucket's words stay few
    chunks = cut(to_chunks(df, id_col, text_col, held, chunk_words, buckets))
    totals = cut(total_up(chunks.where("bucket >= 0").select("bucket", "chunk", "words", "counts"), buckets))
    p = pieces(path)
    expected = np.zeros(p.n)
    for r in expect(totals, path).collect():  # a row a piece at most
        expected[r.piece] = r.n
    n_all, v_all = sums(totals)
    found = look_up(totals, path, expected if n_all else None)
    kind = df.schema[id_col].dataType.simpleString()
    return add_up(chunks.where("bucket < 0"), found, kind, n_all, v_all, buckets).withColumnRenamed("id", id_col)


def sums(totals: DataFrame) -> tuple[int, int]:
    """All training tokens, and the distinct ones."""

    def start():
        n, v = 0, 0

        def step(counts):
            nonlocal n, v
            if counts is None:
                yield {"n": [n], "v": [v]}
                return
            for c in counts:
                if c is None:
                    continue
                a = unpack_ints(c, np.int64)
                n, v = n + int(a.sum()), v + int((a > 0).sum())

        return step

    got = arrow_map(totals, ["totals"], "n long, v long", start).agg(F.sum("n"), F.sum("v")).first()
    return got[0] or 0, got[1] or 0


