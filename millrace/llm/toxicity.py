"""Toxicity: multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is a logistic function of
summed word weights (whole word and its first four and five letters, hashed into a fixed table);
a document's is the noisy-or of its sentences: 1 - prod(1 - p). The weights are trained from
document labels alone, by gradient steps on the documents' likelihood, on a bounded sample:
at most ``max_per_class`` labelled documents of each class, and of these at most ``max_chars``
characters, those whose hashed id is least.
Afterwards each sentence has a score of its own, which locates the offending ones.

Null and empty texts have no sentence and score 0; null ids are kept; repeated rows score alike; of
several labels of one id the largest counts, of several texts the one of least hash;
without labels of both classes every document scores 0. Other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import exp, log1p
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, plain

BITS = 20
BREAK = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [crc32(f.encode("utf-8", "surrogatepass")) & mask for f in {word, *(f"{k}<{word[:k]}" for k in (4, 5) if len(word) > k)}]


def sentences(text: str):
    """(start, end) of each stretch between sentence ends."""
    at = 0
    for m in BREAK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, where each sentence's begin, and where each document's sentences begin."""
    known: dict[str, list[int]] = {}
    feats: list[int] = []
    starts, docs = [], []
    for t in texts:
        docs.append(len(starts))
        for s in BREAK.split(t.lower()):
            words = set(WORD.findall(s))
            if words:
                starts.append(len(feats))
                for w in words:
                    if w not in known:
                        known[w] = word_features(w)
                    feats += known[w]
    return np.array(feats, dtype=np.int64), np.array([*starts, len(feats)], dtype=np.int64), np.array([*docs, len(starts)], dtype=np.int64)


def train(texts: list[str], toxic: list[int], epochs: int = 25, batch: int = 200, rate: float = 1.0, shrink: float = 1e-4, least_docs: int = 3, toxic_weight: float = 4.0, seed: int = 0) -> Model:
    y_all = np.array(toxic, dtype=np.float64)
    model = Model(np.zeros(1 << BITS), -20.0)
    if not len(y_all) or y_all.min() == y_all.max():
        return model
    feats, starts, docs = bags(texts)
    seen = np.zeros(1 << BITS, dtype=np.int32)  # documents with a feature; rare ones get no weight
    for d in range(len(y_all)):
        seen[np.unique(feats[starts[docs[d]] : starts[docs[d + 1]]])] += 1
    use = seen >= least_docs
    w, g2, bias, bias_g2 = model.weights, np.full(1 << BITS, 1e-2), -5.0, 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y_all))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            part = part[docs[part + 1] > docs[part]]
            if not len(part):
                continue
            sents = np.concatenate([np.arange(docs[d], docs[d + 1]) for d in part])
            doc_of = np.repeat(np.arange(len(part)), docs[part + 1] - docs[part])
            sizes = starts[sents + 1] - starts[sents]
            at = np.concatenate([feats[starts[docs[d]] : starts[docs[d + 1]]] for d in part])
            sent_of = np.repeat(np.arange(len(sents)), sizes)
            z = np.clip(bias + np.bincount(sent_of, weights=w[at], minlength=len(sents)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(part)))
            y = y_all[part]
            ratio = np.where(y > 0, -toxic_weight * none / np.maximum(1 - none, 1e-9), 1.0)
            dz = p * ratio[doc_of]
            grad = np.bincount(at, weights=dz[sent_of], minlength=1 << BITS) / len(part)
            grad = np.where(use, grad + shrink * w * (grad != 0), 0.0)
            g2 += grad**2 * 100
            w -= rate * grad * 10 / np.sqrt(g2)
            step = dz.sum() / len(part)
            bias_g2 += step**2
            bias = min(bias - rate * step / np.sqrt(bias_g2), -3.0)
    model.bias = float(bias)
    return model


class Scorer:
    """Sentence and document scores; remembers the weight of each word."""

    def __init__(self, model: Model, keep: int = 400_000):
        self.w, self.bias, self.keep, self.known = model.weights, model.bias, keep, {}

    def logits(self, text: str) -> list[float]:
        known, bias = self.known, self.bias
        if len(known) > self.keep:
            known.clear()
        out = []
        for s in BREAK.split(text.lower()):
            words = set(WORD.findall(s))
            if words:
                z = bias
                for x in words:
                    v = known.get(x)
                    if v is None:
                        v = known[x] = float(sum(self.w[word_features(x)]))
                    z += v
                out.append(z)
        return out

    def score(self, text: str | None) -> tuple[float, float]:
        """Of the document, and of its worst sentence."""
        if not text:
            return 0.0, 0.0
        none, worst = 0.0, 0.0
        for z in self.logits(text):
            p = 1 / (1 + exp(-z)) if z > -30 else 0.0
            p = min(p, 1 - 1e-12)
            worst = max(worst, p)
            none += log1p(-p)
        return 1 - exp(none), worst

    def offending(self, text: str | None, least: float) -> list[tuple[int, int]]:
        out = []
        for a, b in sentences(text or ""):
            z = self.logits(text[a:b])
            if z and max(z) > -30 and 1 / (1 + exp(-max(z))) >= least:
                out.append((a, b))
        return out


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, max_per_class: int, max_chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels of the sample; usable: which rows of labels may be learned from."""
    rows = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    parts = [rows.where(F.col(label_col) == k).orderBy(F.xxhash64(id_col), id_col).limit(max_per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(plain(id_col).alias("id"), plain(label_col).alias("label"))
    texts = docs.select(plain(id_col).alias("id"), F.coalesce(plain(text_col), F.lit("")).alias("t")).withColumn("mark", F.xxhash64("t"))
    sized = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct("mark", F.length("t").alias("n"))).alias("x")).select("id", "label", "x.mark", "x.n", F.xxhash64("id").alias("at"))
    left, ids = {0: max_chars, 1: max_chars}, []
    for r in sorted(sized.collect(), key=lambda r: (r["at"], r["id"])):  # 2 * max_per_class rows of numbers
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            ids.append((r["id"], r["label"], r["mark"], r["at"]))
    if not ids:
        return [], []
    spark = docs.sparkSession
    keys = spark.createDataFrame(ids, f"id {docs.schema[id_col].dataType.simpleString()}, label int, mark long, at long")
    got = texts.join(F.broadcast(keys), ["id", "mark"]).groupBy("id", "label", "at").agg(F.min("t").alias("t")).collect()
    got = sorted(got, key=lambda r: (r["at"], r["id"]))
    return [r["t"] for r in got], [r["label"] for r in got]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 4000, max_chars: int = 16_000_000) -> Model:
    return train(*labelled(docs, labels, usable, id_col, text_col, label_col, max_per_class, max_chars))


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, score, and the sentences at or over ``least``: their number and code point spans."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # a table of 2**BITS weights

    def start():
        scorer = Scorer(Model(*shared.value))

        def step(ids, texts):
            if ids is None:
                return
            scores = [scorer.score(t) for t in texts]
            spans = [scorer.offending(t, least) if s[1] >= least else [] for t, s in zip(texts, scores, strict=True)]
            yield {"id": ids, "score": [s[0] for s in scores], "n_offending": [len(x) for x in spans], "offending": [",".join(f"{a}:{b}" for a, b in x) for x in spans]}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], f"id {kind}, score double, n_offending long, offending string", start).withColumnRenamed("id", id_col)
