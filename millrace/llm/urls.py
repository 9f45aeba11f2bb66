"""URL filters: host word segmentation and multinomial naive Bayes.

Host names are split into words by a unigram Viterbi search over word counts of the visible text
of all pages. The counts are joined to the host names' substrings, so no vocabulary is sent to every task.
Naive Bayes over host words and path tokens (runs of digits become one token) is trained on the
urls that the rules judge and judges the others; the host suffixes and path prefixes that rules
test are left out of the tokens on both sides. Everything is worked out once per distinct host
and path shape; the urls get their verdict by a join that adaptive execution can split.

A null url, or one without ``://``, has an empty host and path and no rule; repeated rows are
judged alike; null ids are kept; a host name of more than 200 letters in a run is split in stretches
of 200; null pages have no words; with no url judged by a rule the method allows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ascii_lower, cut, plain
from .warc import plain_text


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return f"{self.host}{self.path}"

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def judged(rules: list[Rule], host: Column, path: Column, what) -> Column:
    """what(rule) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(str(r))):
        out = (F if out is None else out).when(r.fits(host, path), F.lit(what(r)))
    return out.otherwise(F.lit(None)) if out is not None else F.lit(None).cast("string")


def untested(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path without what rules test: the longest host suffix and path prefix that any rule has.

    The rules' verdicts are the training labels, so those parts would only teach the rules again.
    """
    longest = lambda parts: "|".join(re.escape(p) for p in sorted(set(parts), key=lambda p: (-len(p), p)))
    hosts, paths = longest(r.host for r in rules), longest(r.path for r in rules if r.path != "/")
    return F.regexp_replace(host, rf"(?:^|\.)(?:{hosts})$", "") if hosts else host, F.regexp_replace(path, rf"^(?:{paths})", "/") if paths else path


def segment(name: str, found: dict[tuple[int, int], int], total: int, longest: int) -> list[str]:
    """Best split: words by their share of total, other pieces by a share that falls tenfold a letter."""
    best, back = [0.0] + [float("-inf")] * len(name), [0] * (len(name) + 1)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - longest), j):
            n = found.get((i, j))
            lp = log10(n / total) if n else 1 - log10(max(total, 1)) - (j - i)
            if best[i] + lp > best[j]:
                best[j], back[j] = best[i] + lp, i
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


LETTERS = re.compile(r"[^\W\d_]+")


def page_words(pages: DataFrame, html_col: str = "html", most: int = 200_000) -> DataFrame:
    """(word, n) of lower-case letter runs of the visible text of all pages, summed within a task first."""

    def start():
        held: Counter[str] = Counter()

        def step(htmls):
            if htmls is not None:
                for h in htmls:
                    held.update(LETTERS.findall(plain_text(h or "").lower()))
            if held and (htmls is None or len(held) >= most):
                yield {"word": list(held), "n": list(held.values())}
                held.clear()

        return step

    return arrow_map(pages, [html_col], "word string, n long", start).groupBy("word").agg(F.sum("n").alias("n"))


#: A name of more letters is split in stretches of so many.
LONGEST_NAME = 200


def names_in(host: Column) -> Column:
    """The letter runs of a host name, long ones in stretches."""
    runs = F.regexp_extract_all(host, F.lit(r"(\p{L}+)"), 1)
    return F.flatten(F.transform(runs, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / LONGEST_NAME).cast("int")), lambda i: F.substring(w, i * LONGEST_NAME + 1, F.lit(LONGEST_NAME)))))


def split_names(names: DataFrame, counts: DataFrame, longest: int = 20) -> DataFrame:
    """(name, words) for distinct names: substrings joined with the counts, then Viterbi."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    n = F.length("name")
    spans = names.select("name", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("p", "i")).select("name", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.length("name"), F.col("i") + longest))).alias("j"))
    subs = spans.withColumn("word", F.expr("substring(name, i + 1, j - i)"))
    found = subs.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("i", "j", "n")).alias("found"))
    every = names.join(found, "name", "left")

    def start():
        def step(name, hits):
            if name is not None:
                yield {"name": name, "words": [segment(x, {(h["i"], h["j"]): h["n"] for h in f or ()}, total, longest) for x, f in zip(name, hits, strict=True)]}

        return step

    return arrow_map(every, ["name", "found"], "name string, words array<string>", start)


def filter_urls(pages: DataFrame, rules: list[Rule], counts: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, log_odds (of block; null where a rule decides)."""
    counts = cut(counts)
    host, path = split_url(plain(url_col))
    parsed = pages.select(plain(id_col).alias("id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", judged(rules, F.col("host"), F.col("path"), str)).withColumn("given", judged(rules, F.col("host"), F.col("path"), lambda r: r.verdict))
    name, rest = untested(rules, F.col("host"), F.col("path"))
    parsed = parsed.withColumn("name", name).withColumn("shape", F.regexp_replace(F.lower(rest), "[0-9]+", "#"))
    shapes = cut(parsed.groupBy("host", "name", "shape", "given").agg(F.count("*").alias("pages")))
    hosts = shapes.select("host", "name").distinct()
    names = hosts.select(F.explode(names_in(F.col("name"))).alias("name")).distinct()
    words = hosts.select("host", F.posexplode(names_in(F.col("name"))).alias("at", "name")).join(split_names(names, counts), "name")
    words = words.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x.words)).alias("host_words"))
    in_path = F.regexp_extract_all(F.col("shape"), F.lit(r"(\p{L}+|#)"), 1)
    bag = shapes.join(words, "host", "left").withColumn("tokens", F.concat(F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.transform(in_path, lambda w: F.concat(F.lit("p:"), w))))
    block = F.when(F.col("given") == "block", F.col("pages")).otherwise(0)
    allow = F.when(F.col("given") == "allow", F.col("pages")).otherwise(0)
    token_counts = bag.where(F.col("given").isNotNull()).select(F.explode("tokens").alias("token"), block.alias("b"), allow.alias("a")).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    seen = token_counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    n_b, n_a, v = (x or 0 for x in seen)
    docs = shapes.agg(F.sum(block), F.sum(allow)).first()
    prior = log((docs[0] or 0) + 1) - log((docs[1] or 0) + 1)
    unseen = log(n_a + v + 1) - log(n_b + v + 1)
    weight = F.coalesce(F.log((F.col("b") + 1.0) / (F.col("a") + 1.0)), F.lit(0.0)) + F.lit(unseen)
    open_bag = bag.where(F.col("given").isNull())
    odds = open_bag.select("host", "shape", F.explode("tokens").alias("token")).groupBy("host", "shape", "token").agg(F.count("*").alias("k")).join(token_counts, "token", "left").groupBy("host", "shape").agg(F.sum(weight * F.col("k")).alias("sum"))
    out = parsed.join(odds.withColumn("open", F.lit(True)), ["host", "shape"], "left")
    log_odds = F.when(F.col("given").isNull(), F.round(F.coalesce("sum", F.lit(0.0)) + F.lit(prior), 9))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.when(log_odds > 0, "block").otherwise("allow")).alias("verdict"), log_odds.alias("log_odds"))
