"""Quality rules: learned decision lists, as Spark column expressions throughout.

``measures`` computes document statistics with built-in functions. ``learn`` grows rules on a
bounded sample of labelled rows (``max_labelled``, the rows whose hashed id is least): sequential
covering adds the threshold test with the largest FOIL gain until a conjunction is pure, prunes
tests from its end on a held-out third, and keeps it if its precision there is high enough.
``verdict`` turns the ordered list into one CASE expression.

A null or empty text has no words and fails the base rules; null ids are kept; repeated rows are
judged alike; of several labels of one id the largest counts, of several texts the one of least
statistics; a table without labels gives an empty list, so the base rules decide alone.
Statistics are put in one struct column of a reserved name, so other columns can have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

STATS = "__millrace_stats"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once: a lambda's variable, where a plain reuse would be evaluated anew."""
    return F.transform(F.array(value), body)[0]


INDEX_BITS = 24


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more.

    The upper bits of a window's hash and its place share a long; sorted longs bring equal windows
    together, in order of place. Neighbours are then compared word by word; if two of equal bits
    differ, or a text has too many words for the place's bits, whole windows are sorted instead.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    low = (1 << INDEX_BITS) - 1

    def window(i: Column) -> Column:
        return F.concat_ws(" ", words[i], words[i + 1], words[i + 2])

    def hit(places: Column) -> Column:
        three = let(F.array_distinct(F.flatten(places)), lambda h: F.size(F.array_distinct(F.flatten(F.array(h, F.transform(h, lambda i: i + 1), F.transform(h, lambda i: i + 2))))))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(three)

    def sorted_windows(s: Column) -> Column:
        twice = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.when(s[k - 1].w == s[k].w, F.array(s[k - 1].i, s[k].i)))
        return let(F.filter(twice, lambda x: x.isNotNull()), hit)

    def sorted_longs(s: Column) -> Column:
        same = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.shiftright(s[k - 1], INDEX_BITS) == F.shiftright(s[k], INDEX_BITS))
        pairs = F.transform(same, lambda k: F.array(s[k - 1].bitwiseAND(F.lit(low)).cast("int"), s[k].bitwiseAND(F.lit(low)).cast("int")))
        return let(pairs, lambda p: F.when(F.forall(p, lambda x: window(x[0]) == window(x[1])), hit(p)).otherwise(whole))

    whole = let(F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("w"), i.alias("i")))), sorted_windows)
    longs = F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    return F.when(n < 4, F.lit(0)).when(n > low, whole).otherwise(let(F.sort_array(longs), sorted_longs))


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the statistics in the struct column STATS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumn(STATS, let(words, lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
    ))))


def features(stats: Column) -> dict[str, Column]:
    """What rules test: ratios, so that thresholds don't depend on length. No words: all 0."""
    n = F.greatest(stats.n_words, F.lit(1)).cast("double")
    return {
        "chars_per_word": stats.word_chars / n,
        "symbols_per_word": stats.n_symbols / n,
        "repeat_share": stats.n_repeat_words / n,
        "distinct_share": stats.n_distinct / n,
        "dup_line_share": stats.n_dup_lines / F.greatest(stats.n_lines, F.lit(1)),
        "n_words": stats.n_words.cast("double"),
    }


def base_failed(stats: Column) -> Column:
    return (stats.n_words < 50) | (100 * stats.n_repeat_words > 50 * stats.n_words)


@dataclass(frozen=True)
class Test:
    feature: str
    over: bool
    threshold: float

    def holds(self, x: dict) -> bool:
        return x[self.feature] > self.threshold if self.over else x[self.feature] <= self.threshold

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > F.lit(self.threshold) if self.over else f[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.over else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def candidates(rows: list[dict], names: list[str], bins: int) -> list[Test]:
    out = []
    for f in names:
        values = sorted({r[f] for r in rows})
        mids = sorted({(a + b) / 2 for i in range(bins) for k in [max(1, min(len(values) - 1, (i + 1) * len(values) // (bins + 1)))] for a, b in [(values[k - 1], values[k])]}) if len(values) > 1 else []
        out += [Test(f, over, m) for m in mids for over in (True, False)]
    return out


def grow(pos: list[dict], neg: list[dict], names: list[str], bins: int, most: int) -> Rule:
    rule: Rule = ()
    while pos and neg and len(rule) < most:
        before = math.log2(len(pos) / (len(pos) + len(neg)))
        best, gain = None, 1e-9
        for t in candidates(pos, names, bins):
            p = sum(map(t.holds, pos))
            if p:
                q = sum(map(t.holds, neg))
                g = p * (math.log2(p / (p + q)) - before)
                if g > gain:
                    best, gain = t, g
        if best is None:
            break
        rule += (best,)
        pos, neg = list(filter(best.holds, pos)), list(filter(best.holds, neg))
    return rule


def covers(rule: Rule, x: dict) -> bool:
    return all(t.holds(x) for t in rule)


def prune(rule: Rule, pos: list[dict], neg: list[dict]) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on held-out rows, its precision and cover there."""
    best = (-2.0, rule, 0.0, 0)
    for k in range(len(rule), 0, -1):
        p, n = sum(covers(rule[:k], x) for x in pos), sum(covers(rule[:k], x) for x in neg)
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / (p + n) if p + n else 0.0, p)
    return best[1:]


def cover(rows: list[dict], bins: int = 24, max_tests: int = 4, max_rules: int = 12, least_precision: float = 0.97, least_cover: int = 5) -> list[Rule]:
    """Sequential covering of the rows with bad = True; every third row prunes. Ordered rules for bad rows."""
    names = [k for k in rows[0] if k != "bad"] if rows else []
    hold = rows[::3]
    rest = [r for i, r in enumerate(rows) if i % 3]
    pos, neg = [r for r in rest if r["bad"]], [r for r in rest if not r["bad"]]
    hold_pos, hold_neg = [r for r in hold if r["bad"]], [r for r in hold if not r["bad"]]
    rules: list[Rule] = []
    while len(pos) >= least_cover and neg and len(rules) < max_rules:
        rule, precision, n = prune(grow(pos, neg, names, bins, max_tests), hold_pos, hold_neg)
        if not rule or precision < least_precision or n < least_cover:
            break
        rules.append(rule)
        pos, neg = ([x for x in part if not covers(rule, x)] for part in (pos, neg))
        hold_pos, hold_neg = ([x for x in part if not covers(rule, x)] for part in (hold_pos, hold_neg))
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> list[dict]:
    """Features of at most max_labelled labelled rows that pass the base rules, by least hash of the id."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    chosen = one.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    picked = measures(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), text_col)
    stats = F.col(STATS)
    rows = picked.select(F.xxhash64(id_col).alias("at"), (F.col(label_col) == 0).alias("bad"), F.struct(base_failed(stats).alias("failed"), *[v.alias(k) for k, v in features(stats).items()]).alias("f"))
    got = rows.groupBy("at", "bad").agg(F.min("f").alias("f")).collect()  # a row an id, however often it is repeated
    return [{"bad": r["bad"], **{k: v for k, v in r["f"].asDict().items() if k != "failed"}} for r in sorted(got, key=lambda r: (r["at"], r["bad"])) if not r["f"]["failed"]]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000, **how) -> list[Rule]:
    return cover(labelled_rows(docs, labels, id_col, text_col, label_col, max_labelled), **how)


def kept(rules: list[Rule], stats: Column) -> Column:
    """The decision list: base rules, then the learned ones in order, then keep."""
    f = features(stats)
    out = F.when(base_failed(stats), False)
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, [t.column(f) for t in rule]), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with STATS, base_failed and kept beside it in that struct's place: columns STATS and __millrace_kept."""
    return measures(docs, text_col).withColumn("__millrace_kept", kept(rules, F.col(STATS)))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that the list keeps, with the columns of docs."""
    return judge(docs, rules, text_col).where("__millrace_kept").drop(STATS, "__millrace_kept")
