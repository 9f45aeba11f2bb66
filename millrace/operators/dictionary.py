"""Many patterns against many texts: literals first, patterns on candidates only.

A pattern can match only where one of the literals that it must hold stands. All literals of a
registry form one Aho-Corasick automaton, built once a worker from a registry of a checked size;
a text is read once, by Arrow batches, whatever the number of patterns, and gives the numbers of
the entries whose literals it holds. Only these entries' patterns are then tried, in the JVM.
Patterns without a literal are tried on every text.
"""

from __future__ import annotations

import re
import uuid
from re import _constants as K
from re import _parser as P

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from millrace.workers import importable

#: Automata and the like by broadcast, one at a time in a worker.
HELD: dict[str, object] = {}
OTHER_RULES = re.IGNORECASE | re.VERBOSE


def better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Of two sets of literals the one whose shortest is longer, then the smaller."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def literals_in(parsed) -> set[str] | None:
    """Literals of which every match of the parsed sequence holds one; None if there are none."""
    best, run = None, ""
    for kind, value in [*parsed, (None, None)]:
        if kind is K.LITERAL and value >= 0x20:
            run += chr(value)
            continue
        if run:
            best, run = better(best, {run}), ""
        inner = None
        if kind is K.BRANCH:
            each = [literals_in(p) for p in value[1]]
            inner = set().union(*each) if all(each) else None
        elif kind is K.SUBPATTERN and not value[1] & OTHER_RULES:
            inner = literals_in(value[3])
        elif kind is K.ATOMIC_GROUP:
            inner = literals_in(value)
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = literals_in(value[2])
        best = better(best, inner)
    return best


def needed(pattern: str) -> set[str] | None:
    """Literals of which every match of the pattern holds one, the longest that it offers; None if it has none or is written by other rules."""
    try:
        parsed = P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return None if parsed.state.flags & OTHER_RULES else literals_in(parsed)


def indexed(patterns: list[list[str]]) -> tuple[dict[str, list[int]], list[int]]:
    """(entries by literal, entries that are always tried); an entry is a list of patterns."""
    by: dict[str, list[int]] = {}
    always = []
    for i, ps in enumerate(patterns):
        each = [needed(p) for p in ps]
        if not all(each):
            always.append(i)
            continue
        for word in sorted(set().union(*each)):
            by.setdefault(word, []).append(i)
    return by, always


def automaton(by: dict[str, list[int]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, entries in by.items():
        out.add_word(word, entries)
    out.make_automaton()
    return out


def candidates_of(text: str, found, always: list[int]) -> list[int]:
    """Numbers of the entries that the text can match, in order."""
    hits = set(always)
    if len(found):
        for _, entries in found.iter(text):
            hits.update(entries)
    return sorted(hits)


def candidate_entries(text: Column, df: DataFrame, patterns: list[list[str]]) -> Column:
    """array<int>: numbers of the entries whose literals the text holds; null has none."""
    importable(df.sparkSession)
    shared, name = df.sparkSession.sparkContext.broadcast(indexed(patterns)), uuid.uuid4().hex

    @F.pandas_udf(ArrayType(IntegerType()))
    def entries(s: pd.Series) -> pd.Series:
        from millrace.operators import dictionary as D

        if name not in D.HELD:
            D.HELD.clear()
            D.HELD[name] = D.automaton(shared.value[0])
        return s.map(lambda t: [] if t is None else D.candidates_of(t, D.HELD[name], shared.value[1]))

    return entries(text)


def matched(df: DataFrame, key: str, entries: list[tuple[tuple[str, ...], list[str]]], names: list[str], out: str) -> DataFrame:
    """df with out, an array of structs (names) of the entries with a pattern that the column key matches, in their order.

    entries: values of the names, and patterns by the rules of Java with (?U).
    """
    hits = f"__hits_{out}"
    listed = lambda words: F.split(F.lit("\x00".join(words)), "\x00")  # noqa: E731  one literal, however many words
    patterns = listed(["(?U)" + "|".join(f"(?:{p})" for p in ps) for _, ps in entries])
    values = [listed([v[k] for v, _ in entries]) for k in range(len(names))]
    rows = df.withColumn(hits, candidate_entries(F.col(key), df, [ps for _, ps in entries]))
    some = F.filter(hits, lambda i: F.regexp_like(F.col(key), F.get(patterns, i)))
    return rows.withColumn(out, F.transform(some, lambda i: F.struct(*[F.get(v, i).alias(n) for v, n in zip(values, names, strict=True)]))).drop(hits)
