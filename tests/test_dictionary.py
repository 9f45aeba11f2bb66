"""Needed literals and the automaton against trying every pattern."""

import random
import re
import time

import pytest

from millrace.operators import dictionary as D
from millrace.operators import terms as T

rng = random.Random(5)


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", {"abc"}), (r"\bab\s+cde\b", {"cde"}), ("(?:foo|barn)x?", {"foo", "barn"}), ("(?:foo|.)z", {"z"}), ("a?b*", None), (r"\w+", None), ("(ab)+c", {"ab"}), ("(?i)abc", None),
        ("(?i:abc)d", {"d"}), ("[ab]cd[ef]g", {"cd"}), ("x{2,3}", {"x"}), ("(?=abc)d", {"d"}), ("(?!abc)de", {"de"}), ("a|", None), ("(?>abc)", {"abc"}), (r"ab\.c", {"ab.c"}), ("(", None), (r"a\vb", {"a"}),
    ],
)
def test_needed_literals(pattern, want):
    assert D.needed(pattern) == want


def test_every_match_holds_a_needed_literal():
    bits = ["a", "b", "ab", "ca", "(?:a|bc)", "(?:ab|c)?", "[abc]", ".", "c+", "(?:ca)*", "(?:b{1,2}|ac)", r"\b"]
    for _ in range(3000):
        p = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        words, t = D.needed(p), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))
        for m in re.finditer(p, t):
            assert words is None or any(w in m[0] for w in words), (p, t)


def registry_of(n):
    syllables = ["ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru"]
    words = sorted({"".join(rng.choice(syllables) for _ in range(4)) for _ in range(2 * n)})[:n]
    shapes = [r"\b{}\b", "{}", r"\b{}s?\b", r"(?:{}|x{})\w*", r"{}\s+\w+", r"[a-z]*{}", r"\d+"]
    out = [(f"E{k}", "institution" if k % 3 else "procedure", shapes[k % 6].format(w, w)) for k, w in enumerate(words)]
    return words, [*out, ("E0", "procedure", shapes[6]), ("E1", "institution", "zzz|qqq"), ("skip", "ignore", "la")]


@pytest.fixture(scope="module")
def named(spark):
    words, registry = registry_of(2000)
    texts = [" ".join(rng.choice([rng.choice(words), rng.choice(words).upper() + "s", "x" + rng.choice(words), "Él", "7", "la"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, words[5] * 3), (3, texts[3]), (3, texts[3])]
    return registry, spark.createDataFrame(rows, "id long, text string").repartition(3).cache()


def pairs(df):
    return sorted((r.id, r.entity, r.kind) for r in df.collect())


def test_automaton_equals_every_pattern(spark, named, monkeypatch):
    registry, frame = named
    few = registry[:40] + registry[-3:]
    with_automaton = {}
    for part in (few, registry):
        monkeypatch.setattr(T, "INLINE", 0)
        rows, cover = pairs(T.entity_rows(frame, "text", part, "id")), tuple(T.entity_coverage(frame, "text", part).first())
        free = sorted(map(tuple, T.candidates(frame, "id", "text", "id", part, [], 1, 50).collect()))
        with_automaton[len(part)] = rows
        monkeypatch.setattr(T, "INLINE", 10**6)
        if part is few:
            assert rows == pairs(T.entity_rows(frame, "text", part, "id")) and cover == tuple(T.entity_coverage(frame, "text", part).first())
            assert free == sorted(map(tuple, T.candidates(frame, "id", "text", "id", part, [], 1, 50).collect()))
    want = []
    for r in frame.collect():  # all 2,000 by plain Python
        t = (r.text or "").lower().replace("é", "e")
        hit = {(e, k) for e, k, p in registry if k != "ignore" and r.text is not None and re.search(p, t)}
        want += [(r.id, e, k) for e, k in hit]
    assert with_automaton[len(registry)] == sorted(want) and len(want) > 500


def test_time_hardly_grows_with_the_registry(spark, named, monkeypatch):
    registry, frame = named
    monkeypatch.setattr(T, "INLINE", 0)
    many = frame.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).select("id", "text").repartition(4).cache()
    many.count()
    took = {}
    for n in (100, 100, 2000):
        t = time.time()
        T.entity_rows(many, "text", registry[:n], "id").write.format("noop").mode("overwrite").save()
        took[n] = time.time() - t
    assert took[2000] < 5 * took[100] + 2  # twenty times the patterns


def test_empty_registry_and_table(spark, named):
    registry, frame = named
    assert T.entity_rows(frame, "text", [], "id").count() == 0
    assert T.entity_rows(frame.limit(0), "text", registry, "id").count() == 0
