"""Survey values to canonical ones and to display labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import fold, strip, title_case


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, default) if default is not None else found


def not_a_city(c: Column) -> Column:
    """(excluded, reason)."""
    key = fold(c)
    reason = F.when(c.isNull() | key.isin("", "nan"), "missing").when(key.rlike(r"^\d+$"), "numeric token").when(key.isin(V.NOT_A_CITY), "country/region, not a city").otherwise("")
    return F.struct((reason != "").alias("excluded"), reason.alias("reason"))


def city(c: Column) -> Column:
    """Exact name, else the first name that begins the value and is followed by a space, else the other bucket."""
    key = fold(c)
    begun = reduce(lambda w, k: (F if w is None else w).when(key.startswith(k + " "), V.CITY[k]), [k for k in V.CITY if k not in V.CITY_WHOLE_ONLY], None)
    return F.when(not_a_city(c).excluded, V.OTHER_CITY).otherwise(F.coalesce(lookup(V.CITY, key), begun, F.lit(V.OTHER_CITY)))


def written_city(raw: Column, other: Column) -> Column:
    raw, other = strip(F.coalesce(raw, F.lit(""))), strip(F.coalesce(other, F.lit("")))
    return F.when((raw == V.OTHER_CITY) & (other != ""), title_case(other)).otherwise(raw)


def plausible_nationality(c: Column, own_words: list[str]) -> Column:
    t = F.split(fold(c), r"\s+")
    return c.rlike(r"\p{L}") & (F.size(t) <= 3) & ~F.exists(t, lambda w: w.isin(own_words))


def nationality(c: Column, own_words: list[str]) -> Column:
    known = lookup(V.NATIONALITY, fold(c))
    return F.coalesce(known, F.when(F.coalesce(plausible_nationality(c, own_words), F.lit(False)), title_case(strip(c))), F.lit(V.UNKNOWN_NATIONALITY))


def department(city_name: Column) -> Column:
    return lookup(V.DEPARTMENT, city_name)


def on_scale(scale: dict[str, str], c: Column) -> Column:
    """(label, order, display) of an ordered scale; null off it."""
    key = fold(c)
    label = order = None
    for i, v in enumerate(scale):
        hit = key == fold(F.lit(v))
        label, order = (F if label is None else label).when(hit, v), (F if order is None else order).when(hit, i)
    return F.struct(label.alias("label"), order.alias("order"), lookup(scale, label).alias("display"))


def or_no_answer(label: Column, order: Column) -> tuple[Column, Column]:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(V.NO_ANSWER)), F.coalesce(order, F.lit(V.NO_ANSWER_ORDER))


def gender(c: Column) -> Column:
    key = fold(F.coalesce(c, F.lit("")))
    return F.when(key.isin("", "nan", "none"), "").otherwise(lookup(V.GENDER, key, F.lit(V.GENDER_REST)))


def own_or_other(raw: Column, other: Column) -> Column:
    raw, other = strip(F.coalesce(raw, F.lit(""))), strip(F.coalesce(other, F.lit("")))
    return F.when(raw.isin("", "Otro", "Otra") & (other != ""), other).otherwise(raw)


def discovery(c: Column) -> Column:
    return F.when(c.isNull(), None).otherwise(lookup(V.DISCOVERY, c, F.when(c.isin(sorted(set(V.DISCOVERY.values()))), c).otherwise("Other")))


def language(c: Column) -> Column:
    return F.coalesce(lookup(V.LANGUAGE, F.lower(strip(c))), F.when(c.isin(sorted(V.LANGUAGE.values())), c), F.lit(V.LANGUAGE_UNKNOWN))


def yes_no(c: Column) -> Column:
    key = fold(F.coalesce(c, F.lit("")))
    return F.when(key.isin("", "nan", "none"), "").otherwise(lookup(V.YES_NO, key, strip(c)))


def age_band(age: Column) -> Column:
    out = None
    for lo, hi, band in zip(V.AGE_EDGES, V.AGE_EDGES[1:], V.AGE_BANDS, strict=False):
        out = (F if out is None else out).when((age >= lo) & (age < hi), band)
    return out.otherwise(V.AGE_UNKNOWN)


def age_order(band: Column) -> Column:
    return lookup({b: i for i, b in enumerate([*V.AGE_BANDS, V.AGE_UNKNOWN])}, band, F.lit(len(V.AGE_BANDS)))


def age_flag(age: Column) -> Column:
    return F.when(age < 18, "unreliable_sub18").otherwise("ok")


def emotion_display(emotion: Column, sentiment: Column) -> Column:
    by_tone = F.when(sentiment == "negative", "Concern").when(sentiment == "positive", "Satisfaction").otherwise("Neutral")
    return F.when(emotion == "others", by_tone).otherwise(F.initcap(emotion))


def resolve_emotion(probs: Column, text: Column) -> Column:
    """Label of array<struct<label,p>>: distrusted ones dropped, a close trusted runner-up beats others, then markers."""
    ranked = F.sort_array(F.transform(F.filter(probs, lambda x: ~x.label.isin(V.EMOTIONS_DROPPED)), lambda x: F.struct(x.p.alias("p"), x.label.alias("label"))), asc=False)
    top, second = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    close = (top.label == "others") & second.label.isin(V.EMOTIONS_TRUSTED) & (top.p - second.p < V.EMOTION_MARGIN)
    label = F.when(close, second.label).otherwise(top.label)
    low, marked = F.lower(text), None
    for word, emotion in V.EMOTION_MARKERS:
        marked = (F if marked is None else marked).when(F.contains(low, F.lit(word)), emotion)
    return F.when(label == "others", F.coalesce(marked, label)).otherwise(label)


def session_minutes(start: Column, last: Column) -> Column:
    """Minutes between, null where negative; last is text and trusted in one ISO form only."""
    ts = F.when(last.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.try_to_timestamp(last))
    m = (F.unix_micros(ts) - F.unix_micros(start.cast("timestamp"))) / F.lit(60e6)
    return F.when(m >= 0, m)
