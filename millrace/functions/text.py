"""Scalar text functions as column expressions: all stay in the JVM."""

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from . import values as V


def _latin() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and combining marks, and that letter."""
    src, dst = [], []
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]):
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c:
            src.append(c)
            dst.append(base[0])
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _latin()
COMBINING = r"[\x{0300}-\x{036F}]"


def strip(c: Column) -> Column:
    """White space off both ends, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Accents and case dropped, trimmed. Covers Latin letters; see fold_any for every script."""
    return strip(F.lower(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), COMBINING, "")))


@F.pandas_udf(StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """fold by full compatibility decomposition, letters that become several included."""
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).strip().lower())


def squash(c: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised, also after apostrophes and hyphens."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def id_digits(c: Column) -> Column:
    """Digits of an identifier; a trailing .0 or an exponent, as numbers are printed with, is not part of it."""
    s = strip(c.cast("string"))
    whole = F.when(s.rlike(r"^\d+(\.\d+)?[eE]\+?\d+$"), s.try_cast("double").try_cast("decimal(38,0)").cast("string"))
    return F.regexp_replace(F.coalesce(whole, F.regexp_replace(s, r"\.0+$", "")), r"\D", "")


def pseudonym(c: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), id_digits(c)), 256), 1, 12)


def message_key(user: Column, seq: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x00", user.cast("string"), seq.cast("string"), text)), 1, 16)


def reply_key(c: Column) -> Column:
    return F.substring(F.sha1(F.lower(squash(c))), 1, 16)


def turn_key(user: Column, ts: Column, key: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", user.cast("string"), ts.cast("string"), key)), 1, 16)


def is_noise(c: Column) -> Column:
    t = strip(F.regexp_replace(c, r"\[redacted\]", ""))
    return (F.length(t) < 3) | t.rlike(r"^\d+$") | F.lower(t).isin(V.NOISE)


def redact_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d{7,}", "[redacted]")


PII = r"(?i)whatsapp:|\b\d{7,}\b"


def folded_tokens(c: Column) -> Column:
    """Words of the folded text without punctuation at their edges."""
    words = F.split(fold(c), r"(?U)\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def is_low_content(c: Column, bot_names: list[str] = ()) -> Column:
    """One word at most, nothing but greeting and filler words (the bot's own names too), or nothing but city names."""
    t = folded_tokens(c)
    cities = sorted({w for k in V.CITY for w in k.split()})
    greets = F.forall(t, lambda w: w.isin(V.GREETINGS + V.GREETING_FILL + list(bot_names))) & F.exists(t, lambda w: w.isin(V.GREETINGS))
    return (F.size(t) <= 1) | greets | F.forall(t, lambda w: w.isin(cities))


def term_tokens(c: Column, stop: list[str], longer_than: int = 3) -> Column:
    """Lower-case letter runs, accents kept, of more than so many letters, without stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(stop or [""]))


def contains_term(text: Column, term: Column) -> Column:
    return F.contains(F.lower(text), F.lower(term))


def probe(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, accented letters too; null is no."""
    return F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False))


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with each \b where ASCII word characters begin or end, as in engines whose words are ASCII; \\b stays."""
    return re.sub(r"\\.", lambda m: r"(?-iu:(?<=\w)(?!\w)|(?<!\w)(?=\w))" if m[0] == r"\b" else m[0], pattern, flags=re.S)


def names_self(c: Column, not_names: list[str] = V.NOT_NAMES) -> Column:
    """Phrases by which writers give a name. The first word after 'soy' must not be a known other word;
    after a third person or a relative it must also be in lower case, as capitalised names are a model's job."""
    word = lambda frame, flags: F.regexp_extract(c, f"(?U{flags})" + frame + V.NAME, 1)
    known = lambda w: F.lower(w).isin(not_names or [""])
    after = word(V.NAMING_SELF, "")
    told = reduce(lambda a, b: a | b, [c.rlike("(?iU)" + f) for f in V.NAMING]) | ((after != "") & ~known(after))
    for frame in V.NAMING_OTHERS:
        w = word(frame, "i")
        told = told | ((w != "") & (F.lower(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & ~known(w))
    return F.coalesce(told, F.lit(False))


def holds_name(c: Column, first_names: list[str]) -> Column:
    """Whether any whole word, in any case, is one of the given names."""
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + V.NAME), 1), lambda w: F.lower(w))
    return F.arrays_overlap(words, F.array(*[F.lit(n) for n in first_names])) if first_names else F.lit(False)


def scrub(c: Column, first_names: list[str] = (), people: Column | None = None, openers: list[str] = ()) -> Column:
    """struct<text, changed>; text is null where the message must be dropped.

    Dropped are blank texts, those that give a name by a phrase or hold a known first name, and those
    with personal data left at the end. people: array<struct<start,end,text>> of person spans from a
    model (code points, in order); spans on the opener list stay, the others are replaced by offset;
    spans that overlap or don't fit the text drop it.
    """
    keep = c.isNotNull() & (squash(c) != "") & ~names_self(c) & ~holds_name(c, list(first_names))
    if people is None:
        return F.struct(F.when(keep & ~c.rlike(PII), c).alias("text"), F.lit(False).alias("changed"))
    spans = F.filter(F.coalesce(people, F.array().cast("array<struct<start:int,end:int,text:string>>")), lambda s: ~F.lower(s.text).isin(list(openers) or [""]))
    fits = F.forall(spans, lambda s: F.substring(c, s.start + 1, s.end - s.start) == s.text)
    apart = F.forall(F.transform(spans, lambda s, i: (i == 0) | (s.start >= F.coalesce(F.try_element_at(spans, F.when(i > 0, i).otherwise(1)).end, F.lit(0)))), lambda x: x)
    last = F.coalesce(F.try_element_at(spans, F.lit(-1)).end, F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(c, F.when(i == 0, 0).otherwise(F.try_element_at(spans, F.when(i > 0, i).otherwise(1)).end) + 1, s.start - F.when(i == 0, 0).otherwise(F.try_element_at(spans, F.when(i > 0, i).otherwise(1)).end)), F.lit(V.NAME_PLACE)))
    out = F.concat(F.array_join(parts, ""), F.substring(c, last + 1, F.length(c)))
    ok = keep & fits & apart & ~out.rlike(PII)
    return F.struct(F.when(ok, out).alias("text"), (ok & (F.size(spans) > 0)).alias("changed"))


def is_courtesy(c: Column) -> Column:
    """Nothing but words of courtesy, or no word at all."""
    return F.forall(F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("([a-zñ]+)"), 1), lambda w: w.isin(V.COURTESY))


def round_half_even(c: Column, digits: int) -> Column:
    """Rounds the exact binary value, ties to even, as Python does; for small published tables, by Arrow."""
    return _round(c.cast("double"), F.lit(digits))


@F.pandas_udf(DoubleType())
def _round(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([x if x != x else round(x, int(d)) for x, d in zip(values, digits, strict=True)], dtype="float64")


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stop_terms(ignored: list[str] = (), more: list[str] = ()) -> list[str]:
    """Folded words that are never a candidate term: stop words, places and nationalities, and single words of longer ones."""
    import unicodedata as u

    plain = lambda s: "".join(x for x in u.normalize("NFKD", s) if not u.combining(x)).strip().lower()
    words = {plain(w) for w in [*ignored, *more, *V.STOP, *V.COURTESY, *V.CITY, *V.CITY.values(), *V.NATIONALITY, *V.NATIONALITY.values()]}
    return sorted({p for w in words for p in (w, *w.split())} - {""})
