"""Fill-in-middle transformation: a constant-memory two-pass streaming matcher.

A text is cut into units (lines by default) by a pattern, matched left to right. The first pass
runs the match iterator to its end and counts units; two ranks, drawn from a hash of the row's id,
say after how many units the prefix and the middle end. The second pass runs a new iterator to both
ranks and notes where they end. No list of units is ever held, so memory is the text and its
output, whatever the number of units.

Rows are mapped where they stand: nothing is shuffled, and a row's form depends on its id and text
alone, so a task that is run again gives the same rows.

Null text is empty; empty texts, and texts that hold a marker, stay as they are (form ``plain``);
a null id is hashed as an empty one; repeated rows each give their row. Where the pattern leaves
gaps between units, a gap belongs to the unit behind it and the end of the text to the suffix. An
empty table gives no rows. Only the id and the text are read, so other columns may have any name;
texts are never cut, and rows go out in batches of ``batch_chars`` characters.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

LINES = r"[^\n]*\n|[^\n]+"
#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")


def draws(name: str, seed: int) -> list[int]:
    """Four numbers of 32 bits from a row's id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def count_units(text: str, unit: re.Pattern) -> int:
    return sum(1 for _ in unit.finditer(text))


def ends_of(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """Where the first and the second rank of units end, 0 for rank 0; first <= second. Matching stops there."""
    at, out = 0, [0, 0]
    for k, m in enumerate(unit.finditer(text), 1):
        if k > second:
            break
        at = m.end()
        if k == first:
            out[0] = at
    out[1] = at
    return out[0], out[1]


def rearranged(text: str, name: str, unit: re.Pattern, seed: int, rate: int, spm_rate: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of a text."""
    n = count_units(text, unit)
    h1, h2, h3, h4 = draws(name, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    a, b = ends_of(text, unit, *sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = markers
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def original(output: str, form: str, markers: tuple[str, str, str]) -> str:
    """The text that an output was made of; no text of these forms holds a marker, so the first of each kind is the marker."""
    if form == "plain":
        return output
    p, s, m = markers
    one, two = (p, s) if form == "psm" else (s, p)
    if not output.startswith(one):
        raise ValueError(f"an output of form {form} begins with {one}")
    head, _, rest = output[len(one) :].partition(two)
    tail, _, middle = rest.partition(m)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def in_batches(rows, columns: tuple[str, ...], chars_at: int, batch_chars: int):
    """Dicts of columns from rows; a batch ends once it holds batch_chars characters of the column chars_at."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[chars_at])
        if chars >= batch_chars:
            yield dict(zip(columns, map(list, zip(*held, strict=True)), strict=True))
            held, chars = [], 0
    if held:
        yield dict(zip(columns, map(list, zip(*held, strict=True)), strict=True))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS, batch_chars: int = 8_000_000) -> DataFrame:
    """id, n_units, form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output, per row.

    rate: how many of a hundred texts are rearranged; spm_rate: how many of those begin with the suffix.
    """
    if len(set(markers)) < 3 or not all(markers) or any(a in b for a in markers for b in markers if a != b) or any(a[0] in b[1:] for a in markers for b in markers):
        raise ValueError("three markers, none within another, whose first characters stand nowhere else in them; so none can begin in a text and end in a marker")
    columns = ("id", "n_units", "form", "prefix_chars", "middle_chars", "output")

    def start():
        pattern = re.compile(unit)

        def step(ids, texts):
            if ids is not None:
                rows = ((i, *rearranged(t or "", "" if i is None else str(i), pattern, seed, rate, spm_rate, markers)) for i, t in zip(ids, texts, strict=True))
                yield from in_batches(rows, columns, -1, batch_chars)

        return step

    kind = df.schema[id_col].dataType.simpleString()
    made = arrow_map(df, [id_col, text_col], f"id {kind}, n_units long, form string, prefix_chars long, middle_chars long, output string", start)
    return made.withColumnRenamed("id", id_col)


def restore(made: DataFrame, markers: tuple[str, str, str] = MARKERS, batch_chars: int = 8_000_000) -> DataFrame:
    """The rows of fill_in_middle with restored, the text rebuilt from output and form alone; other columns stay."""
    names = made.columns
    form, output = names.index("form"), names.index("output")

    def start():
        def step(*values):
            if values[0] is not None:
                rows = ((*r, original(r[output], r[form], markers)) for r in zip(*values, strict=True))
                yield from in_batches(rows, (*names, "restored"), -1, batch_chars)

        return step

    return arrow_map(made, names, T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())]), start)


def with_digests(made: DataFrame) -> DataFrame:
    """restore(made) with the sha256 digests of both texts in place of the texts."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    names = [c for c in made.columns if c != "output"]
    return restore(made).select(*names, digest("output"), digest("restored"))
