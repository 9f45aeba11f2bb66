"""Schema contracts of incoming tables: names, required columns, question columns."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import id_digits


class ContractError(Exception):
    """A table doesn't have what its contract asks for; the message names all of it."""


# --- fixed values: columns of the two exports ----------------------------------------
RENAMES = {
    "responses": {
        "Address": "Name", "Created At": "Timestamp", "QA Messages": "Messages", "QA Summary": "Chat_summary", "consent": "Consent", "nationality": "Nationality",
        "nationality (raw)": "Nationality_other", "city": "City", "time_in_city": "City_duration", "gender": "Gender", "age": "Age", "children": "Minors",
        "destination": "Destination", "Survey Sent": "Survey sent",
    },
    "meal": {"Respondent": "Name", "Recorded At": "Timestamp"},
}
REQUIRED = {"responses": ["Name", "Timestamp", "City", "Age", "Messages", "Chat_summary"], "meal": ["Name", "Timestamp"]}
HEADERS = {"responses": [("address", "created at"), ("name", "timestamp")], "meal": [("respondent", "recorded at"), ("name", "timestamp")]}
HEADER_ROWS = 8


def renamed(df: DataFrame, role: str) -> DataFrame:
    """Canonical names where the old one is there and the new one isn't; doing it twice changes nothing."""
    have = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in RENAMES.get(role, {}).items() if a in have and b not in have})


def require(df: DataFrame, role: str) -> DataFrame:
    missing = [c for c in REQUIRED[role] if c not in df.columns]
    if missing:
        raise ContractError(f"{role}: missing columns {', '.join(missing)}; found {', '.join(df.columns)}")
    return df


def unknown(df: DataFrame, known: list[str]) -> list[str]:
    return sorted(set(df.columns) - set(known))


def with_ids(df: DataFrame, col: str = "Name") -> DataFrame:
    """Rows whose identifier holds a digit."""
    return df.where(F.coalesce(id_digits(F.col(col)), F.lit("")) != "")


def header_row(rows: list[list[str | None]], role: str) -> int:
    """Place of the first of some leading rows that holds every marker of a set."""
    for i, row in enumerate(rows[:HEADER_ROWS]):
        cells = {str(c).strip().lower() for c in row if c is not None}
        if any(set(m) <= cells for m in HEADERS[role]):
            return i
    raise ContractError(f"{role}: no header among the first {HEADER_ROWS} rows")


def question_columns(df: DataFrame, questions: dict[str, str]) -> dict[str, str | None]:
    """Canonical name to column, by a folded piece of the question; of several, the last that has data; each is used once. Warns of questions without a column."""
    from unicodedata import combining, normalize

    plain = lambda s: "".join(c for c in normalize("NFKD", s) if not combining(c)).strip().lower()
    hits = {q: [c for c in df.columns if plain(piece) in plain(c)] for q, piece in questions.items()}
    asked = sorted({c for cs in hits.values() for c in cs})
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in asked]).first().asDict() if asked else {}
    used, out = set(), {}
    for q, cs in hits.items():
        free = [c for c in cs if c not in used]
        best = [c for c in free if filled[c]] or free
        out[q] = best[-1] if best else None
        used.add(out[q])
    if missed := [f"{q} ({questions[q]!r})" for q, c in out.items() if c is None]:
        warnings.warn(f"no column for {', '.join(missed)}: its values will be null", stacklevel=2)
    return out
