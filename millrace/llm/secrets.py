"""Secret scans: multipart credential linking.

Strong parts (an assigned password or key, an AKIA access id, a long hex run) are always
reported. Weak parts (a named account or client id, an opaque high-entropy string, a service
endpoint) are reported only where a complementary part lies in the same scope: an identifier
next to a secret, an endpoint next to a secret that is strong or itself linked. A scope is a
paragraph (text between blank lines), however long: parts are joined to the interval of the
paragraph that they begin in. A caller may ask for a ``reach`` besides, within which two parts'
intervals must lie; none is set by default. The meeting is an interval join by sorted starts and
running maxima of ends, in O(k log k) for k parts and inside one row: no shuffle, no pairs are made.

Null text counts as empty and has no spans; a null id is kept; repeated rows are each scanned.
Other columns of the input are never read by the scan, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from .common import arrow_map

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 or more
IDENT = re.compile(r"""(?ai:\b(user|username|login|account|client_?id|access_?key_?id|access_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+")
BLANK = re.compile(r"\n[ \t\r]*\n")
#: Order of kinds at equal starts; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
IDS, SECRETS = ("access", "ident"), ("assign", "hex", "opaque")

Span = tuple[int, int, str]


def base_spans(text: str, low: str | None = None) -> list[Span]:
    """The strong parts, by start and then kind."""
    low = text.lower() if low is None else low
    out: list[Span] = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def opaque(s: str, least_bits: float) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= least_bits


def weak_parts(text: str, low: str, strong: list[Span], least_bits: float) -> list[Span]:
    out: list[Span] = []
    if any(k in low for k in ("user", "login", "account", "client", "access")):
        out += [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)]
    if "://" in text:
        out += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    taken = sorted((a, b) for a, b, _ in [*strong, *out])
    starts, most, tops = [a for a, _ in taken], -1, []
    for _, b in taken:
        most = max(most, b)
        tops.append(most)
    for m in OPAQUE.finditer(text):
        i = bisect_left(starts, m.end())  # parts that begin before this one ends
        if not (i and tops[i - 1] > m.start()) and opaque(m[0], least_bits):
            out.append((m.start(), m.end(), "opaque"))
    return out


#: Farther than any text is long.
EVERYWHERE = 1 << 62


class Meeting:
    """Whether any of some intervals comes within reach of another one; without a reach, whether there are any."""

    def __init__(self, parts: list[Span], reach: int | None):
        self.reach, self.starts, self.tops, most = EVERYWHERE if reach is None else reach, [], [], -1
        for a, b, _ in sorted(parts):
            most = max(most, b)
            self.starts.append(a)
            self.tops.append(most)

    def near(self, s: Span) -> bool:
        i = bisect_left(self.starts, s[1] + self.reach)
        return bool(i) and self.tops[i - 1] > s[0] - self.reach


def linked(parts: list[Span], reach: int | None) -> list[Span]:
    """The weak parts of one scope that have a complementary part within reach."""
    ids = Meeting([p for p in parts if p[2] in IDS], reach)
    secrets = Meeting([p for p in parts if p[2] in SECRETS], reach)
    kept = [p for p in parts if p[2] == "opaque" and ids.near(p) or p[2] == "ident" and secrets.near(p)]
    sure = Meeting([p for p in parts if p[2] in ("assign", "hex")] + [p for p in kept if p[2] == "opaque"], reach)
    return kept + [p for p in parts if p[2] == "endpoint" and sure.near(p)]


def scan(text: str | None, reach: int | None = None, least_bits: float = 3.5) -> tuple[list[Span], list[Span]]:
    """The strong spans and all spans of a text, each by start and then kind."""
    if not text:
        return [], []
    low = text.lower()
    strong = base_spans(text, low)
    weak = weak_parts(text, low, strong, least_bits)
    if not weak:
        return strong, strong
    breaks = [m.start() for m in BLANK.finditer(text)]
    scopes: dict[int, list[Span]] = {}
    for p in [*strong, *weak]:
        scopes.setdefault(bisect_left(breaks, p[0]), []).append(p)
    extra = [p for parts in scopes.values() for p in linked(parts, reach)]
    return strong, sorted([*strong, *extra], key=lambda s: (s[0], KINDS.index(s[2])))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str, spans: list[Span], by: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCAN = "id {id}, n_assign long, n_access long, n_hex long, n_weak long, base_sha256 string, spans string"


def link_credentials(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None, least_bits: float = 3.5) -> DataFrame:
    """One row per input row: id, counts by kind, digest of the strong spans, all spans."""

    def start():
        def step(ids, texts):
            if ids is None:
                return
            found = [scan(t, reach, least_bits) for t in texts]
            yield {
                "id": ids, "n_weak": [len(x) - len(s) for s, x in found],
                **{f"n_{k}": [sum(p[2] == k for p in s) for s, _ in found] for k in KINDS[:3]},
                "base_sha256": [hashlib.sha256(told(s).encode()).hexdigest() for s, _ in found],
                "spans": [told(x) for _, x in found],
            }

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], SCAN.format(id=kind), start).withColumnRenamed("id", id_col)


def mask_credentials(df: DataFrame, text_col: str = "text", reach: int | None = None, least_bits: float = 3.5, by: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every reported span of the text replaced; null text stays null."""
    names = df.columns

    def start():
        at = names.index(text_col)

        def step(*columns):
            if columns[0] is None:
                return
            out = dict(zip(names, columns, strict=True))
            out[text_col] = [t if not t else mask(t, scan(t, reach, least_bits)[1], by) for t in columns[at]]
            yield out

        return step

    return arrow_map(df, names, df.schema, start)
