"""WARC: derivative builder.

A response record becomes two linked records: ``metadata`` (a JSON envelope: the record's own
headers, the HTTP status and headers, title, links and digests) and ``conversion`` (the page as
plain text). Both name the response in WARC-Refers-To, keep its WARC-Target-URI and WARC-Date, and
carry a block digest of their own; the response's payload digest stays in the envelope and in
WARC-Source-Payload-Digest. Record ids are made from the response's id and the type, so a task that
runs again makes the same records. Each record is handled on its own: no shuffle.

``responses`` wraps fetched pages as response records, ``parse`` reads record bytes, and
``read_records`` reads files of records, gzipped by record or not. Repeated headers keep all their
values. Chunked, gzip, deflate and zstd bodies are decoded before they are read as text.

Null pages have an empty payload and empty text; a null url gives no WARC-Target-URI; null ids are
kept; repeated rows give equal records; a record that isn't a response yields no derivative; other
columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urljoin

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map

Headers = list[tuple[str, str]]
END = b"\r\n"
#: HTML elements that begin a line, whose content isn't shown, and that link.
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
RAW, UNSEEN = ("script", "style"), ("noscript", "template")
LINKING = frozenset("a area link img script iframe source".split())
NAME = re.compile(r"/?([A-Za-z][^\s/<>]*)")
ADDRESS = re.compile(r"""(?is)\s(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
CLOSE = {n: re.compile(rf"(?i)</{n}(?=[\s/>])") for n in RAW}
CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    h = hashlib.sha1("\x00".join(parts).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h[:16], version=5)}>"


def uri(url: str) -> str:
    """Header values can't hold control characters or spaces."""
    return quote(url, safe="".join(map(chr, range(33, 127))), errors="surrogatepass")


def write(headers: Headers, block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + END + block + END + END


def parse_headers(data: bytes) -> tuple[str, Headers]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # a folded line goes on with the one before
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return first, out


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def length(headers: Headers) -> int | None:
    """Content-Length, if it is one."""
    n = get(headers, "Content-Length")
    return int(n) if n is not None and re.fullmatch("[0-9]{1,18}", n) else None


def parse(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record; a ValueError says why it is none."""
    head, _, rest = data.partition(END + END)
    first, headers = parse_headers(head)
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    n = length(headers)
    if n is None:
        raise ValueError("a WARC record without its length")
    if len(rest) < n:
        raise ValueError(f"a WARC record cut short: {len(rest)} of {n} bytes")
    return headers, rest[:n]


def members(data: bytes, size: int = 1 << 16) -> Iterator[bytes]:
    """The members of a gzipped file, each read once; from one that is broken on, the bytes as they stand."""
    at = 0
    while at < len(data):
        z, out, begin = zlib.decompressobj(31), [], at
        try:
            while at < len(data) and not z.eof:
                out.append(z.decompress(data[at : at + size]))
                at = min(at + size, len(data)) - len(z.unused_data)
        except zlib.error:
            yield data[begin:]
            return
        yield b"".join(out)


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file, gzipped one by one or plain; from a header that can't be read on, the rest is given as one."""
    if data[:2] == b"\x1f\x8b":
        yield from members(data)
        return
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(END + END, at)
        n = length(parse_headers(data[at:end])[1]) if end >= 0 else None
        if n is None:
            yield data[at:]
            return
        yield data[at : end + 4 + n]
        at = end + 4 + n


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, record): the records of files, by their number in the file; a file is a task."""

    def start():
        def step(paths, data):
            for p, d in zip(paths or (), data or (), strict=True):
                for k, r in enumerate(records(d)):
                    yield {"path": [p], "at": [k], "record": [r]}

        return step

    return arrow_map(spark.read.format("binaryFile").load(path), ["path", "content"], "path string, at long, record binary", start)


def response(page_id, url: str | None, page: str | None, date: str) -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + END + END + payload
    d = digest(payload)
    target: Headers = [("WARC-Target-URI", uri(url))] if url is not None else []
    return write([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", d)), ("WARC-Date", date), *target, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", d), ("WARC-Block-Digest", digest(block))], block)


@dataclass
class Page:
    text: str
    title: str | None
    links: list[tuple[str, str, str]]  # element, attribute, address as written


def read_page(page: str) -> Page:
    """Visible text, title and links in one pass over the markup, whose time is linear in the page.

    A tag goes from ``<`` and a letter to the next ``>`` with no ``<`` between; other ``<`` are text.
    A comment, script or style that doesn't end goes on to the end of the page.
    """
    out, found, title, title_at = [], [], None, None
    at, close, hidden, n = 0, -1, None, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if hidden is None:
            out.append(page[at:i])
        if i == n:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            out.append(" ")
            continue
        if close <= i:
            close = page.find(">", i)
            if close < 0:
                close = n
        tag = NAME.match(page, i + 1)
        other = page.startswith(("<!", "<?"), i)
        if close == n or not (tag or other) or 0 <= page.find("<", i + 1, close):
            if hidden is None:
                out.append("<")
            at = i + 1
            continue
        at = close + 1
        if not tag:
            out.append(" ")
            continue
        name, shut = tag[1].lower(), page[i + 1] == "/"
        if hidden is not None:
            hidden = None if shut and name == hidden else hidden
        elif name in UNSEEN and not shut:
            out.append(" ")
            hidden = name
        elif name in BLOCK:
            out.append("\n")
        if not shut and name in LINKING and (m := ADDRESS.search(page, tag.end(), close)):
            found.append((name, m[1].lower(), html.unescape(m[2].strip("\"'").strip())))
        if name == "title" and title is None:
            if shut and title_at is not None:
                title = " ".join(html.unescape(page[title_at:i]).split())
            elif not shut:
                title_at = at
        if name in RAW and not shut:
            end = CLOSE[name].search(page, at)
            at = n if end is None else end.start()
            out.append(" ")
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return Page("\n".join(x for x in lines if x), title, found)


def plain_text(page: str) -> str:
    """Lines of visible text: scripts, styles and comments dropped, block elements broken, entities resolved."""
    return read_page(page).text


def links(page: Page, base: str) -> list[dict]:
    """Links of the page outside comments, resolved against its address."""
    out = []
    for element, attribute, raw in page.links:
        try:
            url = urljoin(base, raw)
        except ValueError:  # not an address; kept as it stands
            url = raw
        out.append({"path": f"{element.upper()}@/{attribute}", "url": url})
    return out


def gathered(headers: Headers) -> dict[str, str | list[str]]:
    """Headers by name; one that is repeated has all its values, in order."""
    out: dict[str, str | list[str]] = {}
    for k, v in headers:
        out[k] = v if k not in out else [*(out[k] if isinstance(out[k], list) else [out[k]]), v]
    return out


CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")


def unchunked(body: bytes) -> bytes:
    """The chunks' content; a ValueError where a size isn't a hexadecimal number or more than what is left."""
    out, at = [], 0
    while True:
        size = CHUNK.match(body, at)
        if not size:
            raise ValueError("no chunk size")
        n, at = int(size[1], 16), size.end()
        if n == 0:
            return b"".join(out)
        if at + n > len(body):
            raise ValueError("a chunk cut short")
        out.append(body[at : at + n])
        at += n + 2


def entity(payload: bytes, headers: Headers) -> bytes:
    """The payload without its transfer and content codings; one that isn't coded as its headers say, or by a coding unknown here, is taken as it stands."""
    if "chunked" in (get(headers, "Transfer-Encoding") or "").lower():
        try:
            payload = unchunked(payload)
        except ValueError:
            pass
    for coding in reversed([c.strip().lower() for c in (get(headers, "Content-Encoding") or "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(31).decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompressobj(15 if payload[:1] == b"\x78" else -15).decompress(payload)
            elif coding == "zstd":
                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
        except (zlib.error, zstandard.ZstdError):
            pass
    return payload


#: Names that decoders have, but that no page is written in.
NO_CHARSET = ("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape")


def derive(data: bytes) -> list[tuple[str, Headers, bytes]]:
    """(type, headers, block) of the metadata and conversion records of a response; none for other records."""
    headers, block = parse(data)
    if (get(headers, "WARC-Type") or "").lower() != "response":
        return []
    http, _, payload = block.partition(END + END)
    status, http_headers = parse_headers(http)
    charset = CHARSET.search(get(http_headers, "Content-Type") or "")
    body = entity(payload, http_headers)
    try:
        markup = body.decode(charset[1] if charset and charset[1].lower() not in NO_CHARSET else "utf-8", "replace")
    except (LookupError, ValueError):  # no name of a charset, or one whose decoder fails whatever it is told
        markup = body.decode("utf-8", "replace")
    page = read_page(markup)
    source, target, date = get(headers, "WARC-Record-ID") or "", get(headers, "WARC-Target-URI"), get(headers, "WARC-Date") or ""
    declared, computed = get(headers, "WARC-Payload-Digest"), digest(payload)
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": gathered(headers), "Payload-Metadata": {
                "Actual-Content-Length": len(block), "HTTP-Response-Metadata": {
                    "Response-Message": status, "Headers": gathered(http_headers), "Entity-Length": len(payload), "Entity-Digest": computed,
                    "HTML-Metadata": {"Head": {"Title": page.title}, "Links": links(page, target or "")},
                },
            },
            "Declared-Digest-Matches": declared is None or declared == computed,
        }
    }
    out = []
    for kind, mime, body in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "surrogatepass")), ("conversion", "text/plain", page.text.encode("utf-8", "surrogatepass"))):
        named: Headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source), ("WARC-Date", date)]
        named += [("WARC-Target-URI", target)] if target is not None else []
        out.append((kind, [*named, ("Content-Type", mime), ("WARC-Source-Payload-Digest", declared or computed), ("WARC-Block-Digest", digest(body))], body))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, record): fetched pages as response records."""

    def start():
        def step(ids, urls, htmls):
            for i in range(0, len(ids or ()), 500):  # records are as large as their pages
                part = slice(i, i + 500)
                yield {"id": ids[part], "record": [response(*x, date) for x in zip(ids[part], urls[part], htmls[part], strict=True)]}

        return step

    return arrow_map(pages, [id_col, url_col, html_col], f"id {pages.schema[id_col].dataType.simpleString()}, record binary", start).withColumnRenamed("id", id_col)


COLUMNS = "id {id}, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, source_digest string, block_digest string, record binary, error string"


def derived_rows(key, data: bytes | None) -> list[tuple]:
    """Rows of COLUMNS of one record."""
    try:
        made = derive(data) if data is not None else []
    except ValueError as e:
        return [(key, "error", *[None] * 8, str(e))]
    return [(key, kind, get(h, "WARC-Record-ID"), get(h, "WARC-Refers-To"), get(h, "WARC-Target-URI"), get(h, "Content-Type"), len(body), get(h, "WARC-Source-Payload-Digest"), get(h, "WARC-Block-Digest"), write(h, body), None) for kind, h, body in made]


def derivatives(source: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Two rows a response: the derivative's headers as columns, and its bytes. A record that can't be read gives one row of type error, which says why; null gives none."""

    def start():
        def step(ids, data):
            for i in range(0, len(ids or ()), 500):
                rows: dict[str, list] = {k: [] for k in ("id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "source_digest", "block_digest", "record", "error")}
                for k, d in zip(ids[i : i + 500], data[i : i + 500], strict=True):
                    for row in derived_rows(k, d):
                        for c, v in zip(rows.values(), row, strict=True):
                            c.append(v)
                yield rows

        return step

    return arrow_map(source, [id_col, record_col], COLUMNS.format(id=source.schema[id_col].dataType.simpleString()), start).withColumnRenamed("id", id_col)
