"""SimHash by anchors, importance resampling and fill-in-middle: brute force, odd rows, empty tables, clashing names."""

import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from millrace.llm import fim, importance, secrets, simhash, warc

rng = random.Random(11)
WORDS = [f"word{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, id long, fp string, anchor int, n string, rank string, score int, output string, form int, mark int"


def near_copies(words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out


def texts():
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 80))) for _ in range(60)]
    out += near_copies([rng.choice(WORDS) for _ in range(150)], 60, 3) + near_copies([rng.choice(WORDS) for _ in range(400)], 80, 6)
    return [*out, *[out[0]] * 5, None, "", " \n ", "one two", "One  TWO", "É é " * 3, "a\n\nb\n", "\n", "x <P> y\nz\n", "long word\n" * 4000]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    return [*out, (None, "some text without an id " * 6), (None, None), out[3], out[3], (4, "another text with the id of the fourth row " * 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", "z", 3, "o", 4, 5) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow_fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_fingerprints_by_brute_force():
    for t in texts()[:80] + texts()[-10:-1]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    many = " ".join(str(k % 70_001) for k in range(simhash.RUN + 5000))
    h = np.array([xxhash.xxh64_intdigest(" ".join(many.split()[i : i + 4]).encode(), 42) for i in range(0)], dtype=np.uint64)
    assert len(h) == 0 and simhash.fingerprint(many) == slow_fingerprint(many)


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_anchors_are_all_code_words_in_reach(reach):
    code = simhash.HammingAnchors(reach)
    words = np.array([rng.getrandbits(31) for _ in range(200)], dtype=np.int64)
    seen = np.zeros(len(words), dtype=bool)
    for at, anchors in code.near(words):
        seen[at] = True
        assert (code.syndromes(anchors.ravel()) == 0).all()
        away = np.bitwise_count(anchors ^ words[at, None])
        assert away.max() <= reach and (away[:, 0] <= 1).all() and (anchors[:, 0] == code.homes(words[at])).all()
        assert all(len(set(a)) == len(a) for a in anchors.tolist())
    assert seen.all()
    assert sum(len(e) for e in code.errors) == sum(math.comb(31, k) for k in range(reach + 1))  # none is missing


def test_points_of_a_cell_are_near():
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        one, two = (simhash.cell_of(np.array([x], dtype=np.uint64).view(np.int64))[0] for x in (a, b))
        if one == two:
            assert (a ^ b).bit_count() <= 4


@pytest.mark.parametrize("most", [simhash.MOST, 6])
def test_simhash_groups(docs, rows, empty, most):
    prints = [slow_fingerprint(t) for _, t in rows]
    of = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), g in zip(rows, of, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(i), f"{p:016x}", str(least.get(g))) for (i, _), p, g in zip(rows, prints, of, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component)) for r in simhash.near_groups(docs, most=most).collect())
    assert got == want
    assert simhash.near_groups(empty, most=most).count() == 0


def test_simhash_keeps_one_of_each(docs, rows, empty):
    of = groups_of([slow_fingerprint(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and simhash.one_of_each(empty).count() == 0
    stay = {}
    for (i, t), g in zip(rows, of, strict=True):
        stay.setdefault(g, []).append((i is None, i or 0, t or ""))
    first = [min(v, key=lambda r: r[:2]) for v in stay.values()]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.dropDuplicates(["doc_id", "text"]).collect())
    assert got == sorted(f[:2] for f in first)


@pytest.mark.parametrize("distance", [1, 4])
def test_links_of_points_around_a_few_centres(spark, distance):
    """Dense clusters, whole and split anchors: the same components as all pairs give."""
    centres = [rng.getrandbits(64) for _ in range(3)]
    points = sorted({c ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(100)})
    of, least = groups_of(points, lambda a, b: (a ^ b).bit_count() <= distance), {}
    signed = [int(np.array([p], dtype=np.uint64).view(np.int64)[0]) for p in points]
    for p, g in zip(signed, of, strict=True):
        least[g] = min(p, least.get(g, p))
    want = {p: least[g] for p, g in zip(signed, of, strict=True)}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    for most in (simhash.MOST, 10):
        links = simhash.near_links(frame, distance, most)
        got = {p: p for p in signed} | {r["cls"]: r.comp for r in simhash.components(links).collect()}
        assert got == want


def test_split_anchors_give_no_pairs(spark):
    """One cluster of many points: links stay in proportion to the points."""
    centre = rng.getrandbits(63)
    points = sorted({centre ^ sum(1 << i for i in rng.sample(range(60), rng.randint(0, 3))) for _ in range(3000)})
    frame = spark.createDataFrame([(p,) for p in points], "fp long").repartition(4)
    links = simhash.near_links(frame, 4, 100)
    assert links.count() < 40 * len(points)
    assert {r.comp for r in simhash.components(links).collect()} == {points[0]}


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def slow_resample(rows, target, percent=10, min_words=20, order=1, buckets=10_000, seed=2024):
    def features(text):
        w = slow_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    have, want = [features(t) for _, t in rows], [b for t in target for b in features(t)]
    s, t = [0] * buckets, [0] * buckets
    for b in itertools.chain(*have):
        s[b] += 1
    for b in want:
        t[b] += 1
    n, m = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), f in zip(rows, have, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(slow_words(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(tuple(map(str, r[:5])) for r in out)


@pytest.mark.parametrize("how", [{}, {"percent": 37, "min_words": 5, "order": 3, "buckets": 65_536, "seed": 5}, {"percent": 100, "min_words": 0, "buckets": 7}])
def test_resampling_by_brute_force(spark, docs, rows, empty, how):
    target = [" ".join(WORDS[:40]) * 3, None, "", "Word1 one-two"]
    aim = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id int, text string, buckets string")
    for chunk in (1_000_000, 50):
        got = sorted(tuple(str(r[c]) for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resample(docs, aim, chunk=chunk, **how).collect())
        assert got == slow_resample(rows, target, **how)
    assert importance.resample(empty, aim, **how).count() == 0
    assert sorted(tuple(str(r[c]) for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resample(docs, aim.limit(0), **how).collect()) == slow_resample(rows, [], **how)


def test_drawn_rows(spark, docs, rows, empty):
    aim = spark.createDataFrame([(" ".join(WORDS[:40]),)], "text string")
    ranks = {(r.doc_id, r.n_features) for r in importance.resample(docs, aim, percent=30).where("rank is not null").collect()}
    kept = importance.drawn_rows(docs, aim, percent=30)
    assert kept.columns == docs.columns and importance.drawn_rows(empty, aim).count() == 0
    assert {(r.doc_id, len(slow_words(r.text))) for r in kept.collect()} == ranks


def test_streams_count_and_gather():
    stream = np.array([3, 1, 3, 3, 9, 1], dtype=np.uint16)
    value, n = importance.runs(stream)
    assert value.tolist() == [1, 3, 9] and n.tolist() == [2, 3, 1]
    assert [x.tolist() for x in importance.runs(stream[:0])] == [[], []]
    gains = np.arange(10, dtype=np.int64) - 5
    assert importance.gathered(gains, stream, np.array([0, 0, 2, 2, 6, 6])).tolist() == [0, -6, 0, -4, 0]


def test_ranks_over_ranges(spark):
    """Ties, repeated rows and fewer rows than ranges."""
    for n in (0, 1, 500):
        rows = [(k % 7 if k % 3 else None, rng.randrange(5)) for k in range(n)]
        frame = importance.cut(spark.createDataFrame(rows, "id long, score long").repartition(3))
        order = [importance.F.col("score").desc(), importance.F.col("id").asc_nulls_last()]
        got = [(r.rank, r.score, r.id) for r in importance.with_rank(frame, order, 10**9).orderBy("rank").collect()]
        want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        assert got == [(k, s, i) for k, (i, s) in enumerate(want, 1)]


def slow_fim(i, text, unit=fim.LINES, rate=100, spm=50, seed=7, marks=fim.MARKERS):
    text = text or ""
    ends = [0, *(m.end() for m in re.finditer(unit, text))]
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(ends) - 1, "plain", None, None, text
    a, b = sorted((ends[h[0] % len(ends)], ends[h[1] % len(ends)]))
    p, s, m = marks
    out = (s + text[b:] + p + text[:a] + m + text[a:b]) if h[3] % 100 < spm else (p + text[:a] + s + text[b:] + m + text[a:b])
    return len(ends) - 1, "spm" if h[3] % 100 < spm else "psm", a, b - a, out


@pytest.mark.parametrize("how", [{}, {"unit": r"\S+", "rate": 60, "spm": 10, "seed": 3}, {"unit": ".", "spm": 100, "marks": ("[pre]", "[suf]", "[mid]")}])
def test_fill_in_middle(docs, rows, empty, how):
    more = {"unit": how.get("unit", fim.LINES), "rate": how.get("rate", 100), "spm_rate": how.get("spm", 50), "seed": how.get("seed", 7), "markers": how.get("marks", fim.MARKERS)}
    made = fim.fill_in_middle(docs, **more, batch_chars=1000)
    got = sorted((str(r.doc_id), r.n_units, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in made.collect())
    assert got == sorted((str(i), n, f, str(a), str(b), o) for i, t in rows for n, f, a, b, o in [slow_fim(i, t, **how)])
    assert sorted((str(r.doc_id), r.restored) for r in fim.restore(made, more["markers"]).collect()) == sorted((str(i), t or "") for i, t in rows)
    assert fim.with_digests(fim.fill_in_middle(empty)).count() == 0


def test_markers_cannot_arise_in_between():
    bits = ["<", ">", "P", "S", "M", "<P", "P>", "\n", "a", "é\n"]
    unit = re.compile(fim.LINES)
    for k in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        _, form, _, _, out = fim.rearranged(text, str(k), unit, 7, 100, 50, fim.MARKERS)
        assert fim.original(out, form, fim.MARKERS) == text and form == slow_fim(k, text)[1]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "c", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(None, markers=bad)


def test_linking_by_brute_force():
    """The interval join of one scope against all pairs of its parts."""
    for _ in range(4000):
        parts = []
        for _ in range(rng.randint(0, 9)):
            a = rng.randrange(400)
            parts.append((a, a + rng.randint(1, 30), rng.choice(secrets.KINDS)))
        for reach in (None, 0, 40):
            near = lambda p, q: reach is None or p[0] < q[1] + reach and q[0] < p[1] + reach  # noqa: B023, E731
            some = lambda p, kinds, among: any(q[2] in kinds and near(p, q) for q in among)  # noqa: B023, E731
            kept = [p for p in parts if p[2] == "opaque" and some(p, secrets.IDS, parts) or p[2] == "ident" and some(p, secrets.SECRETS, parts)]
            sure = [p for p in parts if p[2] in ("assign", "hex")] + [p for p in kept if p[2] == "opaque"]
            want = kept + [p for p in parts if p[2] == "endpoint" and some(p, secrets.KINDS, sure)]
            assert sorted(secrets.linked(parts, reach)) == sorted(want)


def test_credentials_far_apart_in_a_paragraph(spark):
    key, far = "x9Kd83jQpz71LmWq4ZtB", "word " * 5000
    rows = [(1, f"user: bob {far}{key}"), (2, f"user: bob {far}\n \n{key}"), (3, f"see {key}"), (4, None), (4, None)]
    got = {r.doc_id: r.n_weak for r in secrets.link_credentials(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 0}


def http(headers, body):
    return warc.write([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + body)


def test_odd_headers_neither_hang_nor_crash():
    chunked = b"Transfer-Encoding: chunked"
    for size in (b"-6", b"+3", b"0x3", b" 3", b"1_0", b"zz", b"", b"f" * 40, b"3;x=y"):
        (_, _, _), (_, _, text) = warc.derive(http(chunked, size + b"\r\nabc\r\n0\r\n\r\n"))
        assert b"abc" in text
    for charset in (b"idna", b"undefined", b"punycode", b"hex", b"no-such", b"utf-16", b"utf_8_sig", b"mbcs", b"rot13"):
        assert len(warc.derive(http(b"Content-Type: text/html; charset=" + charset, b"<p>abc \xff\xfe</p>"))) == 2
    for coding in (b"gzip", b"deflate", b"zstd"):
        assert len(warc.derive(http(b"Content-Encoding: " + coding, gzip.compress(b"abc")[:-9]))) == 2


def test_malformed_records_are_rows_with_an_error(spark):
    good = warc.response(1, "http://a/b", "<p>x</p>", "2024-01-01T00:00:00Z")
    bad = [b"", b"GET / HTTP/1.1", good[:-20], b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\n", b"WARC/1.1\r\n\r\n"]
    frame = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([good, *bad])] + [(99, None)], "page_id long, record binary")
    rows = warc.derivatives(frame).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(0, "conversion"), (0, "metadata"), *((k, "error") for k in range(1, 7))]
    assert all((r.error is None) == (r.record is not None) for r in rows)


def test_broken_files_give_what_can_be_read(spark, tmp_path):
    good = warc.response(1, "http://a/b", "<p>x</p>", "2024-01-01T00:00:00Z")
    packed = gzip.compress(good)
    files = {"a": packed + packed[: len(packed) // 2], "b": packed + b"\x1f\x8bjunk", "c": good + good[:-30], "d": good + b"junk", "e": b"", "f": packed + b"\0" * 9}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    made = warc.derivatives(warc.read_records(spark, str(tmp_path)).selectExpr("path as page_id", "record")).collect()
    kinds = {}
    for r in made:
        kinds.setdefault(r.page_id[-1], []).append(r.record_type)
    assert {k: sorted(v) for k, v in kinds.items()} == {k: ["conversion", "error", "metadata"] for k in "abcdf"}


def test_mutated_records_never_crash():
    base = [
        warc.response(1, "http://a/b?c=d", "<title>t</title><p>caf\u00e9 <a href='/x'>y</a></p>", "2024-01-01T00:00:00Z"),
        http(b"Transfer-Encoding: chunked\r\nContent-Type: text/html; charset=latin-1", b"5\r\n<p>ab\r\n4\r\nc</p\r\n1\r\n>\r\n0\r\n\r\n"),
        http(b"Content-Encoding: gzip, deflate\r\nContent-Type: text/html; charset=utf-16", gzip.compress(b"<p>x</p>")),
    ]
    bits = [b"\r\n", b"\r\n\r\n", b"-1", b"0", b"ffff", b"charset=", b"idna", b"gzip", b"\x00", b"\xff", b":", b"<", b"<!--", b"&#x110000;", b"http://[", b"WARC/"]
    for k in range(10_000):
        data = bytearray(base[k % 3])
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(data) + 1)
            how = rng.random()
            if how < 0.4:
                data[at : at + 1] = bytes([rng.randrange(256)])
            elif how < 0.7:
                data[at:at] = rng.choice(bits)
            else:
                del data[at : at + rng.randint(1, 40)]
        rows = warc.derived_rows(k, bytes(data))
        assert all((r[1] == "error") == (r[-1] is not None) for r in rows)
        for part in (bytes(data), gzip.compress(bytes(data))[: rng.randint(5, 400)]):
            assert sum(len(r) for r in itertools.islice(warc.records(part), 1000)) < 10_000
