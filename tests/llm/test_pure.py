"""The operators' own parts against brute force; no Spark."""

import gzip
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import chat, fmindex, jaccard, lattice, packing, quality, secrets, toxicity, urls, warc

rng = random.Random(7)


def test_fm_index_finds_what_a_scan_finds():
    for it in range(120):
        voc = [f"w{i}" for i in range(rng.choice([2, 5, 30]))]
        texts = [" ".join(rng.choice(voc) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))] + [None]
        texts += texts[:3] if it % 3 == 0 else []
        items = [(str(i), " ".join(rng.choice([*voc, f"zz{i}"]) for _ in range(rng.randint(0, 20)))) for i in range(5)] + [("null", None)]
        for i in range(3):
            w = (rng.choice(texts) or "").split()
            if w:
                a = rng.randrange(len(w))
                items.append((f"x{i}", " ".join(w[a : a + rng.randint(1, 20)])))
        got = list(fmindex.search_texts(texts, fmindex.Phrases(items, 13), rng.choice([20, 1000]), rng.choice([1, 3, 8])))
        for text, (n, spans, found) in zip(texts, got, strict=True):
            w, hit, seen = (text or "").split(), set(), set()
            for k, (_, x) in enumerate(items):
                x = (x or "").split()
                size = min(13, len(x))
                for s, p in itertools.product(range(max(1, len(x) - 12) if x else 0), range(len(w) - size + 1)):
                    if w[p : p + size] == x[s : s + size]:
                        hit |= set(range(p, p + size))
                        seen.add(k)
            assert (n, set(found)) == (len(w), seen)
            assert {j for a, b in spans for j in range(a, b)} == hit


def test_words_of_the_benchmark_rule():
    assert fmindex.words_of("Ab-c 9é\x00_x") == [b"ab", b"c", "9é".encode(), b"x"]
    assert fmindex.words_of(None) == []


def test_packing_places_every_id_once():
    for _ in range(60):
        p, docs = packing.Packer(rng.choice([8, 16, 64]), rng.choice([3, 50])), {}
        for i in range(rng.randint(0, 80)):
            docs[i] = np.array([rng.randrange(99) for _ in range(rng.randint(1, 150))], dtype="<u4").tobytes()
            p.add(i, docs[i])
        p.finish()
        by_doc, by_seq = {}, {}
        for d, s, n, c, t, q, o in p.take():
            assert c == crc32(docs[d][4 * s : 4 * (s + n)]) and t == len(docs[d]) // 4
            by_doc.setdefault(d, []).append((s, n))
            by_seq.setdefault(q, []).append((o, n))
        assert by_doc.keys() == docs.keys()
        for pieces, total in [*((by_doc[d], len(b) // 4) for d, b in docs.items()), *((s, None) for s in by_seq.values())]:
            at = 0
            for s, n in sorted(pieces):
                assert s == at
                at += n
            assert at == total if total is not None else at == p.window or at & (at - 1) == 0


def test_packing_takes_the_level_of_least_squares():
    p = packing.Packer(10)
    for fill, n in ((2, 3), (5, 1), (7, 2)):
        for _ in range(n):
            p.keep([("d", 0, b"\0" * 4 * fill, fill)], fill)

    def cost(level, r):
        c = p.counts.copy()
        c[0] = 0
        if level:
            c[level] -= 1
        if level + r < 10:
            c[level + r] += 1
        return (c[:10] ** 2).sum()

    for r in range(1, 10):
        able = [h for h in range(10 - r + 1) if h == 0 or p.counts[h]]
        assert cost(p.level(r), r) == min(cost(h, r) for h in able)


def test_encoder_gives_the_ids_of_the_file():
    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, slow = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), packing.Encoder(path)
    texts = ["a  b", "a\n b", " \n x", "don't we'll a.b, c! 3,4 x|", "", "  ", "<|endoftext|> x", "\x00 a", "é. ñ, 日本. ", "x" * 3000]
    assert fast.encode(texts) == slow.encode(texts)


def brute_spans(text):
    out = []
    for kind, rx, group, least in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rx, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1]))))


def test_base_secrets_match_the_plain_expressions():
    parts = ["password = ", "Token:", "api_key='", "secret", "AKIA", "ABCDEFGHIJ1234567", "deadbeef" * 5, " ", "\n\n", "é", "user=bob ", "ftp://h/x ", "x9Kd83jQpz71LmWq4ZtB ", "paſſword=12345678"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        strong, every = secrets.scan(t)
        assert secrets.told(strong) == brute_spans(t)
        assert set(strong) <= set(every)


def test_weak_parts_need_a_complement_in_scope():
    key = "x9Kd83jQpz71LmWq4ZtB"
    kinds = lambda t: [s[2] for s in secrets.scan(t)[1]]
    assert kinds(f"see {key} there") == []
    assert kinds("user: bob") == []
    assert kinds(f"user: bob and {key}") == ["ident", "opaque"]
    assert kinds(f"user: bob\n\n{key}") == []
    far = f"user: bob {'word ' * 60}{key}"
    assert kinds(far) == ["ident", "opaque"] and [s[2] for s in secrets.scan(far, reach=160)[1]] == []  # the paragraph is the only bound unless a reach is asked for
    assert kinds("https://h.example/x password=hunter2hunter2") == ["endpoint", "assign"]
    assert kinds("https://h.example/x") == []
    assert secrets.mask("a password=hunter2hunter2 b", secrets.scan("a password=hunter2hunter2 b")[1]) == "a [SECRET] b"


def test_shingle_keys_meet_for_every_similar_pair():
    for _ in range(300):
        n = rng.randint(2, 60)
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        keep = [x for x in a.tolist() if rng.random() > 0.12]
        b = np.unique(np.array(keep + [rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 8)))], dtype=np.uint64))
        share = rng.choice([0, 0.3, 0.9, 1])
        heavy = lambda s: np.array([hash((x, 5)) % 1000 < share * 1000 for x in s.tolist()], dtype=bool)  # noqa: B023, E731
        common = len(np.intersect1d(a, b))
        if len(b) > 1 and len(a) > 1 and 100 * common >= 80 * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
            for k in (2, 3):
                assert np.intersect1d(jaccard.index_keys(a, heavy(a), 80, k)[0], jaccard.index_keys(b, heavy(b), 80, k)[0]).size


def test_shingles():
    s = jaccard.Shingler()
    assert len(s.shingles(None)) == len(s.shingles(" \n ")) == 0
    assert len(s.shingles("a b c")) == 1
    assert (s.shingles("A b C d E f") == s.shingles("a b\tc d e\x0bf")).all()
    assert len(s.shingles("a b c d e a b c d e")) == 5
    assert len(s.shingles("x y b c d e")) == 1


def test_lattice_sums_all_segmentations():
    p = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lp = p.log_weights(None)
    assert math.isclose(np.exp(lp).sum(), 1)
    model = lattice.Lattice(p, lp)

    def brute(word):
        if not word:
            return 0.0
        total = -math.inf
        for i in range(1, len(word) + 1):
            ways = []
            if word[:i] in p.text:
                ways.append(lp[p.text[word[:i]]])
            if i == 1:
                ways.append(sum(lp[p.byte[b]] for b in word[0].encode()))
            if ways:
                rest = brute(word[i:])
                total = np.logaddexp(total, np.logaddexp.reduce(ways) + rest)
        return float(total)

    words = [b"the", b"a", "çöx".encode(), b"and.", "日本".encode(), b"nation"]
    got = model.score([*words, lattice.END])
    for w, g in zip(words, got, strict=False):
        assert math.isclose(g, brute("▁" + w.decode()), rel_tol=1e-9)
        assert math.isclose(g, model.one("▁" + w.decode()), rel_tol=1e-9)
    expected = np.zeros(p.n)
    model.score(words, np.array([3.0, 1, 2, 1, 1, 5]), expected)
    assert expected.sum() > 13 and np.isfinite(expected).all()


def test_toxicity_learns_words_from_document_labels():
    clean = [f"w{i}" for i in range(300)]
    docs, y = [], []
    for i in range(600):
        s = [" ".join(rng.choice(clean) for _ in range(6)) for _ in range(rng.randint(1, 6))]
        bad = i % 3 == 0
        if bad:
            s[rng.randrange(len(s))] += f" grubby{rng.choice('abcdef')}"
        docs.append(". ".join(s))
        y.append(int(bad))
    scorer = toxicity.Scorer(toxicity.train(docs[:450], y[:450]))
    scores = [scorer.score(d)[0] for d in docs[450:]]
    assert np.mean([(s >= 0.7) == bool(t) for s, t in zip(scores, y[450:], strict=True)]) > 0.95
    text = "w1 w2 w3. w4 grubbya w5. w6 w7"
    assert [text[a:b].strip() for a, b in scorer.offending(text, 0.5)] == ["w4 grubbya w5"]
    assert scorer.score(None) == scorer.score("") == (0.0, 0.0)
    assert toxicity.Scorer(toxicity.train([], [])).score("any words")[0] < 1e-6


def test_segmentation_is_the_best_split():
    counts = {"news": 50, "paper": 40, "newspaper": 5, "s": 3, "pap": 1}
    total = sum(counts.values())
    for name in ("newspaper", "newspapers", "papernews", "xqz", "a"):
        found = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}

        def worth(parts):
            return sum(math.log10(counts[w] / total) if w in counts else 1 - math.log10(total) - len(w) for w in parts)  # noqa: B023

        ways = [[name[a:b] for a, b in zip([0, *c], [*c, len(name)], strict=True)] for r in range(len(name)) for c in itertools.combinations(range(1, len(name)), r)]
        got = urls.segment(name, found, total, 20)
        assert "".join(got) == name and math.isclose(worth(got), max(map(worth, ways)))


def test_decision_list_finds_the_planted_rule():
    rows = []
    for _ in range(900):
        a, b = rng.random(), rng.random()
        rows.append({"a": a, "b": b, "bad": a > 0.7 and b <= 0.4})
    rules = quality.cover(rows)
    verdicts = [any(quality.covers(r, x) for r in rules) for x in rows]
    assert np.mean([v == x["bad"] for v, x in zip(verdicts, rows, strict=True)]) > 0.95
    assert quality.cover([]) == [] and quality.cover([{"a": 1.0, "bad": False}] * 50) == []


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "x<", "</s>"])
def test_chat_round_trip(role):
    bits = [*chat.CONTROL, "\\", "<", "[", "s>", " ", "\n", "é", "text"]
    for _ in range(200):
        turns = [(rng.choice([role, "user", "assistant"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        out = "".join(chat.render_turn(r, t) for r, t in turns)
        assert [(r, t) for r, t, _, _ in chat.read_turns(out)] == turns
        for _, t in turns:
            assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_digests_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == chat.Digest(1).row()["turns_sha256"]


def test_warc_records_are_linked_and_round_trip():
    page = """<!DOCTYPE html><html><head><title>A &amp; b</title><style>p{x}</style></head><!-- <a href="/no"> --><body>
    <p>One<br>two <b>b</b>old&nbsp;x</p><script>var t="</p>";</script><a class=x href='/c?d=1&amp;e'>link</a><img src=i.png></body></html>"""
    source = warc.response(5, "http://h.org/a/b", page, "2024-01-01T00:00:00Z")
    head, block = warc.parse(source)
    assert warc.get(head, "WARC-Payload-Digest") == warc.digest(page.encode()) and warc.get(head, "WARC-Block-Digest") == warc.digest(block)
    made = {k: warc.parse(warc.write(h, b)) for k, h, b in warc.derive(source)}
    for k, (h, b) in made.items():
        assert warc.get(h, "WARC-Refers-To") == warc.get(head, "WARC-Record-ID") and warc.get(h, "WARC-Target-URI") == "http://h.org/a/b"
        assert warc.get(h, "WARC-Source-Payload-Digest") == warc.get(head, "WARC-Payload-Digest") and warc.get(h, "WARC-Block-Digest") == warc.digest(b)
        assert warc.get(h, "WARC-Record-ID") == warc.record_id(k, warc.get(head, "WARC-Record-ID"))
    assert made["conversion"][1].decode() == "A & b\nOne\ntwo bold x\nlink"
    meta = json.loads(made["metadata"][1])["Envelope"]
    assert meta["WARC-Header-Metadata"] == dict(head) and meta["Declared-Digest-Matches"]
    inner = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert inner["Headers"]["Content-Type"] == "text/html; charset=utf-8" and inner["HTML-Metadata"]["Head"]["Title"] == "A & b"
    assert [x["url"] for x in inner["HTML-Metadata"]["Links"]] == ["http://h.org/c?d=1&e", "http://h.org/a/i.png"]
    for data in (source + source, gzip.compress(source) + gzip.compress(source)):
        assert [warc.parse(x) for x in warc.records(data)] == [(head, block)] * 2
    assert warc.derive(warc.write([("WARC-Type", "request")], b"GET / HTTP/1.1")) == []
    empty = warc.derive(warc.response(None, None, None, "d"))
    assert [len(b) > 0 for _, _, b in empty] == [True, False] and warc.get(empty[0][1], "WARC-Target-URI") is None
    assert warc.uri("http://x/a b\r\nX: y") == "http://x/a%20b%0D%0AX:%20y"


def test_warc_repeats_codings_and_files():
    html = "<p>caf\xe9</p>"
    for coding, body in (("gzip", gzip.compress(html.encode())), ("deflate", zlib.compress(html.encode())), ("br", html.encode()), ("gzip", html.encode())):
        for chunked in (False, True):
            sent = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 5]), body[i : i + 5]) for i in range(0, len(body), 5)) + b"0\r\n\r\n" if chunked else body
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Encoding: {coding}\r\n" + "Transfer-Encoding: chunked\r\n" * chunked
            record = warc.write([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Concurrent-To", "<y>"), ("WARC-Concurrent-To", "<z>")], http.encode() + b"\r\n" + sent)
            (_, _, meta), (_, _, text) = warc.derive(record)
            assert text.decode() == "caf\xe9"
            inner = json.loads(meta)["Envelope"]
            assert inner["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<y>", "<z>"]
            assert inner["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Set-Cookie"] == ["a=1", "b=2"]
    source = warc.response(1, "u", "x" * 100, "d")
    broken = b"WARC/1.1\r\nWARC-Type: x\r\n\r\n" + source
    assert list(warc.records(source + broken)) == [source[:-4], broken]  # from a header without a length on, the rest is one record that says so


@pytest.mark.parametrize("bit", ["<!--", "<script>", "<a ", "<a href='", "<", "<!", "</p", "<a\n" * 3, "<template>", "<title>", '<a "', "&lt;", "< a>"])
def test_hostile_pages_take_linear_time(bit):
    import time

    page = bit * (5_000_000 // len(bit))
    t = time.process_time()
    warc.read_page(page)
    assert time.process_time() - t < 8


def test_pages_as_a_reader_sees_them():
    read = warc.read_page
    assert read("a < b <3 <b>c</b> x<y").text == "a < b <3 c x<y"
    assert read("a<!-- <p>b --><p>c<script>d</script >e<noscript><img src=q>f</noscript>g").text == "a\nc e g"
    assert read("<title>x</title><svg><title>y</title></svg>").title == "x"
    assert read("<noscript><img src=q></noscript><!-- <img src=n> --><a name=x>").links == [("img", "src", "q")]
    assert read("a<!-- b").text == "a" and read("a<script>b").text == "a" and read("").text == ""


def test_long_words_count_like_others(monkeypatch):
    import public_tokenizers

    p = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = [b"abc" * 20, "日本語".encode() * 19, b"x" * 60, b"internationalization" * 3, b"short", b""]
    counts, found = np.array([1.0, 2.0, 3.0, 1.0, 5.0, 4.0]), []
    for most in (48, 100):
        monkeypatch.setattr(lattice, "LONG_WORD", most)
        expected = np.zeros(p.n)
        found.append((lattice.Lattice(p, p.log_weights(None)).score(words, counts, expected), expected))
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1], atol=1e-9)


def test_spanning_links_join_what_similar_pairs_join():
    for _ in range(30):
        base = np.unique(np.random.default_rng(rng.randrange(1 << 30)).integers(0, 1 << 62, 40, dtype=np.uint64))
        rows = []
        for k in range(50):
            s = np.unique(np.r_[rng.sample(base.tolist(), rng.randint(34, 40)), [rng.randrange(1 << 62) for _ in range(rng.randint(0, 4))]].astype(np.uint64))
            rows.append((k + 1, rng.randint(1, 30), s.tobytes()))
        split = rng.randint(1, 49)
        for one in (True, False):
            x = jaccard.Packed.load(jaccard.Packed.of(rows[:split] if not one else rows).dump())
            y = x if one else jaccard.Packed.of(rows[split:])
            links = jaccard.spanning_links(x, y, 80)
            sets, comp = {r[0]: set(np.frombuffer(r[2], np.uint64).tolist()) for r in rows}, {r[0]: r[1] for r in rows}

            def joined(pairs, comp=comp):
                name = {c: c for c in comp.values()}
                for a, b in pairs:
                    u, v = name[comp[a]], name[comp[b]]
                    name = {c: u if n == v else n for c, n in name.items()}
                return {frozenset(c for c in name if name[c] == n) for n in name.values()}

            left, right = (rows, rows) if one else (rows[:split], rows[split:])
            want = [(a[0], b[0]) for a in left for b in right if a[0] != b[0] and 100 * len(sets[a[0]] & sets[b[0]]) >= 80 * len(sets[a[0]] | sets[b[0]])]
            assert joined(links) == joined(want) and len(links) < 50
            assert all(jaccard.similar(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), 80) for a, b in links)


def test_toxicity_score_is_a_noisy_or():
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BITS), -1.0)
    for text in ("You are bad. Truly, badly bad!\nFine words", "", "...", "één woord", "same same. same"):
        chances = []
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            words = set(re.findall(r"\w+", sentence))
            if words:
                z = model.bias + sum(model.weights[zlib.crc32(f.encode()) % (1 << toxicity.BITS)] for w in words for f in {w, *(f"{k}<{w[:k]}" for k in (4, 5) if len(w) > k)})
                chances.append(1 / (1 + math.exp(-z)))
        assert abs(toxicity.Scorer(model).score(text)[0] - (1 - math.prod(1 - p for p in chances))) < 1e-9


def test_word_hashes_by_brute_force():
    """Equal words have one hash wherever they stand, other words others; sets don't depend on the texts around them."""
    texts = ["A b\tc d e f", None, "", " \n", "a b", "é \x85 \xa0x y z w", "a" * 70_000 + " b c d " + "dd " * 30_000 + "Z" * 200_000, "z" * 200_000 + " q b c d e", "a b c d e f", "x" * 64 + " " + "x" * 65, "\ud800 a b c d e"]
    known, named = {}, {}
    for t in filter(None, texts):
        raw = t.encode("utf-8", "surrogatepass").lower()
        got = jaccard.word_hashes(raw)[0].tolist()
        assert len(got) == len(raw.split())
        for w, h in zip(raw.split(), got, strict=True):
            assert known.setdefault(w, h) == h and named.setdefault(h, w) == w
    s = jaccard.Shingler()
    together = list(s.each(texts))
    assert len(together) == len(texts) and all((a == s.shingles(t)).all() for a, t in zip(together, texts, strict=True))
    assert (together[0] == together[8]).all() and len(together[4]) == 1
    rng = random.Random(4)
    for n in (5, 9, 3000):
        words = [rng.choice("abc") * rng.randint(1, 3) for _ in range(n)]
        assert len(s.shingles(" ".join(words))) == len({tuple(words[i : i + 5]) for i in range(n - 4)})
