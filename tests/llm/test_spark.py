"""The operators over Spark frames: odd rows, empty tables, clashing names, and small brute-force versions."""

import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, fmindex, jaccard, lattice, packing, quality, secrets, toxicity, urls, warc

rng = random.Random(3)
WORDS = [f"word{i}" for i in range(400)]
BASE = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 90))) for _ in range(60)]


def texts():
    out = list(BASE)
    for b in BASE[:25]:  # near copies: a few words replaced, or a tail added
        w = b.split()
        for _ in range(rng.randint(1, 3)):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v + [rng.choice(WORDS)] * rng.randint(0, 2)))
    out += [" ".join(f"W{i}" for i in range(40))] * 30 + [" ".join(f"w{i}" for i in range(40 - k % 5)) for k in range(30)]
    return [*out, None, "", " \n ", "one two", "One  TWO", "é" * 3, "long " * 5000]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, cls string, bucket int, n string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2, "y") for i, t in enumerate(texts())]
    rows += [(None, "some text without an id " * 4, None, None, None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_groups(docs, empty):
    rows = [(r.doc_id, sets_of(r.text)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, s) in enumerate(rows):
        if d is not None and s:
            groups.setdefault(root(i), []).append(d)
    want = sorted((str(d), len(s), str(min(groups[root(i)]) if s and root(i) in groups else d)) for i, (d, s) in enumerate(rows))
    for how in ({"rounds": 1}, {"k": 3, "frequent": 2, "bucket_chars": 2000, "rounds": 1}):
        got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.similar_groups(docs, **how).collect())
        assert got == want
    assert jaccard.similar_groups(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    stay = {}
    for i, (d, s) in enumerate(rows):
        stay.setdefault(root(i) if s else ("empty", i), []).append(d)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min(v, key=lambda d: (d is None, d))) for v in stay.values())


def components_of(rows):
    """Brute force: the component of each (id, text), as the sorted places of its rows."""
    sets, parent = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_links_through_null_and_repeated_ids(spark):
    base = [f"v{i}" for i in range(60)]
    a, b, c = " ".join(base), " ".join(base[:55]), " ".join(base[:47])
    rows = [(1, a), (None, b), (3, c), (None, "other words that stand alone here"), (3, "a text of another kind with the id of the third"), (None, b), (1, a), (5, ""), (5, ""), (None, None)]
    assert len(set(components_of(rows[:3]))) == 1 and len(set(components_of([rows[0], rows[2]]))) == 2
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, `odd.name` int").repartition(2)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component)) for r in jaccard.similar_groups(frame).collect())
    of = components_of(rows)
    least = {g: min((i for (i, _), h in zip(rows, of, strict=True) if h == g and i is not None), default=None) for g in of}
    assert got == sorted((str(i), len(sets_of(t)), str(least[g] if sets_of(t) else i)) for (i, t), g in zip(rows, of, strict=True))
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", a), ("None", rows[3][1]), ("3", rows[4][1]), ("5", ""), ("5", ""), ("None", "")])


def test_hot_keys_meet_in_blocks(spark, monkeypatch):
    """A large group of near copies around the threshold: the same groups by blocks of few classes, and few rows of links."""
    base = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 48)
    made = []
    across = jaccard.across_blocks
    monkeypatch.setattr(jaccard, "across_blocks", lambda *a: made.append(across(*a)) or made[-1])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in jaccard.similar_groups(frame, frequent=2).collect()}
    of, least = components_of(rows), {}
    for k, g in enumerate(of):
        least.setdefault(g, k)
    assert got == {k: least[g] for k, g in enumerate(of)}
    made = [m.count() for m in made if m is not None]
    assert made and sum(made) < 20 * len(rows)


def test_secret_rows(docs, empty):
    got = secrets.link_credentials(docs)
    assert got.count() == docs.count() and secrets.link_credentials(empty).count() == 0
    assert got.where("spans is null").count() == 0
    masked = secrets.mask_credentials(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert secrets.mask_credentials(empty).count() == 0


def test_packing_rows(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    one = docs.dropDuplicates(["doc_id"])
    rows = packing.pack(one, path).collect()
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert per.keys() == {r.doc_id for r in one.collect()}
    for pieces in per.values():
        assert sum(p[1] for p in pieces) == pieces[0][2]
    assert packing.pack(empty, path).count() == 0


def windows_of(text, n=13):
    w = fmindex.words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_decontamination(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passages = [" ".join(BASE[i].split()[3:23]) for i in (0, 4, 9)]
    tests = [("a", passages[0]), ("a", passages[0]), (None, passages[1]), ("c", "one two"), ("d", None), ("e", "!"), ("f", passages[2])]
    items = spark.createDataFrame(tests, "item_id string, text string")

    def brute(text):
        w, hit, found = fmindex.words_of(text), set(), []
        for i, t in tests:
            got = False
            for p in windows_of(t):
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        got = True
            if got:
                found.append(str(i))
        return len(w), len(hit), sorted(found)

    want = sorted((str(d), *map(str, brute(t))) for d, t in rows)
    clean = sorted(str(d) for d, t in rows for n, hit, _ in [brute(t)] if not (hit and 20 * hit >= n))
    for block_chars in (2_000_000, 60):
        found = fmindex.with_verdict(fmindex.find_items(docs, items, shard_words=500, block_chars=block_chars)).collect()
        assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(sorted(map(str, r["items"])))) for r in found) == want
        kept = fmindex.drop_contaminated(docs, items, block_chars=block_chars)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == clean
    assert fmindex.find_items(empty, items).count() == 0 and fmindex.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_lattice_scores(docs, empty):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = {}
    for r in rows:
        if not out(r.doc_id):
            for w in lattice.tokens_of(r.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), len(t), sum(w in counts for w in t), round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t), 6)) for r in rows for t in [lattice.tokens_of(r.text)])
    for how in ({}, {"chunk_words": 300, "bucket_words": 50}):
        got = lattice.score_texts(docs, path, held, **how).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 and r.held_out == out(r.doc_id) for r in got)
    assert lattice.score_texts(empty, path, held).count() == 0


def test_toxicity_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score_documents(docs, model)
    assert got.count() == docs.count() and got.where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels, F.lit(True))).count() == 0


def test_quality_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    judged = quality.judge(docs, quality.learn(docs, labels)).collect()
    assert len(judged) == docs.count()
    for r in judged:
        w = (r.text or "").encode().split()
        w3 = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {i + k for i, x in enumerate(w3) if w3.count(x) > 1 for k in range(3)} if len(w) < 3000 else set(range(len(w)))
        s = r[quality.STATS]
        assert (s.n_words, s.n_repeat_words, s.word_chars) == (len(w), len(rep), sum(len(x.decode()) for x in w))
    assert quality.learn(docs, labels.limit(0)) == [] and quality.keep_good(empty, []).count() == 0
    assert quality.keep_good(docs, []).columns == docs.columns
    odd = spark.createDataFrame([("a b c a b c\n\na #\n a #\n",), ("#*$%&|<> é",), ("x y x y x y",)], "text string")
    got = [tuple(r[quality.STATS])[:5] for r in quality.measures(odd).collect()]
    assert got == [(10, 10, 2, 0, 7), (2, 9, 8, 0, 0), (6, 6, 0, 0, 6)]


def test_url_rows(spark):
    rules = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("org", "/fr/", "allow")]
    rows = ["http://A.Example.NET/en/1", "http://a.example.net/de", "http://a.example.net", "x.net/", None, "", "http://b.org/fr/#x", "http://b.org/en?x=/fr/", "a://b://c.net/", "http://goodnews.com/en/7", "http://notnet/", "s://net/"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(rows)] + [(9, rows[9], "t")], "page_id long, url string, host string")
    counts = urls.page_words(spark.createDataFrame([("<p>good</p> news<script>x</script>",), (None,), ("Good",)], "html string"))
    assert {r.word: r.n for r in counts.collect()} == {"good": 2, "news": 1}
    got = {r.page_id: r for r in urls.filter_urls(pages, rules, counts).collect()}
    assert [got[i].rule for i in range(12)] == ["example.net/en/", "net/", None, None, None, None, "org/fr/", None, None, None, None, "net/"]
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/1") and (got[8].host, got[8].path) == ("b:", "//c.net/")
    assert (got[4].host, got[4].path, got[3].host) == ("", "", "") and got[7].path == "/en"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    split = {r.name: r.words for r in urls.split_names(spark.createDataFrame([("goodnews",), ("x",)], "name string"), counts).collect()}
    assert split == {"goodnews": ["good", "news"], "x": ["x"]}
    assert urls.filter_urls(pages.limit(0), rules, counts).count() == 0
    long = spark.createDataFrame([("goodnews" * 40,)], "host string").select(urls.names_in(F.col("host")).alias("n")).first().n
    assert [len(x) for x in long] == [200, 120] and "".join(long) == "goodnews" * 40


def test_url_odds_by_brute_force(spark):
    """Log odds of naive Bayes over what the rules don't test, worked out one url at a time."""
    rules = [urls.Rule("bad.net", "/", "block"), urls.Rule("org", "/ok/", "allow")]
    rows = [f"http://{h}{p}" for h in ("news.bad.net", "farm.bad.net", "news.org", "shop.org", "newsfarm.com", "x.net") for p in ("/ok/a/1", "/spam/22", "/ok/spam", "/b-c/7/")]
    pages = spark.createDataFrame([(i, u, "<p>news farm shop news</p>") for i, u in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.filter_urls(pages, rules, urls.page_words(pages)).collect()}
    counts = {"news": 48, "farm": 24, "shop": 24}

    def tokens(u):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        host, path = re.sub(r"(^|\.)(bad\.net|org)$", "", host), re.sub(r"^/ok/", "/", path)
        words = []
        for name in re.findall("[a-z]+", host):
            words += ["h:" + w for w in urls.segment(name, {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}, 96, 20)]
        return words + ["p:" + x for x in re.findall("[a-z]+|#", re.sub("[0-9]+", "#", path))]

    def given(u):
        return "block" if u.split("/")[2].endswith("bad.net") else "allow" if re.match(r"http://[^/]*\.org/ok/", u) else None

    bags = {"block": [t for u in rows if given(u) == "block" for t in tokens(u)], "allow": [t for u in rows if given(u) == "allow" for t in tokens(u)]}
    v = len(set(bags["block"] + bags["allow"]))
    prior = math.log(sum(given(u) == "block" for u in rows) + 1) - math.log(sum(given(u) == "allow" for u in rows) + 1)
    for i, u in enumerate(rows):
        if given(u):
            assert got[i].verdict == given(u) and got[i].log_odds is None
            continue
        odds = prior + sum(math.log((bags["block"].count(t) + 1) / (len(bags["block"]) + v + 1)) - math.log((bags["allow"].count(t) + 1) / (len(bags["allow"]) + v + 1)) for t in tokens(u))
        assert abs(got[i].log_odds - odds) < 1e-6 and got[i].verdict == ("block" if got[i].log_odds > 0 else "allow"), u


def test_event_folding(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "new"), (1, 0, 5, "edit", None, "hello"), (2, 0, 0, "message", None, None), (None, 0, 0, "message", "user", "x"), (2, 0, 0, "message", None, None)]
    events = spark.createDataFrame(rows, "conv long, msg long, seq long, kind string, role string, text string")
    folded = chat.fold_messages(events)
    assert sorted((str(r.conv), r.msg, r.again, r.role, r.text) for r in folded.collect()) == [("1", 0, 0, "user", "hello"), ("1", 1, 0, "assistant", "new"), ("2", 0, 0, "", ""), ("2", 0, 1, "", ""), ("None", 0, 0, "user", "x")]
    text = {r.conv: r.formatted for r in chat.render(folded).collect()}
    assert text[1] == "<s>[INST] hello [/INST] new </s>"
    assert {r.conv_id: r.n_turns for r in chat.render_digests(folded).collect()} == {1: 2, 2: 2, None: 1}
    assert chat.render_digests(chat.fold_messages(events.limit(0))).count() == 0


def test_streamed_turns_come_back(spark):
    """The log has deltas, edits and regenerations; folding and rendering give the turns that it was made of."""
    bits = [*chat.CONTROL, "\\", "é", "word ", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in (1, 2, None) for t in range(40)]
    rows += [(1, 3, "user", "x"), (1, 3, "user", "x"), (2, 5, "user", None), (2, 5, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    events = chat.events_of(turns)
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    folded = chat.fold_messages(events.repartition(5))
    got = {r.conv_id: r for r in chat.render_digests(folded).collect()}
    text = {r.conv: r.formatted for r in chat.render(folded).collect()}
    for c in (1, 2, None):
        want = [(r, x) for _, r, x in sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)]
        assert [(r, x) for r, x, _, _ in chat.read_turns(text[c])] == want and got[c].n_turns == len(want)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest() and got[c].formatted_chars == len(text[c])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    src = "/root/testdata/sf0.001"
    out = spark.read.parquet(f"{src}/documents.parquet")
    sizes = []
    for name, stage in P.STAGES[:4]:
        out = stage(spark, out, src)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{len(sizes)}")
        out = spark.read.parquet(f"{tmp_path}/{len(sizes)}")
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    done = P.run(spark, src)
    assert {r.doc_id for r in done.select("doc_id").distinct().collect()} == kept
    root = pathlib.Path(done.inputFiles()[0].removeprefix("file:")).parents[1]
    assert [p.name for p in root.iterdir()] == ["4"]  # what the other stages kept is gone


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages over a small table with null and repeated ids, against plain Python; packing gives back the masked texts' ids."""
    import corpus_pipeline as P
    import tokenizers

    words = [rng.choice(WORDS) for _ in range(4000)]
    texts = [" ".join(words[i : i + 80]) for i in range(0, 2400, 80)]
    texts += [texts[0] + " tail", texts[1], "too short", texts[2] + " " + "# & " * 30, texts[3] + ' password="abcdefgh12345"', None, ""]
    rows = [(i if i % 7 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1), (5, texts[9] + " one more", "en", "s", 1)]
    items = [("q", " ".join(words[2 * 80 + 5 : 2 * 80 + 30])), ("r", " ".join(words[10 * 80 : 10 * 80 + 13])), ("n", None)]
    for name, part, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id string, text string"), ("labels", [], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = [(d, t) for d, t, *_ in rows if t and len(t.split()) >= 50]  # no labels: the base rules alone, and no text repeats itself
    groups = {}
    for (d, t), g in zip(kept, components_of(kept), strict=True):
        groups.setdefault(g, []).append((d is None, d, t))
    left = [min(v, key=lambda r: (r[0], r[1] or 0)) for v in groups.values()]
    spans = {p for _, t in items for p in windows_of(t)}
    clean = []
    for _, d, t in left:
        w = fmindex.words_of(t)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in spans for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((d, t))
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = P.run(spark, str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in pieces}) == sorted({str(d) for d, _ in clean})
    want = sorted((str(d), len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t in clean if 'password' not in t)
    got = sorted((str(r.doc_id), r.doc_tokens) for r in pieces if r.start == 0)
    assert [d for d, _ in got] == sorted(str(d) for d, _ in clean)
    assert not [x for x in want if x not in got]


def test_warc_rows(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "<p>x</p>", "r"), (None, None, None, None), (1, "http://a/b", "<p>x</p>", "r"), (2, "", "y" * 10**6, "r")], "page_id long, url string, html string, record string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    assert all(bytes(r.record).startswith(b"WARC/1.1") and r.refers_to for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
