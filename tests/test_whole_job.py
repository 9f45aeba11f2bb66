"""Registered queries on small fixtures that a smaller job would get wrong."""

from datetime import datetime

import duckdb
import numpy as np

from millrace import catalog
from millrace.functions import text as X
from millrace.operators import clustering as K
from millrace.operators import spread
from millrace.operators import terms as T


def test_calendar_counts_every_event(spark, tmp_path):
    days = {1: 3, 2: 1, 5: 2}
    rows = [(i + 1, datetime(2024, 1, day, i % 24)) for i, day in enumerate(d for d, n in days.items() for _ in range(n))]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.bucket.day: r.n for r in catalog.QUERIES["daily_calendar_fill"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 1, 3: None, 4: None, 5: 2}


def embeddings(spark, tmp_path, n):
    x = np.random.default_rng(1).normal(size=(n, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_stability_scan_tries_every_k(spark, tmp_path):
    rows = catalog.QUERIES["stability_scan"](spark, embeddings(spark, tmp_path, 60)).collect()
    assert sorted(r.k for r in rows) == list(range(3, 13))
    assert {r.n_pairs for r in rows} == {30 * 29 // 2}


def test_resamples_of_subclusters_and_bootstrap(spark, tmp_path, monkeypatch):
    asked = {}
    monkeypatch.setattr(K, "split_parents", lambda *a, boots=20, **k: asked.update(subclusters=boots))
    monkeypatch.setattr(K, "bootstrap_ci", lambda df, value, boots=1000, **k: asked.update(bootstrap=boots))
    spark.createDataFrame([(1.0,)], "value double").write.parquet(str(tmp_path / "events.parquet"))
    d = embeddings(spark, tmp_path, 60)
    catalog.QUERIES["subclusters"](spark, d)
    catalog.QUERIES["bootstrap_mean"](spark, d)
    assert asked == {"subclusters": 20, "bootstrap": 1000}


def test_fits_are_alike_for_any_partitioning(spark):
    """One path for all sizes: the same labels and figures however rows are dealt; the silhouette by brute force."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.9, (80, 3)) for c in ((0, 0, 0), (3, 3, 3), (0, 4, 0))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    made = [(df.repartition(n), n) for n in (1, 5)]
    labels = [[r.cluster_id for r in K.kmeans(f, "k", "v", 4).orderBy("k").collect()] for f, _ in made]
    assert labels[0] == labels[1] and set(labels[0]) == {0, 1, 2, 3}
    scans = [{r.k: r for r in K.k_scan(f, "k", "v", [3, 4], boots=5).collect()} for f, _ in made]
    for k in (3, 4):
        a, b = scans[0][k], scans[1][k]
        assert np.allclose([a.silhouette, a.davies_bouldin, a.ari_mean, a.ari_std], [b.silhouette, b.davies_bouldin, b.ari_mean, b.ari_std], atol=1e-5) and a.n_pairs == 10
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    own = np.array(labels[0])
    scores = []
    for i, c in enumerate(own):
        inside = far[i, (own == c) & (np.arange(len(x)) != i)].mean()
        other = min(far[i, own == o].mean() for o in set(own.tolist()) - {c})
        scores.append((other - inside) / max(other, inside))
    assert abs(scans[0][4].silhouette - np.mean(scores)) < 1e-4


def test_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 2.0])], "k long, v array<double>")
    assert K.kmeans(df.limit(0), "k", "v", 3).count() == 0
    assert [tuple(r) for r in K.k_scan(df.limit(0), "k", "v", [2]).collect()] == [(2, None, None, None, None, None)]
    got = {r.k: r.cluster_id for r in K.kmeans(df, "k", "v", 5).collect()}  # fewer distinct rows than clusters
    assert got[1] == got[2] != got[3]
    assert K.k_scan(df, "k", "v", [2], boots=2).first().silhouette > 0.5


def test_labels_beyond_the_rows_that_seed(spark, monkeypatch):
    """More rows than first centres are drawn from: the same blobs as with fewer."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.3, (10_100, 2)) for c in ((0, 0), (4, 4))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "k long, v array<double>")
    own = np.array([r.cluster_id for r in K.kmeans(df, "k", "v", 2).orderBy("k").collect()])
    assert len(set(own[:10_100])) == len(set(own[10_100:])) == 1 and own[0] != own[-1]
    few = {r.k: r.cluster_id for r in K.kmeans(df.where("k % 3 = 0"), "k", "v", 2).collect()}
    assert K.ari(own[::3], np.array([few[k] for k in sorted(few)])) == 1


def test_probes_end_words_where_sql_does(spark, tmp_path):
    """A letter with an accent is no word character in the SQL's patterns: 'laentionéeux' holds 'tion' at a word's end."""
    texts = ["laentionéeux xx", "ñwas it", "wasn é", "nation", "nationwide", "ſwas"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["theme_probes"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.ORACLE["theme_probes"]).fetchall()) == [("tion", 2, 2), ("was", 2, 2)]
    assert X.ascii_bounds(r"\\b\w") == r"\\b\w"


def test_a_large_class_meets_its_terms_in_many_parts(spark):
    messages = spark.createDataFrame([(i, "es", f"u{i % 7}", f"casa {i}") for i in range(400)], "k long, label string, user string, text string")
    terms = spark.createDataFrame([("es", 0, "casa", 2.0)], "label string, rank int, term string, weight double")
    joined = T.with_terms(messages, terms, "label", "text")
    assert joined.count() == joined.select("k").distinct().count() == 400 and joined.columns == [*joined.columns[:4], "hits"]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__part") > 2  # dealt by class and part, not by class alone
    assert T.with_terms(messages, terms, "label", "text").where("hits[0].term = 'casa'").count() == 400


def test_a_table_of_one_block_is_scanned_in_few_jobs(spark):
    """Its fits are dealt to tasks that take them through all steps; before, each step was two jobs of as few tasks as the table had partitions."""
    x = np.random.default_rng(7).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").coalesce(1)
    spark.sparkContext.setJobGroup("scan of one block", "")
    assert K.k_scan(df, "k", "v", [4, 6], boots=4).count() == 2
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scan of one block"))
    spark.sparkContext.setJobGroup("others", "")
    assert 0 < jobs <= 15


def test_blocks_that_meet_in_a_shuffle_give_the_same_fits(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(150, 4)) + np.repeat([0, 4, 8], 50)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    made = []
    for size in (1 << 20, 1200):
        monkeypatch.setattr(spread, "BYTES", size)
        made.append(np.array([tuple(r) for r in K.k_scan(df, "k", "v", [3, 4], boots=2).orderBy("k").collect()], dtype=float))
    assert spread.blocks(df, "k", "v").made.getNumPartitions() == 2
    assert np.allclose(*made, atol=1e-5)


def test_parents_are_split_without_a_task_of_their_own(spark):
    """Two blobs of 55 and 40 rows, one of 50, three of 40 and users without a cluster; before, a parent's rows met in one task."""
    rng = np.random.default_rng(9)
    blobs = [(0, 0, 40), (0, 5, 55), (1, 0, 50), (2, 0, 40), (2, 5, 41), (2, 10, 42), (-1, 0, 70)]
    x = [(p, rng.normal(at, 0.2, 3).tolist(), at) for p, at, n in blobs for _ in range(n)]
    df = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(x)], "k long, p int, v array<double>")
    made = K.split_parents(df.repartition(3), "k", "v", "p", boots=4)
    assert made.columns == ["k", "subcluster_id"] and "FlatMapGroups" not in made._jdf.queryExecution().toString()
    right = {(0, 5): 0, (0, 0): 1, (1, 0): 10, (2, 10): 20, (2, 5): 21, (2, 0): 22}
    assert {r.k: r.subcluster_id for r in made.collect()} == {i: right[p, at] for i, (p, _, at) in enumerate(x) if p >= 0}
    assert K.split_parents(df.where("p < 0"), "k", "v", "p").count() == 0


def test_rows_that_seed_a_group_are_found_in_parts(spark, monkeypatch):
    """All rows of a group met in one task's sort before."""
    monkeypatch.setattr(spread, "SEEDS", 5)
    rows = spark.createDataFrame([(i % 3, hash((i, "x")) if i % 2 else -i, [float(i)]) for i in range(400)], "p long, h long, v array<double>")
    got = [(r.p, r.h) for r in spread.least_by_group(rows).collect()]
    every = [(r.p, r.h) for r in rows.collect()]
    assert got == [at for p in range(3) for at in sorted(r for r in every if r[0] == p)[:5]]
    plan = spread.least_by_group(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") >= 2 and "pmod" in plan


def rated(spark, tmp_path):
    """Ratings under ids of each remainder by 3, missing ones among them; users 0, 3, 7 are of cluster 0, 1, 4, 8 of 1, 2 of 2, 6 of none."""
    bought = [(0, 2.0 + i % 3) for i in range(24)] + [(1, 7.0 + i % 4) for i in range(24)] + [(2, 9.0), (6, 3.0), (7, 5.0), (4, None)]
    kinds = [(u, "purchase", v) for u, v in bought] + [(3, "view", 1.0), (8, "view", 8.0), (2, "error", 2.0), (1, "error", 4.0)]
    spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(u, c) for c, us in enumerate(((0, 3, 7), (1, 4, 8), (2,))) for u in us], "vec_id long, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert bought.index((7, 5.0)) % 3 != 0
    return str(tmp_path), bought


def by_sql(d, name, cols):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall()


def test_fallback_is_the_mean_of_every_rating(spark, tmp_path):
    """All that are not missing, whatever their event's id; for a time only ids divisible by 3 were rated, in query and SQL."""
    d, bought = rated(spark, tmp_path)
    df = catalog.QUERIES["priority_fallback"](spark, d)
    got = sorted(tuple(r) for r in df.collect())
    mean = np.mean([v for _, v in bought if v is not None])
    assert [(c, fallback, n) for c, _, fallback, n in got] == [(c, True, 3) for c in (-1, 0, 1, 2)]
    assert np.allclose([r[1] for r in got], mean) and np.allclose(np.array(got, dtype=float), np.array(sorted(by_sql(d, "priority_fallback", df.columns)), dtype=float))


def test_users_without_a_rating_take_their_clusters(spark, tmp_path):
    """The given tables have no such user: here 3 and 8 bought nothing and 4's rating is missing; 7's counts, though its event's id isn't divisible by 3."""
    d, bought = rated(spark, tmp_path)
    df = catalog.QUERIES["agg_priority_matrix"](spark, d)
    got = {r.user_id: tuple(r) for r in df.collect()}
    want = {r[df.columns.index("user_id")]: r for r in by_sql(d, "agg_priority_matrix", df.columns)}
    assert set(got) == set(want) == {0, 1, 2, 3, 4, 7, 8}  # 6 is in no cluster
    assert all(np.allclose(np.array(got[u], dtype=float), np.array(want[u], dtype=float)) for u in want)
    every = np.mean([v for _, v in bought if v is not None])
    own = {c: np.mean([v for u, v in bought if u in us and v is not None]) for c, us in ((0, (0, 7)), (1, (1, 4)))}
    spread_of = np.std([own[0], own[1], every, every])  # clusters 2 and -1 have fewer than 20 ratings
    need = {u: r[df.columns.index("unmet_need")] for u, r in got.items()}
    assert np.isclose(need[4], need[8]) and np.isclose(need[3] - need[7], (5.0 - own[0]) / spread_of / 3)
    assert np.isclose(need[8] - need[3], (own[0] - own[1]) / spread_of / 3)
