"""Worked examples with known answers, and edge cases."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import canon as C
from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import aggregates as A
from millrace.operators import clustering as K
from millrace.operators import spine as S
from millrace.operators import terms as T
from millrace.plans import gold, questions, tables
from millrace.sources import contract, files, preflight
from millrace.streaming import events


def values(spark, rows, col):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_nationality(spark):
    got = values(spark, ["1", "-", "Soy Colombovenezolana", "México mexicana", "Otro", None, "Costa de Marfil"], lambda c: C.nationality(c, ["soy"]))
    assert got == ["Desconocida", "Desconocida", "Desconocida", "Mexico", "Desconocida", "Desconocida", "Costa De Marfil"]


def test_title_case_and_fold(spark):
    assert values(spark, ["d'este o-neil"], X.title_case) == ["D'Este O-Neil"]
    texts = ["  ÁÉÍ ñ  Ü", "ﬁn", "naïve"]
    assert values(spark, texts, X.fold_any) == ["aei n  u", "fin", "naive"]
    assert values(spark, [texts[0], texts[2]], X.fold) == ["aei n  u", "naive"]


def test_kappa_and_association(spark):
    cells = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    row = A.kappa(spark.createDataFrame(cells, "a string, b string"), "a", "b").first()
    assert row.n == 50 and math.isclose(row.kappa, 0.4)
    assert A.kappa(spark.createDataFrame([("y", "y")] * 4 + [("n", "n")], "a string, b string"), "a", "b").first().kappa == 1
    for n, v in (([10, 0, 0, 10], 1.0), ([10, 10, 10, 10], 0.0)):
        rows = [p for p, k in zip([("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")], n, strict=True) for _ in range(k)]
        assert A.association(spark.createDataFrame(rows, "a string, b string"), "a", "b").first().cramers_v == pytest.approx(v, abs=0.06)
    assert A.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-3)


def test_probe_report(spark):
    rows = [("matched", "gap")] * 50 + [("unmatched", "gap")] * 5 + [("unmatched", "not_gap")] * 95
    r = A.probe_report(spark.createDataFrame(rows, "s string, l string"), "s", "l", 1000).first()
    assert r.precision == 1 and r.recall == 0.5 and r.recall_lo < 0.5 < r.recall_hi and r.is_floor and r.passed


def test_latest_row_without_time_wins(spark):
    df = spark.createDataFrame([("u", 1, 5), ("u", None, 2), ("v", 3, 1), ("v", 3, 4)], "k string, t int, id int")
    assert {(r.k, r.id) for r in S.latest_per(df, "k", "t", "id").collect()} == {("u", 2), ("v", 4)}


def test_spine_of_empty_and_null_text(spark):
    rows = [("u", 2, "hola amigo\n12345\n?"), ("u", 1, None), ("u", 3, "call 3001234567 now\n\nok"), ("w", 1, "")]
    df = spark.createDataFrame(rows, "user string, turn int, text string")
    got = [(r.user_id, r.seq, r.n_msgs_user, r.message) for r in S.message_spine(df, "user", ["turn"], "text").orderBy("user_id", "seq").collect()]
    assert got == [("u", 0, 2, "hola amigo"), ("u", 1, 2, "call [redacted] now")]
    assert S.message_spine(df.limit(0), "user", ["turn"], "text").columns == ["user_id", "turn", "seq", "n_msgs_user", "message", "message_id"]


def test_candidates_and_registry(spark):
    rows = [("one", f"m{i}", "palabra rara") for i in range(20)] + [(f"u{i}", f"k{i}", "tema comun de todos") for i in range(20)]
    got = T.candidates(spark.createDataFrame(rows, "u string, k string, t string"), "u", "t", "k", [("X", "procedure", "zzz")], [], 15, 10).collect()
    assert [r.term for r in got] == ["comun", "tema", "tema comun", "todos"]
    assert T.check_registry([("A", "procedure", "a"), ("A", "institution", "b"), ("", "x", "("), ("A", "procedure", "a")])


def test_ctfidf_floor_and_common_word(spark):
    rows = [("a", "alpha common rare")] + [("a", "alpha common")] * 5 + [("b", "beta! common")] * 6
    df = spark.createDataFrame(rows, "l string, t string")
    got = {(r.label, r.term): r.weight for r in T.ctfidf(df, "l", "t", []).collect()}
    assert ("a", "rare") not in got and got["a", "common"] == 0 and got["a", "alpha"] > 0
    assert ("a", "rare") in {(r.label, r.term) for r in T.ctfidf(df, "l", "t", [], min_docs=1).collect()}


def test_emotions(spark):
    p = lambda **k: F.array(*[F.struct(F.lit(e).alias("label"), F.lit(k.get(e, 0.0)).alias("p")) for e in V.EMOTIONS])
    one = spark.createDataFrame([("me da temor, temo todo",)], "t string")
    label = lambda probs: one.select(C.resolve_emotion(probs, F.col("t"))).first()[0]
    assert label(p(others=0.5, sadness=0.4)) == "sadness" and label(p(others=0.5, joy=0.45)) == "fear" and label(p(surprise=0.9, joy=0.1)) == "joy"


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, (60, 3)) for c in ((0, 0, 0), (3, 3, 3), (0, 4, 0))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = [r.cluster_id for r in K.kmeans(df, "k", "v", 3).orderBy("k").collect()]
    assert K.ari(np.array(got), np.repeat([0, 1, 2], 60)) == 1
    assert K.choose_k(K.k_scan(df, "k", "v", [2, 3], boots=4)) == 3
    kids = K.split_parents(df.withColumn("p", F.lit(2)), "k", "v", "p", boots=4)
    assert {r.subcluster_id for r in kids.collect()} == {20, 21, 22}
    assert K.name_by_marker({0: ["bus", "x"], 1: ["bus", "y", "z", "w"]}, [("bus", "Transport")]) == {0: ("Transport", False), 1: ("bus / y / z", True)}


def test_bootstrap_interval(spark):
    r = K.bootstrap_ci(spark.range(500).select((F.col("id") % 7).alias("v")), "v", 300).first()
    assert r.lo < r["mean"] < r.hi and r.hi - r.lo < 0.6


def workbook(path, rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_workbook_to_gold(spark, tmp_path):
    head = ["Address", "Created At", "city", "age", "QA Messages", "QA Summary", "Migrated From v1", "gender"]
    rows = [["banner"], [None, "x"], head, ["573001.0", "2026-07-01T10:00:00Z", "Medellin", "30", "hola amigos\nnecesito ayuda", "s", "v1:1", "Mujer"], ["573002", "2026-07-02T10:00:00Z", "Otra", "x", None, "s", None, None], [None, "2026-07-02", "a", "1", "b", "c", None, None]]
    path = str(tmp_path / "responses.xlsx")
    workbook(path, rows)
    raw = files.read_workbook(spark, path, "responses")
    assert raw.columns == head and raw.count() == 3
    responses = gold.load_responses(raw, "salt", ["soy"])
    assert {(r.instrument_version, r.city_canon) for r in responses.collect()} == {("v1", "Medellín"), ("v2", "Otra")}
    messages = S.message_spine(responses, "user_id", ["ts"], "Messages")
    meal = gold.load_meal(spark.createDataFrame([("573001", "2026-07-03T00:00:00Z", "Muy útil")], "Respondent string, `Recorded At` string, `¿Qué tan útil?` string"), "salt", {"usefulness_rating": "que tan util"})
    labels = messages.select("user_id", F.lit(4).alias("cluster_id")).distinct()
    tables = gold.build(gold.Dataset(responses, messages, meal), labels)
    users = {r.city_canon: r for r in tables["dim_user"].collect()}
    assert (users["Medellín"].cluster_id, users["Medellín"].gender_clean, users["Other"].cluster_id, users["Other"].age_range) == (4, "Woman", -1, "Not specified")
    assert tables["fact_meal"].first().rating_num == 5 and tables["fact_message"].count() == 2
    manifest = files.write_all({k: tables[k] for k in ("dim_city", "fact_meal")}, str(tmp_path / "out"))
    assert {(r.table, r.rows) for r in manifest.collect()} == {("dim_city", 14), ("fact_meal", 1)}
    with pytest.raises(files.PrivacyError):
        files.write_all({"bad": spark.createDataFrame([("call 30012345678",)], "t string")}, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    with pytest.raises(contract.ContractError):
        contract.require(raw.drop("age"), "responses")
    with pytest.raises(ValueError):
        gold.policy("new_column")


def test_all_tables_of_the_star_schema(spark):
    """32 tables from hand-made frames; counts worked out by hand."""
    import datetime as dt

    day = dt.datetime(2026, 7, 6)
    responses = spark.createDataFrame(
        [(f"u{i}", day, "v1" if i % 2 else "v2", "Mujer", 30.0, "Medellín", "Antioquia", "Venezuela", None, None, None, None, float(i), "es", "Si", None, "Completed", "x", 5.0, i) for i in range(8)],
        "user_id string, ts timestamp, instrument_version string, gender_clean string, age_num double, city_canon string, department string, nationality_canon string, away_duration_canon string, away_duration_order int, city_duration_canon string, city_duration_order int, n_questions double, language string, minors string, destination_country string, registration_status string, registration_started string, session_minutes double, record long",
    )
    said = [(f"u{i}", day, k, 2, f"necesito ayuda con el albergue y la comida para mi familia en la ciudad numero {'abc'[i % 3]} de la lista {'xyz'[k]}", f"m{i}{k}") for i in range(6) for k in range(2)]
    messages = spark.createDataFrame(said, "user_id string, ts timestamp, seq int, n_msgs_user int, message string, message_id string")
    meal = spark.createDataFrame([("u1", day, "Útil", None, "Si", "Otro"), ("u9", day, None, None, None, None)], "user_id string, ts timestamp, usefulness_rating string, no_usefulness_reason string, would_recommend string, discovery_channel string")
    labels = spark.createDataFrame([(f"u{i}", i % 2) for i in range(6)], "user_id string, cluster_id int")
    tones = spark.createDataFrame([(m[5], "negative" if m[2] else "positive", "others") for m in said], "message_id string, sentiment string, emotion string")
    turns = spark.createDataFrame([("t1", "u1", day, "k", "albergue?", "no se", True, False), ("t2", "zz", day, "k", "hola", "si", False, False)], gold.TURNS)
    terms = spark.createDataFrame([(c, r, w, 0.5) for c in (0, 1) for r, w in enumerate(["albergue", "comida"])], "cluster_id int, rank int, term string, weight double")
    more = gold.Insight(
        members=spark.createDataFrame([(f"u{i}", (i % 2) * 10 + i % 3, True) for i in range(6)], "user_id string, subcluster_id int, is_split boolean"), terms=terms, subterms=terms.withColumnRenamed("cluster_id", "subcluster_id"),
        points=labels.selectExpr("user_id", "0d x", "1d y"), gold_tone=tones.selectExpr("message_id", "sentiment human", "'negative' model"), gold_emotion=tones.selectExpr("message_id", "emotion human", "'joy' model"),
        registry=[("Shelter", "institution", "albergue")], probes={"food": "comida"}, facts={"k": "2", "checks": "no"},
    )
    tables = gold.build(gold.Dataset(responses, messages, meal, turns), labels, tones, more)
    assert len(tables) == 32
    rows = {k: t.collect() for k, t in tables.items()}
    n = {k: len(v) for k, v in rows.items()}
    assert (n["dim_user"], n["dim_cluster"], n["dim_subcluster"], n["dim_city"], n["fact_message"], n["fact_meal"]) == (8, 3, 7, 14, 12, 2)
    assert (n["agg_registration_funnel"], n["agg_language"], n["fact_message_entities"], n["nlp_entity_candidates"], n["agg_priority_matrix"]) == (16, 8, 12, 0, 6)
    assert n["agg_funnel"] == 8 + 6 + 6 + 6 + 2 and n["nlp_cluster_terms"] == 12 and n["fact_conversation_full"] == 6 and n["fact_message_sample"] == 12
    assert {(r.theme, r.n_messages, r.n_users) for r in rows["nlp_emergent_themes"]} == {("food", 12, 6)}
    assert {r.turn_id: r.has_survey_record for r in rows["fact_bot_turn"]} == {"t1": True, "t2": False} and n["agg_bot_gap_entities"] == 0
    assert all(r.rate_pct is None for r in rows["agg_coverage_gap"]) and n["agg_coverage_gap"] == 4
    assert {r.metric: r.match for r in rows["parity_check"]} == {"users": True, "messages": True, "users_with_text": True, "meal_responses": True, "repeat_askers_pct": True, "cluster_coverage_pct": False, "subcluster_min_users": False, "entity_coverage_pct": True}
    assert all(r.quote != "—" for r in rows["nlp_voices"]) and {r.key for r in rows["meta_run"]} == {"k", "n_tables"}
    bare = gold.build(gold.Dataset(responses, messages.limit(0), meal.limit(0)), labels.limit(0))
    assert bare["fact_bot_turn"].count() == 0 and bare["agg_coverage_gap"].columns == tables["agg_coverage_gap"].columns and bare["agg_priority_matrix"].count() == 0
    with pytest.raises(ValueError):
        gold.pooled(responses, "nationality_canon")
    assert gold.pooled(responses, "language").count() == 4


def test_priority_axes_and_baseline(spark):
    messages = spark.createDataFrame([(c, f"u{c}{u}") for c in range(3) for u in range(4) for _ in range(1 + c * u)], "cluster_id int, user_id string")
    none, two = spark.createDataFrame([], "cluster_id int, rating_num double"), spark.createDataFrame([(0, 5.0), (1, 1.0)], "cluster_id int, rating_num double")
    negative = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.9)], "cluster_id int, pct_negative double")
    assert {r.n_axes for r in tables.priority(messages, none).collect()} == {1} and {r.n_axes for r in tables.priority(messages, two).collect()} == {2}
    full = tables.priority(messages, two, negative)
    assert {(r.n_axes, r.mean_rating, r.rating_is_fallback) for r in full.collect()} == {(3, 3.0, True)}
    per = messages.groupBy("user_id").agg(F.count("*").alias("n"), F.min("cluster_id").alias("cluster_id"))
    repeat = per.join(per.agg(F.percentile("n", F.lit(0.9)).alias("p"))).selectExpr("user_id", "n >= p as is_repeat_asker")
    own = per.join(negative, "cluster_id").selectExpr("user_id", "pct_negative as negative_share")
    users = tables.priority_by_user(messages, full, repeat, spark.createDataFrame([], "user_id string, rating_num double"), own)
    back = {r.cluster_id: r.u for r in users.groupBy("cluster_id").agg(F.avg("unmet_need").alias("u")).collect()}
    assert all(back[r.cluster_id] == pytest.approx(r.unmet_need) for r in full.collect())
    with pytest.raises(ValueError):
        tables.priority_by_user(messages, full.where("cluster_id < 2"), repeat, none.selectExpr("'x' user_id", "rating_num"))


def test_numbers_as_ids_and_rounding(spark):
    ids = spark.createDataFrame([(573154047912.0,), (None,)], "x double").select(X.id_digits(F.col("x")).alias("d")).collect()
    assert [r.d for r in ids] == ["573154047912", None]
    texts = spark.createDataFrame([("573154047912.0",), ("\t573154047912\t",), ("5.73154047912E11",), ("+57 315-404",), ("12.50",)], "x string")
    assert [r.d for r in texts.select(X.id_digits(F.col("x")).alias("d")).collect()] == ["573154047912"] * 3 + ["57315404", "1250"]
    got = spark.createDataFrame([(2.675,), (0.125,), (2.5,), (None,)], "x double").select(X.round_half_even(F.col("x"), 2).alias("r")).collect()
    assert [r.r for r in got] == [round(2.675, 2), round(0.125, 2), 2.5, None]


def test_scrub_and_names(spark):
    cases = {
        "hable con maria ayer": True, "hable con Maria ayer": False, "mi hija tiene 5 años": False, "mi hija xiomara": True, "Soy Andrea": True, "soy venezolana": False,
        "me atendió pedro": True, "la trabajadora social ana": True, "el doctor no vino": False, "Me Llamo X": True, "somos tres": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", X.names_self(F.col("t")).alias("n")).collect()} == cases
    spans = "array<struct<start:int,end:int,text:string>>"
    rows = [("Ana vino con Luis hoy", [(0, 3, "Ana"), (13, 17, "Luis")]), ("Ana Maria vino", [(0, 3, "Ana"), (0, 9, "Ana Maria")]), ("Hola Ana", [(0, 4, "Hola")]), ("Ana vino", [(1, 4, "Ana")]), ("llame al 3001234567", None), ("", None), (None, None), ("vi a pedro", None), ("todo bien", None)]
    got = spark.createDataFrame(rows, f"t string, p {spans}").select(X.scrub(F.col("t"), ["pedro"], F.col("p"), ["hola"]).alias("s")).collect()
    assert [(r.s.text, r.s.changed) for r in got] == [("[nombre] vino con [nombre] hoy", True), (None, False), ("Hola Ana", False), (None, False), (None, False), (None, False), (None, False), (None, False), ("todo bien", False)]


def test_association_p_values(spark):
    cells = lambda a, b, c, d: spark.createDataFrame([("x", "p")] * a + [("x", "q")] * b + [("y", "p")] * c + [("y", "q")] * d, "a string, b string")
    small = A.association_test(cells(10, 2, 1, 2), "a", "b")
    assert small["test"] == "fisher" and small["p"] == pytest.approx((66 * 3 + 12) / 1365)  # by hand: the tables as likely as this one or less
    assert A.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and A.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9) and A.chi2_tail(0, 3) == 1


def test_gold_keys_must_be_known_and_single(spark):
    gold_rows, rows = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "k string, v int")
    assert S.aligned(gold_rows, rows, "k").count() == 2
    for g, r in ((gold_rows.union(gold_rows), rows), (gold_rows, rows.union(rows)), (gold_rows, rows.where("v = 1"))):
        with pytest.raises(ValueError):
            S.aligned(g, r, "k")


def test_bot_log_registry_and_preflight(spark, tmp_path, monkeypatch):
    log = spark.createDataFrame([("2026-07-23T10:00:00.000Z", "whatsapp:+573001112233", "hola", "plain answer"), ("x", "1", "a", "b"), ("2026-08-04T17:51:43.624Z", "whatsapp:+573001112233", "albergue", "no tengo  información")], "a string, b string, c string, d string")
    turns = files.bot_log(log, "salt", "no tengo", "asesor").orderBy("ts").collect()
    assert [t.gap_flag for t in turns] == [False, True] and len({t.user_id for t in turns}) == 1 and not any("57300" in str(t) for t in turns)
    for bad in (log.drop("d"), log.withColumn("a", F.lit("x"))):
        with pytest.raises(contract.ContractError):
            files.bot_log(bad, "salt", "x", "y")
    good, wrong = tmp_path / "r.csv", tmp_path / "w.csv"
    good.write_text("\ufeffentity,kind,pattern,notes\nShelter,institution,albergue,\n", encoding="utf-8")
    wrong.write_text("entity,kind,pattern,notes\nShelter,place,(,\n")
    assert files.read_registry(spark, str(good)) == [("Shelter", "institution", "albergue")]
    with pytest.raises(contract.ContractError):
        files.read_registry(spark, str(wrong))
    assert [preflight.check_registry_file(spark, str(p)).status for p in (good, wrong)] == ["ok", "fail"]
    monkeypatch.delenv("MILL_SALT", raising=False)
    env = tmp_path / ".env"
    env.write_text("# x\nMILL_SALT='s'\n")
    assert preflight.salt("MILL_SALT", str(env)) == "s" and preflight.check_salt("MILL_SALT", str(tmp_path / "no")).status == "fail"
    (tmp_path / "responses").mkdir()
    assert preflight.check_export(str(tmp_path), "responses").status == "fail"
    workbook(str(tmp_path / "responses" / "a.xlsx"), [["b"], ["Address", "Created At", "city", "age", "QA Messages", "QA Summary"], ["1", "2", "3", "4", "5", "6"]])
    (tmp_path / "responses" / "~$a.xlsx").write_text("")
    assert preflight.check_export(str(tmp_path), "responses").status == "ok" and files.require_file(str(tmp_path), "responses").name == "a.xlsx"
    with pytest.raises(files.DatasetError):
        files.require_file(str(tmp_path), "meal")
    (tmp_path / "out" / "old").mkdir(parents=True)
    results = preflight.run([preflight.check_python, lambda: preflight.check_packages(["pyspark", "nosuchpackage"]), preflight.check_device, lambda: preflight.check_disk(str(tmp_path), 0.0), lambda: preflight.check_output(str(tmp_path / "out"), ["new"]), lambda: preflight.check_file("labels", "none")])
    assert [r.status for r in results][:2] == ["ok", "fail"] and [r.status for r in results][3:] == ["ok", "warn", "warn"] and not preflight.passed(results)
    assert "nosuchpackage" in preflight.render(results)


def test_small_reports(spark):
    subs = spark.createDataFrame([(1, True, 40), (2, True, 31), (3, False, 5), (-10, False, None)], "subcluster_id long, is_split boolean, n_users long")
    assert A.least_subcluster(subs).first().least == 31 and A.least_subcluster(subs.where("not is_split")).first().least == 30
    assert A.cluster_coverage(spark.createDataFrame([], "cluster_id int")).first().coverage == 0
    assert T.coverage_warning(3, 10) and not T.coverage_warning(4, 10)
    assert "santa" in X.stop_terms() and "medellin" in X.stop_terms() and "colombia" in X.stop_terms(["zzz"])
    assert K.is_flat([0.1, 0.12]) and not K.is_flat([0.1, 0.3]) and (K.subcluster_id(3, 1), K.subcluster_id(-1, 0)) == (31, -10)
    with pytest.raises(ValueError):
        K.subcluster_id(3, 10)
    quotes = spark.createDataFrame([("a",), ("—",), ("z",)], "quote string")
    assert {r.quote: r.traced for r in questions.traced(quotes, spark.createDataFrame([("a",)], "message string")).collect()} == {"a": True, "—": True, "z": False}


def test_question_matcher_takes_the_filled_column(spark):
    df = spark.createDataFrame([(None, "x"), (None, None)], "`¿Útil? v1` string, `¿Útil? v2` string")
    assert contract.question_columns(df, {"r": "util", "other": "nada"}) == {"r": "¿Útil? v2", "other": None}


def test_stream_weeks(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    weeks = events.weekly_counts(events.read_events(spark, str(tmp_path / "in"), src.schema), ["event_type"])
    q = weeks.writeStream.format("memory").queryName("weeks").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r.bucket, r.event_type, r.n) for r in S.regrain(src, "ts", "week", "event_type").collect()}
    assert {(r.bucket, r.event_type, r.n) for r in spark.table("weeks").collect()} == want
