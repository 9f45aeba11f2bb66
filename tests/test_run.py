"""One call from raw frames to published tables; what is kept is used again."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.plans import run as R

TOPICS = ["albergue refugio techo colchones", "comida mercado hambre alimentos"]


@pytest.fixture(scope="module")
def raw(spark):
    users = range(140)
    responses = [(f"57300{i:04}", f"2026-07-{1 + i % 9:02}T10:00:00Z", "Medellin" if i % 2 else "Cali", "30", f"necesito {TOPICS[i % 2]} para mi familia numero {'abc'[i % 3]}\n{TOPICS[i % 2]} urgente por favor vecinos", "s", "v1:1" if i % 4 == 0 else None, "Mujer", str(i % 7)) for i in users]
    names = "`Address` string, `Created At` string, city string, age string, `QA Messages` string, `QA Summary` string, `Migrated From v1` string, gender string, `Questions per user` string"
    meal = [("573000001", "2026-07-20T00:00:00Z", "Muy útil"), ("573000003", "2026-07-21T00:00:00Z", "Poco útil")]
    log = [("2026-07-20 10:00:00", "573000001", "donde hay albergue", "no tengo esa informacion"), ("2026-07-20 11:00:00", "573000002", "y comida", "hay un comedor cerca"), ("2026-07-20 12:00:00", "573000002", "gracias", "hay un comedor cerca")]
    return spark.createDataFrame(responses, names), spark.createDataFrame(meal, "Respondent string, `Recorded At` string, `¿Qué tan útil?` string"), spark.createDataFrame(log, "a string, b string, c string, d string")


SETTINGS = R.Settings(salt="s", questions={"usefulness_rating": "que tan util"}, gap="no tengo", registry=[("Shelter", "institution", "albergue"), ("Food", "procedure", r"comida|mercado")], probes={"food": "comida"}, markers=[("albergue", "Shelter and roof"), ("hambre", "Food")], ks=(2, 3), boots=4)


def test_one_call_makes_and_publishes_all_tables(spark, raw, tmp_path):
    labels = spark.createDataFrame([("matched", "gap"), ("unmatched", "not_gap"), ("unmatched", "gap")], "stratum string, human_label string")
    told = []
    manifest = {r.table: r.rows for r in R.run(spark, f"{tmp_path}/stages", f"{tmp_path}/out", *raw, SETTINGS, told=lambda *x: told.append(x), gap_labels=labels).collect()}
    assert len(manifest) == 32 and manifest["dim_user"] == 140 and manifest["fact_message"] == 280 and manifest["fact_bot_turn"] == 3 and manifest["nlp_umap"] == 140
    stages = {t[0]: t for t in told if len(t) == 4}
    assert {"responses", "messages", "answers", "turns", "documents", "vectors", "scan", "labels", "terms", "names", "members", "subterms", "points"} == stages.keys() and not any(t[3] for t in stages.values())
    assert {t[0] for t in told if len(t) == 3} == manifest.keys()
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    meta = {r.key: r.value for r in read("meta_run").collect()}
    assert meta["chosen_k"] in ("2", "3") and meta["bot_log_turns"] == "3" and meta["gap_gold_present"] == "True" and meta["coverage_gap_quotable"] == "True"
    clusters = {r.cluster_id: r for r in read("dim_cluster").collect()}
    assert {c.cluster_name for k, c in clusters.items() if k >= 0} >= {"Shelter and roof", "Food"}
    assert read("parity_check").where("not match").count() == 0


def test_stages_are_kept_by_content(spark, raw, tmp_path):
    told, made = [], []

    def make(f, n):
        made.append(n)
        return f.limit(n)

    def chain(frame, n):
        told.clear()
        stages = R.Stages(spark, str(tmp_path), lambda *x: told.append(x))
        first = stages("first", make, stages.raw(frame), n=n)
        stages("second", lambda f: f.select("Address"), first)
        return [t[3] for t in told], [t[2] for t in told]

    assert chain(raw[0], 5) == ([False, False], [5, 5])
    assert chain(raw[0].repartition(3), 5) == ([True, True], [5, 5]) and made == [5]  # the same rows, dealt otherwise
    assert chain(raw[0], 6)[0] == [False, False]  # another setting: what follows is worked out again
    assert chain(raw[0].union(raw[0].limit(1)), 5)[0] == [False, False]
    assert chain(raw[0], 5)[0] == [True, True]
    (next(tmp_path.glob("second-*")) / "_SUCCESS").unlink()
    assert False in chain(raw[0], 5)[0] or False in chain(raw[0], 6)[0] or False in chain(raw[0].union(raw[0].limit(1)), 5)[0]  # a table that wasn't finished is written again


def test_empty_inputs_make_empty_tables(spark, raw, tmp_path):
    tables = R.tables_of(R.Stages(spark, f"{tmp_path}/s"), raw[0].limit(0), raw[1].limit(0), None, SETTINGS)
    assert len(tables) == 32 and tables["fact_message"].count() == 0 and tables["dim_user"].count() == 0 and tables["nlp_voices"].count() == 0
    assert {r.key: r.value for r in tables["meta_run"].collect()}["bot_log_present"] == "False"


def test_misses_are_scaled_by_distinct_replies(spark):
    turns = spark.createDataFrame([("a", True), *[("b", False)] * 50, ("c", False)], "reply_key string, gap_flag boolean")
    labels = spark.createDataFrame([("matched", "gap"), ("unmatched", "gap"), ("unmatched", "not_gap")], "stratum string, human_label string")
    assert R.gap_report(turns, labels).select("recall").first() == A.probe_report(labels, "stratum", "human_label", 2).select("recall").first()
    assert R.gap_report(turns, labels).where(F.col("recall") == 0.5).count() == 1
