"""Publishing all or none, and cohort policies followed through plans."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans import cohorts, gold
from millrace.sources import publish


def names(folder):
    return sorted(p.name for p in Path(folder).glob("*") if not p.name.startswith("."))


def test_all_or_none(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("m1", 1), ("m2", None)], "message_id string, `odd.name` int")
    only_numbers = spark.range(5)
    told = []
    manifest = publish.write_all({"a": good, "b": only_numbers, "c": good.limit(0)}, out, told=lambda *x: told.append(x))
    assert {(r.table, r.rows, r.columns) for r in manifest.collect()} == {("a", 2, "message_id, odd.name"), ("b", 5, "id"), ("c", 0, "message_id, odd.name")}
    assert [(t[0], t[2]) for t in told] == [("a", 2), ("b", 5), ("c", 0)] and names(tmp_path) == ["out"]
    before = {r.table: r.hash for r in manifest.collect()}
    private = spark.createDataFrame([("call 30012345678",)], "`t.x` string")
    for wrong, error in (
        ({"d": private}, publish.PrivacyError),
        ({"a": only_numbers, "d": spark.range(3).selectExpr("assert_true(id < 2) x", "id")}, Exception),
    ):
        with pytest.raises(error):
            publish.write_all({"b": spark.range(9), **wrong}, out)
        assert names(tmp_path) == ["out"] and names(out) == ["_manifest_table", "a", "b", "c"] and spark.read.parquet(f"{out}/b").count() == 5
    again = publish.write_all({"a": good.repartition(2), "b": only_numbers}, out)
    assert {r.table: r.hash for r in again.collect()} == {k: before[k] for k in ("a", "b")}


def test_gates(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("b", 3)], "k string, n int")
    for gate, ok in ((publish.Gate(rows={"n": "n > 0"}), False), (publish.Gate(totals={"sum": "sum(n) = 4"}), True), (publish.Gate(totals={"sum": "sum(n) = 5"}), False), (publish.Gate(unique=("k",)), False), (publish.Gate(unique=("n",)), True)):
        if ok:
            publish.write_all({"t": rows}, str(tmp_path / "x"), gates={"t": gate})
            continue
        with pytest.raises(publish.QualityError):
            publish.write_all({"t": rows}, str(tmp_path / "y"), gates={"t": gate})
    assert names(tmp_path) == ["x"]


def test_a_move_that_fails_is_taken_back(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    publish.write_all({k: spark.range(2) for k in "abc"}, out)
    move = publish.Folders.move

    def fails(self, a, b):
        if b.endswith("out/b"):
            raise OSError("full")
        move(self, a, b)

    monkeypatch.setattr(publish.Folders, "move", fails)
    with pytest.raises(OSError, match="full"):
        publish.write_all({k: spark.range(7) for k in "abc"}, out)
    assert names(tmp_path) == ["out"] and [spark.read.parquet(f"{out}/{k}").count() for k in "abc"] == [2, 2, 2]


def test_csv(spark, tmp_path):
    frame = spark.createDataFrame([("x", 1.5), ('a "b", c', None)], "t string, v double")
    publish.write_all({"t": frame}, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "csv/t"), header=True).count() == 2
    with pytest.raises(ValueError):
        publish.write_all({"t": frame}, str(tmp_path / "z"), fmt="xml")


@pytest.fixture(scope="module")
def users(spark):
    rows = [(f"u{i}", "v1" if i % 2 else "v2", "Venezuela", "short", "es", i) for i in range(6)]
    return cohorts.tagged(spark.createDataFrame(rows, "user_id string, instrument_version string, nationality_canon string, away_duration_canon string, language string, n int"))


def test_pools_are_found_through_plans(spark, users):
    nation = users.withColumnRenamed("nationality_canon", "x").withColumn("y", F.upper("x"))
    assert nation.schema["x"].metadata == {"cohort_policy": "split"}
    wrong = [
        nation.groupBy("y").count(),
        nation.select("y").agg(F.max("y")),
        users.groupBy("nationality_canon").agg(F.sum("n")),
        nation.withColumn("share", F.count("*").over(W.partitionBy("y"))),
        users.groupBy("user_id").agg(F.first("nationality_canon").alias("z")).groupBy("z").count(),
        nation.select("y").union(nation.select("x")).groupBy("y").count(),
        users.select("user_id", F.explode(F.array("nationality_canon")).alias("e")).groupBy("e").count(),
        users.select("n", "nationality_canon").join(spark.range(3), F.col("n") == F.col("id")).groupBy("nationality_canon").count(),
        users.groupBy("language").count(),
        users.where("instrument_version = 'v2'").groupBy("away_duration_canon").count(),
        users.where("instrument_version = 'v1' or n > 2").groupBy("nationality_canon").count(),
    ]
    assert all(cohorts.pools(df) for df in wrong)
    fine = [
        nation.groupBy("instrument_version", "y").count(),
        nation.where("instrument_version = 'v1'").groupBy("y").count(),
        nation.where((F.col("n") > 1) & (F.col("instrument_version") == "v2")).agg(F.count("x")),
        users.groupBy("user_id").agg(F.first("nationality_canon")),
        users.withColumn("k", F.count("*").over(W.partitionBy("user_id"))),
        users.where("instrument_version = 'v2'").groupBy("language").count(),
        cohorts.pooled(users, "language").groupBy("language").count(),
        cohorts.pooled(users, "away_duration_canon").groupBy("away_duration_canon").count(),
        users.agg(F.sum("n")),
        users.select(F.col("n").alias("m")).distinct(),
        nation.select("y", "n"),
    ]
    assert [cohorts.pools(df) for df in fine] == [[]] * len(fine)
    with pytest.raises(cohorts.CohortError, match="t: nationality_canon"):
        cohorts.check({"s": fine[0], "t": wrong[2]})
    with pytest.raises(cohorts.CohortError):
        cohorts.policy("unknown")


def star(spark, n=90):
    """Raw frames of a small survey: every cluster and subcluster large enough for the gates."""
    day = dt.datetime(2026, 7, 6)
    responses = spark.createDataFrame(
        [(f"u{i:03}", day, "v1" if i % 2 else "v2", "Mujer", 30.0, "Medellín", "Antioquia", "Venezuela", None, None, None, None, float(i), "es", "Si", None, "Completed", "x", 5.0, i) for i in range(n)],
        "user_id string, ts timestamp, instrument_version string, gender_clean string, age_num double, city_canon string, department string, nationality_canon string, away_duration_canon string, away_duration_order int, city_duration_canon string, city_duration_order int, n_questions double, language string, minors string, destination_country string, registration_status string, registration_started string, session_minutes double, record long",
    )
    said = [(f"u{i:03}", day, k, 2, f"necesito ayuda con el albergue y la comida para mi familia en la ciudad {'abc'[i % 3]} de la lista {'xyz'[k]}", f"m{i}-{k}") for i in range(n) for k in range(2)]
    messages = spark.createDataFrame(said, "user_id string, ts timestamp, seq int, n_msgs_user int, message string, message_id string")
    meal = spark.createDataFrame([("u001", day, "Útil", None, "Si", "Otro"), ("u900", day, None, None, None, None)], "user_id string, ts timestamp, usefulness_rating string, no_usefulness_reason string, would_recommend string, discovery_channel string")
    labels = spark.createDataFrame([(f"u{i:03}", i % 2) for i in range(n)], "user_id string, cluster_id int")
    tones = spark.createDataFrame([(m[5], "negative" if m[2] else "positive", "others") for m in said], "message_id string, sentiment string, emotion string")
    turns = spark.createDataFrame([("t1", "u001", day, "k", "albergue?", "no se", True, False), ("t2", "zz", day, "k", "hola", "si", False, False)], gold.TURNS)
    terms = spark.createDataFrame([(c, r, w, 0.5) for c in (0, 1) for r, w in enumerate(["albergue", "comida"])], "cluster_id int, rank int, term string, weight double")
    more = gold.Insight(
        members=spark.createDataFrame([(f"u{i:03}", (i % 2) * 10, True) for i in range(n)], "user_id string, subcluster_id int, is_split boolean"), terms=terms, subterms=terms.selectExpr("cluster_id * 10 subcluster_id", "rank", "term", "weight"),
        points=labels.selectExpr("user_id", "0d x", "1d y"), gold_tone=tones.selectExpr("message_id", "sentiment human", "'negative' model"), gold_emotion=tones.selectExpr("message_id", "emotion human", "'joy' model"),
        registry=[("Shelter", "institution", "albergue")], probes={"food": "comida"}, facts={"k": "2"},
    )
    return gold.build(gold.Dataset(responses, messages, meal, turns), labels, tones, more)


@pytest.fixture(scope="module")
def tables(spark):
    return star(spark)


def test_the_star_schema_is_published(spark, tmp_path, tables):
    assert len(tables) == 32
    manifest = {r.table: r for r in gold.write(tables, str(tmp_path / "gold")).collect()}
    assert manifest.keys() == tables.keys() and names(tmp_path) == ["gold"] and len(names(tmp_path / "gold")) == 33
    assert manifest["dim_user"].rows == 90 and manifest["fact_message"].rows == 180


def test_star_gates_keep_the_old_output(spark, tmp_path, tables):
    out = str(tmp_path / "gold")
    few = {k: tables[k] for k in ("fact_message", "fact_meal")}
    gold.write(few, out)
    doubled = tables["fact_message"].unionByName(tables["fact_message"].limit(1))
    low = spark.createDataFrame([("entity_coverage_pct", 0.0, 20.0, False)], "metric string, exported_value double, reconciliation_value double, match boolean")
    pooled = tables["dim_user"].groupBy("nationality_canon").count()
    for more, error, said in (({"fact_message": doubled}, publish.QualityError, "message_id stands in several rows"), ({"parity_check": low}, publish.QualityError, "parity_check"), ({"by_nation": pooled}, cohorts.CohortError, "by_nation: nationality_canon")):
        with pytest.raises(error, match=said):
            gold.write(few | more, out)
    assert names(tmp_path) == ["gold"] and spark.read.parquet(f"{out}/fact_message").count() == 180
