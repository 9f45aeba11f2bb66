"""Cohorts of answers, bounded samples, warnings, exported labels, subcluster names."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import spine as S
from millrace.plans import gold, questions
from millrace.sources import contract


def test_samples_never_exceed_what_is_asked(spark):
    rows = spark.createDataFrame([(i, f"s{i % 40}") for i in range(200)] + [(500, None)], "k long, s string")
    got = S.stratified_sample(rows, "s", "k", 10).collect()
    assert len(got) == 10 and len({r.s for r in got}) == 10  # each from a stratum of its own
    assert S.stratified_sample(rows, "s", "k", 80).count() == 80
    some = S.stratified_sample(rows.where("s in ('s1', 's2', 's3')"), "s", "k", 7).collect()
    assert len(some) <= 7 and {r.s for r in some} == {"s1", "s2", "s3"}
    assert S.stratified_sample(rows.limit(0), "s", "k", 5).count() == 0


def test_a_question_without_a_column_is_told(spark):
    df = spark.createDataFrame([("x",)], "`¿Útil?` string")
    with pytest.warns(UserWarning, match="other"):
        assert contract.question_columns(df, {"r": "util", "other": "nada"}) == {"r": "¿Útil?", "other": None}


def test_answers_get_their_users_cohort(spark):
    users = spark.createDataFrame([("a", "v1"), ("a", "v2"), ("b", "v2"), ("c", None)], "user_id string, instrument_version string")
    answers = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), ("z", 4)], "user_id string, n int")
    assert {(r.n, r.instrument_version) for r in questions.with_cohort(answers, users).collect()} == {(1, "v1"), (2, "v1"), (3, None), (4, None)}
    rows = users.withColumn("gender", F.when(F.col("user_id") == "a", "Woman").when(F.col("user_id") == "b", "Man"))
    assert {(r.instrument_version, r.n, r.share) for r in questions.share_by_cohort(rows, "gender", "Woman", "instrument_version").collect()} == {("v1", 1, 1.0), ("v2", 2, 0.5)}


def test_exported_labels_have_their_texts(spark):
    rows = spark.createDataFrame([("m1", "one"), ("m2", None)], "message_id string, message string")
    labels = spark.createDataFrame([("m1", "x")], "message_id string, label string")
    assert [tuple(r) for r in questions.gold_export(labels, rows, "message_id", "message").collect()] == [("m1", "x", "one")]
    for wrong in ("m2", "m9"):
        with pytest.raises(ValueError):
            questions.gold_export(spark.createDataFrame([(wrong, "x")], labels.schema), rows, "message_id", "message")


def test_subclusters_have_names(spark):
    df = spark.createDataFrame([("a", 11), ("b", 12), ("c", V.NO_SUBCLUSTER)], "user_id string, subcluster_id int")
    names = spark.createDataFrame([(11, "Shelter")], "subcluster_id int, subcluster_name string")
    assert {r.user_id: r.subcluster_name for r in gold.with_subnames(df, names).collect()} == {"a": "Shelter", "b": "Subcluster 12", "c": V.NO_CLUSTER_NAME}
    assert {r.user_id: r.subcluster_name for r in gold.with_subnames(df).collect()} == {"a": "Subcluster 11", "b": "Subcluster 12", "c": V.NO_CLUSTER_NAME}
