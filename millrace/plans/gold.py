"""The star schema: each builder is frames in, frame out; ``build`` wires them and ``write`` gates them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import canon as C
from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import aggregates as A
from millrace.operators import spine as S
from millrace.operators import terms as T
from millrace.plans import cohorts as H
from millrace.plans import tables as P
from millrace.plans.cohorts import COHORT_MARK, policy, pooled  # noqa: F401  read from here too
from millrace.sources import contract, publish


@dataclass(frozen=True)
class Dataset:
    responses: DataFrame
    messages: DataFrame
    meal: DataFrame
    turns: DataFrame | None = None


def cohort(df: DataFrame) -> DataFrame:
    """instrument_version by the mark that migrated rows carry; all v2 without that column."""
    mark = F.col(f"`{COHORT_MARK}`").isNotNull() if COHORT_MARK in df.columns else F.lit(False)
    return df.withColumn("instrument_version", F.when(mark, "v1").otherwise("v2"))


def column(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def load_responses(raw: DataFrame, salt: str, own_words: list[str]) -> DataFrame:
    """Records with pseudonyms, canonical values and no run of digits left in texts; the name column is gone."""
    df = contract.with_ids(contract.require(contract.renamed(raw, "responses"), "responses"))
    c = lambda n: column(df, n)
    ts = F.try_to_timestamp(c("Timestamp"))
    city = C.written_city(c("City"), c("City_other"))
    national = C.own_or_other(c("Nationality"), c("Nationality_other"))
    age = c("Age").try_cast("double")
    away, here = C.on_scale(V.AWAY, c("Away_duration")), C.on_scale(V.IN_CITY, c("City_duration"))
    out = cohort(df).select(
        X.pseudonym(F.col("Name"), salt).alias("user_id"), ts.alias("ts"), "instrument_version", X.redact_digits(c("Messages")).alias("Messages"),
        C.city(city).alias("city_canon"), C.department(C.city(city)).alias("department"), age.alias("age_num"), C.age_flag(age).alias("age_flag"),
        C.own_or_other(c("Gender"), c("Gender_other")).alias("gender_clean"), C.nationality(national, own_words).alias("nationality_canon"),
        away.label.alias("away_duration_canon"), away.order.alias("away_duration_order"), here.label.alias("city_duration_canon"), here.order.alias("city_duration_order"),
        c("Questions per user").try_cast("double").alias("n_questions"), C.session_minutes(ts, c("Last Message At")).alias("session_minutes"),
        c("Language").alias("language"), c("Minors").alias("minors"), c("Destination_Country").alias("destination_country"),
        c("Registration Status").alias("registration_status"), c("Registration Started").alias("registration_started"),
    )
    return H.tagged(out).withColumn("record", F.xxhash64(*out.columns))  # a tie-break that plans don't change


def load_meal(raw: DataFrame, salt: str, questions: dict[str, str]) -> DataFrame:
    """The newest answer of each respondent."""
    df = contract.with_ids(contract.require(contract.renamed(raw, "meal"), "meal"))
    found = contract.question_columns(df, questions)
    rows = df.select(X.pseudonym(F.col("Name"), salt).alias("user_id"), F.try_to_timestamp(F.col("Timestamp")).alias("ts"), *[column(df, found[q] or "").alias(q) for q in questions])
    rows = rows.withColumn("record", F.xxhash64(*rows.columns))
    return S.latest_per(rows, "user_id", "ts", "record").drop("record")


PROFILE = ["instrument_version", "gender_clean", "age_num", "age_flag", "city_canon", "department", "nationality_canon", "away_duration_canon", "away_duration_order", "city_duration_canon", "city_duration_order", "n_questions", "language", "minors", "destination_country", "registration_status"]


def with_members(df: DataFrame, members: DataFrame | None) -> DataFrame:
    """df with its users' subcluster, or that of users without text."""
    if members is None:
        return df.withColumn("subcluster_id", F.lit(V.NO_SUBCLUSTER))
    return S.with_labels(df, members.select("user_id", "subcluster_id"), "user_id", "subcluster_id", V.NO_SUBCLUSTER)


def with_subnames(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """df with the name of its subcluster: given, or made of its number; that of users without text is fixed."""
    own = F.when(F.col("subcluster_id") == V.NO_SUBCLUSTER, V.NO_CLUSTER_NAME).otherwise(F.concat(F.lit("Subcluster "), F.col("subcluster_id").cast("string")))
    if names is None:
        return df.withColumn("subcluster_name", own)
    given = names.select("subcluster_id", F.col("subcluster_name").alias("__name"))
    return df.join(given, "subcluster_id", "left").withColumn("subcluster_name", F.coalesce("__name", own)).drop("__name")


def dim_user(responses: DataFrame, messages: DataFrame, labels: DataFrame, members: DataFrame | None = None, subnames: DataFrame | None = None) -> DataFrame:
    """One row a user: first value of each profile column, message facts, repeat flag, cluster, display labels."""
    cols = [c for c in PROFILE if c in responses.columns]
    rec = responses.groupBy("user_id").agg(*[S.first_value(c, "ts", "record").alias(c) for c in cols], F.max("session_minutes").alias("session_minutes"), F.min("ts").alias("registered_at"), F.max("n_questions").alias("most_questions"))
    msg = messages.groupBy("user_id").agg(F.count("*").alias("n_msgs_user"), F.min("ts").alias("first_seen"))
    p90 = rec.agg(F.percentile("most_questions", F.lit(0.9)).alias("p90"))
    df = with_members(S.with_labels(rec.join(msg, "user_id", "left").join(F.broadcast(p90)), labels, "user_id", "cluster_id", V.NO_CLUSTER), members)
    df = with_subnames(df, subnames)
    age = C.age_band(F.col("age_num"))
    stay = F.col("destination_country").isNull() | X.fold(F.coalesce("destination_country", F.lit(""))).isin("", "colombia")
    away, away_order = C.or_no_answer(C.lookup(V.AWAY, F.col("away_duration_canon")), F.col("away_duration_order"))
    here, here_order = C.or_no_answer(C.lookup(V.IN_CITY, F.col("city_duration_canon")), F.col("city_duration_order"))
    return df.withColumns({
        "n_msgs_user": F.coalesce("n_msgs_user", F.lit(0)), "has_text": F.col("first_seen").isNotNull(), "is_repeat_asker": F.coalesce(F.col("most_questions") >= F.col("p90"), F.lit(False)),
        "age_range": age, "age_range_order": C.age_order(age), "intends_to_stay": stay, "gender_clean": C.gender(F.col("gender_clean")), "language": C.language(F.col("language")),
        "minors": C.yes_no(F.col("minors")), "away_duration_canon": away, "away_duration_order": away_order, "city_duration_canon": here, "city_duration_order": here_order,
        "city_canon": F.when(F.col("city_canon") == V.OTHER_CITY, "Other").otherwise(F.col("city_canon")),
        "nationality_canon": F.when(F.col("nationality_canon") == V.UNKNOWN_NATIONALITY, "Unknown").otherwise(F.col("nationality_canon")),
    }).drop("p90", "most_questions")


def fact_message(messages: DataFrame, tones: DataFrame | None, labels: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row a message, without its text; tone columns are null without a model."""
    df = with_members(S.with_labels(messages.select("message_id", "user_id", "ts", "seq", "n_msgs_user"), labels, "user_id", "cluster_id", V.NO_CLUSTER), members)
    if tones is None:
        return df.withColumns({"sentiment": F.lit(None).cast("string"), "emotion": F.lit(None).cast("string"), "emotion_display": F.lit(None).cast("string")})
    return df.join(tones.select("message_id", "sentiment", "emotion"), "message_id", "left").withColumn("emotion_display", C.emotion_display(F.col("emotion"), F.col("sentiment")))


def fact_meal(meal: DataFrame) -> DataFrame:
    """Ratings as numbers, valid reasons flagged before the labels are translated."""
    reason = column(meal, "no_usefulness_reason")
    low = [k for k, v in V.RATING.items() if v <= 3]
    rating = F.col("usefulness_rating")
    return meal.select("user_id", "ts", C.lookup(V.RATING, rating).alias("rating_num"), F.coalesce(rating.isin(low) & reason.isNotNull(), F.lit(False)).alias("reason_is_valid"), C.yes_no(column(meal, "would_recommend")).alias("would_recommend"), C.discovery(column(meal, "discovery_channel")).alias("discovery_channel"))


def weekly_rating(fact: DataFrame) -> DataFrame:
    return fact.where("ts is not null and rating_num is not null").select(F.date_trunc("week", "ts").alias("bucket"), "user_id", F.col("rating_num").cast("double").alias("mean_rating"), F.lit(1).alias("n"))


def daily_meal(fact: DataFrame) -> DataFrame:
    return fact.where("ts is not null").select(F.date_trunc("day", "ts").alias("bucket"), "user_id", F.lit(1).alias("n"))


def meta_run(spark: SparkSession, **facts) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(facts.items())] or [], "key string, value string")


@dataclass(frozen=True)
class Insight:
    """What models and people add; each part may be missing."""

    members: DataFrame | None = None  # user_id, subcluster_id, is_split
    names: DataFrame | None = None  # cluster_id, cluster_name, name_is_provisional
    subnames: DataFrame | None = None  # subcluster_id, subcluster_name
    terms: DataFrame | None = None  # cluster_id, rank, term, weight
    subterms: DataFrame | None = None  # subcluster_id, rank, term, weight
    points: DataFrame | None = None  # user_id, x, y
    gold_tone: DataFrame | None = None  # message_id, human, model
    gold_emotion: DataFrame | None = None
    gap_probe: DataFrame | None = None  # probe_report's row
    registry: list[T.Entry] = field(default_factory=list)
    probes: dict[str, str] = field(default_factory=dict)
    markers: dict[int, str] | None = None
    first_names: list[str] = field(default_factory=list)
    bot_names: list[str] = field(default_factory=list)
    facts: dict[str, str] = field(default_factory=dict)


TURNS = "turn_id string, user_id string, ts timestamp, reply_key string, user_message string, bot_reply string, gap_flag boolean, handoff_flag boolean"


def build(data: Dataset, labels: DataFrame, tones: DataFrame | None = None, more: Insight | None = None) -> dict[str, DataFrame]:
    """Every table whose inputs are there; without a bot log its tables are empty, without a probe its rates are withheld."""
    spark, more = data.responses.sparkSession, more or Insight()
    members, messages = more.members, data.messages
    users, meal = dim_user(data.responses, messages, labels, members, more.subnames), fact_meal(data.meal)
    facts = fact_message(messages, tones, labels, members)
    said = messages.join(labels.select("user_id", "cluster_id"), "user_id")
    texts = messages.select("message_id", "message")
    clusters = P.dim_cluster(users, more.names, more.terms)
    per_user = users.select("user_id", F.when(F.col("has_text"), F.col("n_msgs_user")).alias("n"))
    rated = meal.where("rating_num is not null").join(labels.select("user_id", "cluster_id"), "user_id", "left")
    tables = {
        "dim_city": P.dim_city(spark), "dim_quadrant": P.dim_quadrant(spark), "dim_user": users, "dim_cluster": clusters, "fact_message": facts, "fact_meal": meal,
        "agg_daily_volume": S.regrain(facts, "ts", "day", "user_id"), "agg_weekly_cluster": S.regrain(facts, "ts", "week", "cluster_id", "user_id"),
        "agg_weekly_rating": weekly_rating(meal), "agg_daily_meal": daily_meal(meal), "agg_funnel": P.funnel_by_user(per_user, meal),
        "agg_registration_funnel": P.registration_by_user(data.responses), "agg_language": P.language_by_user(data.responses),
        "fact_message_entities": T.entity_rows(messages, "message", more.registry, "message_id", "user_id") if more.registry else spark.createDataFrame([], "message_id string, user_id string, entity string, kind string"),
        "nlp_entity_candidates": T.candidates(messages, "user_id", "message", "message_id", more.registry, X.stop_terms([e for e, k, _ in more.registry if k == "ignore"]), 15, 40) if more.registry else spark.createDataFrame([], "term string, n_msgs long, n_users long, example string"),
    }
    toned = facts.join(texts, "message_id").withColumn("sentiment", F.coalesce("sentiment", F.lit("neutral"))) if tones is None else facts.join(texts, "message_id")
    tables["fact_conversation_full"] = P.conversations_full(toned, "sentiment", "emotion", more.bot_names, more.first_names)
    tables["fact_message_sample"] = P.message_sample(facts, texts, 6, more.first_names)
    negative = by_user = None
    if tones is not None:
        share = F.avg((F.col("sentiment") == "negative").cast("double"))
        negative, by_user = (facts.where(F.col("cluster_id") != V.NO_CLUSTER).groupBy(k).agg(share.alias(n)) for k, n in (("cluster_id", "pct_negative"), ("user_id", "negative_share")))
    matrix = P.priority(said, rated, negative)
    tables["agg_priority_matrix"] = P.priority_by_user(said, matrix, users.select("user_id", "is_repeat_asker"), rated.groupBy("user_id").agg(F.max("rating_num").alias("rating_num")), by_user)
    if more.probes:
        tables["nlp_emergent_themes"] = T.themes(messages, "user_id", "message", more.probes).orderBy(F.desc("n_users"), "theme")
    if members is not None:
        tables["dim_subcluster"] = P.dim_subcluster(members, messages, clusters, more.subterms)
    if more.points is not None:
        tables["nlp_umap"] = more.points.join(labels.select("user_id", "cluster_id"), "user_id")
    if more.terms is not None:
        tables["nlp_cluster_terms"] = T.term_users(more.terms, said, "cluster_id", "user_id", "message")
        tables["nlp_voices"] = T.voices(said, more.terms, "cluster_id", "user_id", "seq", "message", markers=more.markers, first=T.exclusive(more.terms, "cluster_id"))
    if more.subterms is not None and members is not None:
        tables["nlp_subcluster_terms"] = T.term_users(T.exclusive(more.subterms, "subcluster_id"), messages.join(members.select("user_id", "subcluster_id"), "user_id"), "subcluster_id", "user_id", "message")
    if more.gold_tone is not None:
        tables["nlp_tone_confusion"] = P.confusion_rows(more.gold_tone, "message_id", "human", "model", True)
    if more.gold_emotion is not None:
        tables["nlp_emotion_confusion"] = P.confusion_rows(more.gold_emotion, "message_id", "human", "model", False)
    turns = data.turns if data.turns is not None else spark.createDataFrame([], TURNS)
    tables |= {"fact_bot_turn": P.bot_turn_facts(turns, users), "agg_coverage_gap": P.coverage_gap(turns, more.gap_probe)}
    if more.registry:
        tables |= {"fact_bot_turn_entities": T.entity_rows(turns, "user_message", more.registry, "turn_id", "user_id"), "agg_bot_gap_entities": P.gap_entities(turns, "user_message", more.registry)}
    else:
        tables |= {"fact_bot_turn_entities": spark.createDataFrame([], "turn_id string, user_id string, entity string, kind string"), "agg_bot_gap_entities": spark.createDataFrame([], "kind string, entity string, n_turns long, n_gap long, pct_gap double")}
    subs = tables.get("dim_subcluster", spark.createDataFrame([], "subcluster_id long, is_split boolean, n_users long"))
    named = T.entity_coverage(messages, "message", more.registry).first() if more.registry else None
    covered = 100.0 * named.hit / named.total if named and named.total else 0.0  # no registry names nothing, and its gate says so
    tables["parity_check"] = P.parity(P.reconciliation(data.responses, messages, data.meal), users, facts, meal, A.least_subcluster(subs), covered)
    tables["meta_run"] = meta_run(spark, **{k: v for k, v in more.facts.items() if k != "checks"}, n_tables=len(tables) + 1)
    H.check(tables)
    return tables


#: What the published tables must keep to, beside holding no personal data.
GATES = {
    "parity_check": publish.Gate(rows={"a figure differs from its reconciliation or floor": "match"}),
    "dim_user": publish.Gate(rows={"a user without id": "user_id is not null"}, unique=("user_id",)),
    "fact_message": publish.Gate(totals={"messages of users don't add up": "coalesce(sum(if(seq = 0, n_msgs_user, 0)), 0) = count(*)"}, unique=("message_id",)),
    "fact_meal": publish.Gate(unique=("user_id",)),
}


def write(tables: dict[str, DataFrame], out: str, fmt: str = "parquet", told=None) -> DataFrame:
    """Publishes all tables or none, each planned and run once: cohorts not pooled, no personal data, parity and quality rules kept. Returns the manifest."""
    H.check(tables)
    return publish.write_all(tables, out, fmt=fmt, gates=GATES, told=told)
