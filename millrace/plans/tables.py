"""Builders of the published tables: frames in, frame out, whatever they are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import canon as C
from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import aggregates as A
from millrace.operators import spine as S
from millrace.operators import terms as T

#: A colour a size rank; the palette begins anew after its end.
PALETTE = ["#6b1f3a", "#1f6b63", "#c9803b", "#3b5dc9", "#8a8d2f", "#7a4fa3", "#2f8ac9", "#a3557a", "#4f7a3b", "#c94f3b", "#5a5a5a", "#b09a2f"]
NO_TEXT_COLOUR = "#bdbdbd"
QUADRANTS = [
    ("high_volume_high_need", "Large and badly served", "Act here", "high", "high", "#6b1f3a"),
    ("low_volume_high_need", "Small and badly served", "Watch", "low", "high", "#a3557a"),
    ("high_volume_low_need", "Large and well served", "Protect", "high", "low", "#1f6b63"),
    ("low_volume_low_need", "Small and well served", "Steady state", "low", "low", "#8c8c8c"),
]


def tints(colour: str, n: int) -> list[str]:
    """n shades of a colour, from itself towards white."""
    rgb = [int(colour[i : i + 2], 16) for i in (1, 3, 5)]
    return ["#" + "".join(f"{round(c + (255 - c) * 0.6 * k / max(n, 1)):02x}" for c in rgb) for k in range(n)]


def cycled(colours: list[str], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in colours]), (rank % len(colours)).cast("int") + 1)


def dim_city(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, d, *V.CITY_PLACE[c]) for c, d in V.DEPARTMENT.items()], "city_canon string, department string, lat double, lon double")


def dim_quadrant(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*q, i) for i, q in enumerate(QUADRANTS)], "quadrant_key string, label string, action string, axis_x string, axis_y string, color_hex string, display_order int")


def dim_cluster(users: DataFrame, names: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """A row a cluster by size, ties by id, with colour, name and first terms; last the row of users without text, whose counts are null."""
    sized = users.where(F.col("cluster_id") >= 0).groupBy("cluster_id").agg(F.count("*").alias("n_users"), F.sum("n_msgs_user").cast("long").alias("n_messages"))
    ranked = A.size_ranked(sized, "cluster_id", "n_users").withColumn("color_hex", cycled(PALETTE, F.col("display_order")))
    if names is not None:
        ranked = ranked.join(names.select("cluster_id", "cluster_name", "name_is_provisional"), "cluster_id", "left")
    else:
        ranked = ranked.withColumns({"cluster_name": F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")), "name_is_provisional": F.lit(True)})
    if terms is not None:
        ranked = ranked.join(T.top_terms(terms, "cluster_id"), "cluster_id", "left")
    ranked = ranked.withColumn("top_terms", F.coalesce("top_terms", F.lit("")) if terms is not None else F.lit(""))
    last = sized.agg(F.count("*").cast("int").alias("display_order")).select(F.lit(V.NO_CLUSTER).cast(users.schema["cluster_id"].dataType).alias("cluster_id"), F.lit(None).cast("long").alias("n_users"), F.lit(None).cast("long").alias("n_messages"), "display_order", F.lit(NO_TEXT_COLOUR).alias("color_hex"), F.lit(V.NO_CLUSTER_NAME).alias("cluster_name"), F.lit(False).alias("name_is_provisional"), F.lit("").alias("top_terms"))
    return ranked.unionByName(last)


def dim_subcluster(members: DataFrame, messages: DataFrame, clusters: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """A row a child: users and messages, order beneath its parent by size, a shade of its colour; last the row without text.

    members: user_id, subcluster_id, is_split; clusters: dim_cluster.
    """
    users = members.where("subcluster_id >= 0").groupBy("subcluster_id").agg(F.count_distinct("user_id").alias("n_users"), F.bool_or("is_split").alias("is_split"))
    said = messages.join(members.select("user_id", "subcluster_id"), "user_id").groupBy("subcluster_id").agg(F.count("*").alias("n_messages"))
    rows = users.join(said, "subcluster_id", "left").withColumn("cluster_id", F.floor(F.col("subcluster_id") / 10))
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("n_users"), "subcluster_id")) - 1
    parents = clusters.where("cluster_id >= 0").select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("display_order").alias("parent"), F.col("color_hex").alias("of"))
    shade = lambda c, r: F.lpad(F.hex(F.round(c + (255 - c) * 0.06 * r).cast("long")), 2, "0")
    part = lambda i: F.conv(F.substring("of", i, 2), 16, 10).cast("int")
    out = rows.withColumn("at", rank).join(parents, "cluster_id").withColumn("display_order", (F.col("parent") * 10 + F.col("at")).cast("int"))
    out = out.withColumn("color_hex", F.lower(F.concat(F.lit("#"), *[shade(part(i), F.col("at")) for i in (2, 4, 6)])))
    if terms is not None:
        out = out.join(T.top_terms(terms, "subcluster_id"), "subcluster_id", "left")
    out = out.withColumn("top_terms", F.coalesce("top_terms", F.lit("")) if terms is not None else F.lit(""))
    cols = ["subcluster_id", "cluster_id", "top_terms", "n_users", "n_messages", "display_order", "color_hex", "is_split"]
    out = out.select(F.col("subcluster_id").cast("long").alias("subcluster_id"), "cluster_id", "top_terms", "n_users", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "display_order", "color_hex", "is_split")
    last = clusters.agg(((F.max(F.when(F.col("cluster_id") >= 0, F.col("display_order"))) + 1) * 10).cast("int").alias("display_order"))
    last = last.select(F.lit(V.NO_SUBCLUSTER).cast("long").alias("subcluster_id"), F.lit(V.NO_CLUSTER).cast("long").alias("cluster_id"), F.lit("").alias("top_terms"), F.lit(None).cast("long").alias("n_users"), F.lit(None).cast("long").alias("n_messages"), F.coalesce("display_order", F.lit(0)).alias("display_order"), F.lit(NO_TEXT_COLOUR).alias("color_hex"), F.lit(False).alias("is_split"))
    return out.select(*cols).unionByName(last.select(*cols))


def message_sample(facts: DataFrame, texts: DataFrame, per_bucket: int = 6, first_names: list[str] = (), people: str | None = None) -> DataFrame:
    """At most so many scrubbed messages of middling length a (subcluster, tone), by message id; dropped ones are replaced.

    facts: message_id, subcluster_id, sentiment; texts: message_id, message (and spans of people, if a model found them).
    """
    rows = facts.where("subcluster_id >= 0").join(texts, "message_id").where(F.length("message").between(60, 190))
    clean = rows.withColumn("__s", X.scrub(F.col("message"), first_names, F.col(people) if people else None))
    clean = clean.withColumn("message", F.col("__s.text")).withColumn("was_redacted", F.col("__s.changed")).drop("__s")
    return S.sample_per_bucket(clean, ["subcluster_id", "sentiment"], "message_id", per_bucket, F.col("message").isNotNull())


def conversations_full(messages: DataFrame, tone: str, emotion: str | None = None, bot_names: list[str] = (), first_names: list[str] = (), people: str | None = None) -> DataFrame:
    """A row a user: scrubbed messages in order, joined by blank lines; blank and low-content ones, before and after scrubbing, are left out."""
    low = lambda c: F.coalesce(X.is_low_content(c, list(bot_names)), F.lit(True))
    rows = messages.where((X.squash(F.col("message")) != "") & ~low(F.col("message"))).withColumn("__s", X.scrub(F.col("message"), first_names, F.col(people) if people else None))
    rows = rows.withColumn("message", F.col("__s.text")).withColumn("__c", F.col("__s.changed")).where(F.col("message").isNotNull()).where(~low(F.col("message")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x.message)
    facts = [F.array_join(parts, "\n\n").alias("conversation"), F.count("*").alias("n_messages"), F.mode(tone, True).alias("dominant_tone"), F.bool_or("__c").alias("was_redacted")]
    facts += [F.mode(emotion, True).alias("dominant_emotion")] if emotion else []
    facts += [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")] if "ts" in messages.columns else []
    return rows.groupBy("user_id").agg(*facts)


def funnel_by_user(per_user: DataFrame, surveyed: DataFrame, n: str = "n") -> DataFrame:
    """A row a user and stage reached. The survey's stage doesn't depend on messages, and its users need not be known otherwise."""
    heavy = per_user.agg(F.coalesce(F.ceil(F.percentile(n, F.lit(0.9))), F.lit(2)).cast("long").alias("h"))
    c = F.col(n)
    stage = lambda i, name, when: F.when(when, F.struct(F.lit(i).alias("stage_order"), name.alias("stage")))
    reached = F.filter(F.array(
        stage(0, F.lit("Arrived"), F.lit(True)), stage(1, F.lit("Sent a message"), c >= 1), stage(2, F.lit("Sent 2 or more messages"), c >= 2),
        stage(3, F.concat(F.lit("Sent "), F.col("h").cast("string"), F.lit(" or more messages")), c >= F.col("h")),
    ), lambda x: x.isNotNull())
    rows = per_user.join(F.broadcast(heavy)).select("user_id", F.inline(reached))
    return rows.unionByName(surveyed.select("user_id").distinct().select("user_id", F.lit(4).alias("stage_order"), F.lit("Answered the survey").alias("stage")))


def registration_by_user(records: DataFrame, status: str = "registration_status", started: str = "registration_started", version: str = "instrument_version", ts: str = "ts", tie: str = "record") -> DataFrame:
    """Two rows a started record: that it started, and its status, unknown ones as other; the cohort is that of the user's first record."""
    if status not in records.columns:
        return records.sparkSession.createDataFrame([], "user_id string, cohort string, stage_order int, stage string")
    cohort = F.first(version).over(W.partitionBy("user_id").orderBy(F.col(ts).asc_nulls_last(), tie))
    rows = records.withColumn("cohort", cohort)
    rows = rows.where(F.col(started).isNotNull()) if started in records.columns else rows
    s = F.lower(F.col(status))
    kind = F.when(s.contains("complet"), 1).when(s.contains("abandon"), 2).when(s.contains("progress"), 3).otherwise(4)
    name = F.when(kind == 1, "registration completed").when(kind == 2, "abandoned").when(kind == 3, "in progress").otherwise("other")
    pair = F.array(F.struct(F.lit(0).alias("stage_order"), F.lit("registration started").alias("stage")), F.struct(kind.alias("stage_order"), name.alias("stage")))
    return rows.select("user_id", "cohort", F.inline(pair))


def language_by_user(records: DataFrame, language: str = "language", version: str = "instrument_version", ts: str = "ts", tie: str = "record") -> DataFrame:
    """Distinct (cohort, user, language); records without a language are left out."""
    cohort = F.first(version).over(W.partitionBy("user_id").orderBy(F.col(ts).asc_nulls_last(), tie))
    return records.withColumn("cohort", cohort).where(F.col(language).isNotNull()).select("cohort", "user_id", C.language(F.col(language)).alias("language")).distinct()


def priority(messages: DataFrame, ratings: DataFrame, negative: DataFrame | None = None, least: int = V.LEAST_RATINGS) -> DataFrame:
    """A row a cluster: messages, users, share of users at the 90th percentile of messages, mean rating, and unmet_need.

    unmet_need is the mean of the z-scores of repeat share, negative share (if given) and inverted rating;
    n_axes says of how many. A cluster with fewer than ``least`` ratings takes the mean of all, and is marked.
    messages: cluster_id, user_id; ratings: cluster_id, rating_num; negative: cluster_id, pct_negative.
    """
    per = messages.groupBy("user_id").agg(F.min("cluster_id").alias("cluster_id"), F.count("*").alias("n"))
    p90 = per.agg(F.percentile("n", F.lit(0.9)).alias("p"))
    out = per.join(F.broadcast(p90)).groupBy("cluster_id").agg(F.sum("n").alias("messages"), F.count("*").alias("users"), F.avg((F.col("n") >= F.col("p")).cast("double")).alias("pct_repeat"))
    rated = ratings.where("rating_num is not null")
    mean = rated.groupBy("cluster_id").agg(F.avg("rating_num").alias("own"), F.count("*").alias("k"))
    every = rated.agg(F.avg("rating_num").alias("overall"))
    few = F.coalesce("k", F.lit(0)) < least
    out = out.join(mean, "cluster_id", "left").join(F.broadcast(every)).select("cluster_id", "messages", "users", "pct_repeat", F.when(few, F.col("overall")).otherwise(F.col("own")).alias("mean_rating"), F.coalesce("k", F.lit(0)).alias("meal_n"), few.alias("rating_is_fallback"))
    axes = ["pct_repeat"]
    if negative is not None:
        out = out.join(negative.select("cluster_id", "pct_negative"), "cluster_id", "left")
        axes.append("pct_negative")
    out = out.withColumn("__inverted", -F.col("mean_rating"))
    for c in [*axes, "__inverted"]:
        z = A.zscore(c)
        out = out.withColumn(f"__z{c}", F.when(F.col("mean_rating").isNotNull(), z) if c == "__inverted" else z)
    n = F.lit(len(axes)) + F.when(F.count("mean_rating").over(W.partitionBy(F.lit(0))) > 0, 1).otherwise(0)
    need = A.mean_of(*[f"__z{c}" for c in [*axes, "__inverted"]])
    return out.withColumn("n_axes", n).withColumn("unmet_need", need).drop("__inverted", *[f"__z{c}" for c in [*axes, "__inverted"]])


def priority_by_user(messages: DataFrame, matrix: DataFrame, repeat: DataFrame, ratings: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """A row a user: messages, and unmet_need on the fixed baseline of the clusters, so that a cluster's mean comes back.

    matrix: priority's rows; repeat: user_id, is_repeat_asker; ratings: user_id, rating_num; negative: user_id,
    negative_share. A user without a rating takes the cluster's. Raises if a cluster isn't in the matrix.
    """
    users = messages.where(F.col("cluster_id") != V.NO_CLUSTER).groupBy("user_id").agg(F.min("cluster_id").alias("cluster_id"), F.count("*").alias("messages"))
    if n := users.join(matrix, "cluster_id", "left_anti").count():
        raise ValueError(f"{n} users are in clusters that the matrix doesn't have")
    inverted = -F.col("mean_rating")
    measures = {"repeat": F.col("pct_repeat"), "rating": inverted} | ({"negative": F.col("pct_negative")} if negative is not None else {})
    base = matrix.agg(*[f(v).alias(f"{p}_{k}") for k, v in measures.items() for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = users.join(matrix.select("cluster_id", inverted.alias("__neutral")), "cluster_id").join(repeat.select("user_id", F.col("is_repeat_asker").cast("double").alias("__repeat")), "user_id", "left")
    rows = rows.join(ratings.select("user_id", F.col("rating_num").cast("double").alias("__own")), "user_id", "left").withColumn("__rating", F.coalesce(-F.col("__own"), "__neutral"))
    if negative is not None:
        rows = rows.join(negative.select("user_id", F.col("negative_share").alias("__negative")), "user_id", "left")
    rows = rows.join(F.broadcast(base))
    for k in measures:
        z = F.when(F.col(f"s_{k}") > 0, (F.col(f"__{k}") - F.col(f"m_{k}")) / F.col(f"s_{k}")).when(F.col(f"__{k}").isNotNull() & F.col(f"m_{k}").isNotNull(), 0.0)
        rows = rows.withColumn(f"__z{k}", z)
    return rows.select("user_id", "cluster_id", "messages", F.lit(1).alias("users"), A.mean_of(*[f"__z{k}" for k in measures]).alias("unmet_need"))


def confusion_rows(gold: DataFrame, key: str, human: str, model: str, binary: bool) -> DataFrame:
    """(key, human_label, model_label), a row a labelled message: two classes for tone, all for emotions, others as neutral."""
    label = (lambda c: A.binarised(F.col(c))) if binary else (lambda c: F.when(F.col(c) == "others", "neutral").otherwise(F.col(c).cast("string")))
    return gold.select(key, label(human).alias("human_label"), label(model).alias("model_label"))


def bot_turn_facts(turns: DataFrame, users: DataFrame) -> DataFrame:
    """Turns without text, times as text, and whether their user has a survey record."""
    cols = [c for c in ("turn_id", "user_id", "reply_key", "gap_flag", "handoff_flag") if c in turns.columns]
    rows = turns.select(*cols, X.stamp(F.col("ts")).alias("ts")) if "ts" in turns.columns else turns.select(*cols)
    return S.member_flag(rows, users.select("user_id"), "user_id", "has_survey_record")


GAP_COLUMNS = "metric string, grain string, numerator bigint, denominator bigint, rate_pct double, rate_quotable boolean, is_floor boolean, window_start string, window_end string"


def coverage_gap(turns: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Both metrics at both grains; a rate is null unless the probe's gate passed, its counts stay. No turns: no rows.

    probe: probe_report's row, for the gap; without it, and for hand-offs, nothing is quotable.
    """
    ts = F.col("ts").cast("timestamp") if "ts" in turns.columns else F.lit(None).cast("timestamp")
    hits = [f for p, c in (("g", "gap_flag"), ("h", "handoff_flag")) for f in (F.count_if(c).alias(f"{p}_turns"), F.count_distinct(F.when(F.col(c), F.col("user_id"))).alias(f"{p}_users"))]
    k = turns.agg(F.count("*").alias("turns"), F.count_distinct("user_id").alias("users"), F.date_format(F.min(ts), "yyyy-MM-dd").alias("window_start"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("window_end"), *hits).where("turns > 0")
    if probe is not None:
        k = k.join(F.broadcast(probe.select("passed", F.col("is_floor").alias("floor"))))
    else:
        k = k.withColumns({"passed": F.lit(False), "floor": F.lit(True)})
    rows = []
    for metric, p in (("coverage_gap", "g"), ("human_handoff", "h")):
        for grain in ("users", "turns"):
            ok = F.col("passed") if p == "g" else F.lit(False)
            num, den = F.col(f"{p}_{grain}"), F.col(grain)
            rows.append(F.struct(F.lit(metric).alias("metric"), F.lit(grain).alias("grain"), num.alias("numerator"), den.alias("denominator"), A.quotable(100 * num / den, ok).alias("rate_pct"), ok.alias("rate_quotable"), (F.col("floor") if p == "g" else F.lit(True)).alias("is_floor"), F.col("window_start").alias("window_start"), F.col("window_end").alias("window_end")))
    out = k.select(F.inline(F.array(*rows)))
    return out.withColumn("rate_pct", X.round_half_even(F.col("rate_pct"), 1))


def gap_entities(turns: DataFrame, text: str, registry: list[T.Entry], floor: int = 5) -> DataFrame:
    """Entities of at least ``floor`` turns: turns, those with a gap, and their share; the largest share first."""
    rows = T.entity_rows(turns, text, registry, "gap_flag").groupBy("kind", "entity").agg(F.count("*").alias("n_turns"), F.count_if("gap_flag").alias("n_gap")).where(F.col("n_turns") >= floor)
    return rows.withColumn("pct_gap", X.round_half_even(100 * F.col("n_gap") / F.col("n_turns"), 1)).orderBy(F.desc("pct_gap"), F.desc("n_turns"), "entity")


def gold_candidates(turns: DataFrame, n_unmatched: int = 200, seed: int = 0) -> DataFrame:
    """Replies to label, once each: all that the probe matches, and so many others, those whose hashed key is least."""
    once = turns.groupBy("reply_key").agg(F.min("bot_reply").alias("bot_reply"), F.bool_or("gap_flag").alias("gap_flag"))
    rest = once.where("not gap_flag").orderBy(F.sha1(F.concat_ws(":", F.lit(str(seed)), "reply_key")), "reply_key").limit(n_unmatched)
    return once.where("gap_flag").withColumn("stratum", F.lit("matched")).unionByName(rest.withColumn("stratum", F.lit("unmatched"))).select("reply_key", "stratum", "bot_reply", F.lit(None).cast("string").alias("human_label"))


def archetypes(users: DataFrame, messages: DataFrame, terms: DataFrame | None = None, tone: str | None = None) -> DataFrame:
    """A row a cluster: users, messages, median age of adults, most frequent city and nationality, negative share, first terms."""
    out = users.groupBy("cluster_id").agg(F.count("*").alias("n_users"), F.median(F.when(F.col("age_num") >= 18, F.col("age_num"))).alias("median_age"), F.mode("city_canon", True).alias("top_city"), F.mode("nationality_canon", True).alias("top_nationality"))
    facts = [F.count("*").alias("n_messages")] + ([F.avg((F.col(tone) == "negative").cast("double")).alias("pct_negative")] if tone else [])
    out = out.join(messages.join(users.select("user_id", "cluster_id"), "user_id").groupBy("cluster_id").agg(*facts), "cluster_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return out.join(T.top_terms(terms, "cluster_id"), "cluster_id", "left") if terms is not None else out


def reconciliation(records: DataFrame, messages: DataFrame, meal: DataFrame, questions: str = "n_questions") -> DataFrame:
    """(metric, value) as text: users, records, messages, users with text, answers, their rate, repeat askers; pending where nothing can be said."""
    per = records.groupBy("user_id").agg(F.max(questions).alias("q"))
    p90 = per.agg(F.percentile("q", F.lit(0.9)).alias("p"))
    repeat = per.join(F.broadcast(p90)).agg(F.when(F.first("p").isNotNull(), 100 * F.avg(F.coalesce(F.col("q") >= F.col("p"), F.lit(False)).cast("double"))).alias("repeat"))
    one = records.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("records"))
    for other in (messages.agg(F.count("*").alias("messages"), F.count_distinct("user_id").alias("users_with_text")), meal.agg(F.count("*").alias("meal_responses")), repeat):
        one = one.join(F.broadcast(other))
    share = lambda c: F.coalesce(F.format_string("%.1f", X.round_half_even(c, 1)), F.lit("pending"))
    values = {c: F.col(c).cast("string") for c in ("users", "records", "messages", "users_with_text", "meal_responses")}
    values |= {"response_rate_pct": share(F.try_divide(100.0 * F.col("meal_responses"), F.col("users"))), "repeat_askers_pct": share(F.col("repeat"))}
    return one.select(*[v.alias(k) for k, v in values.items()]).unpivot([], list(values), "metric", "value")


def parity(recon: DataFrame, users: DataFrame, facts: DataFrame, meal: DataFrame, least_users: DataFrame, entity_coverage_pct: Column | float = 100.0) -> DataFrame:
    """(metric, exported_value, reconciliation_value, match): four counts and a share that must be equal, three that must reach a floor.

    users: user_id, has_text, is_repeat_asker, cluster_id; least_users: least_subcluster's row. A pending value never matches.
    """
    one = users.agg(F.count_distinct("user_id").alias("users"), F.count_if("has_text").alias("users_with_text"), F.avg(F.col("is_repeat_asker").cast("double")).alias("repeat"), F.avg((F.col("cluster_id").isNotNull() & (F.col("cluster_id") != V.NO_CLUSTER)).cast("double")).alias("covered"))
    for other in (facts.agg(F.count("*").alias("messages")), meal.agg(F.count("*").alias("meal_responses")), least_users):
        one = one.join(F.broadcast(other))
    pct = lambda c: X.round_half_even(100 * F.coalesce(c, F.lit(0.0)), 1)
    entity = X.round_half_even(F.lit(entity_coverage_pct) if not isinstance(entity_coverage_pct, Column) else entity_coverage_pct, 1)
    one = one.withColumns({"repeat_askers_pct": pct(F.col("repeat")), "cluster_coverage_pct": pct(F.col("covered")), "entity_coverage_pct": entity, "subcluster_min_users": F.col("least")})
    equal = ["users", "messages", "users_with_text", "meal_responses", "repeat_askers_pct"]
    floors = {"cluster_coverage_pct": 100 * V.COVERAGE_FLOOR, "subcluster_min_users": float(V.LEAST_SUBCLUSTER), "entity_coverage_pct": 100 * V.ENTITY_FLOOR}
    names = [*equal, *floors]
    rows = one.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "exported_value")
    both = rows.join(recon, "metric", "left").withColumn("floor", C.lookup(floors, F.col("metric")))
    number = F.col("value").try_cast("double")
    return both.select("metric", "exported_value", F.coalesce("floor", number).alias("reconciliation_value"), F.coalesce(F.when(F.col("floor").isNotNull(), F.col("exported_value") >= F.col("floor")).otherwise(F.col("exported_value") == number), F.lit(False)).alias("match"))
