"""Questions asked of the published tables, one function each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import aggregates as A
from millrace.operators import spine as S


def response_rate(meal: DataFrame, users: DataFrame) -> DataFrame:
    return meal.agg(F.count("*").alias("answers")).join(F.broadcast(users.agg(F.count_distinct("user_id").alias("users")))).withColumn("rate", F.try_divide(F.col("answers"), F.col("users")))


def with_cohort(answers: DataFrame, users: DataFrame, cohort: str = "instrument_version") -> DataFrame:
    """answers with the cohort of their user, null for users without a record; a user of two cohorts has the one of the first record (by cohort)."""
    one = users.groupBy("user_id").agg(F.min(cohort).alias(cohort))
    return answers.join(one, "user_id", "left")


def share_by_cohort(users: DataFrame, col: str, value: str, cohort: str) -> DataFrame:
    """(cohort, n, share): of the distinct users of a cohort that have a value in the column, the share that has this one."""
    rows = users.where(F.col(col).isNotNull())
    n, hit = F.count_distinct("user_id"), F.count_distinct(F.when(F.col(col) == value, F.col("user_id")))
    return rows.groupBy(cohort).agg(n.alias("n"), F.try_divide(hit, n).alias("share"))


def gold_export(labels: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """labels with the text that each was given for; raises where a label has no row, or its row no text."""
    out = S.aligned(labels, rows.select(key, text), key)
    if n := out.where(F.col(text).isNull()).count():
        raise ValueError(f"{n} labels have no text")
    return out


def mix(users: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Gender, care or away-time shares: a fixed list of values in its order."""
    return A.counts_in_order(users, col, order)


def with_running_share(counts: DataFrame) -> DataFrame:
    """counts_in_order's rows with the share of this and all values before it."""
    return counts.withColumn("running", F.sum("share").over(W.partitionBy(F.lit(0)).orderBy("position")))


def top_by_cohort(users: DataFrame, col: str, cohort: str, k: int, pinned: list[str] = ()) -> DataFrame:
    """Distinct users by cohort of the k most frequent values over all cohorts, and of the pinned ones."""
    top = A.top_values(users, col, k, "user_id").select("value")
    if pinned:
        top = top.unionByName(users.sparkSession.createDataFrame([(p,) for p in pinned], "value string")).distinct()
    return users.join(F.broadcast(top), users[col] == F.col("value"), "left_semi").groupBy(cohort, F.col(col).alias("value")).agg(F.count_distinct("user_id").alias("n"))


def age_quartiles(users: DataFrame, age: str = "age_num") -> DataFrame:
    adult = F.when(F.col(age) >= 18, F.col(age))
    return users.agg(*[F.percentile(adult, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def concentration(users: DataFrame, col: str, k: int, skip: list[str] = ()) -> DataFrame:
    """One row: the share of the k most frequent values of a column among all that aren't skipped."""
    rows = users.where(~F.col(col).isin(list(skip) or [""]))
    return A.top_values(rows, col, k).agg(F.sum("share").alias("share"))


def by_department(users: DataFrame, city: str = "city_canon") -> DataFrame:
    """Users a department, by the folded name; cities without one are left out."""
    rows = users.sparkSession.createDataFrame([(c, d) for c, d in V.DEPARTMENT.items()], "__c string, department string").withColumn("__k", X.fold(F.col("__c")))
    return users.withColumn("__k", X.fold(F.col(city))).join(F.broadcast(rows), "__k").groupBy("department").agg(F.count("*").alias("n"))


def stages_by_cohort(rows: DataFrame, stage: str = "stage", cohort: str = "cohort") -> DataFrame:
    """Distinct users a cohort and stage, and their share of the cohort's first stage."""
    n = rows.groupBy(cohort, "stage_order", stage).agg(F.count_distinct("user_id").alias("n"))
    first = F.first("n").over(W.partitionBy(cohort).orderBy("stage_order", stage))
    return n.withColumn("of_first", F.col("n") / first)


def weekly_rating(facts: DataFrame, small: int = 20) -> DataFrame:
    """Mean rating and count a week, empty weeks included; weeks of few ratings are marked."""
    got = S.calendar(facts.where("rating_num is not null"), "ts", "week", F.avg("rating_num").alias("mean_rating"), F.count("*").alias("n"))
    return got.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("is_small", F.col("n") < small)


def quadrants(matrix: DataFrame) -> DataFrame:
    """The matrix with each cluster's quadrant: messages and need against their medians."""
    mid = matrix.agg(F.median("messages").alias("m"), F.median("unmet_need").alias("u"))
    side = lambda c, m: F.when(F.col(c) >= F.col(m), "high").otherwise("low")
    return matrix.join(F.broadcast(mid)).withColumn("quadrant_key", F.concat(side("messages", "m"), F.lit("_volume_"), side("unmet_need", "u"), F.lit("_need"))).drop("m", "u")


def negative_by_place(messages: DataFrame, place: str, tone: str, least: int = 20) -> DataFrame:
    """Negative share a place with so many messages at least."""
    return messages.where(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("n"), F.avg((F.col(tone) == "negative").cast("double")).alias("negative_share")).where(F.col("n") >= least)


def tone_by_group(messages: DataFrame, group: str, tone: str) -> DataFrame:
    """Shares of the tones a group."""
    return A.share(messages, group, tone)


def links(subclusters: DataFrame) -> DataFrame:
    """(cluster_id, subcluster_id, n_users): what flows from parents to children."""
    return subclusters.where("subcluster_id >= 0").select("cluster_id", "subcluster_id", "n_users")


def traced(quotes: DataFrame, messages: DataFrame, quote: str = "quote", text: str = "message") -> DataFrame:
    """quotes with whether each stands in the messages word for word; a dash needs none."""
    known = messages.select(F.col(text).alias(quote)).distinct().withColumn("__in", F.lit(True))
    return quotes.join(known, quote, "left").withColumn("traced", F.coalesce("__in", F.col(quote) == "—")).drop("__in")


def examples(sample: DataFrame, n: int, order: str, **equal) -> DataFrame:
    """The first n rows with all the given values; a None asks for nothing."""
    rows = sample
    for c, v in equal.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows.orderBy(order).limit(n)
