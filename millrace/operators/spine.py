"""Message spine, bot turns and per-user reductions. Every order has a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X


def message_spine(records: DataFrame, user: str, order: list[str], blob: str) -> DataFrame:
    """One row per line of blob that is no noise: user_id, seq (0-based), n_msgs_user, message, message_id."""
    lines = records.select(F.col(user).cast("string").alias("user_id"), *order, F.posexplode(F.split(X.redact_digits(blob if isinstance(blob, Column) else F.col(blob)), "\n")).alias("pos", "line"))
    kept = lines.withColumn("message", X.strip("line")).where(~X.is_noise(F.col("message")))
    each = W.partitionBy("user_id")
    seq = (F.row_number().over(each.orderBy(*[F.col(c).asc_nulls_last() for c in order], "pos")) - 1).cast("long")
    out = kept.withColumn("seq", seq).withColumn("n_msgs_user", F.count("*").over(each))
    return out.select("user_id", *order, "seq", "n_msgs_user", "message", X.message_key(F.col("user_id"), F.col("seq"), F.col("message")).alias("message_id"))


def bot_turns(log: DataFrame, user: str, order: str, role: str, text: str) -> DataFrame:
    """Replies with the user's message before them: user_id, msg_turn, user_message, bot_reply, reply_key, turn_id."""
    before = F.lag(F.when(F.col(role) == "user", F.col(text))).over(W.partitionBy(user).orderBy(order))
    rows = log.withColumn("user_message", before).where(F.col(role) == "assistant")
    key = X.reply_key(F.col(text))
    return rows.select(F.col(user).cast("string").alias("user_id"), F.col(order).alias("msg_turn"), "user_message", F.col(text).alias("bot_reply"), key.alias("reply_key"), X.turn_key(F.col(user), F.col(order), key).alias("turn_id"))


def latest_per(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key; a row without a time wins, as it sorts last."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.col(ts).desc_nulls_first(), F.col(tie).desc()))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def first_row_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def first_value(col: str, *order: str) -> Column:
    """First value of col that is not null, by order."""
    return F.min_by(F.when(F.col(col).isNotNull(), F.col(col)), F.when(F.col(col).isNotNull(), F.struct(*order)))


def with_labels(df: DataFrame, labels: DataFrame, key: str, label: str, default: int) -> DataFrame:
    return df.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def member_flag(df: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    ids = known.select(key).distinct().withColumn("__in", F.lit(True))
    return df.join(ids, key, "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")


def conversations_in_full(messages: DataFrame, user: str, order: str, text: str, tone: str) -> DataFrame:
    """One row per user: text in order, joined by blank lines; dominant tone, ties alphabetical."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x.t)
    return messages.groupBy(user).agg(F.array_join(parts, "\n\n").alias("conversation"), F.mode(tone, True).alias("dominant"), F.count("*").alias("n_messages"), F.min_by(text, order).alias("first_message"), F.max_by(text, order).alias("last_message"))


def calendar(df: DataFrame, ts: str, unit: str, *aggs: Column) -> DataFrame:
    """Aggregates per bucket, empty buckets included."""
    b = F.date_trunc(unit, F.col(ts)).alias("bucket")
    got = df.where(F.col(ts).isNotNull()).groupBy(b).agg(*aggs)
    step = F.expr(f"interval 1 {unit}")
    every = got.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", step)).alias("bucket"))
    return every.join(got, "bucket", "left")


def regrain(df: DataFrame, ts: str, unit: str, *keys: str) -> DataFrame:
    """Counts per bucket and key, so that a filter on a key's table reaches the rows; no empty buckets."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket"), *keys).agg(F.count("*").alias("n"))


def rolling3(df: DataFrame, key: list[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(W.partitionBy(*key).orderBy(order).rowsBetween(-1, 1)))


def sample_per_bucket(df: DataFrame, bucket: list[str], order: str, k: int, keep: Column) -> DataFrame:
    """At most k rows a bucket of those that keep lets through, in order: dropped rows are replaced."""
    rows = df.where(keep)
    for b in bucket:
        rows = rows.where(F.col(b).isNotNull())
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*bucket).orderBy(order))).where(F.col("__rn") <= k).drop("__rn")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at most, in proportion and one a stratum as far as n goes, those whose hashed key is least."""
    total = df.where(F.col(stratum).isNotNull())
    w = W.partitionBy(stratum)
    sizes = total.groupBy(stratum).agg(F.count("*").alias("__n"))
    all_n = sizes.agg(F.sum("__n")).first()[0] or 1
    quota = sizes.withColumn("__q", F.greatest(F.lit(1), F.floor(F.col("__n") * n / F.lit(all_n))))
    order = [F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]
    # the least of each part first, so that no task ranks a whole stratum
    parts = total.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(200))).join(quota, stratum)
    few = parts.withColumn("__rn", F.row_number().over(W.partitionBy(stratum, "__part").orderBy(*order))).where("__rn <= __q")
    drawn = few.withColumn("__rn", F.row_number().over(w.orderBy(*order))).where("__rn <= __q")
    if (quota.agg(F.sum("__q")).first()[0] or 0) > n:  # many small strata: each one's first row before any second one
        drawn = drawn.orderBy(F.col("__rn") > 1, *order).limit(n)
    return drawn.drop("__rn", "__q", "__n", "__part")


def gate_unmatched(left: DataFrame, right: DataFrame, key: str) -> int:
    """How many keys of left have no row in right; callers raise if any."""
    return left.join(right, key, "left_anti").count()


def aligned(gold: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """gold joined with rows by key; raises if a key of gold is unknown, or stands twice on either side."""
    if n := gate_unmatched(gold, rows, key):
        raise ValueError(f"{n} labels have no row")
    for name, df in (("labels", gold), ("rows", rows.join(gold.select(key), key, "left_semi"))):
        if n := df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).count():
            raise ValueError(f"{n} keys stand twice among the {name}")
    return gold.join(rows, key)


def user_documents(messages: DataFrame, user: str, order: str, text: str) -> DataFrame:
    """(user, doc, n_msgs): a user's messages, white space collapsed, empty ones dropped, in one text."""
    rows = messages.withColumn("__t", X.squash(F.col(text))).where(F.col("__t") != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__t").alias("t")))), lambda x: x.t)
    return rows.groupBy(user).agg(F.array_join(parts, " ").alias("doc"), F.count("*").alias("n_msgs"))
