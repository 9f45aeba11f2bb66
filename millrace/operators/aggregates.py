"""Shares, funnels, priority matrix, agreement and association: grouped aggregates in two phases, no row loops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import values as V


def share(df: DataFrame, *keys: str) -> DataFrame:
    """Share of rows by the last key, within the others; null keys are left out."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    over = W.partitionBy(*(keys[:-1] or [F.lit(0)]))
    return n.withColumn("share", F.col("n") / F.sum("n").over(over))


def top_or_rest(df: DataFrame, col: str, k: int, rest: str = "Other") -> DataFrame:
    """col with all but its k most frequent values as rest; ties by value."""
    top = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), col).limit(k).select(col, F.lit(True).alias("__top"))
    return df.join(F.broadcast(top), col, "left").withColumn(col, F.when(F.col("__top"), F.col(col)).otherwise(rest)).drop("__top")


def zscore(c: str) -> Column:
    """Over all rows of a small frame; 0 where there is no spread."""
    w = W.partitionBy(F.lit(0))
    sd = F.stddev_pop(c).over(w)
    return F.when(sd > 0, (F.col(c) - F.avg(c).over(w)) / sd).otherwise(F.lit(0.0))


def mean_of(*cols: str) -> Column:
    """Mean of those that are not null."""
    a = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def funnel(per_user: DataFrame, n: str, surveyed: int) -> DataFrame:
    """Stages by message count (per_user: one row a user, n may be null), conversion to the stage before."""
    heavy = F.coalesce(F.ceil(F.percentile(n, F.lit(0.9))), F.lit(2))
    one = per_user.agg(F.count("*").alias("arrived"), F.count_if(F.col(n) >= 1).alias("one"), F.count_if(F.col(n) >= 2).alias("two"), heavy.alias("h"))
    count_h = per_user.join(F.broadcast(one.select("h")), F.col(n) >= F.col("h")).agg(F.count("*").alias("heavy"))
    row = one.join(F.broadcast(count_h))
    stages = F.array(*[F.struct(F.lit(i).alias("stage_order"), name.alias("stage"), value.cast("long").alias("n")) for i, (name, value) in enumerate([
        (F.lit("Arrived"), F.col("arrived")), (F.lit("Sent a message"), F.col("one")), (F.lit("Sent 2 or more messages"), F.col("two")),
        (F.concat(F.lit("Sent "), F.col("h").cast("string"), F.lit(" or more messages")), F.col("heavy")), (F.lit("Answered the survey"), F.lit(surveyed)),
    ])])
    rows = row.select(F.inline(stages))
    before = F.lag("n").over(W.partitionBy(F.lit(0)).orderBy("stage_order"))
    return rows.withColumn("conversion", F.when(F.col("stage_order") < 4, F.try_divide(F.col("n"), before)))


def size_ranked(groups: DataFrame, key: str, n: str) -> DataFrame:
    """display_order by size, ties by key; groups are few."""
    return groups.withColumn("display_order", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(n), key)) - 1)


def confusion(df: DataFrame, human: str, model: str, labels: list[str]) -> DataFrame:
    """Counts over the full grid of labels, zero cells included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "human string, model string")
    got = df.groupBy(F.col(human).alias("human"), F.col(model).alias("model")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(got, ["human", "model"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, expected and Cohen's kappa."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("label"), "n"), F.struct(F.lit(1).alias("side"), F.col("b").alias("label"), "n"))).alias("s")).select("s.*")
    margins = sides.groupBy("label").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("y"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = margins.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    row = seen.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("p_o"), (F.col("xy") / (F.col("n").cast("double") * F.col("n"))).alias("p_e"))
    same = F.when(F.col("p_o") >= 1, F.lit(1.0)).otherwise(F.lit(float("nan")))
    return row.withColumn("kappa", F.when(1 - F.col("p_e") < 1e-12, same).otherwise((F.col("p_o") - F.col("p_e")) / (1 - F.col("p_e"))))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi-square (uncorrected), degrees of freedom, least expected count, bias-corrected Cramer's V."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = (cells.groupBy(k).agg(F.sum("o").alias(f"n{k}")) for k in "ab")
    total = cells.agg(F.sum("o").alias("n"))
    # sum of (o - e)^2 / e over all cells, empty ones too, is n * (sum of o^2 / (row * column) - 1)
    inner = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("na").cast("double") * F.col("nb"))).alias("s"))
    shape = rows.agg(F.count("*").alias("r"), F.min("na").alias("lo_a")).join(F.broadcast(cols.agg(F.count("*").alias("k"), F.min("nb").alias("lo_b"))))
    one = inner.join(F.broadcast(total)).join(F.broadcast(shape)).withColumn("n", F.col("n").cast("double"))
    one = one.withColumn("chi2", F.col("n") * (F.col("s") - 1)).withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1)).withColumn("least_expected", F.col("lo_a") * F.col("lo_b") / F.col("n"))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - F.col("dof") / (F.col("n") - 1))
    rc, kc = (F.col(x) - (F.col(x) - 1) * (F.col(x) - 1) / (F.col("n") - 1) for x in ("r", "k"))
    den = F.least(rc - 1, kc - 1)
    one = one.withColumn("cramers_v", F.when(den <= 0, F.lit(0.0)).otherwise(F.sqrt(phi / den)))
    small = (F.col("dof") == 1) & (F.col("least_expected") < 5)
    return one.select("chi2", "dof", "least_expected", "cramers_v", F.when(small, "fisher").otherwise("chi2").alias("test"), ((F.col("cramers_v") >= 0.1) & (F.col("least_expected") >= 5)).alias("meaningful"))


def chi2_tail(x: float, dof: int) -> float:
    """Chance of a chi-square over x: the upper regularised gamma function, by series or continued fraction."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d, c = 1 / (n * d + b), b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def association_test(df: DataFrame, a: str, b: str) -> dict:
    """association's row with p: of the chi-square, or of Fisher's exact test for a 2x2 table with a small expected count."""
    row = association(df, a, b).first().asDict()
    if row["test"] == "fisher":
        cells = {(r.a, r.b): r.n for r in df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).collect()}  # four at most
        xs, ys = sorted({x for x, _ in cells}), sorted({y for _, y in cells})
        row["p"] = fisher_exact(*[cells.get((x, y), 0) for x in xs for y in ys])
    else:
        row["p"] = chi2_tail(row["chi2"], row["dof"]) if row["chi2"] is not None and row["dof"] else None
    return row


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table."""

    def lp(x: int) -> float:
        g = math.lgamma
        return g(a + b + 1) + g(c + d + 1) + g(a + c + 1) + g(b + d + 1) - g(a + b + c + d + 1) - g(x + 1) - g(a + b - x + 1) - g(a + c - x + 1) - g(d - a + x + 1)

    here = lp(a)
    return min(1.0, sum(math.exp(lp(x)) for x in range(max(0, a - d), min(a + b, a + c) + 1) if lp(x) <= here + 1e-7))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share, clamped to 0 and 1; NaN without rows."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    none = F.lit(float("nan"))
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(none)


def probe_report(gold: DataFrame, stratum: str, label: str, n_unmatched: int, gate: float = 0.9) -> DataFrame:
    """Precision by census of matched rows; recall from the miss rate of sampled unmatched ones, scaled up."""
    count = lambda s, v: F.count_if((F.col(stratum) == s) & (F.col(label) == v)).alias(f"{s}_{v}")
    one = gold.agg(count("matched", "gap"), count("matched", "not_gap"), count("unmatched", "gap"), count("unmatched", "not_gap"))
    one = one.select(F.col("matched_gap").alias("tp"), F.col("matched_not_gap").alias("fp"), F.col("unmatched_gap").alias("miss"), (F.col("unmatched_gap") + F.col("unmatched_not_gap")).alias("sampled"))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    lo, hi = wilson(F.col("miss"), F.col("sampled"))

    def recall(rate: Column) -> Column:
        return F.try_divide(F.col("tp").cast("double"), F.col("tp") + rate * n_unmatched)

    rate = F.coalesce(F.try_divide(F.col("miss"), F.col("sampled")), F.lit(0.0))
    out = one.withColumn("precision", precision).withColumn("recall", recall(rate)).withColumn("recall_lo", recall(hi)).withColumn("recall_hi", recall(lo))
    return out.withColumn("is_floor", F.col("miss") > 0).withColumn("passed", F.coalesce(F.col("precision") >= gate, F.lit(False)))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labelings."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    both = cells.agg(F.sum(pairs).alias("both"), F.sum("n").alias("total"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs).alias(f"by_{k}"))
    one = both.join(F.broadcast(side("a"))).join(F.broadcast(side("b")))
    every = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("by_a") * F.col("by_b") / every
    most = (F.col("by_a") + F.col("by_b")) / 2
    return one.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def quotable(rate: Column, ok: Column) -> Column:
    """A rate is null where its gate failed; counts stay."""
    return F.when(ok, rate)


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, pct) of values that are not null, empty or NaN."""
    aggs = [F.avg(F.when(F.col(c).isNull() | F.lower(F.col(c).cast("string")).isin("", "nan"), 0.0).otherwise(100.0)).alias(c) for c in cols]
    return df.agg(*aggs).unpivot([], cols, "field", "pct")


def pii_scan(df: DataFrame, pattern: str, skip: list[str] = ()) -> DataFrame:
    """(field, hit) of string columns, in one pass."""
    cols = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in skip]
    return df.agg(*[F.coalesce(F.bool_or(F.col(c).rlike(pattern)), F.lit(False)).alias(c) for c in cols]).unpivot([], cols, "field", "hit")


def binarised(c: Column) -> Column:
    return F.when(F.lower(c) == "negative", "negative").otherwise("not_negative")


def agreement_report(df: DataFrame, human: str, model: str, gate: float) -> DataFrame:
    """One row: n, accuracy, kappa, and whether its gate lets rates be quoted."""
    k = kappa(df, human, model)
    return k.select("n", F.col("p_o").alias("accuracy"), "kappa", F.coalesce((F.col("kappa") >= gate) & ~F.isnan("kappa"), F.lit(False)).alias("gate_passed"))


def tone_report(df: DataFrame, human: str, model: str, gate: float = V.TONE_GATE) -> DataFrame:
    """agreement_report of negative against the rest."""
    return agreement_report(df.select(binarised(F.col(human)).alias("human"), binarised(F.col(model)).alias("model")), "human", "model", gate)


def emotion_report(df: DataFrame, human: str, model: str, gate: float = V.EMOTION_GATE) -> DataFrame:
    return agreement_report(df.select(F.col(human).cast("string").alias("human"), F.col(model).cast("string").alias("model")), "human", "model", gate)


def precision_recall(df: DataFrame, human: str, model: str, label: str) -> DataFrame:
    hit = F.count_if((F.col(human) == label) & (F.col(model) == label))
    return df.agg(F.try_divide(hit, F.count_if(F.col(model) == label)).alias("precision"), F.try_divide(hit, F.count_if(F.col(human) == label)).alias("recall"))


def counts_in_order(df: DataFrame, col: str, order: list[str], distinct: str | None = None) -> DataFrame:
    """(value, position, n, share): counts of the values of a fixed list, those that don't occur as 0; shares of all that occur."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    got = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(n.alias("n"))
    every = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], "value string, position int")
    total = got.agg(F.sum("n").alias("total"))
    return F.broadcast(every).join(got, "value", "left").join(F.broadcast(total)).select("value", "position", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")).alias("share"))


def top_values(df: DataFrame, col: str, k: int, by: str | None = None) -> DataFrame:
    """(value, n, share) of the k most frequent values, by rows or distinct by; ties by value."""
    n = F.count_distinct(by) if by else F.count("*")
    got = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(n.alias("n"))
    return got.join(F.broadcast(got.agg(F.sum("n").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "value").limit(k)


def cluster_coverage(users: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: the share of users with a cluster; 0 without users."""
    return users.agg(F.coalesce(F.avg((F.col(cluster).isNotNull() & (F.col(cluster) != V.NO_CLUSTER)).cast("double")), F.lit(0.0)).alias("coverage"))


def least_subcluster(subclusters: DataFrame, floor: int = V.LEAST_SUBCLUSTER) -> DataFrame:
    """One row: the fewest users of a child of a split parent; the floor itself where nothing was split."""
    return subclusters.where("subcluster_id >= 0 and is_split").agg(F.coalesce(F.min("n_users"), F.lit(floor)).cast("long").alias("least"))


def qa_checks(responses: DataFrame, messages: DataFrame, meal: DataFrame, pattern: str) -> DataFrame:
    """(check, passed): no personal data in either table, the spine's counts add up, one answer a respondent."""
    clean = lambda df: pii_scan(df, pattern).agg((~F.coalesce(F.bool_or("hit"), F.lit(False))).alias("ok"))
    spine = messages.groupBy("user_id").agg(F.first("n_msgs_user").alias("n"), F.count("*").alias("k")).agg((F.coalesce(F.sum("n"), F.lit(0)) == F.coalesce(F.sum("k"), F.lit(0))).alias("ok"))
    once = meal.groupBy("user_id").agg(F.count("*").alias("k")).agg((F.coalesce(F.max("k"), F.lit(1)) <= 1).alias("ok"))
    out = None
    for name, one in (("pii_responses", clean(responses)), ("pii_messages", clean(messages)), ("spine_adds_up", spine), ("one_answer_each", once)):
        row = one.select(F.lit(name).alias("check"), F.col("ok").alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def schema_stats(df: DataFrame, ts: str) -> DataFrame:
    """One row: rows, columns, and the share of times that can be read."""
    ok = F.try_to_timestamp(F.col(ts).cast("string")).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("ts_parse_rate"))
