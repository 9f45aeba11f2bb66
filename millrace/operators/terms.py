"""Dictionary entities, probes and class-based TF-IDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import values as V

from . import dictionary as D

Entry = tuple[str, str, str]  # entity, kind, pattern


def check_registry(rows: Iterable[Entry]) -> list[str]:
    """Every problem of a registry: empty or doubled entries, unknown kinds, two kinds, bad or upper-case patterns."""
    import re

    found, kinds, seen = [], {}, set()
    for i, (entity, kind, pattern) in enumerate(rows):
        if not entity:
            found.append(f"row {i}: no entity")
        if kind not in ("institution", "procedure", "ignore"):
            found.append(f"row {i}: unknown kind {kind!r}")
        if kinds.setdefault(entity, kind) != kind:
            found.append(f"row {i}: {entity} has two kinds")
        if (entity, pattern) in seen:
            found.append(f"row {i}: doubled")
        seen.add((entity, pattern))
        if kind == "ignore":
            continue
        if not pattern:
            found.append(f"row {i}: no pattern")
        elif pattern != pattern.lower() and not re.search(r"\\[A-Z]", pattern):
            found.append(f"row {i}: upper case in a pattern")
        try:
            re.compile(pattern or "")
        except re.error as e:
            found.append(f"row {i}: {e}")
    return found


#: So many entities are tried one by one in one expression; more go through an automaton. Both give the same rows.
INLINE = 48


def by_entity(registry: list[Entry]) -> dict[tuple[str, str], list[str]]:
    """Patterns of each (entity, kind) that isn't to be ignored."""
    by: dict[tuple[str, str], list[str]] = {}
    for e, k, p in registry:
        if k != "ignore":
            by.setdefault((e, k), []).append(p)
    return by


def entities(text: Column, registry: list[Entry]) -> Column:
    """array<struct<entity,kind>>: an entity counts once a text, whatever patterns hit; one expression, no join."""
    key = X.fold(F.coalesce(text, F.lit("")))
    each = [F.when(key.rlike("(?U)" + "|".join(f"(?:{p})" for p in ps)), F.struct(F.lit(e).alias("entity"), F.lit(k).alias("kind"))) for (e, k), ps in by_entity(registry).items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<struct<entity:string,kind:string>>")


def with_entities(df: DataFrame, text: str, registry: list[Entry], out: str = "__entities") -> DataFrame:
    """df with the entities of its texts, as ``entities`` gives them, in time that a registry's size hardly touches."""
    by = by_entity(registry)
    if len(by) <= INLINE:
        return df.withColumn(out, entities(F.col(text), registry))
    keyed = df.withColumn("__key", X.fold(F.coalesce(F.col(text), F.lit(""))))
    return D.matched(keyed, "__key", list(by.items()), ["entity", "kind"], out).drop("__key")


def entity_rows(df: DataFrame, text: str, registry: list[Entry], *keep: str) -> DataFrame:
    return with_entities(df.where(F.col(text).isNotNull()), text, registry).select(*keep, F.inline("__entities"))


def entity_coverage(df: DataFrame, text: str, registry: list[Entry]) -> DataFrame:
    rows = with_entities(df.where(F.col(text).isNotNull()).select(text), text, registry)
    return rows.agg(F.count_if(F.size("__entities") > 0).alias("hit"), F.count("*").alias("total"))


def coverage_warning(hit: int, total: int, floor: float = V.ENTITY_WARN) -> str | None:
    """A warning where too few texts name an entity; never an error."""
    share = hit / total if total else 0.0
    return f"{100 * share:.1f} % of {total} texts name an entity, under {100 * floor:.0f} %" if share < floor else None


def candidates(df: DataFrame, user: str, text: str, key: str, registry: list[Entry], stop: list[str], min_users: int, top: int) -> DataFrame:
    """Words and adjacent pairs of texts without an entity: occurrences, users, first example."""
    free = with_entities(df.where(F.col(text).isNotNull()), text, registry).where(F.size("__entities") == 0)
    words = F.regexp_extract_all(X.fold(F.col(text)), F.lit(r"(\p{L}+)"), 1)
    good = lambda w: (F.length(w) >= 4) & ~w.isin(stop or [""])
    rows = free.select(user, key, words.alias("w")).withColumn("n", F.size("w"))
    pairs = F.when(F.col("n") < 2, F.array().cast("array<string>")).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 2, F.lit(0))), lambda i: good(F.col("w")[i]) & good(F.col("w")[i + 1])), lambda i: F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1])))
    terms = rows.select(user, key, F.explode(F.concat(F.filter("w", good), pairs)).alias("term"))
    got = terms.groupBy("term").agg(F.count("*").alias("n_msgs"), F.count_distinct(user).alias("n_users"), F.min(key).alias("example")).where(F.col("n_users") >= min_users)
    return got.orderBy(F.desc("n_users"), "term").limit(top)


def themes(df: DataFrame, user: str, text: str, probes: dict[str, str]) -> DataFrame:
    """(theme, n_messages, n_users), all probes in one pass."""
    hits = F.filter(F.array(*[F.when(X.probe(F.col(text), p), F.lit(t)) for t, p in probes.items()]), lambda x: x.isNotNull())
    return df.select(user, F.explode(hits).alias("theme")).groupBy("theme").agg(F.count("*").alias("n_messages"), F.count_distinct(user).alias("n_users"))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where a scan has fewer: what follows works hard on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ctfidf(df: DataFrame, label: str, text: str, stop: list[str], top: int = 10, min_docs: int = 5) -> DataFrame:
    """(label, rank, term, weight): term share of its class times log of classes over classes with the term.

    One pass over the texts: sorted tokens tell occurrences from documents, so one grouped count has both.
    """
    tokens = spread(df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text")))
    tokens = tokens.select("label", F.array_sort(X.term_tokens(F.col("text"), stop)).alias("t"))
    each = F.transform("t", lambda w, i: F.struct(w.alias("term"), F.when((i > 0) & (F.get(F.col("t"), i - 1) == w), 0).otherwise(1).alias("first")))
    counts = tokens.select("label", F.explode_outer(each).alias("x")).groupBy("label", F.col("x.term").alias("term")).agg(F.count("x").alias("tf"), F.sum("x.first").alias("df"))
    n = counts.agg(F.count_distinct("label").alias("k"))
    of_term = W.partitionBy("term")
    kept = counts.where("term is not null").withColumn("docs", F.sum("df").over(of_term)).withColumn("c", F.count("*").over(of_term)).where(F.col("docs") >= min_docs)
    total = kept.groupBy("label").agg(F.sum("tf").alias("total"))
    weighted = kept.join(total, "label").join(F.broadcast(n)).withColumn("weight", F.col("tf") / F.col("total") * F.log(F.col("k") / F.col("c")))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("weight"), "term")) - 1
    return weighted.withColumn("rank", rank).where(F.col("rank") < top).select("label", "rank", "term", "weight")


def exclusive(terms: DataFrame, label: str = "label") -> DataFrame:
    """Terms that one label alone has; a label without any keeps all of its own."""
    once = F.count("*").over(W.partitionBy("term")) == 1
    rows = terms.withColumn("once", once)
    return rows.withColumn("some", F.bool_or("once").over(W.partitionBy(label))).where("once or not some").drop("once", "some")


#: Parts that a class's messages are dealt to when they meet its terms.
PARTS = 200


def with_terms(messages: DataFrame, terms: DataFrame, label: str, text: str) -> DataFrame:
    """messages with hits: array of (rank, term, weight) of their class's terms that they hold; a message has one row.

    Each part of a class's messages meets a copy of the class's list, so a large class isn't one task's.
    """
    lists = terms.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))).alias("__terms"))
    lists = lists.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    dealt = spread(messages).withColumn("__part", F.pmod(F.xxhash64(*messages.columns), F.lit(PARTS)).cast("long"))
    both = dealt.join(lists, [label, "__part"]).drop("__part").withColumn("__low", F.lower(F.col(text)))
    return both.withColumn("hits", F.filter("__terms", lambda t: F.contains(F.col("__low"), F.lower(t.term)))).drop("__low", "__terms").where(F.size("hits") > 0)


def term_users(terms: DataFrame, messages: DataFrame, label: str, user: str, text: str) -> DataFrame:
    """Messages of each user that hold each of their class's terms, times its weight."""
    hit = with_terms(messages.select(label, user, text), terms, label, text).select(label, user, F.explode("hits").alias("h"))
    return hit.groupBy(label, user, F.col("h.term").alias("term")).agg((F.count("*") * F.first("h.weight")).alias("weight"))


def voices(messages: DataFrame, terms: DataFrame, label: str, user: str, seq: str, text: str, lo: int = 60, hi: int = 190, markers: dict | None = None, first: DataFrame | None = None) -> DataFrame:
    """A class's first message of middling length that holds its best possible term.

    Before the class's terms come its marker (markers: label to word) and its own terms that no other
    class has (first: as terms); a class without any message has a dash.
    """
    tiers = []
    if markers:
        spark = terms.sparkSession
        tiers.append(spark.createDataFrame([(k, 0, w, 0.0) for k, w in markers.items()], f"`{label}` {terms.schema[label].dataType.simpleString()}, rank int, term string, weight double"))
    tiers += [t.select(label, F.col("rank").cast("int").alias("rank"), "term", "weight") for t in (first, terms) if t is not None]
    ranked = None
    for tier, t in enumerate(tiers):
        t = t.withColumn("rank", F.struct(F.lit(tier).alias("tier"), F.col("rank").alias("rank")))
        ranked = t if ranked is None else ranked.unionByName(t)
    fit = with_terms(messages.where(F.length(text).between(lo, hi)).select(label, user, seq, text), ranked, label, text).withColumn("h", F.col("hits")[0])
    best = fit.groupBy(label).agg(F.min_by(F.struct(F.col(text).alias("quote"), F.col("h.term").alias("term")), F.struct(F.col("h.rank"), F.col(user), F.col(seq))).alias("v"))
    return terms.select(label).distinct().join(best, label, "left").select(label, F.coalesce("v.quote", F.lit("—")).alias("quote"), "v.term")


def top_terms(terms: DataFrame, label: str = "label", n: int = 6) -> DataFrame:
    """(label, top_terms): the first terms in one string."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("rank", "term"))), 1, n)
    return terms.groupBy(label).agg(F.array_join(F.transform(first, lambda x: x.term), ", ").alias("top_terms"))
