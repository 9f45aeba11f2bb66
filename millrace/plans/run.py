"""From raw frames to published tables in one call.

Stages form a graph: each is named by its own name, its settings and the keys of what it reads,
down to the contents of the raw frames. A stage's result is a table under that name, so a second
run reads what hasn't changed and works out the rest; a lost session goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import aggregates as A
from millrace.operators import clustering as K
from millrace.operators import neighbours as N
from millrace.operators import spine as S
from millrace.operators import terms as T
from millrace.plans import gold
from millrace.sources import files
from millrace.sources.publish import Folders, named


@dataclass(frozen=True)
class Held:
    """A frame and the key of what it was made of."""

    frame: DataFrame
    key: str


def content_key(df: DataFrame) -> str:
    """Names a frame by its columns and rows, whatever their order: one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[named(c) for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(json.dumps([df.schema.simpleString(), one.n, str(one.h)]).encode()).hexdigest()


class Stages:
    """Stages whose results are kept under root."""

    def __init__(self, spark: SparkSession, root: str, told: Callable[[str, float, int, bool], None] | None = None):
        self.spark, self.root, self.told = spark, root.rstrip("/"), told
        self.folders = Folders(spark, root)

    def raw(self, df: DataFrame) -> Held:
        return Held(df, content_key(df))

    def __call__(self, name: str, make: Callable[..., DataFrame], *inputs: Held, **settings) -> Held:
        """The stage's table: read if it was written, else made of the inputs' frames and written. told: name, seconds, rows, whether it was there."""
        key = hashlib.sha256(json.dumps([name, settings, [i.key for i in inputs]], sort_keys=True, default=str).encode()).hexdigest()
        path, began = f"{self.root}/{name}-{key[:24]}", time.time()
        there = self.folders.exists(f"{path}/_SUCCESS")
        if not there:
            self.spark.sparkContext.setJobDescription(name)
            try:
                make(*[i.frame for i in inputs], **settings).write.mode("overwrite").parquet(path)
            finally:
                self.spark.sparkContext.setJobDescription(None)
        out = self.spark.read.parquet(path)
        if self.told:
            self.told(name, time.time() - began, out.count(), there)
        return Held(out, key)


@dataclass(frozen=True)
class Settings:
    salt: str
    own_words: list[str] = field(default_factory=list)
    questions: dict[str, str] = field(default_factory=dict)
    gap: str = "$^"
    handoff: str = "$^"
    registry: list[T.Entry] = field(default_factory=list)
    probes: dict[str, str] = field(default_factory=dict)
    markers: list[tuple[str, str]] = field(default_factory=list)  # word, cluster's name
    stop: list[str] = field(default_factory=lambda: list(V.STOP))
    first_names: list[str] = field(default_factory=list)
    bot_names: list[str] = field(default_factory=list)
    ks: tuple[int, ...] = tuple(range(3, 13))
    k: int | None = None  # instead of the most that is stable
    boots: int = 30
    least: int = V.LEAST_SUBCLUSTER
    seed: int = 0


def hashed_vectors(docs: DataFrame, size: int = 256) -> DataFrame:
    """(user_id, vector) of documents: hashed word weights of length 1. A model's vectors may stand in their place."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    if docs.isEmpty():
        return docs.select("user_id", F.array().cast("array<double>").alias("vector"))
    words = docs.select("user_id", T.X.term_tokens(F.col("doc"), []).alias("words"))
    counted = HashingTF(numFeatures=size, inputCol="words", outputCol="counts").transform(words)
    weighed = IDF(inputCol="counts", outputCol="weights").fit(counted).transform(counted)
    return Normalizer(inputCol="weights", outputCol="unit").transform(weighed).select("user_id", vector_to_array("unit").alias("vector"))


def terms_by(docs: DataFrame, of: DataFrame, label: str, stop: list[str], least_docs: int = 5) -> DataFrame:
    return T.ctfidf(docs.join(of.select("user_id", label), "user_id"), label, "doc", stop, 40, least_docs).withColumnRenamed("label", label)


def with_names(terms: DataFrame, markers: list[tuple[str, str]]) -> DataFrame:
    """(cluster_id, cluster_name, name_is_provisional): by the first marker among a cluster's terms, 40 a cluster at most."""
    lists = {r.cluster_id: r.words for r in terms.where("term is not null").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("words")).collect()}
    named_by = K.name_by_marker(lists, list(markers))
    kind = terms.schema["cluster_id"].dataType.simpleString()
    return terms.sparkSession.createDataFrame([(c, n, p) for c, (n, p) in named_by.items()], f"cluster_id {kind}, cluster_name string, name_is_provisional boolean")


def children(vectors: DataFrame, labels: DataFrame, least: int, boots: int, seed: int) -> DataFrame:
    """(user_id, subcluster_id, is_split)."""
    made = K.split_parents(vectors.join(labels, "user_id"), "user_id", "vector", "cluster_id", least, boots=boots, seed=seed)
    parent = F.floor(F.col("subcluster_id") / 10)
    split = made.groupBy(parent.alias("parent")).agg((F.count_distinct("subcluster_id") > 1).alias("is_split"))
    return made.withColumn("parent", parent).join(F.broadcast(split), "parent").select("user_id", "subcluster_id", "is_split")


def gap_report(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """probe_report of labelled replies (stratum, human_label); the miss rate is scaled by the distinct replies that the probe doesn't match."""
    once = turns.groupBy("reply_key").agg(F.bool_or("gap_flag").alias("gap_flag"))
    return A.probe_report(labels, "stratum", "human_label", once.where("not gap_flag").count())


def facts_of(spark: SparkSession, scan: DataFrame, k: int, names: DataFrame, members: DataFrame, turns: DataFrame | None, probe: DataFrame | None, least: int) -> dict[str, object]:
    """What a run says of itself; one row a figure in meta_run."""
    stable = scan.where(F.col("k") == k).first()
    kids = members.where("subcluster_id >= 0").agg(F.count_distinct("subcluster_id"), F.count_distinct(F.when(F.col("is_split"), F.floor(F.col("subcluster_id") / 10)))).first()
    out = {"chosen_k": k, "stability_ari": round(stable.ari_mean, 3) if stable and stable.ari_mean is not None else None, "n_provisional_names": names.where("name_is_provisional").count(), "n_subclusters": kids[0], "n_parents_split": kids[1], "subcluster_min_users": least, "nlp_included": True}
    seen = turns.agg(F.count("*"), F.count_distinct("user_id")).first() if turns is not None else None
    out |= {"bot_log_present": seen is not None, "gap_gold_present": probe is not None, "coverage_gap_quotable": False}
    if seen is not None:
        out |= {"bot_log_turns": seen[0], "bot_log_users": seen[1]}
    if probe is not None:
        p = probe.first()
        short = lambda x: None if x is None else round(x, 3)
        out |= {"coverage_gap_quotable": p.passed, "gap_probe_precision": short(p.precision), "gap_probe_recall": short(p.recall)}
    return out


def tables_of(stages: Stages, responses: DataFrame, meal: DataFrame, log: DataFrame | None, s: Settings, vectors_of: Callable[[DataFrame], DataFrame] = hashed_vectors, tones: DataFrame | None = None, gap_labels: DataFrame | None = None, gold_tone: DataFrame | None = None, gold_emotion: DataFrame | None = None) -> dict[str, DataFrame]:
    """All 32 tables of raw responses, survey answers and bot log; a table without input is empty.

    vectors_of: vectors of user documents, from a model where there is one; tones: a model's
    (message_id, sentiment, emotion); gap_labels: (stratum, human_label) of labelled replies.
    """
    spark = stages.spark
    r = stages("responses", lambda f, salt, own: gold.load_responses(f, salt, own), stages.raw(responses), salt=s.salt, own=s.own_words)
    m = stages("messages", lambda f: S.message_spine(f, "user_id", ["ts", "record"], "Messages"), r)
    a = stages("answers", lambda f, salt, questions: gold.load_meal(f, salt, questions), stages.raw(meal), salt=s.salt, questions=s.questions)
    t = stages("turns", lambda f, salt, gap, handoff: files.bot_log(f, salt, gap, handoff), stages.raw(log), salt=s.salt, gap=s.gap, handoff=s.handoff) if log is not None else None
    docs = stages("documents", lambda f: S.user_documents(f, "user_id", "seq", "message"), m)
    vectors = stages("vectors", lambda f, by: vectors_of(f), docs, by=getattr(vectors_of, "__qualname__", repr(vectors_of)))
    scan = stages("scan", lambda f, ks, boots, seed: K.k_scan(f, "user_id", "vector", ks, boots, seed=seed), vectors, ks=list(s.ks), boots=s.boots, seed=s.seed)
    k = s.k or (1 if vectors.frame.isEmpty() else K.choose_k(scan.frame))
    labels = stages("labels", lambda f, k, seed: K.kmeans(f, "user_id", "vector", k, seed), vectors, k=k, seed=s.seed)
    terms = stages("terms", lambda d, c, stop: terms_by(d, c, "cluster_id", stop), docs, labels, stop=s.stop)
    names = stages("names", lambda f, markers: with_names(f, markers), terms, markers=s.markers)
    members = stages("members", children, vectors, labels, least=s.least, boots=min(s.boots, 20), seed=s.seed)
    subterms = stages("subterms", lambda d, c, stop: terms_by(d, c, "subcluster_id", stop), docs, members, stop=s.stop)
    points = stages("points", lambda f, seed: N.layout(f, "user_id", "vector", seed=seed), vectors, seed=s.seed)
    probe = gap_report(t.frame, gap_labels) if t is not None and gap_labels is not None else None
    none = lambda schema: spark.createDataFrame([], schema)
    labelled = "message_id string, human string, model string"
    more = gold.Insight(
        members=members.frame, names=names.frame, terms=terms.frame, subterms=subterms.frame, points=points.frame, gap_probe=probe, registry=s.registry, probes=s.probes, first_names=s.first_names, bot_names=s.bot_names,
        gold_tone=gold_tone if gold_tone is not None else none(labelled), gold_emotion=gold_emotion if gold_emotion is not None else none(labelled),
        markers={c.cluster_id: w for c in names.frame.where("not name_is_provisional").collect() for w, n in s.markers if n == c.cluster_name},
        facts=facts_of(spark, scan.frame, k, names.frame, members.frame, t.frame if t is not None else None, probe, s.least),
    )
    out = gold.build(gold.Dataset(r.frame, m.frame, a.frame, t.frame if t is not None else None), labels.frame, tones, more)
    return {"nlp_emergent_themes": none("theme string, n_messages long, n_users long")} | out


def run(spark: SparkSession, root: str, out: str, responses: DataFrame, meal: DataFrame, log: DataFrame | None, settings: Settings, told: Callable[..., None] | None = None, **more) -> DataFrame:
    """Stages under root, tables published to out, all or none; returns the manifest. told: name, seconds, rows and, of a stage, whether it was there."""
    tables = tables_of(Stages(spark, root, told), responses, meal, log, settings, **more)
    return gold.write(tables, out, told=told)
