"""The queries of the text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, fmindex, importance, jaccard, lattice, packing, quality, secrets, simhash, toxicity, urls, warc
from .common import id_remainder, table

#: A tokenizers file, the same vocabulary as ranks, and its splitting pattern.
TOKENIZER = {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


PIECES = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.link_credentials(table(spark, sf_dir, "documents"))


def op3_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_offending", "offending")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **TOKENIZER)


def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.with_verdict(fmindex.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(id_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return lattice.score_texts(table(spark, sf_dir, "documents"), PIECES, held)


def op8_host_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, URL_RULES, urls.page_words(pages))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    stats = F.col(quality.STATS)
    judged = quality.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *[stats[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], quality.base_failed(stats).alias("base_failed"), F.col("__millrace_kept").alias("kept"))


def op10_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.render_digests(chat.fold_messages(chat.events_of(turns)))


def op11_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


def op12_sort_count_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_two_pass_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.with_digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.withColumnRenamed("n_units", "n")


CONTROL_SQL = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in (r"\\", *chat.CONTROL))

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
SPACED_SQL = WORDS_SQL.format(r"[^\x20\x09-\x0D]+")
PLAIN_SQL = WORDS_SQL.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACED_SQL} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, sha256(array_to_string(list_sort(s), chr(10))) AS c, s FROM s),
c AS (SELECT c, min(doc_id) AS doc_id FROM n WHERE n > 0 GROUP BY c),
r AS (SELECT n.* FROM n JOIN c USING (c, doc_id)),
t AS (SELECT doc_id, n, unnest(s) AS s FROM r),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
g AS (SELECT doc_id AS a, doc_id AS b FROM r UNION SELECT g.a, p.b FROM g JOIN p ON g.b = p.a),
m AS (SELECT a, min(b) AS component_id FROM g GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(m.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN c ON n.c = c.c AND n.n > 0 LEFT JOIN m ON c.doc_id = m.a""",
    "op6_fm_index_decontamination": f"""
WITH d AS (SELECT doc_id, {PLAIN_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {PLAIN_SQL} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM q),
o AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT d.*, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, z WHERE len(w) >= z.n)),
h AS (SELECT DISTINCT o.doc_id, o.i, o.n, q.item_id FROM o JOIN q ON o.n = q.n AND o.s = q.s),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "op10_event_sourced_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROL_SQL}')) AS n,
    length(role) + len(regexp_extract_all(role, '{CONTROL_SQL}')) AS role_n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN n + 18 WHEN 'assistant' THEN n + 6 WHEN 'system' THEN n + 17
    ELSE n + role_n + 8 + 9 + 9 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_sort_count_resampling": f"""
WITH RECURSIVE k AS (SELECT i AS i, i AS c, 0 AS r FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM k WHERE r < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM k WHERE r = 8),
d AS (SELECT doc_id, {PLAIN_SQL} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
g AS (SELECT unnest({PLAIN_SQL}) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM f UNION SELECT w FROM g),
y AS (SELECT w, list_transform(range(0, CAST(len(hex(w)) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)) AS y FROM v),
b AS (SELECT w, xor(list_reduce(y, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM y, tab),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM g JOIN b USING (w) GROUP BY b),
n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM f) AS s, (SELECT CAST(count(*) AS DOUBLE) FROM g) AS t),
z AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (n.s + 10000) / ((s.s + 1.0::DOUBLE) * (n.t + 10000)))) AS BIGINT) AS gain FROM n, s LEFT JOIN t USING (b)),
x AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN b USING (w) JOIN z USING (b) GROUP BY doc_id),
q AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM q),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM e WHERE n_features >= 20)
SELECT e.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= able * 10 // 100 THEN rank END AS rank
FROM e LEFT JOIN r USING (doc_id)""",
    "op13_two_pass_fill_in_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
n AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1:], '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_secret_links, op3_noisy_or_toxicity, op4_warc_derivatives, op5_sum_of_squares_packing, op6_fm_index_decontamination,
    op7_lattice_likelihood, op8_host_segmentation, op9_decision_list, op10_event_sourced_chat, op11_anchor_simhash, op12_sort_count_resampling,
    op13_two_pass_fill_in_middle,
)}
