"""Queries of the published tables and of the questions asked of them, bound to the test tables, with their SQL.

Bindings as in ``catalog``; ``events`` give clusters, ratings (value of purchases) and tones (errors are negative).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import ENTITY, EVENTS, FUN, GOLD, REGISTRY, SPINE, TFIDF, TONED, TURNS, USERS, case_sql, events_of, fold_sql, gold_of, per_user_of, pick, pick_sql, q, query, read, spine_of, terms_of, toned, turns_of, users_of
from millrace.functions import text as X
from millrace.functions import values as V
from millrace.operators import aggregates as A
from millrace.operators import spine as S
from millrace.operators import terms as T
from millrace.plans import questions as Q
from millrace.plans import tables as P

PLACES = " UNION ALL ".join(f"SELECT {q(c)} AS city_canon, {q(d)} AS department, {V.CITY_PLACE[c][0]}::DOUBLE AS lat, {V.CITY_PLACE[c][1]}::DOUBLE AS lon" for c, d in V.DEPARTMENT.items())


@query(PLACES)
def dim_city(spark, d):
    return P.dim_city(spark)


@query(" UNION ALL ".join("SELECT " + ", ".join(f"{q(v)} AS {c}" for c, v in zip(("quadrant_key", "label", "action", "axis_x", "axis_y", "color_hex"), row, strict=True)) + f", {i} AS display_order" for i, row in enumerate(P.QUADRANTS)))
def dim_quadrant(spark, d):
    return P.dim_quadrant(spark)


@query(f"""WITH {USERS}, g AS (SELECT cluster_id, count(*) AS n_users, CAST(sum(c_nationkey) AS BIGINT) AS n_messages FROM u WHERE cluster_id >= 0 GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n_users DESC, cluster_id) - 1 AS display_order FROM g)
SELECT cluster_id, n_users, n_messages, display_order, {pick_sql(P.PALETTE, 'display_order')} AS color_hex, 'Cluster ' || cluster_id AS cluster_name, true AS name_is_provisional, '' AS top_terms FROM r
UNION ALL SELECT -1, NULL, NULL, (SELECT count(*) FROM g), {q(P.NO_TEXT_COLOUR)}, 'No conversation text', false, ''""")
def dim_cluster(spark, d):
    return P.dim_cluster(users_of(spark, d).withColumn("n_msgs_user", F.col("c_nationkey")))


SHADE = "printf('%02x', CAST(round(CAST('0x' || of[{0}:{0} + 1] AS INT) + (255 - CAST('0x' || of[{0}:{0} + 1] AS INT)) * 0.06 * place) AS BIGINT))"
SUBS = f"{USERS}, sb AS (SELECT c_custkey AS user_id, cluster_id * 10 + c_custkey % 3 AS subcluster_id FROM u WHERE cluster_id >= 0)"


@query(f"""WITH {SUBS}, g AS (SELECT subcluster_id, count(*) AS n_users FROM sb GROUP BY 1), m AS (SELECT subcluster_id, count(*) AS n_messages FROM sb JOIN orders ON o_custkey = user_id GROUP BY 1),
p AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) - 1 AS parent FROM u WHERE cluster_id >= 0 GROUP BY 1),
r AS (SELECT g.*, subcluster_id // 10 AS cluster_id, row_number() OVER (PARTITION BY subcluster_id // 10 ORDER BY n_users DESC, subcluster_id) - 1 AS place FROM g)
SELECT CAST(subcluster_id AS BIGINT) AS subcluster_id, CAST(r.cluster_id AS BIGINT) AS cluster_id, '' AS top_terms, n_users, coalesce(n_messages, 0) AS n_messages, parent * 10 + place AS display_order, true AS is_split,
  '#' || {' || '.join(SHADE.format(i) for i in (2, 4, 6))} AS color_hex FROM r JOIN (SELECT *, {pick_sql(P.PALETTE, 'parent')} AS of FROM p) USING (cluster_id) LEFT JOIN m USING (subcluster_id)
UNION ALL SELECT -10, -1, '', NULL, NULL, (SELECT (max(parent) + 1) * 10 FROM p), false, {q(P.NO_TEXT_COLOUR)}""")
def dim_subcluster(spark, d):
    u = users_of(spark, d).withColumn("user_id", F.col("c_custkey")).withColumn("n_msgs_user", F.col("c_nationkey"))
    members = u.where("cluster_id >= 0").select("user_id", (F.col("cluster_id") * 10 + F.col("user_id") % 3).alias("subcluster_id"), F.lit(True).alias("is_split"))
    return P.dim_subcluster(members, read(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), P.dim_cluster(u))


PII_SQL = r"(?i)whatsapp:|\b\d{7,}\b"
NAMED_SQL = r"regexp_matches({0}, '(?i)\bme\s+llamo\b|\bmi\s+nombre\s+es\b|\bse(?:ñ|n)ora?\s+[a-zñáéíóú]+')"
FIRST_NAMES = ["camila", "zzz", "ana"]
#: What is put behind texts, so that each way of giving a name, and each that only looks like one, occurs.
TAILS = ["", " me llamo Rosa", " Soy Andrea y busco", " soy venezolana", " mi  nombre es X", " hola CAMILA", " camilas", " anana", " la señora Perez", " mi hija tiene 5", " ana", " somos tres"]
GIVEN_SQL = rf"""({NAMED_SQL.format('t')} OR (regexp_extract(t, '\b(?i:soy)\s+{V.NAME}', 1) <> '' AND lower(regexp_extract(t, '\b(?i:soy)\s+{V.NAME}', 1)) NOT IN ({', '.join(map(q, V.NOT_NAMES))}))
  OR {' OR '.join(f"(regexp_matches(regexp_extract(t, '(?i){frame}{V.NAME}', 1), '^[a-zñáéíóú]') AND lower(regexp_extract(t, '(?i){frame}{V.NAME}', 1)) NOT IN ({', '.join(map(q, V.NOT_NAMES))}))" for frame in V.NAMING_OTHERS)})"""
WORD_SQL = f"len(list_intersect(list_transform(regexp_extract_all(t, {q(V.NAME)}), lambda w: lower(w)), [{', '.join(map(q, FIRST_NAMES))}])) > 0"


def told_of(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat("text", pick(TAILS, F.col("doc_id"))).alias("text"))


TOLD = f"d AS (SELECT doc_id, text || {pick_sql(TAILS, 'doc_id')} AS t FROM documents)"


@query(f"WITH {TOLD} SELECT doc_id, md5(coalesce(CASE WHEN NOT regexp_matches(t, {q(PII_SQL)}) AND trim(t) <> '' AND NOT {GIVEN_SQL} AND NOT ({WORD_SQL}) THEN t END, 'dropped')) AS clean FROM d")
def scrub_texts(spark, d):
    return told_of(spark, d).select("doc_id", F.md5(F.coalesce(X.scrub(F.col("text"), FIRST_NAMES).text, F.lit("dropped"))).alias("clean"))


@query(f"WITH {TOLD} SELECT doc_id, {GIVEN_SQL} AS by_phrase, {WORD_SQL} AS by_name FROM d")
def name_layers(spark, d):
    return told_of(spark, d).select("doc_id", X.names_self(F.col("text")).alias("by_phrase"), X.holds_name(F.col("text"), FIRST_NAMES).alias("by_name"))


@query(f"WITH {TONED}, f AS (SELECT *, CAST(user_id AS BIGINT) % 4 AS subcluster_id FROM z WHERE length(message) BETWEEN 60 AND 190 AND NOT regexp_matches(message, {q(PII_SQL)}) AND NOT ({NAMED_SQL.format('message')})) SELECT message_id, subcluster_id, tone AS sentiment, md5(message) AS text, false AS was_redacted FROM (SELECT *, row_number() OVER (PARTITION BY subcluster_id, tone ORDER BY message_id) AS rn FROM f) WHERE rn <= 6")
def fact_message_sample(spark, d):
    m = toned(spark, d)
    facts = m.select("message_id", (F.col("user_id").cast("long") % 4).alias("subcluster_id"), F.col("tone").alias("sentiment"))
    return P.message_sample(facts, m.select("message_id", "message")).select("message_id", "subcluster_id", "sentiment", F.md5("message").alias("text"), "was_redacted")


EDGES = r"regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
WORDS_OF = f"list_filter(list_transform(string_split_regex({fold_sql('message')}, '\\s+'), lambda x: {EDGES}), lambda x: x <> '')"
LIST = lambda words: "[" + ", ".join(map(q, words)) + "]"
CITY_WORDS = sorted({w for k in V.CITY for w in k.split()})
LOW_SQL = f"(len(w) <= 1 OR (len(list_filter(w, lambda x: NOT list_contains({LIST(V.GREETINGS + V.GREETING_FILL)}, x))) = 0 AND len(list_filter(w, lambda x: list_contains({LIST(V.GREETINGS)}, x))) > 0) OR len(list_filter(w, lambda x: NOT list_contains({LIST(CITY_WORDS)}, x))) = 0)"


@query(f"""WITH {TONED}, f AS (SELECT * FROM (SELECT *, {WORDS_OF} AS w FROM z) WHERE NOT {LOW_SQL} AND NOT regexp_matches(message, {q(PII_SQL)}) AND NOT ({NAMED_SQL.format('message')}))
SELECT user_id, md5(string_agg(message, chr(10) || chr(10) ORDER BY seq)) AS conversation, count(*) AS n_messages, (SELECT arg_min(tone, ROW(-n, tone)) FROM (SELECT tone, count(*) AS n FROM f x WHERE x.user_id = f.user_id GROUP BY tone)) AS dominant_tone, false AS was_redacted FROM f GROUP BY user_id""")
def fact_conversation_full(spark, d):
    return P.conversations_full(toned(spark, d), "tone").withColumn("conversation", F.md5("conversation"))


@query(f"WITH {SPINE}, f AS (SELECT message_id, {WORDS_OF} AS w, regexp_extract_all({fold_sql('message')}, '[a-zñ]+') AS c FROM m) SELECT message_id, {LOW_SQL} AS low, len(list_filter(c, lambda x: NOT list_contains({LIST(V.COURTESY)}, x))) = 0 AS courtesy FROM f")
def content_flags(spark, d):
    return spine_of(spark, d).select("message_id", X.is_low_content(F.col("message")).alias("low"), X.is_courtesy(F.col("message")).alias("courtesy"))


@query(f"""WITH {FUN} SELECT CAST(conv_id AS VARCHAR) AS user_id, unnest(CASE WHEN n >= h AND h >= 2 THEN [0, 1, 2, 3] WHEN n >= 2 THEN [0, 1, 2] WHEN n >= 1 THEN [0, 1] ELSE [0] END) AS stage_order, unnest(CASE WHEN n >= h THEN ['Arrived', 'Sent a message', 'Sent 2 or more messages', 'Sent ' || h || ' or more messages'] WHEN n >= 2 THEN ['Arrived', 'Sent a message', 'Sent 2 or more messages'] WHEN n >= 1 THEN ['Arrived', 'Sent a message'] ELSE ['Arrived'] END) AS stage FROM p, h
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 4, 'Answered the survey' FROM conversations WHERE role = 'system'""")
def agg_funnel(spark, d):
    surveyed = read(spark, d, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("user_id"))
    return P.funnel_by_user(per_user_of(spark, d), surveyed)


RECORDS = "rc AS (SELECT o_custkey AS user_id, o_orderkey AS record, o_orderdate AS ts, CASE WHEN o_orderpriority LIKE '1-%' THEN 'v1' ELSE 'v2' END AS v, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'In progress' WHEN 'P' THEN 'gone' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN 'x' END AS started, CASE o_orderkey % 4 WHEN 0 THEN 'es' WHEN 1 THEN 'en' WHEN 2 THEN 'xx' END AS lang FROM orders), cf AS (SELECT *, first(v) OVER (PARTITION BY user_id ORDER BY ts, record) AS cohort FROM rc)"


def records_of(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), k.alias("record"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderpriority").like("1-%"), "v1").otherwise("v2").alias("instrument_version"),
        F.when(s == "F", "Completed").when(s == "O", "In progress").when(s == "P", "gone").alias("registration_status"), F.when(k % 5 != 0, "x").alias("registration_started"),
        F.when(k % 4 == 0, "es").when(k % 4 == 1, "en").when(k % 4 == 2, "xx").alias("language"),
    )


REG_ROWS = f"{RECORDS}, rr AS (SELECT user_id, cohort, unnest([0, CASE status WHEN 'Completed' THEN 1 WHEN 'In progress' THEN 3 ELSE 4 END]) AS stage_order, unnest(['registration started', CASE status WHEN 'Completed' THEN 'registration completed' WHEN 'In progress' THEN 'in progress' ELSE 'other' END]) AS stage FROM cf WHERE started IS NOT NULL)"


@query(f"WITH {REG_ROWS} SELECT * FROM rr")
def agg_registration_funnel(spark, d):
    return P.registration_by_user(records_of(spark, d))


@query(f"WITH {REG_ROWS}, n AS (SELECT cohort, stage_order, stage, count(DISTINCT user_id) AS n FROM rr GROUP BY ALL) SELECT *, n / first(n) OVER (PARTITION BY cohort ORDER BY stage_order, stage) AS of_first FROM n")
def registration_by_cohort(spark, d):
    return Q.stages_by_cohort(P.registration_by_user(records_of(spark, d)))


LANGS = f"{RECORDS}, lg AS (SELECT DISTINCT cohort, user_id, CASE lang WHEN 'es' THEN 'Spanish' WHEN 'en' THEN 'English' ELSE 'Not specified' END AS language FROM cf WHERE lang IS NOT NULL)"


@query(f"WITH {LANGS} SELECT * FROM lg")
def agg_language(spark, d):
    return P.language_by_user(records_of(spark, d))


@query(f"WITH {LANGS} SELECT cohort, language, count(DISTINCT user_id) AS n FROM lg GROUP BY ALL")
def language_by_cohort(spark, d):
    return P.language_by_user(records_of(spark, d)).groupBy("cohort", "language").agg(F.count_distinct("user_id").alias("n"))


def rated_of(spark, d):
    return events_of(spark, d).where("event_type = 'purchase'").select("cluster_id", "user_id", F.col("value").alias("rating_num"))


def matrix_of(spark, d, least):
    v = events_of(spark, d)
    negative = v.groupBy("cluster_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("pct_negative"))
    return P.priority(v, rated_of(spark, d), negative, least)


def z(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END"


def matrix_sql(least: int) -> str:
    return f"""{EVENTS}, us AS (SELECT user_id, min(cluster_id) AS cluster_id, count(*) AS n FROM v GROUP BY 1), p9 AS (SELECT quantile_cont(n, 0.9) AS p FROM us),
c1 AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS messages, count(*) AS users, avg(CASE WHEN n >= p THEN 1.0 ELSE 0 END) AS pct_repeat FROM us, p9 GROUP BY 1),
rt AS (SELECT cluster_id, user_id, value AS r FROM v WHERE event_type = 'purchase'), r1 AS (SELECT cluster_id, avg(r) AS own, count(r) AS k FROM rt WHERE r IS NOT NULL GROUP BY 1),
ng AS (SELECT cluster_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS pct_negative FROM v GROUP BY 1),
mx AS (SELECT cluster_id, messages, users, pct_repeat, CASE WHEN coalesce(k, 0) < {least} THEN (SELECT avg(r) FROM rt) ELSE own END AS mean_rating, coalesce(k, 0) AS meal_n, coalesce(k, 0) < {least} AS rating_is_fallback, pct_negative FROM c1 LEFT JOIN r1 USING (cluster_id) JOIN ng USING (cluster_id)),
pm AS (SELECT *, 3 AS n_axes, ({z('pct_repeat')} + {z('pct_negative')} + {z('-mean_rating')}) / 3 AS unmet_need FROM mx)"""


@query(f"WITH {matrix_sql(100)} SELECT * FROM pm")
def priority_frame(spark, d):
    return matrix_of(spark, d, 100)


@query(f"WITH {matrix_sql(10**9)} SELECT cluster_id, mean_rating, rating_is_fallback, n_axes FROM pm")
def priority_fallback(spark, d):
    return matrix_of(spark, d, 10**9).select("cluster_id", "mean_rating", "rating_is_fallback", "n_axes")


@query(f"WITH {matrix_sql(20)}, md AS (SELECT median(messages) AS m, median(unmet_need) AS u FROM pm) SELECT cluster_id, CASE WHEN messages >= m THEN 'high' ELSE 'low' END || '_volume_' || CASE WHEN unmet_need >= u THEN 'high' ELSE 'low' END || '_need' AS quadrant_key FROM pm, md")
def priority_quadrants(spark, d):
    return Q.quadrants(matrix_of(spark, d, 20)).select("cluster_id", "quadrant_key")


@query(f"""WITH {matrix_sql(20)}, b AS (SELECT avg(pct_repeat) AS mr, stddev_pop(pct_repeat) AS sr, avg(pct_negative) AS mn, stddev_pop(pct_negative) AS sn, avg(-mean_rating) AS mt, stddev_pop(-mean_rating) AS st FROM pm),
x AS (SELECT us.user_id, us.cluster_id, us.n AS messages, CASE WHEN us.n >= p THEN 1.0 ELSE 0 END AS rp, (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) FROM v WHERE v.user_id = us.user_id) AS ne, coalesce(-(SELECT max(r) FROM rt WHERE rt.user_id = us.user_id), -mean_rating) AS ra FROM us JOIN p9 ON true JOIN pm USING (cluster_id) WHERE us.cluster_id <> -1)
SELECT user_id, cluster_id, messages, 1 AS users, (CASE WHEN sr > 0 THEN (rp - mr) / sr ELSE 0 END + CASE WHEN sn > 0 THEN (ne - mn) / sn ELSE 0 END + CASE WHEN st > 0 THEN (ra - mt) / st ELSE 0 END) / 3 AS unmet_need FROM x, b""")
def agg_priority_matrix(spark, d):
    v = events_of(spark, d)
    per = v.groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("negative_share"))
    repeat = per.join(F.broadcast(per.agg(F.percentile("n", F.lit(0.9)).alias("p")))).select("user_id", (F.col("n") >= F.col("p")).alias("is_repeat_asker"))
    ratings = rated_of(spark, d).groupBy("user_id").agg(F.max("rating_num").alias("rating_num"))
    return P.priority_by_user(v, matrix_of(spark, d, 20), repeat, ratings, per.select("user_id", "negative_share"))


@query(f"WITH {GOLD} SELECT doc_id, human AS human_label, model AS model_label FROM g")
def nlp_tone_confusion(spark, d):
    return P.confusion_rows(gold_of(spark, d), "doc_id", "human", "model", True)


EMO = f"em AS (SELECT doc_id, {pick_sql(V.EMOTIONS, 'doc_id')} AS h, {pick_sql(V.EMOTIONS, '(doc_id * 3 // 2)')} AS m FROM labels)"


def emotions_of(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "labels").select("doc_id", pick(V.EMOTIONS, k).alias("h"), pick(V.EMOTIONS, F.floor(k * 3 / 2)).alias("m"))


@query(f"WITH {EMO} SELECT doc_id, replace(h, 'others', 'neutral') AS human_label, replace(m, 'others', 'neutral') AS model_label FROM em")
def nlp_emotion_confusion(spark, d):
    return P.confusion_rows(emotions_of(spark, d), "doc_id", "h", "m", False)


def kappa_sql(frame: str, a: str, b: str, gate: float) -> str:
    return f"""t AS (SELECT count(*) AS n, avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0 END) AS po FROM {frame}),
e AS (SELECT sum(x.n * y.n) AS xy FROM (SELECT {a} AS l, CAST(count(*) AS DOUBLE) AS n FROM {frame} GROUP BY 1) x JOIN (SELECT {b} AS l, CAST(count(*) AS DOUBLE) AS n FROM {frame} GROUP BY 1) y USING (l)),
k AS (SELECT n, po, (po - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)) AS kappa FROM t, e) SELECT n, po AS accuracy, kappa, kappa >= {gate} AS gate_passed FROM k"""


@query(f"WITH {GOLD}, {kappa_sql('g', 'human', 'model', V.TONE_GATE)}")
def tone_gate(spark, d):
    return A.tone_report(gold_of(spark, d), "human", "model")


@query(f"WITH {EMO}, {kappa_sql('em', 'h', 'm', V.EMOTION_GATE)}")
def emotion_gate(spark, d):
    return A.emotion_report(emotions_of(spark, d), "h", "m")


@query(f"WITH {GOLD} SELECT count(*) FILTER (WHERE human = 'negative' AND model = 'negative') / count(*) FILTER (WHERE model = 'negative') AS precision, count(*) FILTER (WHERE human = 'negative' AND model = 'negative') / count(*) FILTER (WHERE human = 'negative') AS recall FROM g")
def tone_precision_recall(spark, d):
    return A.precision_recall(gold_of(spark, d), "human", "model", "negative")


def turns_at(spark, d):
    return turns_of(spark, d).withColumn("ts", F.timestamp_seconds(F.col("msg_turn") * 86400))


GAPS = f"""{TURNS}, k AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, count(*) FILTER (WHERE gap_flag) AS g, count(DISTINCT user_id) FILTER (WHERE gap_flag) AS gu, count(*) FILTER (WHERE handoff_flag) AS h, count(DISTINCT user_id) FILTER (WHERE handoff_flag) AS hu,
strftime(make_timestamp(min(msg_turn) * 86400000000), '%Y-%m-%d') AS a, strftime(make_timestamp(max(msg_turn) * 86400000000), '%Y-%m-%d') AS b FROM gp)"""


@query(f"""WITH {GAPS} SELECT 'coverage_gap' AS metric, 'users' AS grain, gu AS numerator, u AS denominator, NULL::DOUBLE AS rate_pct, false AS rate_quotable, true AS is_floor, a AS window_start, b AS window_end FROM k UNION ALL SELECT 'coverage_gap', 'turns', g, n, NULL, false, true, a, b FROM k
UNION ALL SELECT 'human_handoff', 'users', hu, u, NULL, false, true, a, b FROM k UNION ALL SELECT 'human_handoff', 'turns', h, n, NULL, false, true, a, b FROM k""")
def agg_coverage_gap(spark, d):
    return P.coverage_gap(turns_at(spark, d))


@query(f"""WITH {GAPS} SELECT 'coverage_gap' AS metric, 'users' AS grain, gu AS numerator, u AS denominator, round_even(100.0::DOUBLE * gu / u, 1) AS rate_pct FROM k UNION ALL SELECT 'coverage_gap', 'turns', g, n, round_even(100.0::DOUBLE * g / n, 1) FROM k""")
def coverage_gap_quoted(spark, d):
    probe = spark.createDataFrame([(True, False)], "passed boolean, is_floor boolean")
    return P.coverage_gap(turns_at(spark, d), probe).where("rate_quotable").select("metric", "grain", "numerator", "denominator", "rate_pct")


@query(f"WITH {TURNS} SELECT turn_id, user_id, reply_key, gap_flag, handoff_flag, strftime(make_timestamp(msg_turn * 86400000000), '%Y-%m-%d %H:%M:%S') AS ts, CAST(user_id AS BIGINT) IN (SELECT user_id FROM events) AS has_survey_record FROM gp")
def fact_bot_turn(spark, d):
    return P.bot_turn_facts(turns_at(spark, d), read(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id")))


@query(f"WITH {TURNS}, e AS ({ENTITY}) SELECT turn_id, user_id, kind, entity FROM gp JOIN e ON regexp_matches({fold_sql('user_message')}, p)")
def fact_bot_turn_entities(spark, d):
    return T.entity_rows(turns_of(spark, d), "user_message", REGISTRY, "turn_id", "user_id")


@query(f"WITH {TURNS}, e AS ({ENTITY}), x AS (SELECT entity, kind, gap_flag FROM gp JOIN e ON regexp_matches({fold_sql('user_message')}, p)) SELECT kind, entity, count(*) AS n_turns, count(*) FILTER (WHERE gap_flag) AS n_gap, round_even(100.0::DOUBLE * count(*) FILTER (WHERE gap_flag) / count(*), 1) AS pct_gap FROM x GROUP BY ALL HAVING count(*) >= 5")
def agg_bot_gap_entities(spark, d):
    return P.gap_entities(turns_of(spark, d), "user_message", REGISTRY)


@query(f"WITH {TURNS}, o AS (SELECT reply_key, min(bot_reply) AS bot_reply, bool_or(gap_flag) AS f FROM gp GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY sha1('0:' || reply_key), reply_key) AS rn FROM o) SELECT reply_key, CASE WHEN f THEN 'matched' ELSE 'unmatched' END AS stratum, md5(bot_reply) AS bot_reply, NULL AS human_label FROM r WHERE f OR rn <= 50")
def gold_candidates(spark, d):
    return P.gold_candidates(turns_of(spark, d), 50).withColumn("bot_reply", F.md5("bot_reply"))


RECON7 = f"""{SPINE}, pq AS (SELECT o_custkey AS user_id, max(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END) AS q FROM orders GROUP BY 1), p9 AS (SELECT quantile_cont(q, 0.9) AS p FROM pq),
k7 AS (SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS users, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM m) AS messages, (SELECT count(DISTINCT user_id) FROM m) AS users_with_text, (SELECT count(*) FROM conversations WHERE role = 'system') AS meal_responses, (SELECT 100.0 * avg(CASE WHEN q >= p THEN 1.0 ELSE 0 END) FROM pq, p9) AS rp)"""


def recon_of(spark, d):
    records = read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 50).cast("double")).alias("n_questions"))
    return P.reconciliation(records, spine_of(spark, d), read(spark, d, "conversations").where("role = 'system'"))


@query(f"WITH {RECON7} SELECT unnest(['users', 'records', 'messages', 'users_with_text', 'meal_responses', 'response_rate_pct', 'repeat_askers_pct']) AS metric, unnest([users::VARCHAR, records::VARCHAR, messages::VARCHAR, users_with_text::VARCHAR, meal_responses::VARCHAR, printf('%.1f', 100.0 * meal_responses / users), printf('%.1f', rp)]) AS value FROM k7")
def reconciliation_table(spark, d):
    return recon_of(spark, d)


@query(f"""WITH {RECON7}, {USERS.replace('u AS', 'us AS')}, cv AS (SELECT 100.0 * avg(CASE WHEN cluster_id <> -1 THEN 1.0 ELSE 0 END) AS c FROM us)
SELECT 'users' AS metric, CAST((SELECT count(*) FROM us) AS DOUBLE) AS exported_value, CAST(users AS DOUBLE) AS reconciliation_value, (SELECT count(*) FROM us) = users AS match FROM k7
UNION ALL SELECT 'messages', messages, messages, true FROM k7 UNION ALL SELECT 'users_with_text', (SELECT count(*) FROM us WHERE c_custkey % 2 = 0), users_with_text, (SELECT count(*) FROM us WHERE c_custkey % 2 = 0) = users_with_text FROM k7
UNION ALL SELECT 'meal_responses', meal_responses, meal_responses, true FROM k7 UNION ALL SELECT 'subcluster_min_users', n, 30, n >= 30 FROM (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM us WHERE cluster_id >= 0 GROUP BY cluster_id, c_custkey % 3))
UNION ALL SELECT 'entity_coverage_pct', round_even(e, 1), 20, round_even(e, 1) >= 20 FROM (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE regexp_matches({fold_sql('message')}, '\\bthe\\b')) / count(*) AS e FROM m)
UNION ALL SELECT 'cluster_coverage_pct', round(c, 1), 80, round(c, 1) >= 80 FROM cv UNION ALL SELECT 'repeat_askers_pct', 100, CAST(printf('%.1f', rp) AS DOUBLE), printf('%.1f', rp) = '100.0' FROM k7""")
def parity_rows(spark, d):
    u = users_of(spark, d).select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 2 == 0).alias("has_text"), F.lit(True).alias("is_repeat_asker"), "cluster_id")
    children = u.where("cluster_id >= 0").groupBy((F.col("cluster_id") * 10 + F.col("user_id") % 3).alias("subcluster_id")).agg(F.count("*").alias("n_users"), F.lit(True).alias("is_split"))
    named = T.entity_coverage(spine_of(spark, d), "message", REGISTRY[:1]).first()
    return P.parity(recon_of(spark, d), u, spine_of(spark, d), read(spark, d, "conversations").where("role = 'system'"), A.least_subcluster(children), 100.0 * named.hit / named.total)


@query(f"WITH {SPINE} SELECT 'pii_responses' AS \"check\", NOT bool_or(regexp_matches(text, {q(PII_SQL)}) OR regexp_matches(lang, {q(PII_SQL)}) OR regexp_matches(source, {q(PII_SQL)})) AS passed FROM documents UNION ALL SELECT 'pii_messages', NOT bool_or(regexp_matches(message, {q(PII_SQL)}) OR regexp_matches(user_id, {q(PII_SQL)})) FROM m UNION ALL SELECT 'spine_adds_up', (SELECT sum(n) = sum(k) FROM (SELECT any_value(n_msgs_user) AS n, count(*) AS k FROM m GROUP BY user_id)) UNION ALL SELECT 'one_answer_each', (SELECT max(n) <= 1 FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def qa_checks(spark, d):
    return A.qa_checks(read(spark, d, "documents"), spine_of(spark, d).drop("message_id"), read(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), X.PII)


@query("SELECT count(*) AS \"rows\", 9 AS columns, 1.0 AS ts_parse_rate FROM orders".replace("9 AS", "(SELECT count(*) FROM (DESCRIBE orders)) AS"))
def schema_stats(spark, d):
    return A.schema_stats(read(spark, d, "orders"), "o_orderdate")


@query(f"WITH {USERS} SELECT avg(CASE WHEN cluster_id <> -1 THEN 1.0 ELSE 0 END) AS coverage FROM u")
def cluster_coverage(spark, d):
    return A.cluster_coverage(users_of(spark, d))


@query(f"WITH {SPINE} SELECT user_id, md5(string_agg(t, ' ' ORDER BY seq)) AS doc, count(*) AS n_msgs FROM (SELECT user_id, seq, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS t FROM m) WHERE t <> '' GROUP BY user_id")
def user_documents(spark, d):
    return S.user_documents(spine_of(spark, d), "user_id", "seq", "message").withColumn("doc", F.md5("doc"))


@query(f"WITH {TFIDF} SELECT label, string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank < 6) AS top_terms FROM tt GROUP BY label")
def top_terms_joined(spark, d):
    return T.top_terms(terms_of(spark, d))


SEGMENTS = ["MACHINERY", "BUILDING", "NONE", "AUTOMOBILE"]


@query("SELECT s AS value, i AS position, (SELECT count(*) FROM customer WHERE c_mktsegment = s) AS n, (SELECT count(*) FROM customer WHERE c_mktsegment = s) / (SELECT count(*) FROM customer) AS share FROM (SELECT unnest(" + str(SEGMENTS) + ") AS s, unnest([0, 1, 2, 3]) AS i)")
def counts_in_order(spark, d):
    return Q.mix(read(spark, d, "customer"), "c_mktsegment", SEGMENTS)


@query("WITH c AS (SELECT s, i, (SELECT count(*) FROM customer WHERE c_mktsegment = s) / (SELECT count(*) FROM customer) AS share FROM (SELECT unnest(" + str(SEGMENTS) + ") AS s, unnest([0, 1, 2, 3]) AS i)) SELECT s AS value, sum(share) OVER (ORDER BY i) AS running FROM c")
def running_share(spark, d):
    return Q.with_running_share(Q.mix(read(spark, d, "customer"), "c_mktsegment", SEGMENTS)).select("value", "running")


@query("WITH n AS (SELECT c_nationkey::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 1) SELECT value, n, n / (SELECT sum(n) FROM n) AS share FROM n ORDER BY n DESC, value LIMIT 10")
def top_cities(spark, d):
    return A.top_values(read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("city")), "city", 10)


@query("WITH n AS (SELECT c_nationkey::VARCHAR AS v, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1) SELECT (SELECT sum(n) FROM (SELECT n FROM n ORDER BY n DESC, v LIMIT 5)) / (SELECT sum(n) FROM n) AS share")
def city_concentration(spark, d):
    return Q.concentration(read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("city")), "city", 5, ["3"])


@query("WITH u AS (SELECT c_custkey AS user_id, c_nationkey::VARCHAR AS nat, CASE WHEN c_custkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS cohort FROM customer), t AS (SELECT nat FROM u GROUP BY 1 ORDER BY count(DISTINCT user_id) DESC, nat LIMIT 6) SELECT cohort, nat AS value, count(DISTINCT user_id) AS n FROM u WHERE nat IN (SELECT nat FROM t) OR nat = '7' GROUP BY ALL")
def nationality_by_cohort(spark, d):
    u = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("string").alias("nat"), F.when(F.col("c_custkey") % 3 == 0, "v1").otherwise("v2").alias("cohort"))
    return Q.top_by_cohort(u, "nat", "cohort", 6, ["7"])


@query("SELECT quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.5) AS median, quantile_cont(a, 0.75) AS q3 FROM (SELECT CAST(c_custkey % 80 AS DOUBLE) AS a FROM customer) WHERE a >= 18")
def age_quartiles(spark, d):
    return Q.age_quartiles(read(spark, d, "customer").select((F.col("c_custkey") % 80).cast("double").alias("age_num")))


TOWNS = ["Medellín", "bogota", "CALI", "Otra", "Pasto"]


@query(f"SELECT department, count(*) AS n FROM (SELECT {case_sql({'medellin': 'Antioquia', 'bogota': 'Bogotá', 'cali': 'Valle del Cauca', 'pasto': 'Nariño'}, fold_sql('t'))} AS department FROM (SELECT {pick_sql(TOWNS, 'c_custkey')} AS t FROM customer)) WHERE department IS NOT NULL GROUP BY 1")
def users_by_department(spark, d):
    return Q.by_department(read(spark, d, "customer").select(pick(TOWNS, F.col("c_custkey")).alias("city_canon")))


@query("SELECT (SELECT count(*) FROM orders) AS answers, (SELECT count(DISTINCT c_custkey) FROM customer) AS users, (SELECT count(*) FROM orders) / (SELECT count(DISTINCT c_custkey) FROM customer) AS rate")
def response_rate(spark, d):
    return Q.response_rate(read(spark, d, "orders"), read(spark, d, "customer").withColumnRenamed("c_custkey", "user_id"))


@query("""WITH r AS (SELECT date_trunc('week', ts) AS w, value FROM events WHERE event_type = 'purchase'), b AS (SELECT unnest(generate_series((SELECT min(w) FROM r), (SELECT max(w) FROM r), INTERVAL 7 DAY)) AS bucket)
SELECT bucket, avg(value) AS mean_rating, count(value) AS n, count(value) < 20 AS is_small FROM b LEFT JOIN r ON w = bucket GROUP BY bucket""")
def satisfaction_by_week(spark, d):
    return Q.weekly_rating(read(spark, d, "events").where("event_type = 'purchase'").withColumnRenamed("value", "rating_num"))


@query("""WITH c AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS cohort FROM customer WHERE c_custkey % 5 <> 0)
SELECT cohort, count(*) AS answers, count(DISTINCT o_custkey) AS users, avg(CAST(o_totalprice AS DOUBLE)) AS mean_price FROM orders LEFT JOIN c ON o_custkey = user_id GROUP BY cohort""")
def answers_by_cohort(spark, d):
    users = read(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "v1").otherwise("v2").alias("cohort"))
    rows = Q.with_cohort(read(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), users, "cohort")
    return rows.groupBy("cohort").agg(F.count("*").alias("answers"), F.count_distinct("user_id").alias("users"), F.avg(F.col("o_totalprice").cast("double")).alias("mean_price"))


@query("SELECT c_nationkey AS cohort, count(*) AS n, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END) AS share FROM customer GROUP BY 1")
def share_by_cohort(spark, d):
    return Q.share_by_cohort(read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("cohort"), "c_mktsegment"), "c_mktsegment", "BUILDING", "cohort")


@query("SELECT doc_id, toxic, md5(text) AS text FROM labels JOIN documents USING (doc_id)")
def gold_text_export(spark, d):
    return Q.gold_export(read(spark, d, "labels").select("doc_id", "toxic"), read(spark, d, "documents"), "doc_id", "text").withColumn("text", F.md5("text"))


@query(f"WITH {TONED} SELECT user_id AS place, count(*) AS n, avg(CASE WHEN tone = 'negative' THEN 1.0 ELSE 0 END) AS negative_share FROM z GROUP BY 1 HAVING count(*) >= 4")
def negative_by_place(spark, d):
    return Q.negative_by_place(toned(spark, d).withColumnRenamed("user_id", "place"), "place", "tone", 4)


@query(f"WITH {TONED} SELECT g, tone, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY g) AS share FROM (SELECT CAST(user_id AS BIGINT) % 5 AS g, tone FROM z) GROUP BY g, tone")
def tone_by_archetype(spark, d):
    return Q.tone_by_group(toned(spark, d).withColumn("g", F.col("user_id").cast("long") % 5), "g", "tone")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 5")
def example_filter(spark, d):
    return Q.examples(read(spark, d, "documents").select("doc_id", "lang", "source"), 5, "doc_id", lang="en", source=None)
