"""Queries of longer methods: pattern automata, pluggable bootstrap, neighbour graphs and layouts, geometries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import SPINE, fold_sql, query, read, spine_of
from millrace.functions import text as X
from millrace.operators import neighbours, quantiles, resample
from millrace.operators import terms as T

WORD = "[a-z]{6,}"
#: Rows of a registry made of a test set's words, at most.
MOST_ENTRIES = 50_000


def words_of_tests(spark, d) -> list[T.Entry]:
    """A registry of the distinct longer words of the test set; raises where that is too large for a registry."""
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(X.fold(F.col("text")), F.lit(f"({WORD})"), 1)).alias("w")).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(words) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} words")
    return [(r.w, "institution" if len(r.w) % 2 == 0 else "procedure", rf"\b{r.w}(?:s|es)?\b") for r in sorted(words)]


NAMED = rf"""{SPINE}, w AS (SELECT DISTINCT unnest(regexp_extract_all({fold_sql('text')}, '{WORD}')) AS w FROM benchmark), f AS (SELECT w, unnest([w, w || 's', w || 'es']) AS f FROM w),
t AS (SELECT user_id, message_id, unnest(regexp_extract_all({fold_sql('message')}, '[\p{{L}}\p{{N}}_]+')) AS f FROM m),
x AS (SELECT DISTINCT user_id, message_id, w AS entity, CASE WHEN length(w) % 2 = 0 THEN 'institution' ELSE 'procedure' END AS kind FROM t JOIN f USING (f))"""


@query(f"WITH {NAMED} SELECT * FROM x")
def entity_automaton_join(spark, d):
    return T.entity_rows(spine_of(spark, d), "message", words_of_tests(spark, d), "user_id", "message_id")


@query(f"WITH {NAMED} SELECT (SELECT count(DISTINCT message_id) FROM x) AS hit, (SELECT count(*) FROM m) AS total")
def entity_automaton_coverage(spark, d):
    return T.entity_coverage(spine_of(spark, d), "message", words_of_tests(spark, d))


@query("""SELECT 'l_extendedprice' AS field, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9) AS p90, CAST(ceil(quantile_cont(CAST(l_quantity AS DOUBLE), 0.9)) AS BIGINT) AS quantity_p90 FROM lineitem""")
def exact_p90(spark, d):
    rows = read(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    price, quantity = (quantiles.exact_quantile(rows, c, 0.9) for c in rows.columns)
    return spark.createDataFrame([("l_extendedprice", price, quantity)], "field string, p90 double, q double").select("field", "p90", F.ceil("q").alias("quantity_p90"))


@query()
def bootstrap_statistics(spark, d):
    """Intervals of the mean, a share and the median of all event values."""
    events = read(spark, d, "events")
    asked = {"mean": resample.Mean(), "share_over_50": resample.Share("v > 50"), "median": resample.median()}
    rows = [resample.interval(events, "value", s).select(F.lit(name).alias("statistic"), "point", "lo", "hi") for name, s in asked.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query()
def neighbour_graph(spark, d):
    """About the ten nearest others of every embedding."""
    return neighbours.knn_graph(read(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def neighbour_layout(spark, d):
    return neighbours.layout(read(spark, d, "embeddings"), "vec_id", "embedding")
