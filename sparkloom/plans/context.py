"""Insight, validation and assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import assembly, insights, ranking
from sparkloom.operators import graph as g
from sparkloom.plans import graph as gp
from sparkloom.plans.catalog import register
from sparkloom.plans.retrieval import _tokens_sql
from sparkloom.plans.trajectory import STEPS_SQL, calls, steps
from sparkloom.runtime import materialize, table

C = F.col

_INSIGHTS_SQL = """
WITH i AS (SELECT o_orderkey AS timestamp, 'cmd ' || o_orderpriority AS command, o_orderstatus <> 'F' AS success, o_custkey AS duration_ms,
  CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 <> 0 THEN 'src/m' || (o_custkey % 40) || '.rs:' || o_custkey || ': failed' END AS error_summary, ['f' || (o_custkey % 7), 'f' || (o_custkey % 11)] AS files, ['s' || (o_custkey % 300)] AS symbols FROM orders)
"""


def _insights(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = C("o_custkey")
    error = F.when((C("o_orderstatus") == "F") & (key % 10 != 0), F.concat(F.lit("src/m"), key % 40, F.lit(".rs:"), key, F.lit(": failed")))
    return o.select(
        C("o_orderkey").alias("timestamp"), F.concat(F.lit("cmd "), "o_orderpriority").alias("command"), (C("o_orderstatus") != "F").alias("success"), key.alias("duration_ms"), error.alias("error_summary"),
        F.array(F.concat(F.lit("f"), key % 7), F.concat(F.lit("f"), key % 11)).alias("affected_files"), F.array(F.concat(F.lit("s"), key % 300)).alias("affected_symbols"),
    )


@register("insight_learnings", _INSIGHTS_SQL + """
SELECT trim(regexp_replace(regexp_extract(error_summary, '^(?:[^:]|:[0-9][0-9:]*)*'), ':[0-9][0-9:]*', '', 'g') || substr(error_summary, length(regexp_extract(error_summary, '^(?:[^:]|:[0-9][0-9:]*)*')) + 1)) AS pattern, count(*) AS occurrences, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM i WHERE NOT success AND error_summary IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def insight_learnings(spark, sf_dir):
    return insights.learnings(_insights(spark, sf_dir)).drop("modules")


@register("insight_recipes", _INSIGHTS_SQL + "SELECT command, count(*) AS seen, (sum(duration_ms) // count(*))::BIGINT AS avg_duration_ms FROM i WHERE success GROUP BY 1")
def insight_recipes(spark, sf_dir):
    return insights.recipes(_insights(spark, sf_dir))


@register("insight_flaky", _INSIGHTS_SQL + "SELECT symbol FROM (SELECT unnest(symbols) AS symbol, success FROM i) GROUP BY 1 HAVING bool_or(success) AND bool_or(NOT success)")
def insight_flaky(spark, sf_dir):
    return insights.flaky(_insights(spark, sf_dir))


@register("insight_failures", _INSIGHTS_SQL + "SELECT pattern, count(DISTINCT timestamp) AS seen, list_sort(list_distinct(list(f))) AS files FROM (SELECT coalesce(error_summary, 'unknown error') AS pattern, timestamp, unnest(files) AS f FROM i WHERE NOT success) GROUP BY 1")
def insight_failures(spark, sf_dir):
    return insights.common_failures(_insights(spark, sf_dir))


@register("insight_search", _INSIGHTS_SQL + "SELECT timestamp, command FROM i WHERE contains(lower(command), 'urgent') OR contains(lower(coalesce(error_summary, '')), 'urgent') ORDER BY timestamp DESC LIMIT 25")
def insight_search(spark, sf_dir):
    return insights.search(_insights(spark, sf_dir), "URGENT", 25).select("timestamp", "command")


@register("event_validation", "SELECT event_id, list_filter(CASE event_type WHEN 'purchase' THEN ['k', 'price'] WHEN 'click' THEN ['k'] ELSE [] END, lambda x: x <> 'k') AS missing FROM events")
def event_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", C("props").alias("payload"))
    return insights.validate(e, {"purchase": ["k", "price"], "click": ["k"]}).select("event_id", "missing")


@register("event_references", "SELECT event_id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 200 AS prior FROM events) WHERE prior NOT IN (SELECT event_id FROM events)")
def event_references(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long") * 200
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k.alias("prior_event_id"))).alias("payload"))
    return insights.unknown_references(e).select("event_id")


@register("toxic_sequences", "SELECT user_id AS run_id, 'exfiltration' AS pattern FROM events GROUP BY 1 HAVING count(*) >= 60 AND bool_or(event_type = 'purchase') AND bool_or(event_type = 'signup')")
def toxic_sequences(spark, sf_dir):
    c = table(spark, sf_dir, "events").select(C("user_id").alias("run_id"), C("event_type").alias("command"))
    return insights.toxic_sequences(c, [("exfiltration", ["purchase", "signup"], 60), ("never", ["purchase", "wipe"], 1)])


@register("episode_summaries", STEPS_SQL + """,
e AS (SELECT run_id, list_sort(list_distinct(list(payload_summary) FILTER (event_type = 'ToolCallCompleted'))) AS files, list_sort(list_distinct(list(tool_name) FILTER (outcome = 'Success'))) AS worked, count(*) FILTER (outcome = 'Success') AS successes,
  count(*) FILTER (outcome = 'Failure') AS failures, count(*) FILTER (event_type = 'Error') AS errors FROM steps GROUP BY 1)
SELECT *, CASE WHEN errors + failures > 0 THEN 'Partial' ELSE 'Success' END AS outcome FROM e""")
def episode_summaries(spark, sf_dir):
    return insights.episodes(steps(spark, sf_dir))


@register("inferred_hypotheses", STEPS_SQL + " SELECT run_id, tool_name || ':' || payload_summary AS subject, count(*) AS seen FROM steps WHERE event_type = 'ToolCallCompleted' GROUP BY ALL HAVING count(*) >= 3")
def inferred_hypotheses(spark, sf_dir):
    return insights.inferred_hypotheses(calls(spark, sf_dir))


@register("token_cost", "SELECT o_orderkey, round((o_custkey * p + (o_shippriority_ + 100) * q) / 1000000, 9) AS cost FROM (SELECT *, o_orderkey % 50 AS o_shippriority_, CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'O' THEN 0.5 END AS p, CASE o_orderstatus WHEN 'F' THEN 15.0 WHEN 'O' THEN 1.5 END AS q FROM orders)")
def token_cost(spark, sf_dir):
    prices = spark.createDataFrame([("F", 3.0, 15.0), ("O", 0.5, 1.5)], "model string, in_price double, out_price double")
    usage = table(spark, sf_dir, "orders").select("o_orderkey", C("o_orderstatus").alias("model"), C("o_custkey").alias("input"), (C("o_orderkey") % 50).alias("output"), F.lit(100).alias("reasoning"))
    return insights.token_cost(usage, prices).select("o_orderkey", F.round("cost", 9).alias("cost"))


@register("similar_lessons", """
WITH l AS (SELECT c_custkey AS id, c_nationkey AS category, list_sort(list_distinct(['w' || (c_custkey % 3), 'x' || (c_custkey % 4), 'y' || (c_custkey % 2), 'z' || (c_custkey % 5), 'v', 'u', 't'])) AS w FROM customer),
c AS (SELECT category, w, min(id) AS class_id, count(*) AS n FROM l GROUP BY 1, 2),
p AS (SELECT a.class_id, b.n, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM c a JOIN c b ON a.category = b.category AND a.w <> b.w),
k AS (SELECT class_id, sum(n)::BIGINT AS n_links FROM p WHERE similarity >= 0.7 GROUP BY 1)
SELECT id, class_id, coalesce(n_links, 0) AS n_links FROM l JOIN c USING (category, w) LEFT JOIN k USING (class_id)""")
def similar_lessons(spark, sf_dir):
    k = C("c_custkey")
    words = F.concat_ws(" ", F.concat(F.lit("w"), k % 3), F.concat(F.lit("x"), k % 4), F.concat(F.lit("y"), k % 2), F.concat(F.lit("z"), k % 5), F.lit("v u t"))
    lessons = table(spark, sf_dir, "customer").select(k.alias("id"), C("c_nationkey").alias("category"), words.alias("lesson"))
    return insights.similar_lessons(lessons)


_FIELDS = """WITH f AS (SELECT p_partkey AS doc_id, 'symbol' AS field, p_name AS text, 3.0 AS boost FROM part UNION ALL SELECT p_partkey, 'path', p_brand, 3.0 FROM part UNION ALL SELECT p_partkey, 'doc', p_type, 1.0 FROM part),"""


def _fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda field, column, boost: p.select(C("p_partkey").alias("doc_id"), F.lit(field).alias("field"), C(column).alias("text"), F.lit(boost).alias("boost"))
    return one("symbol", "p_name", 3.0).union(one("path", "p_brand", 3.0)).union(one("doc", "p_type", 1.0))


@register("bm25f_parts", _FIELDS + _tokens_sql("f", "doc_id || '|' || boost AS k", "text").replace("SELECT doc_id || '|' || boost AS k, lower(w)", "SELECT k, lower(w)").replace("SELECT doc_id || '|' || boost AS k, lower(unnest", "SELECT k, lower(unnest").replace("SELECT doc_id || '|' || boost AS k, CASE", "SELECT k, CASE") + """,
tf AS (SELECT string_split(k, '|')[1]::BIGINT AS doc_id, term, sum(string_split(k, '|')[2]::DOUBLE) AS tf FROM tokens GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT * FROM (VALUES ('red', 2), ('widget', 2), ('small', 2)) v(term, q_n))
SELECT doc_id, round(sum(q_n * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1""")
def bm25f_parts(spark, sf_dir):
    query = spark.createDataFrame([("q", "red widget small")], "query_id string, query string")
    return assembly.bm25f(_fields(spark, sf_dir), query).select("doc_id", F.round("score", 6).alias("score"))


def _field_sql(name):
    """Scores of one field on its own."""
    return f"""{name}_f AS (SELECT doc_id, text FROM f WHERE field = '{name}'),""" + _tokens_sql(f"{name}_f", "doc_id", "text", f"{name}_") + f""",
{name}_tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM {name}_tokens GROUP BY 1, 2), {name}_dl AS (SELECT doc_id, sum(tf) AS dl FROM {name}_tf GROUP BY 1), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1), {name}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_dl),
{name}_s AS (SELECT doc_id, sum(q_n * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM {name}_tf JOIN q USING (term) JOIN {name}_df USING (term) JOIN {name}_dl USING (doc_id), {name}_st GROUP BY 1)"""


@register("multi_field_parts", _FIELDS + " q AS (SELECT * FROM (VALUES ('red', 2), ('widget', 2), ('small', 2)) v(term, q_n)), " + ", ".join(map(_field_sql, ("symbol", "path", "doc"))) + """
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, 3 * s AS s FROM symbol_s UNION ALL SELECT doc_id, 3 * s FROM path_s UNION ALL SELECT doc_id, s FROM doc_s) GROUP BY 1""")
def multi_field_parts(spark, sf_dir):
    query = spark.createDataFrame([("q", "red widget small")], "query_id string, query string")
    return assembly.multi_field(_fields(spark, sf_dir), query).select("doc_id", F.round("score", 6).alias("score"))


@register("dependency_coverage", """
WITH d AS (SELECT l_orderkey AS query_id, l_partkey AS source, l_suppkey AS target FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS query_id, x AS doc_id FROM (SELECT l_orderkey, l_partkey AS x FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey - l_suppkey % 2 FROM lineitem))
SELECT q.query_id, round(CASE WHEN m IS NULL THEN 1 ELSE coalesce(n, 0) / m END, 6) AS coverage FROM (SELECT DISTINCT query_id FROM r) q LEFT JOIN (SELECT query_id, count(*) AS m FROM d GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM d WHERE (query_id, source) IN (SELECT (query_id, doc_id) FROM r) AND (query_id, target) IN (SELECT (query_id, doc_id) FROM r) GROUP BY 1) USING (query_id)""")
def dependency_coverage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    deps = l.select(C("l_orderkey").alias("query_id"), C("l_partkey").alias("source"), C("l_suppkey").alias("target"))
    got = l.select(C("l_orderkey").alias("query_id"), C("l_partkey").alias("doc_id")).union(l.select("l_orderkey", C("l_suppkey") - C("l_suppkey") % 2))
    return insights.dependency_coverage(deps, got).withColumn("coverage", F.round("coverage", 6))


@register("graph_louvain")
def graph_louvain(spark, sf_dir):
    """Greedy moves depend on their order: checked by modularity in the tests."""
    pairs = materialize(g.pair_weights(gp.edges(spark, sf_dir)), "pairs")
    return assembly.louvain(pairs)


@register("rerank_features", """
SELECT doc_id, round(greatest(0, 0.4 * c + 0.2 * (doc_id % 7) / 7 + 0.15 * (doc_id % 5) / 5 + 0.1 * (doc_id % 3) / 3 - CASE WHEN source = 'src1' THEN 0.15 ELSE 0 END - CASE WHEN lang = 'de' AND c = 0 THEN 0.05 ELSE 0 END), 9) AS score
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE (n_chars % 100) / 100 END AS c FROM documents)""")
def rerank_features(spark, sf_dir):
    i = C("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 2 == 0, 0.0).otherwise(C("n_chars") % 100 / 100).alias("content"), (i % 7 / 7).alias("path"), (i % 5 / 5).alias("symbol"), (i % 3 / 3).alias("proximity"), (C("source") == "src1").alias("seen"), (C("lang") == "de").alias("from_community"))
    return assembly.rerank(d.fillna(False)).select("doc_id", F.round("score", 9).alias("score"))


@register("community_signals", """
WITH b AS (SELECT lang AS query_id, source AS doc_id, sum(n_chars)::DOUBLE AS s FROM documents GROUP BY 1, 2), f AS (SELECT lang AS query_id, source AS doc_id, count(*)::DOUBLE AS s FROM documents GROUP BY 1, 2),
n AS (SELECT b.query_id, b.doc_id, CASE WHEN max(b.s) OVER w > min(b.s) OVER w THEN (b.s - min(b.s) OVER w) / (max(b.s) OVER w - min(b.s) OVER w) ELSE 0 END AS t, CASE WHEN max(f.s) OVER w > min(f.s) OVER w THEN (f.s - min(f.s) OVER w) / (max(f.s) OVER w - min(f.s) OVER w) ELSE 0 END AS f FROM b JOIN f USING (query_id, doc_id) WINDOW w AS (PARTITION BY b.query_id))
SELECT query_id, doc_id, round(0.55 * t + 0.3 * f + 0.05 * 0.5 + 0.1 * 0.25, 9) AS score FROM n""")
def community_signals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(C("lang").alias("query_id"), C("source").alias("doc_id"), "n_chars")
    s = d.groupBy("query_id", "doc_id").agg(F.sum("n_chars").cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    flat = d.select("doc_id").distinct()
    scored = assembly.community_scores(s.select("query_id", "doc_id", C("a").alias("score")), s.select("query_id", "doc_id", C("b").alias("score")), flat.withColumn("rank", F.lit(0.5)), flat.withColumn("recency", F.lit(0.25)))
    return scored.withColumn("score", F.round("score", 9))


@register("top_scores", "SELECT source AS query_id, doc_id, n_chars AS score, (r - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 8")
def top_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(C("source").alias("query_id"), "doc_id", C("n_chars").alias("score"))
    return ranking.top_k(d, 8)
