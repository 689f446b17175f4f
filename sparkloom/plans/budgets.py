"""Budget, priority, rate and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import budgets as bg
from sparkloom.plans.catalog import register
from sparkloom.plans.trajectory import STEPS_SQL, steps
from sparkloom.runtime import table

C = F.col


@register("budget_splits", """
WITH b AS (SELECT o_orderkey, greatest(4000, least(32000, floor(500 * sqrt(o_custkey))))::BIGINT AS budget FROM orders)
SELECT o_orderkey, budget, floor(budget * 0.15::DOUBLE)::BIGINT AS repo_map, floor(budget * 0.4::DOUBLE)::BIGINT AS real_code, (budget - floor(budget * 0.15::DOUBLE) - floor(budget * 0.25::DOUBLE))::BIGINT AS structural FROM b""")
def budget_splits(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select("o_orderkey", bg.adaptive_budget(C("o_custkey")).alias("budget"))
    split = bg.budget_split(C("budget"))
    return b.select("o_orderkey", "budget", split["repo_map"].alias("repo_map"), split["real_code"].alias("real_code"), bg.task_split(C("budget"))["structural"].alias("structural"))


@register("block_priorities", """
SELECT doc_id, round(n_chars * (1 + (doc_id % 11) / 10) * greatest(1 - 0.1 * (doc_id % 8), 0.5) + CASE WHEN doc_id % 2 = 0 THEN 0.15 * pow(0.7, doc_id % 8) ELSE 0 END, 6) AS priority FROM documents""")
def block_priorities(spark, sf_dir):
    i = C("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(bg.block_priority(C("n_chars"), i % 11 / 10, i % 8, i % 2 == 0), 6).alias("priority"))


@register("episode_ranks", """
WITH k AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)) AS k FROM documents),
h AS (SELECT doc_id, len(list_intersect(k, ['the', 'station', 'harbour', 'hand'])) AS h FROM k)
SELECT doc_id, round(0.6 * h / 4 + 0.4 * pow(2, -(doc_id % 100) / 24), 6) AS score FROM h WHERE h > 0""")
def episode_ranks(spark, sf_dir):
    hour = 3600 * 1000
    e = table(spark, sf_dir, "documents").select("doc_id", "text", (F.lit(1_000_000 * hour) - C("doc_id") % 100 * hour).alias("created_at_ms"))
    return bg.rank_episodes(e, "The station, harbour hand", F.lit(1_000_000 * hour)).select("doc_id", F.round("score", 6).alias("score"))


@register("rankers_merged", """
WITH a AS (SELECT lang AS query_id, source AS doc_id, count(*)::DOUBLE AS a FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), b AS (SELECT 'en' AS query_id, 's' || (page_id % 9) AS doc_id, count(*)::DOUBLE AS b FROM pages GROUP BY 2)
SELECT query_id, doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (query_id, doc_id)""")
def rankers_merged(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("source is not null and lang is not null").groupBy(C("lang").alias("query_id"), C("source").alias("doc_id")).agg(F.count("*").cast("double").alias("score"))
    b = table(spark, sf_dir, "pages").groupBy(F.lit("en").alias("query_id"), F.concat(F.lit("s"), C("page_id") % 9).alias("doc_id")).agg(F.count("*").cast("double").alias("score"))
    return bg.merged(a, b)


@register("community_best_and_total", "SELECT lang AS query_id, doc_id % 30 AS community, max(n_chars)::DOUBLE AS best, sum(n_chars)::DOUBLE AS total FROM documents GROUP BY 1, 2")
def community_best_and_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return bg.community_scores(d.select(C("lang").alias("query_id"), "doc_id", C("n_chars").cast("double").alias("score")), d.select("doc_id", (C("doc_id") % 30).alias("community")))


@register("token_metrics", """
SELECT o_orderpriority, round(sum(o_custkey % 30) / (sum(o_custkey) + sum(o_custkey % 30)), 6) AS cache_hit_rate, round(sum(o_custkey + 7 + o_custkey % 30 + 1 + 2) / sum(o_orderkey % 2), 6) AS tokens_per_edit FROM orders GROUP BY 1""")
def token_metrics(spark, sf_dir):
    k = C("o_custkey")
    usage = table(spark, sf_dir, "orders").select("o_orderpriority", k.alias("input"), F.lit(7).alias("output"), (k % 30).alias("cache_read"), F.lit(1).alias("cache_write"), F.lit(2).alias("reasoning"), (C("o_orderkey") % 2).alias("edits"))
    return bg.token_metrics(usage, "o_orderpriority").select("o_orderpriority", F.round("cache_hit_rate", 6).alias("cache_hit_rate"), F.round("tokens_per_edit", 6).alias("tokens_per_edit"))


@register("causal_usefulness", "SELECT l_suppkey AS community, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS usefulness FROM lineitem GROUP BY 1")
def causal_usefulness(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("community"), F.when(C("l_returnflag") == "R", "Used").otherwise("Ignored").alias("outcome"))
    return bg.causal_usefulness(links).withColumn("usefulness", F.round("usefulness", 6))


@register("failure_constraints", STEPS_SQL + " SELECT run_id, lower(payload_summary) AS pattern, count(*) AS seen FROM steps WHERE event_type = 'Error' GROUP BY 1, 2 HAVING count(*) >= 3")
def failure_constraints(spark, sf_dir):
    errors = steps(spark, sf_dir).where("event_type = 'Error'").select("run_id", F.concat("payload_summary", F.lit(":"), "sequence", F.lit(":3")).alias("message"))
    return bg.failure_constraints(errors)


@register("retention", STEPS_SQL + " SELECT run_id, CASE WHEN count(*) FILTER (k % 40 = 0) > 0 THEN 'Permanent' WHEN count(*) FILTER (k % 9 = 1) > 0 THEN 'TimeScoped' ELSE 'RunScoped' END AS ttl, CASE WHEN count(*) FILTER (k % 40 = 0) > 0 THEN 'Canonical' WHEN count(*) FILTER (k % 9 = 1) > 0 THEN 'Reusable' ELSE 'Episodic' END AS kind FROM steps WHERE event_type = 'Error' GROUP BY 1")
def retention(spark, sf_dir):
    scope = F.when(C("k") % 40 == 0, "workspace-local").when(C("k") % 9 == 1, "task-local").otherwise("run-local")
    return bg.retention(steps(spark, sf_dir).where("event_type = 'Error'").select("run_id", scope.alias("scope")))


@register("scenario_report", """
WITH g AS (SELECT o_orderpriority AS category, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, sum(o_custkey % 25)::BIGINT AS iterations FROM orders GROUP BY 1)
SELECT category, total, passed, iterations, round(40 * passed / total + greatest(0, least(10, 10 * (1 - (iterations / total - 5) / 15))), 6) AS score FROM g""")
def scenario_report(spark, sf_dir):
    results = table(spark, sf_dir, "orders").select(C("o_orderpriority").alias("category"), (C("o_orderstatus") == "F").alias("passed"), (C("o_custkey") % 25).alias("iterations"))
    return bg.scenario_report(results).withColumn("score", F.round("score", 6))
