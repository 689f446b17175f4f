"""Maintenance, lint and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import maintenance as mt
from sparkloom.operators import memory
from sparkloom.plans.catalog import register
from sparkloom.runtime import table

C = F.col


@register("maintenance_invalidated", """
WITH now AS (SELECT p_partkey AS node, p_size AS hash FROM part), old AS (SELECT p_partkey AS node, CASE WHEN p_size = 13 THEN -1 ELSE p_size END AS hash FROM part), d AS (SELECT DISTINCT l_partkey AS node, l_suppkey + 5 AS needs FROM lineitem),
c AS (SELECT node FROM now JOIN old USING (node) WHERE now.hash <> old.hash), h1 AS (SELECT DISTINCT d.node FROM d JOIN c ON d.needs = c.node), h2 AS (SELECT DISTINCT d.node FROM d JOIN h1 ON d.needs = h1.node)
SELECT node, min(reason) AS reason FROM (SELECT node, 'changed' AS reason FROM c UNION ALL SELECT node, 'dependent' FROM h1 UNION ALL SELECT node, 'dependent' FROM h2) GROUP BY 1""")
def invalidated(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    now = p.select(C("p_partkey").alias("node"), C("p_size").alias("hash"))
    old = p.select(C("p_partkey").alias("node"), F.when(C("p_size") == 13, -1).otherwise(C("p_size")).alias("hash"))
    deps = table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("node"), (C("l_suppkey") + 5).alias("needs")).distinct()
    return mt.invalidated(now, old, deps)


@register("maintenance_merge_edges", """
WITH e AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target, l_returnflag AS edge_type, 1.0 AS weight FROM lineitem WHERE l_quantity <= 30), x AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target, l_returnflag AS edge_type FROM lineitem WHERE l_quantity > 20)
SELECT source, target, edge_type, weight::DOUBLE AS weight FROM e UNION ALL SELECT source, target, edge_type, 1.5 FROM x WHERE (source, target, edge_type) NOT IN (SELECT (source, target, edge_type) FROM e)""")
def merge_edges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("source"), C("l_suppkey").alias("target"), C("l_returnflag").alias("edge_type"), "l_quantity")  # noqa: E741
    e = l.where("l_quantity <= 30").drop("l_quantity").distinct().withColumn("weight", F.lit(1.0))
    return mt.merge_additional(e, l.where("l_quantity > 20").drop("l_quantity"))


@register("session_metrics", """
WITH u AS (SELECT DISTINCT user_id AS run_id, event_type AS file FROM events WHERE value > 20), c AS (SELECT DISTINCT user_id AS run_id, event_type AS file FROM events WHERE value < 8)
SELECT run_id, count(*) FILTER (u.file IS NOT NULL AND c.file IS NOT NULL) AS hit, count(*) FILTER (c.file IS NULL) AS miss, count(*) FILTER (u.file IS NULL) AS over_read FROM u FULL JOIN c USING (run_id, file) GROUP BY 1""")
def session_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(C("user_id").alias("run_id"), C("event_type").alias("file"), "value")
    return mt.session_metrics(e.where("value > 20"), e.where("value < 8"))


@register("test_coverage", "SELECT p_brand AS community, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS tested, count(*) AS total, round(100.0 * count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) / count(*), 6) AS percent FROM part GROUP BY 1")
def test_coverage(spark, sf_dir):
    symbols = table(spark, sf_dir, "part").select(C("p_brand").alias("community"), C("p_partkey").alias("symbol"))
    tested = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(C("l_partkey").alias("symbol"))
    return mt.coverage(symbols, tested).withColumn("percent", F.round("percent", 6))


@register("memory_lint", """
WITH s AS (SELECT count(*) * 10 AS sec, avg(value) * 40 AS p50, max(value) * 20 AS p95 FROM events)
SELECT 'wiki.staleness' AS metric, 'warning' AS severity, NULL::VARCHAR AS subject FROM s WHERE sec > 7200 UNION ALL SELECT 'lesson.zero_hit', 'concern', o_orderkey::VARCHAR FROM orders WHERE o_custkey % 60 >= 30 AND o_orderkey % 7 = 0
UNION ALL SELECT 'episode.orphan', 'info', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'wiki.broken_link', 'warning', page_id::VARCHAR FROM pages WHERE page_id % 9 = 0
UNION ALL SELECT 'retrieval.p50_latency', 'warning', NULL FROM s WHERE p50 > 500 UNION ALL SELECT 'retrieval.p95_latency', 'critical', NULL FROM s WHERE p95 > 2000""")
def memory_lint(spark, sf_dir):
    state = table(spark, sf_dir, "events").agg((F.count("*") * 10).alias("seconds_since_compile"), (F.avg("value") * 40).alias("p50_ms"), (F.max("value") * 20).alias("p95_ms"))
    orders = table(spark, sf_dir, "orders")
    lessons = orders.select(C("o_orderkey").alias("id"), (C("o_custkey") % 60 * 86400).alias("age_seconds"), (C("o_orderkey") % 7).alias("hits"))
    orphans = table(spark, sf_dir, "customer").join(orders, C("c_custkey") == C("o_custkey"), "left_anti").select(C("c_custkey").alias("id"))
    return mt.lint(state, lessons, orphans, table(spark, sf_dir, "pages").where("page_id % 9 = 0").select(C("page_id").alias("slug")))


@register("empty_sections", "SELECT doc_id::VARCHAR AS slug, unnest(CASE WHEN doc_id % 3 = 0 OR NOT regexp_matches(text, '[^ \\n]') THEN ['# ' || lang, '## end'] ELSE ['## end'] END) AS heading FROM documents")
def empty_sections(spark, sf_dir):
    plain = F.regexp_replace("text", "(?m)^#+ ", "")
    body = F.concat(F.lit("# "), "lang", F.lit("\n\n"), F.when(C("doc_id") % 3 == 0, "  ").otherwise(plain), F.lit("\n## end\n"))
    return mt.empty_sections(table(spark, sf_dir, "documents").select(C("doc_id").cast("string").alias("slug"), body.alias("body")))


@register("output_scrub", "SELECT event_id, 'at <TS> or <TS> in /tmp/<TEMP>/f pid=<PID> of <ADDR> <UUID> commit <HASH> took ' || (event_id % 90) || 'ms' AS text FROM events")
def output_scrub(spark, sf_dir):
    i = C("event_id")
    hexed = F.lower(F.lpad(F.hex(i), 12, "0"))
    parts = ["\x1b[31mat\x1b[0m ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), " or ", i + 1700000000, " in /tmp/run-", i, ".d/f PID = ", i, " of 0x", hexed, " 12345678-abcd-ABCD-1234-", hexed, " commit ", hexed, " took ", i % 90, "ms"]
    line = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf_dir, "events").select("event_id", mt.scrub(line).alias("text"))


@register("call_flow", """
WITH RECURSIVE c AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + r_regionkey * 3 + 1) % 25 AS dst FROM nation, region WHERE (n_nationkey + r_regionkey) % 3 = 0),
w AS (SELECT n_nationkey AS root, n_nationkey AS node, 0 AS level FROM nation UNION SELECT root, dst, level + 1 FROM w JOIN c ON node = src WHERE level < 19), s AS (SELECT root, node, min(level) AS level FROM w GROUP BY 1, 2)
SELECT root, step::INTEGER AS step, node FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY level, node) AS step FROM s) WHERE step <= 20""")
def call_flow(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
    calls = n.where((C("n_nationkey") + C("r")) % 3 == 0).select(C("n_nationkey").alias("src"), ((C("n_nationkey") * 7 + C("r") * 3 + 1) % 25).alias("dst")).distinct()
    return mt.call_flow(calls, table(spark, sf_dir, "nation").select(C("n_nationkey").alias("node")))


@register("path_glob", "WITH p AS (SELECT 'src/' || source || '/' || lang || '/d' || doc_id || '.txt' AS path FROM documents) SELECT path, (SELECT count(*) FROM p WHERE regexp_matches(path, '^src/(?:.*/)?de/d[^/]*\\.txt$')) AS total FROM p WHERE regexp_matches(path, '^src/(?:.*/)?de/d[^/]*\\.txt$') ORDER BY path LIMIT 100")
def path_glob(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit(".txt")).alias("path"))
    return mt.glob(paths, "src/**/de/d*.txt")


@register("entry_points", "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def entry_points(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(C("l_partkey").alias("dst"))
    return mt.entry_points(table(spark, sf_dir, "part").select(C("p_partkey").alias("node")), calls)


@register("namespaced_links", "SELECT page_id, CASE WHEN regexp_matches(l, '^(memory|code):') THEN l ELSE ns || ':' || l END AS target FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'code:p' || page_id ELSE 'p' || page_id END AS l, CASE WHEN page_id % 2 = 0 THEN 'memory' ELSE 'code' END AS ns FROM pages)")
def namespaced_links(spark, sf_dir):
    i = C("page_id")
    link = F.when(i % 3 == 0, F.concat(F.lit("code:p"), i)).otherwise(F.concat(F.lit("p"), i))
    return table(spark, sf_dir, "pages").select("page_id", mt.namespaced_link(link, F.when(i % 2 == 0, "memory").otherwise("code")).alias("target"))


@register("promotable_lessons", "SELECT o_orderkey FROM orders WHERE o_custkey % 4 >= 1 AND (DATE '1999-01-01' - o_orderdate::DATE) >= 7")
def promotable_lessons(spark, sf_dir):
    age = F.datediff(F.lit("1999-01-01").cast("date"), C("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").where(memory.promotable(C("o_custkey") % 4, age)).select("o_orderkey")
