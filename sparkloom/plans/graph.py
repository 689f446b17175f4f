"""Graph queries: orders are commits, parts are files, brands are communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import graph as g
from sparkloom.plans.catalog import register
from sparkloom.runtime import materialize, table

C = F.col
NOW = "2024-02-01 00:00:00"

COCHANGE_SQL = """
WITH l AS (SELECT l_orderkey AS commit, l_linenumber AS pos, l_partkey AS file, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
co AS (SELECT a.file AS src, b.file AS dst, max(exp(-0.0001 * greatest((epoch(TIMESTAMP '2024-02-01') - floor(epoch(a.ts))) / 86400.0, 0.0))) AS weight
  FROM l a JOIN l b ON a.commit = b.commit AND a.pos < b.pos AND a.file <> b.file GROUP BY 1, 2)
"""
EDGES_SQL = """
WITH e AS (SELECT l_suppkey AS src, 1000000 + l_partkey % 200 AS dst, 1.0::DOUBLE AS weight FROM lineitem),
p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM e WHERE src <> dst GROUP BY 1, 2),
c AS (SELECT DISTINCT node, node % 9 AS community FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p))
"""


def commits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", C("l_linenumber").alias("pos"), C("l_partkey").alias("file"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", C("o_orderdate").cast("timestamp").alias("ts"))
    return lines.join(orders, C("l_orderkey") == C("o_orderkey")).select(C("l_orderkey").alias("commit"), "pos", "file", "ts")


def cochange_edges(spark, sf_dir):
    return g.cochanges(commits(spark, sf_dir), F.lit(NOW).cast("timestamp"), 0.0001)


def edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(C("l_suppkey").alias("src"), (C("l_partkey") % 200 + 1000000).alias("dst"), F.lit(1.0).alias("weight"))


def communities(spark, sf_dir):
    return g.degrees(g.pair_weights(edges(spark, sf_dir))).select("node", (C("node") % 9).alias("community"))


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("cochange_pairs", COCHANGE_SQL + "SELECT src, dst, round(weight, 6) AS weight FROM co")
def cochange_pairs(spark, sf_dir):
    return _r(cochange_edges(spark, sf_dir), "weight")


@register("cochange_impact", COCHANGE_SQL + """, ch AS (SELECT p_partkey AS file FROM part WHERE p_size = 7),
i AS (SELECT dst AS file, weight FROM co WHERE src IN (SELECT file FROM ch) AND dst NOT IN (SELECT file FROM ch) UNION ALL SELECT src, weight FROM co WHERE dst IN (SELECT file FROM ch) AND src NOT IN (SELECT file FROM ch))
SELECT file, round(max(weight), 6) AS weight FROM i WHERE weight >= 0.3 GROUP BY 1 ORDER BY max(weight) DESC, file LIMIT 20""")
def cochange_impact(spark, sf_dir):
    changed = table(spark, sf_dir, "part").where("p_size = 7").select(C("p_partkey").alias("file"))
    return _r(g.cochange_impact(cochange_edges(spark, sf_dir), changed, 0.3, 20), "weight")


@register("graph_pair_weights", EDGES_SQL + "SELECT a, b, weight FROM p")
def pair_weights(spark, sf_dir):
    return g.pair_weights(edges(spark, sf_dir))


@register("graph_degrees", EDGES_SQL + "SELECT node, sum(weight) AS degree FROM (SELECT a AS node, weight FROM p UNION ALL SELECT b, weight FROM p) GROUP BY 1")
def degrees(spark, sf_dir):
    return g.degrees(g.pair_weights(edges(spark, sf_dir)))


@register("graph_modularity", EDGES_SQL + """,
x AS (SELECT p.weight, ca.community AS ca, cb.community AS cb FROM p JOIN c ca ON p.a = ca.node JOIN c cb ON p.b = cb.node),
t AS (SELECT community, sum(weight) AS total FROM (SELECT ca AS community, weight FROM x UNION ALL SELECT cb, weight FROM x) GROUP BY 1),
i AS (SELECT ca AS community, 2 * sum(weight) AS inn FROM x WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(inn, 0) / (SELECT sum(total) FROM t) - (total / (SELECT sum(total) FROM t)) ** 2), 6) AS modularity FROM t LEFT JOIN i USING (community)""")
def modularity(spark, sf_dir):
    return _r(g.modularity(g.pair_weights(edges(spark, sf_dir)), communities(spark, sf_dir)), "modularity")


@register("graph_quotient", EDGES_SQL + "SELECT a.community AS s, b.community AS t, sum(weight) AS weight FROM e JOIN c a ON e.src = a.node JOIN c b ON e.dst = b.node WHERE a.community <> b.community GROUP BY 1, 2")
def quotient(spark, sf_dir):
    return g.quotient(edges(spark, sf_dir), communities(spark, sf_dir))


def _pagerank_sql(rounds=20):
    steps = [EDGES_SQL, ", o AS (SELECT src, sum(weight) AS out FROM e GROUP BY 1), f AS (SELECT e.src, dst, sum(weight / out) AS share FROM e JOIN o USING (src) GROUP BY 1, 2), n AS (SELECT node FROM c), r0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(rounds):
        steps.append(f", r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN (SELECT dst AS node, sum(rank * share) AS got FROM r{i} JOIN f ON r{i}.node = f.src GROUP BY 1) USING (node))")
    return "".join(steps) + f" SELECT node, round(rank, 9) AS rank, round((rank - (SELECT min(rank) FROM r{rounds})) / ((SELECT max(rank) FROM r{rounds}) - (SELECT min(rank) FROM r{rounds})), 6) AS scaled FROM r{rounds}"


@register("graph_pagerank", _pagerank_sql())
def pagerank(spark, sf_dir):
    e = edges(spark, sf_dir)
    ranked = g.pagerank(communities(spark, sf_dir).select("node"), e)
    return ranked.select("node", F.round("rank", 9).alias("rank"), F.round("scaled", 6).alias("scaled"))


@register("graph_components", """
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 2000000 + c_nationkey * 100 + c_custkey % 40 AS b FROM customer), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT a AS node, a AS label FROM b UNION SELECT b.b, w.label FROM w JOIN b ON w.node = b.a)
SELECT node, min(label) AS label FROM w GROUP BY 1""")
def components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(C("c_custkey").alias("src"), (C("c_nationkey") * 100 + C("c_custkey") % 40 + 2000000).alias("dst"))
    return g.connected_components(c)


def _lpa_sql(rounds=3):
    steps = [EDGES_SQL, ", b AS (SELECT a AS node, b AS near, weight FROM p UNION ALL SELECT b, a, weight FROM p), l0 AS (SELECT node, node AS label FROM c)"]
    for i in range(rounds):
        steps.append(f", l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT v.node, v.label, row_number() OVER (PARTITION BY v.node ORDER BY w DESC, (v.label = o.label) DESC, v.label) AS r FROM (SELECT b.node, l.label, sum(weight) AS w FROM b JOIN l{i} l ON b.near = l.node GROUP BY 1, 2) v JOIN l{i} o ON v.node = o.node) WHERE r = 1)")
    return "".join(steps) + f" SELECT node, label FROM l{rounds}"


@register("graph_label_propagation", _lpa_sql())
def label_propagation(spark, sf_dir):
    return g.label_propagation(g.pair_weights(edges(spark, sf_dir)), 3)


@register("graph_merge_small", EDGES_SQL + """,
k AS (SELECT node, node % 60 AS community FROM c), z AS (SELECT community, count(*) AS n FROM k GROUP BY 1),
x AS (SELECT ca.community AS s, cb.community AS t, p.weight FROM p JOIN k ca ON p.a = ca.node JOIN k cb ON p.b = cb.node WHERE ca.community <> cb.community),
y AS (SELECT s, t, sum(weight) AS w FROM (SELECT s, t, weight FROM x UNION ALL SELECT t, s, weight FROM x) GROUP BY 1, 2),
g AS (SELECT s, t FROM (SELECT y.s, y.t, row_number() OVER (PARTITION BY s ORDER BY w DESC, t) AS r FROM y JOIN z ON y.s = z.community WHERE n < 6) WHERE r = 1),
h AS (SELECT g.s, CASE WHEN g2.t IS NULL OR g2.t = g.s THEN g.t ELSE g2.t END AS dest FROM g LEFT JOIN g g2 ON g.t = g2.s)
SELECT node, coalesce(dest, community) AS community FROM k LEFT JOIN h ON k.community = h.s""")
def merge_small(spark, sf_dir):
    placed = communities(spark, sf_dir).select("node", (C("node") % 60).alias("community"))
    return g.merge_small(g.pair_weights(edges(spark, sf_dir)), placed, 6)


@register("graph_attention", COCHANGE_SQL + """,
b AS (SELECT src AS node, dst AS near, weight FROM co UNION ALL SELECT dst, src, weight FROM co), s AS (SELECT p_partkey AS node, 1.0 AS score FROM part WHERE p_size = 9),
h1 AS (SELECT near AS node, max(score * weight * 0.5) AS score FROM s JOIN b USING (node) GROUP BY 1), h2 AS (SELECT near AS node, max(score * weight * 0.5) AS score FROM h1 JOIN b USING (node) GROUP BY 1)
SELECT node, round(max(score), 9) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1""")
def attention(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").where("p_size = 9").select(C("p_partkey").alias("node"), F.lit(1.0).alias("score"))
    co = materialize(cochange_edges(spark, sf_dir), "cochange")
    return g.attention(co, seeds).withColumn("score", F.round("score", 9))


@register("graph_reach", EDGES_SQL + """,
b AS (SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p), d0 AS (SELECT 7 AS node), d1 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM d0) AND dst NOT IN (SELECT node FROM d0)),
d2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM d1) AND dst NOT IN (SELECT node FROM d0) AND dst NOT IN (SELECT node FROM d1)),
d3 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM d2) AND dst NOT IN (SELECT node FROM d0) AND dst NOT IN (SELECT node FROM d1) AND dst NOT IN (SELECT node FROM d2))
SELECT node::BIGINT AS node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3""")
def reach(spark, sf_dir):
    p = g.pair_weights(edges(spark, sf_dir))
    both = materialize(p.select(C("a").alias("src"), C("b").alias("dst")).union(p.select("b", "a")), "reach-edges")
    return g.reach(both, spark.range(7, 8).select(C("id").alias("node")), 3)


@register("graph_neighbours", EDGES_SQL + """,
b AS (SELECT DISTINCT src AS file, dst AS near FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)
SELECT file, near FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY near) AS n FROM b) WHERE n <= 8""")
def neighbours(spark, sf_dir):
    files = communities(spark, sf_dir).select(C("node").alias("file"))
    return g.neighbours(edges(spark, sf_dir), files, 8)


@register("graph_contains_two_hops", """
SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def contains_two_hops(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = c.join(n, C("c_nationkey") == C("n_nationkey")).join(r, C("n_regionkey") == C("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("graph_alerts", """
WITH i AS (SELECT l_partkey AS file, count(DISTINCT l_suppkey % 5) AS communities, count(*) FILTER (l_returnflag = 'R') AS tests, count(*) FILTER (l_quantity > 45) AS cochanged FROM lineitem GROUP BY 1)
SELECT file, 'critical' AS severity, 'crosses communities' AS reason FROM i WHERE communities >= 3 UNION ALL SELECT file, 'warning', 'untested' FROM i WHERE tests = 0 UNION ALL SELECT file, 'info', 'changes together' FROM i WHERE cochanged > 0""")
def alerts(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("file")).agg(F.count_distinct(C("l_suppkey") % 5).alias("communities"), F.count_if(C("l_returnflag") == "R").alias("tests"), F.count_if(C("l_quantity") > 45).alias("cochanged"))
    return g.alerts(i)
