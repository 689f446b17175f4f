"""Context assembly: communities, files and task contexts packed into budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import packing
from sparkloom.plans.catalog import register
from sparkloom.runtime import table

C = F.col

#: The greater of a quarter of the bytes and 1.3 times the words of ``text``.
_TOKENS = r"greatest(floor(strlen(text) / 4), floor(len(regexp_extract_all(text, '[^\x09-\x0D ]+')) * 1.3))::BIGINT"


def _fold(items: str, by: str, budget: str) -> str:
    """Recursive CTEs i (ranked from 0) and f(kept, used) over ``items``; rows that do not fit are left out."""
    return f"""{items},
f AS (SELECT i.*, tokens <= {budget} AS kept, CASE WHEN tokens <= {budget} THEN tokens ELSE 0 END AS used FROM i WHERE r = 0
  UNION ALL SELECT i.*, f.used + i.tokens <= {budget}, CASE WHEN f.used + i.tokens <= {budget} THEN f.used + i.tokens ELSE f.used END FROM f JOIN i ON i.{by} = f.{by} AND i.r = f.r + 1)"""


_COMMUNITIES = """
WITH RECURSIVE c AS (SELECT s_nationkey AS query_id, l_partkey % 97 AS community, count(DISTINCT l_partkey) AS size, greatest(sum(l_quantity)::BIGINT, 1) AS tokens, round(avg(l_extendedprice), 2) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) - 1 AS r FROM c WHERE size >= 2)"""


@register("assembly_communities", _fold(_COMMUNITIES, "query_id", "4000") + " SELECT query_id, community, tokens, kept, CASE WHEN kept THEN used END::BIGINT AS used FROM f")
def communities(spark, sf_dir):
    """Nations ask for groups of parts; those that do not fit are hints."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    grouped = lines.join(suppliers, C("l_suppkey") == C("s_suppkey")).groupBy(C("s_nationkey").alias("query_id"), (C("l_partkey") % 97).alias("community"))
    scored = grouped.agg(F.count_distinct("l_partkey").alias("size"), F.sum("l_quantity").cast("long").alias("tokens"), F.round(F.avg("l_extendedprice"), 2).alias("score"))
    kept, hints = packing.assemble_communities(scored, 4000)
    sizes = scored.select("query_id", "community", F.greatest(C("tokens"), F.lit(1)).cast("long").alias("tokens"))
    left = hints.join(sizes, ["query_id", "community"]).select("query_id", "community", "tokens", F.lit(False).alias("kept"), F.lit(None).cast("long").alias("used"))
    return kept.select("query_id", "community", "tokens", F.lit(True).alias("kept"), "used").union(left)


_FILES = rf"""
WITH p AS (SELECT p_partkey AS k, p_brand AS query_id, CASE p_partkey % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/benchmarks/' ELSE 'src/' END || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '/lib.rs' ELSE '.rs' END AS path, p_retailprice / 1000 AS score, repeat(p_name || ' ', p_size) AS text FROM part),
w AS (SELECT query_id, path, score * CASE WHEN path LIKE 'tests/%' OR path LIKE 'src/benchmarks/%' THEN 0.1 ELSE 1 END AS score FROM p),
c AS (SELECT a.path AS path, b.path AS caller FROM p a JOIN p b ON b.k = a.k + 1 UNION ALL SELECT a.path, b.path FROM p a JOIN p b ON b.k = a.k + 2 UNION ALL SELECT a.path, b.path FROM p a JOIN p b ON b.k = a.k + 2 WHERE a.k % 5 = 0),
s AS (SELECT query_id, path FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 3),
b AS (SELECT query_id, caller AS path, least(count(*) * 0.2, 0.6) AS score FROM s JOIN c USING (path) WHERE caller <> path AND NOT caller LIKE '%/lib.rs' GROUP BY 1, 2),
t AS (SELECT query_id, path, sum(score) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM b) GROUP BY 1, 2),
i AS (SELECT t.*, greatest({_TOKENS}, 1) AS tokens FROM t JOIN (SELECT path, text FROM p) USING (path)),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, path) AS used, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM i)
SELECT query_id, path, round(score, 6) AS score, tokens, used::BIGINT AS used FROM o WHERE n <= 20 AND used <= 1200"""


@register("assembly_files", _FILES)
def files(spark, sf_dir):
    """Brands ask for parts as files; the next part calls, every fifth twice by the one after."""
    k = C("p_partkey")
    folder = F.when(k % 7 == 0, "tests/").when(k % 7 == 1, "src/benchmarks/").otherwise("src/")
    path = F.concat(folder, k.cast("string"), F.when(k % 11 == 0, "/lib.rs").otherwise(".rs"))
    p = table(spark, sf_dir, "part").select(k.alias("k"), C("p_brand").alias("query_id"), path.alias("path"), (C("p_retailprice") / 1000).alias("score"), F.expr("repeat(concat(p_name, ' '), p_size)").alias("text"))
    steps = F.concat(F.array(F.lit(1), F.lit(2)), F.when(C("k") % 5 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    calls = p.select("path", "k", F.explode(steps).alias("_s")).select("path", (C("k") + C("_s")).alias("k")).join(p.select("k", C("path").alias("caller")), "k").select("path", "caller")
    kept = packing.assemble_files(p.select("query_id", "path", "score"), calls, p.select("path", "text"), 1200)
    return kept.withColumn("score", F.round("score", 6))


_CONTEXT = rf"""
WITH RECURSIVE t AS (SELECT conv_id AS task_id, turn, role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT task_id, arg_min(text, turn) FILTER (role = 'user') AS objective, arg_max(text, turn) FILTER (role = 'assistant') AS step, list('turn ' || turn || ' ' || role ORDER BY turn) AS events FROM t GROUP BY 1),
s AS (SELECT task_id, 0 AS section, NULL::DOUBLE AS priority, '## Task Objective' || chr(10) || objective AS text FROM g WHERE objective IS NOT NULL
  UNION ALL SELECT task_id, 1, NULL, '## Current Step' || chr(10) || step FROM g WHERE step IS NOT NULL
  UNION ALL SELECT task_id, 4, NULL, '## Recent Events' || chr(10) || array_to_string(list_transform(list_reverse(events)[1:8], lambda x: '- ' || x), chr(10)) FROM g
  UNION ALL SELECT task_id, 6, (length(text) % 100) / 100 * (1 + (turn % 3) / 10) * greatest(1 - 0.1 * (turn % 8), 0.5) + CASE WHEN turn % 2 = 0 THEN 0.15 * pow(0.7, turn % 8) ELSE 0 END, text FROM t),
i AS (SELECT task_id, section, priority, text, {_TOKENS} AS tokens, row_number() OVER (PARTITION BY task_id ORDER BY section, priority DESC NULLS LAST, text) - 1 AS r FROM s)"""


@register("assembly_context", _fold(_CONTEXT, "task_id", "300") + " SELECT task_id, section, tokens, used::BIGINT AS used, md5(text) AS text_md5 FROM f WHERE kept")
def context(spark, sf_dir):
    """Each conversation as a task: its turns are events and blocks."""
    t = table(spark, sf_dir, "conversations").select(C("conv_id").alias("task_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    told = F.struct("turn", F.concat_ws(" ", F.lit("turn"), "turn", "role").alias("e"))
    none = F.array().cast("array<string>")
    task = t.groupBy("task_id").agg(
        F.min_by(F.when(C("role") == "user", C("text")), F.when(C("role") == "user", C("turn"))).alias("objective"),
        F.max_by(F.when(C("role") == "assistant", C("text")), F.when(C("role") == "assistant", C("turn"))).alias("step"),
        F.transform(F.array_sort(F.collect_list(told)), lambda x: x["e"]).alias("events"),
    ).withColumns({"hypothesis": F.lit(None).cast("string"), "constraints": none, "hot_files": none})
    blocks = t.select("task_id", "text", (F.length("text") % 100 / 100).alias("score"), (C("turn") % 3 / 10).alias("feedback"), (C("turn") % 8).alias("assembled"), (C("turn") % 2 == 0).alias("positive"))
    return packing.assemble_context(task, blocks, 300).select("task_id", "section", "tokens", "used", F.md5("text").alias("text_md5"))
