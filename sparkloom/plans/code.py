"""Resolution of references: parts are symbols, suppliers import, line items refer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import resolution, scopes
from sparkloom.plans.catalog import register
from sparkloom.runtime import shared_path, table
from sparkloom.sources import logs

C = F.col


@register("reference_resolution", """
WITH s AS (SELECT 'src/d' || p_partkey % 7 || '/f' || p_partkey % 40 || '.py' AS file, split_part(p_name, ' ', 2) || p_partkey % 300 AS name, p_partkey AS line, p_partkey AS k FROM part),
own AS (SELECT file, name, max(line) AS line FROM s GROUP BY 1, 2),
ix AS (SELECT 'src/d' || s_suppkey % 7 || '/f' || s_suppkey % 40 || '.py' AS file, 'm' || s_suppkey % 11 AS name, max(CASE WHEN s_suppkey % 3 = 0 THEN '<external>' ELSE 'src/d' || (s_suppkey + 1) % 7 || '/f' || (s_suppkey + 1) % 40 || '.py' END) AS target FROM supplier GROUP BY 1, 2
  UNION ALL SELECT 'src/d' || s_suppkey % 7 || '/f' || s_suppkey % 40 || '.py', s.name, max(CASE s_suppkey % 4 WHEN 0 THEN '<external>' WHEN 3 THEN 'src/d0/f0.py' ELSE s.file END) FROM supplier JOIN s ON k = s_suppkey GROUP BY 1, 2),
r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, 'src/d' || l_suppkey % 7 || '/f' || l_suppkey % 40 || '.py' AS file, CASE WHEN l_linenumber = 7 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'print' ELSE 'missing' END WHEN l_linenumber % 3 = 0 THEN 'm' || l_partkey % 11 || '.' || s.name ELSE s.name END AS name, l_tax * 10 AS confidence FROM lineitem JOIN s ON k = l_partkey),
b AS (SELECT *, split_part(name, '.', -1) AS bare, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END AS via FROM r),
g AS (SELECT name, count(*) AS total, min((file, line)) AS first FROM s GROUP BY 1), d AS (SELECT name, regexp_extract(file, '^(.*)/', 1) AS dir, min((file, line)) AS first FROM s GROUP BY 1, 2),
j AS (SELECT b.*, i.target AS i, io.line AS il, v.target AS v, vo.line AS vl, o.line AS ol, g.total, g.first AS gf, d.first AS df FROM b LEFT JOIN ix i ON i.file = b.file AND i.name = bare LEFT JOIN own io ON io.file = i.target AND io.name = bare
  LEFT JOIN ix v ON v.file = b.file AND v.name = via LEFT JOIN own vo ON vo.file = v.target AND vo.name = bare LEFT JOIN own o ON o.file = b.file AND o.name = bare LEFT JOIN g ON g.name = bare LEFT JOIN d ON d.name = bare AND d.dir = regexp_extract(b.file, '^(.*)/', 1)),
c AS (SELECT *, CASE WHEN i = '<external>' THEN ('import_known', 0.75, NULL, NULL) WHEN il IS NOT NULL THEN ('import_based', 0.95, i, il) WHEN i IS NOT NULL THEN ('import_based', 0.85, NULL, NULL)
  WHEN v = '<external>' THEN ('import_known', 0.7, NULL, NULL) WHEN vl IS NOT NULL THEN ('import_based', 0.9, v, vl) WHEN v IS NOT NULL THEN ('import_based', 0.8, NULL, NULL) WHEN ol IS NOT NULL THEN ('same_file', 0.9, file, ol)
  WHEN total = 1 THEN ('global_unique', 0.8, gf[1], gf[2]) WHEN df IS NOT NULL THEN ('global_same_dir', 0.6, df[1], df[2]) WHEN total > 1 THEN ('global_ambiguous', 0.4, gf[1], gf[2]) WHEN bare = 'print' THEN ('external', 0.65, NULL, NULL) ELSE ('unresolved', 0.0, NULL, NULL) END AS x FROM j)
SELECT ref_id, file, name, x[3]::VARCHAR AS target_file, x[4]::BIGINT AS target_line, round(greatest(confidence, x[2])::DOUBLE, 6) AS confidence, CASE WHEN confidence > x[2] THEN 'extractor' ELSE x[1] END AS method FROM c""")
def reference_resolution(spark, sf_dir):
    at = lambda k, more=0: F.concat(F.lit("src/d"), (k + more) % 7, F.lit("/f"), (k + more) % 40, F.lit(".py"))
    part, supplier, lines = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    named = part.select(C("p_partkey").alias("k"), at(C("p_partkey")).alias("file"), F.concat(F.split_part(C("p_name"), F.lit(" "), F.lit(2)), C("p_partkey") % 300).alias("name"))
    symbols = named.select("file", "name", C("k").alias("line"))
    k = C("s_suppkey")
    modules = supplier.select(at(k).alias("file"), F.concat(F.lit("m"), k % 11).alias("name"), F.when(k % 3 == 0, resolution.EXTERNAL).otherwise(at(k, 1)).alias("target"))
    direct = supplier.join(named.select(C("k").alias("s_suppkey"), "name", C("file").alias("_f")), "s_suppkey").select(at(k).alias("file"), "name", F.when(k % 4 == 0, resolution.EXTERNAL).when(k % 4 == 3, "src/d0/f0.py").otherwise(C("_f")).alias("target"))
    index = modules.union(direct).groupBy("file", "name").agg(F.max("target").alias("target"))
    joined = lines.join(named.select(C("k").alias("l_partkey"), C("name").alias("_n")), "l_partkey")
    odd = F.when(C("l_orderkey") % 2 == 0, "print").otherwise("missing")
    name = F.when(C("l_linenumber") == 7, odd).when(C("l_linenumber") % 3 == 0, F.concat(F.lit("m"), C("l_partkey") % 11, F.lit("."), C("_n"))).otherwise(C("_n"))
    refs = joined.select((C("l_orderkey") * 10 + C("l_linenumber")).alias("ref_id"), at(C("l_suppkey")).alias("file"), name.alias("name"), F.lit(None).cast("string").alias("target_file"), (C("l_tax") * 10).cast("double").alias("confidence"), F.lit("extractor").alias("method"))
    builtins = spark.createDataFrame([("Python", "print"), ("python", "print")], "language string, name string")
    return resolution.resolve(refs, symbols, index, builtins).withColumn("confidence", F.round("confidence", 6))


@register("partial_json", """
WITH c AS (SELECT event_id, trim(left('[' || props || ', {"t": "' || event_type || '"}]', (event_id % (length(props) + length(event_type) + 14))::BIGINT)) AS t FROM events),
q AS (SELECT *, len(regexp_replace(t, '[^"]', '', 'g')) % 2 = 1 AS s FROM c), o AS (SELECT *, t || CASE WHEN s THEN '"' ELSE '' END || CASE WHEN len(regexp_replace(t, '[^{]', '', 'g')) > len(regexp_replace(t, '[^}]', '', 'g')) THEN '}' ELSE '' END || CASE WHEN t LIKE '[%' AND NOT t LIKE '%]' THEN ']' ELSE '' END AS x FROM q)
SELECT event_id, CASE WHEN t = '' THEN NULL WHEN json_valid(t) THEN t WHEN json_valid(x) AND NOT regexp_matches(x, ', *[]}]') THEN x END AS completed FROM o""")
def partial_json(spark, sf_dir):
    """The payload of each event, broken off somewhere."""
    whole = F.concat(F.lit("["), "props", F.lit(', {"t": "'), "event_type", F.lit('"}]'))
    cut = F.left(whole, (C("event_id") % (F.length("props") + F.length("event_type") + 14)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.partial_json(cut).alias("completed"))


@register("scoped_declarations", r"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS form, 'p' || p_partkey AS path, 'C' || p_partkey AS name, 'B' || p_size AS base FROM part)
SELECT path, CASE form WHEN 1 THEN 'struct' ELSE 'class' END AS kind, name, CASE form WHEN 1 THEN 3 ELSE 2 END AS line, '' AS scope, CASE form WHEN 1 THEN '' ELSE base END AS bases, CASE form WHEN 0 THEN 'note:String,f' || k || ':long' WHEN 1 THEN 'f' || k || ':u64' ELSE 'f' || k || ':int' END AS fields FROM p
UNION ALL SELECT path, CASE form WHEN 0 THEN 'method' ELSE 'function' END, 'm' || k, CASE form WHEN 1 THEN 4 ELSE 5 END, name, '', '' FROM p
UNION ALL SELECT path, 'impl', name, 4, '', base, '' FROM p WHERE form = 1""")
def scoped_declarations(spark, sf_dir):
    """A source text for each part, with decoys in comments and strings."""
    k, base = C("p_partkey"), F.concat(F.lit("B"), "p_size")
    java = F.concat(F.lit("/* class Gone {} */\nclass C"), k, F.lit(" extends "), base, F.lit(' {\n  String note = "class Fake {";\n  long f'), k, F.lit(";\n  void m"), k, F.lit("() { run(); }\n}\n"))
    rust = F.concat(F.lit("// struct Gone {}\n\nstruct C"), k, F.lit(" { f"), k, F.lit(": u64 }\nimpl "), base, F.lit(" for C"), k, F.lit(" { fn m"), k, F.lit('(&self) { f("fn no() {"); } }\n'))
    python = F.concat(F.lit("# class Gone:\nclass C"), k, F.lit("("), base, F.lit('):\n    """class Fake:"""\n    f'), k, F.lit(": int = 0\n    def m"), k, F.lit("(self): pass\n"))
    form = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("path"), form(java, rust, python).alias("text"), form("java", "rust", "python").alias("language"))
    joined = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",")
    return scopes.declarations(files).select("path", "kind", "name", "line", "scope", F.array_join("bases", ",").alias("bases"), joined.alias("fields"))


@register("log_recovery", """
WITH kept AS (SELECT event_type AS writer, event_id AS seq FROM events WHERE event_id % 7 <> 0 OR event_id % 14 = 0)
SELECT writer, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, max(seq) - min(seq) + 1 - count(*) AS missing FROM kept GROUP BY 1""")
def log_recovery(spark, sf_dir):
    """All events are appended; every seventh line is torn, and half of those are written again."""
    events = table(spark, sf_dir, "events").select(C("event_type").alias("writer"), C("event_id").alias("seq"), C("props").alias("payload"))
    path = shared_path(spark, "log")
    torn = F.expr("left(value, cast(length(value) / 2 as int))")
    logs.append(events.where("seq % 7 <> 0"), path, 1)
    logs.encoded(events.where("seq % 7 = 0"), 1).select(torn.alias("value")).write.mode("append").text(path)
    logs.append(events.where("seq % 14 = 0"), path, 2)
    return logs.gaps(logs.recover(logs.parsed(logs.lines(spark, path))))
