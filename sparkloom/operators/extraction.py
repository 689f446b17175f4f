"""Source extraction by patterns: symbols, imports, calls, variables, routes.

No syntax-tree parser is installed, so these read lines by regular expressions
per language.  They stay in the JVM and keep line numbers, but see text, not
scopes; the graph takes its declarations from :mod:`sparkloom.operators.scopes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col
SYMBOLS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")],
    "typescript": [("function", r"\bfunction\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)")],
    "javascript": [("function", r"\bfunction\s+(\w+)"), ("class", r"\bclass\s+(\w+)")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+[\w<>\[\], ]+\s(\w+)\s*\(")],
    "ruby": [("function", r"^\s*def\s+(?:self\.)?(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
    "php": [("function", r"\bfunction\s+(\w+)"), ("class", r"\bclass\s+(\w+)")],
}
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)()",
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"()',
    "typescript": r"""(?:from|require\()\s*['"]([^'"]+)['"]()""",
    "javascript": r"""(?:from|require\()\s*['"]([^'"]+)['"]()""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)()",
}
ENV = r"""(?:os\.environ(?:\.get)?[\[(]\s*['"]|getenv\(\s*['"]|process\.env\.|env::var\(\s*"|System\.getenv\(\s*"|ENV\[['"])([A-Z][A-Z0-9_]*)"""
ROUTES = r"""(?:@\w+|\b(?:app|router|r|e|mux|Route))\s*(?:\.|::)\s*(get|post|put|delete|patch|GET|POST|PUT|DELETE|PATCH)\(\s*['"]([^'"]+)['"]"""
NOT_CALLS = ("if", "for", "while", "switch", "match", "return", "catch", "def", "fn", "func", "function", "class", "elif", "with", "assert")


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", C("line_no") + 1)


def symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, line_start)"""
    found = F.array().cast("array<struct<kind:string,name:string>>")
    for lang, rules in SYMBOLS.items():
        one = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", r, 1).alias("name")) for k, r in rules]), lambda x: x["name"] != "")
        found = F.when(C("language") == lang, one).otherwise(found)
    return lines(files).select("path", "line_no", F.explode(found).alias("s")).select("path", "s.kind", "s.name", C("line_no").alias("line_start"))


def imports(files: DataFrame) -> DataFrame:
    """(path, source, line)"""
    found = F.lit(None).cast("string")
    for lang, rule in IMPORTS.items():
        found = F.when(C("language") == lang, F.concat(F.regexp_extract("line", rule, 1), F.regexp_extract("line", rule, 2))).otherwise(found)
    return lines(files).select("path", found.alias("source"), C("line_no").alias("line")).where("source <> ''")


def call_sites(files: DataFrame) -> DataFrame:
    """(path, callee, line)"""
    names = F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1)
    found = lines(files).where(~C("line").rlike(r"^\s*(?:async\s+)?(?:pub\s+)?(?:def|fn|func|function|class)\b"))
    return found.select("path", F.explode(names).alias("callee"), C("line_no").alias("line")).where(~C("callee").isin(*NOT_CALLS))


def env_vars(files: DataFrame) -> DataFrame:
    return lines(files).select("path", F.explode(F.regexp_extract_all("line", F.lit(ENV), 1)).alias("name"), C("line_no").alias("line"))


def routes(files: DataFrame) -> DataFrame:
    """(path, method, route, line, params)"""
    got = lines(files).select("path", C("line_no").alias("line"), F.upper(F.regexp_extract("line", ROUTES, 1)).alias("method"), F.regexp_extract("line", ROUTES, 2).alias("route"))
    return got.where("method <> ''").withColumn("params", route_params(C("route")))


def route_params(route: Column) -> Column:
    """Names in ``:id``, ``{id}`` and ``<int:id>`` segments."""
    return F.regexp_extract_all(route, F.lit(r"(?::|\{|<(?:\w+:)?)(\w+)"), 1)


def references(calls: DataFrame, syms: DataFrame) -> DataFrame:
    """(path, line, callee, target, method, confidence): the best strategy that is unambiguous.

    Same file .90, globally unique .80, same folder .75, ambiguous .40, else unresolved 0.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    s = syms.select(C("path").alias("target"), "name").distinct().withColumn("total", F.count("*").over(Window.partitionBy("name")))
    j = calls.join(s, calls["callee"] == s["name"], "left")
    method = F.when(C("target").isNull(), "unresolved").when(C("target") == C("path"), "same_file").when(C("total") == 1, "global_unique").when(folder(C("target")) == folder(C("path")), "same_folder").otherwise("ambiguous")
    sure = F.when(method == "same_file", 0.9).when(method == "global_unique", 0.8).when(method == "same_folder", 0.75).when(method == "ambiguous", 0.4).otherwise(0.0)
    best = j.groupBy("path", "line", "callee").agg(F.max(F.struct(sure.alias("c"), method.alias("m"), C("target").alias("t"))).alias("b"))
    return best.select("path", "line", "callee", C("b.t").alias("target"), C("b.m").alias("method"), C("b.c").alias("confidence"))


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): files and symbols; Contains, Imports, Calls and Inherits."""
    from sparkloom.operators import scopes  # it builds on the references above

    found = scopes.declarations(files)
    syms = found.where("kind <> 'impl'").select("path", "kind", "name", C("line").alias("line_start")).withColumn("id", F.concat_ws(":", F.lit("sym"), "path", "name"))
    nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("node_type"), C("path").alias("name"), C("path").alias("file_path")).union(syms.select("id", F.lit("Symbol"), "name", "path")).distinct()
    contains = syms.select(F.concat(F.lit("file:"), "path").alias("source"), C("id").alias("target"), F.lit("Contains").alias("edge_type"), F.lit(1.0).alias("weight"))
    imported = imports(files).select(F.concat(F.lit("file:"), "path"), F.concat(F.lit("import:"), "source"), F.lit("Imports"), F.lit(1.0))
    called = references(call_sites(files), syms).where("target is not null and confidence > 0.4").select(F.concat(F.lit("file:"), "path"), F.concat_ws(":", F.lit("sym"), "target", "callee"), F.lit("Calls"), C("confidence"))
    return nodes, contains.union(imported).union(called).union(scopes.inheritance(found)).distinct()
