"""References to symbols resolved by a cascade of ranked strategies.

Every strategy is a keyed join against a table with one row a key; a reference
takes the first that holds.  References of a name that very many share stay
where they are, and the name's row travels to them.

Order and confidences (fixed values):  the name is imported and found in the
file it is imported from .95, imported from outside .75, imported from a file
that only hands it on .85; the receiver of a qualified name is imported, with
.90, .70 and .80 in the same cases; defined in the same file .90; defined once
in all files .80; in the same folder .60; the first of several .40; a builtin
of the language .65; else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.maintenance import resolve_imports
from sparkloom.operators.skew import join_counted
from sparkloom.runtime import materialize
from sparkloom.sources.readers import language

C = F.col
EXTERNAL = "<external>"


def bare_name(name: Column) -> Column:
    """What follows the last ``::``, or else the last dot, or else the last arrow."""
    out = name
    for mark in ("->", ".", "::"):
        out = F.when(F.contains(name, F.lit(mark)), F.substring_index(name, mark, -1)).otherwise(out)
    return out


def receiver(name: Column) -> Column:
    """What precedes the first dot, or else the first ``::``, or else the first arrow; null for a bare name."""
    out = F.lit(None).cast("string")
    for mark in ("->", "::", "."):
        out = F.when(F.contains(name, F.lit(mark)), F.substring_index(name, mark, 1)).otherwise(out)
    return out


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def import_index(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name, target) of ``imports(file, source, names, line)`` and ``files(path)``: one row for each name a file imports.

    A relative source leads to a file or nowhere, a dotted one of Python to a
    package or module of the project; all others lead outside.  An import
    without names brings its source as name.  Of a file's imports of one name a
    relative one counts first (the last of several), then the first other.
    """
    every = imports.select("file", "source", "line", F.explode(F.when(F.size("names") > 0, C("names")).otherwise(F.array("source"))).alias("name"))
    near = every.where(C("source").rlike(r"^\.\.?/"))
    found = resolve_imports(near.select(C("file").alias("path"), "source").distinct(), files).where(C("target") != EXTERNAL)
    near = near.join(found.withColumnRenamed("path", "file"), ["file", "source"]).select("file", "name", "target", F.lit(1).alias("_first"), C("line").alias("_n"))
    far = every.where(~C("source").rlike(r"^\.\.?/"))
    as_path = F.replace(C("source"), F.lit("."), F.lit("/"))
    tried = far.where(C("file").rlike(r"\.pyi?$")).select("source").distinct().select("source", F.posexplode(F.array(F.concat(as_path, F.lit("/__init__.py")), F.concat(as_path, F.lit(".py")))).alias("_t", "path"))
    packages = tried.join(files.select("path"), "path", "left_semi").groupBy("source").agg(F.min_by("path", "_t").alias("_p"))
    inside = F.when(C("file").rlike(r"\.pyi?$"), C("_p"))
    far = far.join(packages, "source", "left").select("file", "name", F.coalesce(inside, F.lit(EXTERNAL)).alias("target"), F.lit(0).alias("_first"), (-C("line")).alias("_n"))
    return near.union(far).groupBy("file", "name").agg(F.max_by("target", F.struct("_first", "_n")).alias("target"))


def resolve(refs: DataFrame, symbols: DataFrame, index: DataFrame, builtins: DataFrame | None = None) -> DataFrame:
    """``refs(ref_id, file, name, target_file, confidence, method)`` with target_file, target_line, confidence and method anew.

    ``symbols(file, name, line)``, ``index`` from :func:`import_index`,
    ``builtins(language, name)``.  A reference keeps its own confidence and
    method if its confidence is the higher one, and its own target if the
    cascade finds none.
    """
    place = F.struct("file", "line")
    own = symbols.groupBy("file", "name").agg(F.max("line").alias("line"))
    anywhere = symbols.groupBy("name").agg(F.count("*").alias("total"), F.min(place).alias("first"))
    beside = symbols.groupBy(folder(C("file")).alias("_folder"), C("name").alias("_bare")).agg(F.min(place).alias("_beside"))
    # Stored, as four readers follow: the references and the parts of their names are made once.
    rows = materialize(refs.withColumns({"_bare": bare_name(C("name")), "_receiver": receiver(C("name")), "_folder": folder(C("file")), "_l": language(C("file"))}), "references")
    # The names asked for, with how often: those of many references don't meet in one task.
    asked = rows.groupBy("_bare").agg(F.count("*").alias("n")).join(anywhere.withColumnRenamed("name", "_bare"), "_bare", "left")
    rows = join_counted(rows, asked, ["_bare"], rows.count()).drop("n")

    def looked_up(rows: DataFrame, name: str, into: str) -> DataFrame:
        """The import of ``name`` as ``into``, and the line of the bare name in its file."""
        hit = index.select(C("file"), C("name").alias(name), C("target").alias(into))
        line = own.select(C("file").alias(into), C("name").alias("_bare"), C("line").alias(f"{into}_line"))
        return rows.join(hit, ["file", name], "left").join(line, [into, "_bare"], "left")

    rows = looked_up(looked_up(rows, "_bare", "_in"), "_receiver", "_via")
    rows = rows.join(own.select("file", C("name").alias("_bare"), C("line").alias("_here")), ["file", "_bare"], "left").join(beside, ["_folder", "_bare"], "left")
    if builtins is None:
        rows = rows.withColumn("_builtin", F.lit(False))
    else:
        known = builtins.select(C("language").alias("_l"), C("name").alias("_bare"), F.lit(True).alias("_builtin")).distinct()
        rows = rows.join(known, ["_l", "_bare"], "left")

    def given(method: str, sure: float, file: Column | None = None, line: Column | None = None) -> Column:
        return F.struct(F.lit(method).alias("m"), F.lit(sure).alias("c"), (F.lit(None).cast("string") if file is None else file).alias("f"), (F.lit(None).cast("long") if line is None else line.cast("long")).alias("l"))

    def imported(into: str, found: float, outside: float, handed_on: float) -> Column:
        return F.when(C(into) == EXTERNAL, given("import_known", outside)).when(C(f"{into}_line").isNotNull(), given("import_based", found, C(into), C(f"{into}_line"))).otherwise(given("import_based", handed_on))

    best = (
        F.when(C("_in").isNotNull(), imported("_in", 0.95, 0.75, 0.85))
        .when(C("_via").isNotNull(), imported("_via", 0.90, 0.70, 0.80))
        .when(C("_here").isNotNull(), given("same_file", 0.90, C("file"), C("_here")))
        .when(C("total") == 1, given("global_unique", 0.80, C("first.file"), C("first.line")))
        .when(C("_beside").isNotNull(), given("global_same_dir", 0.60, C("_beside.file"), C("_beside.line")))
        .when(C("total") > 1, given("global_ambiguous", 0.40, C("first.file"), C("first.line")))
        .when(C("_builtin"), given("external", 0.65))
        .otherwise(given("unresolved", 0.0))
    )
    judged = rows.withColumn("_r", best).withColumn("_own", F.coalesce(C("confidence") > C("_r.c"), F.lit(False)))
    return judged.select(
        "ref_id", "file", "name", F.coalesce("_r.f", "target_file").alias("target_file"), C("_r.l").alias("target_line"),
        F.when(C("_own"), C("confidence")).otherwise(C("_r.c")).alias("confidence"), F.when(C("_own"), C("method")).otherwise(C("_r.m")).alias("method"),
    )
