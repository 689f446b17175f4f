from pyspark.sql import functions as F

from sparkloom.operators import resolution as rs
from sparkloom.sources.readers import language


def test_names(spark):
    cases = {"user.save": ("save", "user"), "a.b.c": ("c", "a"), "Cls::method": ("method", "Cls"), "std::io::read": ("read", "std"), "$obj->method": ("method", "$obj"), "validate": ("validate", None), "a.b::c": ("c", "a")}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r.name: (r.b, r.v) for r in df.select("name", rs.bare_name(F.col("name")).alias("b"), rs.receiver(F.col("name")).alias("v")).collect()}
    assert got == cases


def test_import_index(spark):
    files = spark.createDataFrame([("src/service.ts",), ("src/util/index.ts",), ("pkg/nn/__init__.py",), ("pkg/io.py",), ("pkg/nn.py",)], "path string")
    imports = [("src/handler.ts", "./service", ["UserService", "x"], 1), ("src/handler.ts", "./gone", ["Gone"], 2), ("src/handler.ts", "express", [], 3), ("src/handler.ts", "lib", ["x", "y"], 4), ("src/a/b.ts", "../util", ["u"], 1), ("pkg/m.py", "pkg.nn", ["Module"], 1), ("pkg/m.py", "pkg.io", ["read"], 2), ("pkg/m.py", "numpy", ["np"], 3), ("src/h.ts", "pkg.io", ["read"], 1)]
    got = {(r.file, r.name): r.target for r in rs.import_index(spark.createDataFrame(imports, "file string, source string, names array<string>, line int"), files).collect()}
    out = rs.EXTERNAL
    assert got == {
        ("src/handler.ts", "UserService"): "src/service.ts", ("src/handler.ts", "x"): "src/service.ts", ("src/handler.ts", "express"): out, ("src/handler.ts", "y"): out,
        ("src/a/b.ts", "u"): "src/util/index.ts", ("pkg/m.py", "Module"): "pkg/nn/__init__.py", ("pkg/m.py", "read"): "pkg/io.py", ("pkg/m.py", "np"): out, ("src/h.ts", "read"): out,
    }


def test_each_strategy_and_a_hub_name(spark):
    symbols = spark.createDataFrame([("a/x.py", "f", 3), ("a/x.py", "f", 9), ("a/y.py", "g", 1), ("b/z.py", "g", 2), ("b/z.py", "only", 5), ("b/w.py", "h", 1), ("c/v.py", "h", 1), ("a/x.py", "hub", 7)], "file string, name string, line int")
    index = spark.createDataFrame([("a/m.py", "f", "a/x.py"), ("a/m.py", "np", rs.EXTERNAL), ("a/m.py", "t", "a/y.py"), ("a/m.py", "y", "a/y.py")], "file string, name string, target string")
    lang = spark.range(1).select(language(F.lit("a.py")).alias("l")).first().l
    builtins = spark.createDataFrame([(lang, "print")], "language string, name string")
    cases = [
        ("f", "a/m.py", ("a/x.py", 9, 0.95, "import_based")), ("np", "a/m.py", (None, None, 0.75, "import_known")), ("t", "a/m.py", (None, None, 0.85, "import_based")),
        ("np.array", "a/m.py", (None, None, 0.70, "import_known")), ("y.g", "a/m.py", ("a/y.py", 1, 0.90, "import_based")), ("y.nothing", "a/m.py", (None, None, 0.80, "import_based")),
        ("f", "a/x.py", ("a/x.py", 9, 0.90, "same_file")), ("only", "a/m.py", ("b/z.py", 5, 0.80, "global_unique")), ("g", "a/m.py", ("a/y.py", 1, 0.60, "global_same_dir")),
        ("h", "a/m.py", ("b/w.py", 1, 0.40, "global_ambiguous")), ("print", "a/m.py", (None, None, 0.65, "external")), ("nowhere", "a/m.py", (None, None, 0.0, "unresolved")),
    ]
    rows = [(i, file, name, None, 0.0, "raw") for i, (name, file, _) in enumerate(cases)]
    rows += [(100, "a/m.py", "h", "kept.py", 0.5, "raw"), (101, "a/m.py", "nowhere", "kept.py", 0.5, "raw"), (102, "a/m.py", "h", None, None, None)]
    rows += [(1000 + i, "q/q.py", "hub", None, 0.0, "raw") for i in range(700)]
    refs = spark.createDataFrame(rows, "ref_id int, file string, name string, target_file string, confidence double, method string")
    got = {r.ref_id: (r.target_file, r.target_line, r.confidence, r.method) for r in rs.resolve(refs, symbols, index, builtins).collect()}
    assert len(got) == len(rows)
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == want, cases[i]
    assert got[100] == ("b/w.py", 1, 0.5, "raw") and got[101] == ("kept.py", None, 0.5, "raw") and got[102] == ("b/w.py", 1, 0.4, "global_ambiguous")
    assert {got[1000 + i] for i in range(700)} == {("a/x.py", 7, 0.8, "global_unique")}
    assert rs.resolve(refs.limit(0), symbols, index).count() == 0


def test_references_are_made_once(spark):
    """What makes the references ran again for every reader of them."""
    refs = spark.range(3).select(F.col("id").alias("ref_id"), F.lit("a/m.py").alias("file"), F.lit("f").alias("name"), F.lit(None).cast("string").alias("target_file"), F.lit(0.0).alias("confidence"), F.lit("raw").alias("method"))
    symbols = spark.createDataFrame([("a/x.py", "f", 3)], "file string, name string, line int")
    got = rs.resolve(refs, symbols, spark.createDataFrame([], "file string, name string, target string"))
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[3:] for r in got.collect()} == {("a/x.py", 3, 0.8, "global_unique")} and got.count() == 3
