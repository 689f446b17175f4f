import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import extraction, graph, ranking, trajectory
from sparkloom.sources import readers
from sparkloom.streaming import stateful

C = F.col


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenizers(spark):
    assert one(spark, tx.tokenize(F.lit("verifyJwtToken HTMLParser communities"))) == ["verifyjwttoken", "htmlparser", "communities", "verify", "jwt", "token", "html", "parser", "community"]
    got = one(spark, tx.tokenize_code(F.lit("fn open_harbour(gate: &str) -> Option<Tide>"), ["fn", "str", "option"]))
    assert {"open", "harbour", "gate", "tide"} <= set(got) and not {"fn", "str", "option"} & set(got)
    stems = {"processing": "process", "authentication": "authenticat", "management": "manage", "searchable": "search", "parser": "pars", "resolved": "resolv", "get": "get", "id": "id"}
    for w, s in stems.items():
        assert one(spark, tx.code_stem(F.lit(w))) == s
    assert one(spark, tx.keywords(F.lit("Move a Harbour LAMP? (pier.go)"))) == ["move", "harbour", "lamp", "pier", "go"]
    rows = spark.createDataFrame([(1, "count_boats readXMLTide"), (2, None), (3, "")], "i long, t string")
    as_rows = sorted(r.term for r in tx.tokens(rows, "i", "t").collect())
    assert as_rows == sorted(one(spark, tx.tokenize(F.lit("count_boats readXMLTide"))))


def test_text_forms(spark):
    assert one(spark, tx.normalize_error(F.lit("src/a.rs:12:3 bad: x:9"))) == "src/a.rs bad: x:9"
    assert one(spark, tx.normalize_lesson(F.lit("Don't  PANIC!"))) == "dont panic"
    assert one(spark, tx.normalize_error(F.lit("a.rs:7: failed"))) == "a.rs failed" and one(spark, tx.normalize_error(F.lit(" a:12:b:c "))) == "ab:c"
    assert one(spark, tx.slugify(F.lit("My Page/Two"))) == "my-page-two" and one(spark, tx.slugify(F.lit("Größe -- ok"))) == "größe--ok"
    for q, want in {"where is the cache": "api_lookup", "How does it start": "call_flow", "LAYER rules": "architecture", "what is a tide": "concept", "an Overview": "onboarding", "hello": "unknown"}.items():
        assert one(spark, tx.query_class(F.lit(q))) == want


@pytest.mark.parametrize("ranked,expected,ndcg,ap", [("xa", "a", 0.6309, 0.5), ("xab", "ab", 0.6934, 0.5833), ("axb", "ab", 0.9197, 0.8333)])
def test_metrics(spark, ranked, expected, ndcg, ap):
    results = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranked)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", d) for d in expected], "query_id string, doc_id string")
    m = ranking.ir_metrics(results, qrels, 5).first()
    assert m.ndcg == pytest.approx(ndcg, abs=1e-3) and m.ap == pytest.approx(ap, abs=1e-3) and m.precision == len(expected) / 5


def steps(spark, rows):
    data = [("r", i, kind, i * 10, "e", payload, tool, outcome) for i, (kind, tool, payload, outcome) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, sequence long, event_type string, timestamp long, entity_id string, payload_summary string, tool_name string, outcome string").withColumn("retryable", F.lit(False)).withColumn("duration_ms", F.lit(None).cast("long"))


def test_loops(spark):
    call = lambda t, p: ("ToolCallCompleted", t, p, "Success")
    s = steps(spark, [call("read_file", "a")] * 3 + [call("grep", "x")])
    assert trajectory.doom_loop_frequency(s).first().value == 0.5
    rows = [("grep", "x")] * 6 + [("read_file", "a")] * 2 + [("bash", "t")] * 2
    got = [r.consecutive for r in trajectory.loop_verdicts(steps(spark, [call(*r) for r in rows])).orderBy("sequence").collect()]
    state, want = ("", "", 0), []
    for r in rows:
        state = stateful.step(state, *r)
        want.append(state[2])
    assert got == want == [1, 2, 3, 4, 5, 6, 0, 1, 1, 2]


def test_integrity_and_bad_lines(spark, tmp_path):
    lines = [json.dumps({"v": 1, "seq": i, "ts": i, "run_id": "r", "kind": "event", "event_type": "Error", "payload": "{}"}) for i in (0, 1, 2, 5, 6)]
    (tmp_path / "t.jsonl").write_text("\n".join([*lines, lines[0][:20]]))
    env = readers.trajectories(spark, str(tmp_path / "t.jsonl")).cache()
    assert env.where("corrupt is null").count() == 5 and env.where("corrupt is not null").count() == 1
    good = env.where("corrupt is null")
    assert [tuple(r) for r in trajectory.missing_ranges(good).collect()] == [("r", 3, 5)]
    assert trajectory.integrity(good).first().confidence == pytest.approx(5 / 7)


def test_git_log_and_cochange(spark):
    log = ["COMMIT:a 1000000", "main.rs", "lib.rs", "", "COMMIT:b 900000", "lib.rs", "model.rs", "utils.rs"]
    lines = spark.createDataFrame(list(enumerate(log)), "line_no long, line string")
    commits = readers.git_commits(lines)
    assert commits.count() == 5
    co = graph.cochanges(commits.withColumn("ts", F.timestamp_seconds("ts")), F.timestamp_seconds(F.lit(1000000)))
    assert {(r.src, r.dst) for r in co.collect()} == {("main.rs", "lib.rs"), ("lib.rs", "model.rs"), ("lib.rs", "utils.rs"), ("model.rs", "utils.rs")}
    assert {r.src: r.weight for r in co.collect()}["main.rs"] == 1.0


def test_components_and_pagerank(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)] + [(i, i + 1) for i in range(20, 60)], "src long, dst long")
    got = {r.node: r.label for r in graph.connected_components(e).collect()}
    assert got[3] == 1 and got[5] == 4 and got[60] == 20 and 9 not in got
    stars = [(1, i) for i in range(2, 3000)] + [(9000, i) for i in range(4000, 6000)] + [(2500, 9000)]
    got = {r.label for r in graph.connected_components(spark.createDataFrame(stars, "src long, dst long")).collect()}
    assert got == {1}
    w = spark.createDataFrame([(1, 3, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "src long, dst long, weight double")
    ranks = {r.node: r.rank for r in graph.pagerank(spark.range(1, 5).select(C("id").alias("node")), w).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) == 3


def test_packing(spark):
    items = spark.createDataFrame([("q", i, t, i) for i, t in enumerate([5, 9, 3, 2])], "query_id string, rank int, tokens long, doc_id long")
    assert [r.rank for r in ranking.pack_stop(items, 10).collect()] == [0]
    assert sorted(r.rank for r in ranking.pack_skip(items, 10).collect()) == [0, 2, 3]
    assert sorted(r.rank for r in ranking.pack_skip(items, 10, most=2).collect()) == [0, 2]


def test_extraction(spark):
    files = spark.createDataFrame([("a/m.py", "python", "import os.path\nclass A:\n    def run(self):\n        helper(os.getenv('HOME_DIR'))\n@app.get('/u/{id}')\ndef helper(x):\n    pass"), ("b/l.rs", "rust", "use std::io;\npub fn go() { helper(1); }\nstruct S;")], "path string, language string, text string")
    assert {(r.kind, r.name) for r in extraction.symbols(files).collect()} == {("class", "A"), ("function", "run"), ("function", "helper"), ("function", "go"), ("struct", "S")}
    assert {r.source for r in extraction.imports(files).collect()} == {"os.path", "std::io"}
    assert [r.name for r in extraction.env_vars(files).collect()] == ["HOME_DIR"]
    route = extraction.routes(files).first()
    assert (route.method, route.route, route.params) == ("GET", "/u/{id}", ["id"])
    refs = {(r.path, r.callee): r.method for r in extraction.references(extraction.call_sites(files), extraction.symbols(files)).collect()}
    assert refs["a/m.py", "helper"] == "same_file"
    nodes, edges = extraction.build_graph(files)
    assert nodes.count() == 7 and edges.where("edge_type = 'Contains'").count() == 5


def test_sources(spark):
    pages = spark.createDataFrame([("s", "---\ntitle: T\ntier: Cached\n---\nbody"), ("u", "plain")], "slug string, content string")
    got = {r.slug: r for r in readers.frontmatter(pages).collect()}
    assert (got["s"].title, got["s"].tier, got["s"].body) == ("T", "Cached", "body") and got["u"].title is None and got["u"].body == "plain"
    sse = spark.createDataFrame([(1, i, s) for i, s in enumerate(['data: {"choices":[{"delta":{"content":"he"}}]}', ": ping", 'data: {"choices":[{"delta":{"content":"y"}}]}', "data: [DONE]"])], "id long, line_no long, line string")
    assert readers.stream_deltas(sse).first().text == "hey"


def test_streaming_loop_detector(spark, tmp_path):
    rows = [(1, i, "grep" if i != 4 else "bash", "x") for i in range(8)]
    for k in range(2):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], "run_id long, sequence long, tool_name string, payload_summary string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, sequence long, tool_name string, payload_summary string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.loop_detector(stream).writeStream.format("memory").queryName("loops").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.consecutive for r in spark.table("loops").orderBy("sequence").collect()] == [1, 2, 3, 4, 1, 1, 2, 3]
