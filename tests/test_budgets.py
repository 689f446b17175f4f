import pytest
from pyspark.sql import functions as F

from sparkloom.operators import budgets as bg

C, L = F.col, F.lit


def test_rules(spark):
    r = spark.range(1).select(
        bg.adaptive_budget(L(25)).alias("small"), bg.adaptive_budget(L(400)).alias("mid"), bg.adaptive_budget(L(10**6)).alias("large"),
        bg.budget_split(L(16000)).alias("split"), bg.task_split(L(101)).alias("task"),
        bg.block_priority(L(1.0), L(0.5), L(9), L(False)).alias("worn"), bg.block_priority(L(1.0), L(0.0), L(1), L(True)).alias("stable"),
        bg.fusion_weights(L(2.0), L(1.0), L(0.0), L(1.0)).alias("w"), bg.fusion_weights(L(0.0), L(0.0), L(0.0), L(0.0)).alias("w0"),
        bg.retry_delay(L(3)).alias("d3"), bg.retry_delay(L(70)).alias("d70"), bg.retry_delay(L(1), jitter=L(0.5)).alias("dj"),
        bg.recency(L(24 * 3600 * 1000)).alias("day"), bg.recency(L(-5)).alias("future"),
        F.array(*[bg.assembly_penalty(L(p)) for p in ("src/a.rs", "x/tests/a", "tests/a", "a_test.go", "b/benches/c", "Eval_x", "latest/a")]).alias("p"),
        F.array(*[bg.is_hub_file(L(p)) for p in ("a/lib.rs", "lib.rs", "a/main.rs")]).alias("hub"),
        bg.consolidation_gate(L(True), L(False), L(True), L(4)).alias("g"), bg.consolidation_gate(L(False), L(True), L(True), L(9)).alias("g0"),
        bg.promotion(F.array(), L(False)).alias("out"), bg.promotion(F.array(L("c")), L(False)).alias("kept"),
        bg.health(L(81), L(100)).alias("h"), bg.health(L(5), L(0)).alias("h0"),
        F.array(*[bg.seed_folder(L(n)) for n in ("file:crates/tide/src/a.rs", "sym:src/pier/b.rs::f", "a.rs", "lib/gate/c.py", "x.y/z.w")]).alias("seed"),
    ).first()
    assert (r.small, r.mid, r.large) == (4000, 10000, 32000)
    assert tuple(r.split) == (2400, 4000, 6400, 2400, 800) and tuple(r.task) == (15, 25, 61)
    assert r.worn == pytest.approx(0.75) and r.stable == pytest.approx(0.9 + 0.105)
    assert r.w == [0.5, 0.25, 0.0, 0.25] and r.w0 == [0.55, 0.30, 0.05, 0.10]
    assert (r.d3, r.d70, r.dj) == (8000, 30000, 1000) and (r.day, r.future) == (0.5, 1.0)
    assert r.p == [1.0, 0.1, 0.1, 0.1, 0.1, 0.1, 1.0] and r.hub == [True, False, True]
    assert (r.g, r.g0, r.out, r.kept) == ("insufficient_files", "no_memory_dir", "evicted", "promoted")
    assert tuple(r.h) == (0.81, True) and tuple(r.h0) == (0.0, False)
    assert r.seed == ["tide", "pier", "root", "gate", "x.y"]


def test_reverse_boost_and_symbols(spark):
    scores = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("q", "d", 0.5)], "query_id string, path string, score double")
    calls = spark.createDataFrame([("a", "d")] * 5 + [("a", "a"), ("b", "x/lib.rs"), ("c", "e"), ("d", "f")], "path string, caller string")
    got = {r.path: round(r.score, 6) for r in bg.reverse_boost(scores, calls).collect()}
    assert got == {"a": 3.0, "b": 2.0, "c": 1.0, "d": 1.1, "e": 0.2}
    symbols = spark.createDataFrame([("f1", "open"), ("f1", "open_gate"), ("f2", "Gate"), ("f3", "tide"), ("", "gate")], "path string, symbol string")
    degree = spark.createDataFrame([("open", 9), ("Gate", 2)], "symbol string, callers int")
    got = {r.path: (r.symbol, round(r.score, 6)) for r in bg.symbol_scores(symbols, "open Gate", degree).collect()}
    assert got == {"f1": ("open", 2.5), "f2": ("Gate", 2.2)}


def test_ghosts_and_hypotheses(spark):
    c = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, score double")
    assert [r.path for r in bg.without_ghosts(c, spark.createDataFrame([("b",)], "path string")).collect()] == ["b"]
    formed = spark.createDataFrame([("e1", "h1"), ("e2", "h2")], "event_id string, hypothesis string")
    assert [r.hypothesis for r in bg.open_hypotheses(formed, spark.createDataFrame([("e1",)], "prior_event_id string")).collect()] == ["h2"]
    s = spark.createDataFrame([("a", 1, 2), ("b", None, 2), (None, 1, 2)], "path string, line_start int, line_end int")
    assert bg.source_ranges(s).count() == 1
