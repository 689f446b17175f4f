import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bitslice, queries


def brute(rows, k=20, step=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, a) in enumerate(ok):
        if q % step == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(ok) if n != place)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = queries.queries()["op3_bitslice"](spark, d).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, -0.5]), (20, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [inf, 1.0]), (4, [nan, 0.0]), (5, [0.3, 0.2]), (6, [0.3, 0.2]), (7, [0.3, 0.2]), (None, [1.0, 1.0]), (40, [-2.0, 900.0]), (8, [0.1]), (9, []), (9, [5.0, 5.0]), (0, [1.0, -0.5]), (60, [0.5] * 300), (60, [2.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, part int")
    for size in (4, 1000):
        monkeypatch.setattr(bitslice, "BLOCK_ROWS", size)
        for k in (2, 20):
            got = bitslice.top_k(df, F.col("vec_id") % 20 == 0, k).collect()
            assert sorted(map(tuple, got)) == brute(rows, k)
    assert bitslice.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_equal_queries_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 70)
    df = spark.createDataFrame([(20, [1.0, 2.0])] * 300 + [(i, [i / 9, 1.0]) for i in range(1, 15)], "vec_id long, embedding array<double>")
    got = bitslice.top_k(df, F.col("vec_id") % 20 == 0)
    assert got.count() == 6000
    assert {(r.rank, r.vec_id, r.score, r["count"]) for r in got.groupBy("rank", "vec_id", "score").count().collect()} == {(n + 1, 20, 64 * 64 * 5, 300) for n in range(20)}


def test_large_components(spark):
    rows = [(0, [2.0**36, -3.0]), (1, [2.0**37, 1.0]), (2, [-(2.0**40), 2.0]), (20, [1.0, 2.0**20]), (3, [0.0, 2.0**30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):  # 2^43 * 2^46
        bitslice.top_k(df, F.col("vec_id") == 0).collect()
    got = bitslice.top_k(df, F.col("vec_id") == 20).collect()
    assert sorted(map(tuple, got)) == [x for x in brute(rows) if x[0] == 20]
    with pytest.raises(Exception, match="does not fit"):
        bitslice.top_k(spark.createDataFrame([(0, [1e30])], df.schema), F.col("vec_id") == 0).collect()


def test_adders_and_descent():
    r = np.random.default_rng(5)
    values = r.integers(-90, 90, (500, 9))
    planes, bias = bitslice.slice_rows(values)
    assert (bitslice.rows_of(planes, bias, np.arange(500)) == values).all()
    for i, found, score in bitslice.search_block(planes, bias, 500, values[2:4], 30, np.array([2, 3])):
        assert (np.array(score) == values[found] @ values[2 + i]).all()
        assert i + 2 not in found and len(found) == 30
    wide = np.array([[-(1 << 63), (1 << 63) - 1], [5, -7]])
    planes, bias = bitslice.slice_rows(wide)
    assert (bitslice.rows_of(planes, bias, np.arange(2)) == wide).all()


def test_dealt_queries_are_not_broadcast(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = bitslice.top_k(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
