import datetime as dt

import pytest

from sparkloom.streaming import enforcement as en

EVENTS = "run_id long, ts timestamp, kind string, tokens long"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get(en.STORE[0])
    spark.conf.set(*en.STORE)
    yield spark
    spark.conf.set(en.STORE[0], before)


def at(run, minute, kind, tokens):
    return run, T0 + dt.timedelta(minutes=minute), kind, tokens


def test_a_violation_is_told_once_also_after_a_restart_and_idle_runs_are_forgotten(store, tmp_path):
    spark = store

    def feed(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        out = en.enforce(stream, {"tokens": 100, "tool_calls": 2, "time": 1800}, idle_seconds=3600, late="1 minute")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(100) and q.exception() is None
        return sorted(tuple(r) for r in spark.read.schema(en.VIOLATION).parquet(str(tmp_path / "out")).collect())

    assert feed([at(1, 0, "tool_call", 60), at(2, 0, "iteration", None), (None, T0, "iteration", 900), at(1, 1, "tool_call", 40)]) == []
    first = [(1, "tokens", 101, 100), (1, "tool_calls", 3, 2)]
    assert feed([at(1, 5, "tool_call", 1)]) == first
    assert feed([at(1, 6, "tool_call", 500), at(2, 31, "iteration", 1)]) == sorted([*first, (2, "time", 1860, 1800)])
    feed([at(3, 600, "iteration", 1)])  # the watermark passes the idle time of runs 1 and 2
    later = feed([at(1, 601, "iteration", 150)])
    assert later == sorted([*first, (2, "time", 1860, 1800), (1, "tokens", 150, 100)])


def test_dead_letters_and_repeated_batches(spark, tmp_path):
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    put = en.dead_letter_sink("id long, name string", good, dead)
    rows = spark.createDataFrame([('{"id": 1, "name": "a"}',), ('{"id": 2, "na',), ("",), (None,), ('{"id": "x"}',), ('{"id": 3}',)], "value string")
    for _ in range(2):  # the second run of a batch replaces the first
        put(rows, 0)
    put(rows.limit(0), 1)
    assert sorted((r.id, r.name) for r in spark.read.parquet(good).collect()) == [(1, "a"), (3, None)]
    assert sorted((str(r.value), r.reason) for r in spark.read.parquet(dead).collect()) == [("", "empty"), ("None", "empty"), ('{"id": "x"}', "malformed"), ('{"id": 2, "na', "malformed")]


def test_dead_letters_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id": 1}\nbroken\n')
    for _ in range(2):  # the restart finds nothing new
        q = spark.readStream.text(str(tmp_path / "in")).writeStream.foreachBatch(en.dead_letter_sink("id long", str(tmp_path / "good"), str(tmp_path / "dead"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "dead")).count() == 1
