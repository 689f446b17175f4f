import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")


def waterfill(sizes, weights=(5, 2, 1), ratio=1.5):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: ratio * sum(sizes.values()) * w[s] / sum(w.values()) for s in names}
    done = set()
    while over := [s for s in names if s not in done and target[s] > 2 * sizes[s] + 1e-9]:
        done |= set(over)
        left = ratio * sum(sizes.values()) - sum(2 * sizes[s] for s in done)
        free = [s for s in names if s not in done]
        for s in names:
            target[s] = 2 * sizes[s] if s in done else left * w[s] / sum(w[x] for x in free)
    return target


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 17 + 1), None if i % 11 == 0 else f"s{i % 5 if i % 2 else 0}", 7) for i in range(800)]
    out = mixing.mix(docs(spark, rows)).collect()
    sizes, taken, biggest = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = waterfill(sizes)
    assert len(out) == 800
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]


def test_epochs_precede_sampling(spark):
    rows = [(i, "a b c", "big" if i < 300 else "small", 0) for i in range(330)]
    out = mixing.mix(docs(spark, rows)).collect()
    small = [r.taken for r in out if r.source == "small"]
    big = [r.taken for r in out if r.source == "big"]
    assert set(small) == {6}
    assert min(big) >= 3 and sum(big) == pytest.approx(1.5 * 990 - 180, abs=3)


def test_reruns_agree_and_edges(spark):
    rows = [(None, None, None, 1), (1, "", "x", 1), (2, "a", "x", 1), (2, "a", "x", 1), (3, "long " * 50000, "y", 1), (4, "k", "y", None)]
    one, two = (sorted(mixing.mix(docs(spark, rows)).select("doc_id", "size", "taken").collect(), key=str) for _ in range(2))
    assert one == two and len(one) == 6
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a", 1)])).collect()[0].taken == 0


def test_repeat_taken(spark):
    rows = [(i, "a b", "s", 0) for i in range(40)]
    mixed = mixing.mix(docs(spark, rows))
    again = mixing.repeat_taken(mixed)
    assert again.count() * 2 == mixed.agg(F.sum("taken")).first()[0]
    assert set(again.columns) == {"doc_id", "text", "source"}


def drawn(rows, target):
    """Words taken of each row by one sort on the keys of a source, after its whole epochs."""
    out, size = {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    for source in size:
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (r["_key"], r["_tie"]))
        epochs = int(target[source] // size[source]) if size[source] else 0
        rest, upto = target[source] - epochs * size[source], 0
        for r in mine:
            upto += r.size
            out[r.doc_id] = r.size * (epochs + (upto - r.size / 2 <= rest))
    return out


def test_the_draw_is_a_sort_by_key(spark):
    rows = [(i, "word %d " % (i * 7919 % 13) * (i * 31 % 29 + 1), f"s{i % 4 if i % 3 else 0}", 0) for i in range(700)] + [(900 + i, "only", f"d{i}", 0) for i in range(40)]
    df = docs(spark, rows)
    keyed = mixing.measure(df.select("doc_id", "text", "source")).collect()
    mixed = mixing.mix(df).collect()
    want = drawn(keyed, {r.source: r.target for r in mixed})
    assert {r.doc_id: r.taken for r in mixed} == want and 0 < sum(want.values())


def test_any_names_and_many_sources(spark):
    names = ["size", "Taken", "target", "source_size", "epochs", "buckets", "end_bucket", "cut", "_s", "_salt", "_of", "_row", "_again", "_key", "_tie", "n", "bucket"]
    rows = [(i, "a b c", f"site{i % 150}", *[7] * len(names)) for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    mixed = mixing.mix(df)
    left = [n for n in names if n.lower() not in mixing.ADDED]
    assert mixed.columns == ["doc_id", "text", "source", *left, *mixing.ADDED]
    out = mixed.collect()
    assert {tuple(r[n] for n in left) for r in out} == {(7,) * len(left)}
    want = waterfill({f"site{i}": 9 for i in range(150)})
    for r in out:
        assert r.target == pytest.approx(want[r.source])
    assert mixing.repeat_taken(mixed).columns == ["doc_id", "text", "source", *left]


def test_a_source_may_end_among_copies(spark):
    rows = [(1, "ten words are in this text and then no more", "hot", 0)] * 800 + [(i, "five words are in it", "hot", 0) for i in range(2, 402)]
    rows += [(None, "a b c d", None, k) for k in range(300)] + [(5000 + i, "a b", "rest", 0) for i in range(90)]
    out = mixing.mix(docs(spark, rows).repartition(7), weights=(3.0, 1.0, 1.0), ratio=0.8).collect()
    assert len(out) == len(rows)
    sizes = {"hot": 10000, None: 1200, "rest": 180}
    for source, size in sizes.items():
        mine = [r for r in out if r.source == source]
        most = max(r.size for r in mine)
        assert {r.source_size for r in mine} == {size} and {r.taken % r.size for r in mine} == {0}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= most / 2 + 1e-6
        assert max(r.taken / r.size for r in mine) <= 2
    again = mixing.mix(docs(spark, rows).repartition(3), weights=(3.0, 1.0, 1.0), ratio=0.8).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r.doc_id, r.size, r.taken) for r in out), key=repr)
    alone = mixing.mix(docs(spark, [(1, "ten words are in this text and then no more", "s", 0)] * 1000), ratio=0.37).collect()
    assert sum(r.taken for r in alone) == 3700
