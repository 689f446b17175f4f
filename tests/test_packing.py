import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import packing, ranking


def brute(rows, budget, stop=False, most=None, carry=True):
    """Rows (group, section, place, tokens, allowance, forced), sorted; kept (group, section, place, used)."""
    out = []
    for g in {r[0] for r in rows}:
        used = kept = left = 0
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        for s in sorted({r[1] for r in mine}):
            spent, over, share = 0, False, None
            for _, _, place, tokens, share, forced in (r for r in mine if r[1] == s):
                if over or (most is not None and kept >= most):
                    continue
                if (forced or share is None or spent + tokens <= share + left) and used + tokens <= budget:
                    used, spent, kept = used + tokens, spent + tokens, kept + 1
                    out.append((g, s, place, used))
                elif stop:
                    over = True
            if carry and share is not None:
                left += max(0, share - spent)
    return sorted(out, key=repr)


def test_fold_against_brute_force(spark):
    r = np.random.default_rng(8)
    rows = [(["a", "b", None, ""][int(r.integers(4))], int(r.integers(3)), i, int(r.integers(0, 40)), None, bool(r.random() < 0.1)) for i in range(400)]
    rows = [(g, s, i, t, [60, None, 25][s], f) for g, s, i, t, _, f in rows]
    df = spark.createDataFrame(rows, "g string, section int, place int, tokens int, share int, must boolean")
    for stop in (False, True):
        for most in (None, 9):
            for carry in (False, True):
                got = packing.fold(df, ["g"], [F.asc("place")], 300, packing.Rules(stop, most, carry), "section", F.col("share"), F.col("must"))
                assert got.columns == [*df.columns, "used"]
                assert sorted(((x.g, x.section, x.place, x.used) for x in got.collect()), key=repr) == brute(rows, 300, stop, most, carry)


def test_a_group_of_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("query_id"), F.col("id").cast("int").alias("rank"), (F.col("id") * 7919 % 1000 + 1).alias("tokens"), F.col("id").alias("doc_id"))
    got = [(x["rank"], x.tokens) for x in ranking.pack_skip(df, 10_000).orderBy("rank").collect()]
    want, used = [], 0
    for i in range(1_000_000):
        t = i * 7919 % 1000 + 1
        if used + t <= 10_000:
            used += t
            want.append((i, t))
    assert got == want
    assert [x["rank"] for x in ranking.pack_skip(df, 10_000, most=3).orderBy("rank").collect()] == [x for x, _ in want[:3]]


def test_budget_of_each_group_and_odd_rows(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, None, 10), (2, 7, 6), (2, 6, 6)], "query_id int, tokens int, most int")
    got = packing.fold(df, ["query_id"], [F.desc("tokens")], F.col("most"))
    assert sorted((x.query_id, x.tokens or 0, x.used) for x in got.collect()) == [(1, 0, 5), (1, 5, 5), (2, 6, 6)]
    assert packing.fold(df.limit(0), ["query_id"], [F.desc("tokens")], 5).count() == 0


def test_context_sections(spark):
    task = spark.createDataFrame([(1, "Fix the login", None, "The token is stale", ["no new crates"], [f"e{i}" for i in range(11)], []), (2, "x " * 200, "step", None, [], [], ["a.rs"])], "task_id int, objective string, step string, hypothesis string, constraints array<string>, events array<string>, hot_files array<string>")
    blocks = spark.createDataFrame([(1, "low block", 0.2, 0.0, 0, False), (1, "high block", 0.9, 0.0, 0, False), (1, "often shown", 1.0, 0.0, 9, False), (1, "praised", 0.5, 0.9, 0, True)], "task_id int, text string, score double, feedback double, assembled int, positive boolean")
    rows = packing.assemble_context(task, blocks, 100).collect()
    one = [r.text for r in sorted((r for r in rows if r.task_id == 1), key=lambda r: r.used)]
    assert one[0] == "## Task Objective\nFix the login"
    assert one[3] == "## Recent Events\n" + "\n".join(f"- e{i}" for i in range(10, 2, -1))
    assert one[4:] == ["praised", "high block", "often shown", "low block"]
    assert [r.text for r in sorted((r for r in rows if r.task_id == 2), key=lambda r: r.used)] == ["## Current Step\nstep", "## Hot Files\n- a.rs"]


def test_communities_and_hints(spark):
    df = spark.createDataFrame([("q", "a", 3, 6, 0.9), ("q", "b", 3, 6, 0.8), ("q", "c", 1, 1, 0.99), ("q", "d", 2, 0, 0.1), ("q", "e", 2, 9, 0.7)], "query_id string, community string, size int, tokens int, score double")
    kept, hints = packing.assemble_communities(df, 10)
    assert sorted((r.community, r.tokens, r.used) for r in kept.collect()) == [("a", 6, 6), ("d", 1, 7)]
    assert sorted((r.place, r.community) for r in hints.collect()) == [(1, "b"), (2, "e")]


def test_feedback_asks_again(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.0, 0.5]), (4, [0.0, 0.0, 1.0])], "doc_id long, e array<double>")
    queries = spark.createDataFrame([(i, [0.0, 0.9, 0.1]) for i in range(150)] + [(200, [1.0, 1.0, 0.0])], "query_id long, qe array<double>")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in ranking.feedback_scan(queries, vectors, 2).collect()}
    assert len(got) == 302
    assert got[0, 0] == (2, round(0.93 / (0.93**2 + 0.07**2) ** 0.5, 6)) and got[0, 1] == (4, round(0.1 / 0.82**0.5, 6))
    assert got[149, 0] == got[0, 0] and got[200, 0][0] == 1
