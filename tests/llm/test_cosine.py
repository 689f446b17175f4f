import math

import numpy as np

from sparkloom.llm import cosine, jaccard


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs and a search."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    big = [max(map(abs, v)) if good else 1.0 for good, (_, v) in zip(ok, rows, strict=True)]
    near = [[] for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(a) == len(b):
                x, y = [p / big[i] for p in a], [p / big[j] for p in b]
                if math.fsum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(math.fsum(p * p for p in x) * math.fsum(q * q for q in y)) >= threshold:
                    near[i].append(j)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [k for j in front for k in near[j] if k not in seen and not seen.add(k)]
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((name, len(near[i]), least, name == least))
    return sorted(out, key=repr)


def linked(spark, rows, columns="vec_id long, embedding array<double>", **more):
    df = spark.createDataFrame(rows, columns)
    return sorted(map(tuple, cosine.link(df, **more).collect()), key=repr)


def test_groups_chains_and_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", 16)
    r = np.random.default_rng(3)
    vectors = list(r.standard_normal((150, 24)))
    centre = r.standard_normal(24)
    vectors += [centre + 0.03 * r.standard_normal(24) for _ in range(70)]  # a dense group over many blocks
    at = r.standard_normal(24)
    for _ in range(40):  # a chain: neighbours link, ends do not
        at = at + 0.22 * r.standard_normal(24)
        vectors.append(at)
    vectors += [vectors[0]] * 9 + [2 * vectors[1], 0.5 * vectors[1], -vectors[2]]
    order = r.permutation(len(vectors)).tolist()
    rows = [(i, [float(x) for x in vectors[k]]) for i, k in enumerate(order)]
    want = brute(rows)
    assert max(x[1] for x in want) >= 69 and len({x[2] for x in want}) > 100
    assert linked(spark, rows) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 0.0]), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (None, [0.0, 5.0]), (None, [0.0, 5.0]), (None, [1.0, 0.05]), (None, None)]
    rows += [(8, [1.0]), (9, [3.0]), (10, [-3.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-300, 1e-301]), (13, [1e300, 1e299]), (14, [-0.0, 1.0]), (15, [0.0, 1.0]), (16, [0.5] * 3000), (17, [0.5] * 2999 + [0.6])]
    want = sorted(((a, b, c, a == c) for a, b, c, _ in brute(rows)), key=repr)
    assert linked(spark, [(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, kept string") == want
    assert linked(spark, [], "vec_id long, embedding array<float>") == []
    assert linked(spark, [(1, None), (2, None)], "vec_id long, embedding array<float>") == [(1, 0, 1, True), (2, 0, 2, True)]


def test_layout_keeps_its_promise():
    r = np.random.default_rng(9)
    for points in (2, 5_000, 50_000, 10**9):
        bits, tables, most = cosine.layout(points)
        same = 1 - math.acos(0.95) / math.pi
        assert (1 - same**bits) ** tables <= 1e-6
    bits, tables, most = cosine.layout(50_000)
    a = cosine.unit(r.standard_normal((4000, 64)))
    side = r.standard_normal((4000, 64))
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * cosine.unit(side - (side * a).sum(1, keepdims=True) * a)
    (s, x), (t, y) = cosine.signs(a, bits, tables), cosine.signs(b, bits, tables)
    assert (x == y).any(1).all()
    assert (np.bitwise_count(s ^ t).sum(1) <= most).all()
    other = np.bitwise_count(s ^ np.roll(t, 1, 0)).sum(1) <= most
    assert other.mean() < 0.001


def test_equal_rows_by_number(spark):
    rows = [(5, [1.0, 2.0])] * 600 + [(3, [1.0, 2.1])]
    got = linked(spark, rows)
    assert got == sorted([(5, 600, 3, False)] * 600 + [(3, 600, 3, True)], key=repr)
