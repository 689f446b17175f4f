import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import jaccard


def sets_of(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, t=0.8):
    """[(doc_id, class_id, n_links, n_text_links)]"""
    sets = [sets_of(x) for _, x in rows]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, texts = [0] * len(rows), [set() for _ in rows]
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                if j > i:
                    common[j] += 1
        for j, c in common.items():
            if c >= t * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                if sets[i] != sets[j]:
                    texts[i].add(sets[j])
                    texts[j].add(sets[i])
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i)), links[i], len(texts[i])) for i, (d, _) in enumerate(rows)), key=str)


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return " ".join(out)


def corpus(seed=4):
    r = random.Random(seed)
    make = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    texts = [" ".join(make(r.randint(1, 200))) for _ in range(60)]
    for size in (40, 300):
        base = make(size)
        texts += [edited(base, r.randint(0, size // 25), r) for _ in range(60)]
    passage = " ".join(make(60))
    texts += [" ".join(make(40)) + " " + passage for _ in range(30)]
    texts += [texts[3]] * 7 + ["a b", "a b", "A  b", "", "", None, "a", "x " * 20000, "x " * 9]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[5]), (None, "only once here"), (None, ""), (2, texts[2])]


def test_chains_take_one_unit_a_link(spark):
    """Each text overlaps only the next: the units are about as many as the links."""
    words = [f"c{i}" for i in range(3000)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 150])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = jaccard.sketch(df)
    texts = sketch.select("doc_id", sketch.doc_id.alias("id"), "values", "bands")
    members = jaccard._members(texts)
    placed = jaccard._placed(jaccard._roots(members, texts))
    units = jaccard._units(members, texts, placed)
    assert units.select("unit").distinct().count() < 900
    got = jaccard.join(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows) and {r.class_id for r in got} == {0}


@pytest.mark.parametrize("blocks", [(512, 128), (8, 5)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", blocks[1])
    rows = corpus()
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n int")
    got = jaccard.join(df).select("doc_id", "class_id", "n_links", "n_text_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_of_each(spark):
    rows = corpus(9)
    names = ["n", "_row", "r1", "class_key", "_row_key"]
    df = spark.createDataFrame([(*x, *[4] * 5) for x in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert {tuple(r[c] for c in names) for r in got} == {(4,) * 5}
    want = brute(rows)
    classes = {c for d, c, _, _ in want if c is not None}
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == sorted(classes)
    assert sorted(str(x.text) for x in got if x.doc_id is None) == ["", "only once here"]
    assert jaccard.join(df.limit(0)).count() == 0


def test_bayes_keeps_true_pairs():
    limits = jaccard.least_matches()
    r = np.random.default_rng(1)
    words = jaccard.Words()
    base = [f"w{i}" for i in range(300)]
    lost = 0
    for k in range(300):
        other = list(base)
        for i in r.integers(0, 300, 6):
            other[i] = f"z{k}-{i}"
        a, b = (jaccard.shingles(" ".join(x), words) for x in (base, other))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = [jaccard.short_values(jaccard.minhash(x))[None] for x in (a, b)]
        lost += j >= 0.8 and not jaccard.surviving(*s, limits)[0, 0]
    assert lost == 0
    far = jaccard.short_values(jaccard.minhash(jaccard.shingles("q r s t u v w x y z", words)))[None]
    assert not jaccard.surviving(far, s[0], limits)[0, 0]
