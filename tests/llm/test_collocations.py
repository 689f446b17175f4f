import re
from collections import Counter

import numpy as np

from sparkloom.llm import collocations as c

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    by_lang = {}
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def corpus(seed=4, docs=120):
    r = np.random.default_rng(seed)
    words = ["the", "Of", "new", "york", "city", "Ünder", "漢字", "<a>", "don't", "x"] + [f"w{k}" for k in range(30)]
    weight = 1 / np.arange(1, len(words) + 1)
    out = []
    for k in range(docs):
        picks = r.choice(len(words), r.integers(0, 90), p=weight / weight.sum())
        gaps = r.choice([" ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b", "\x1f", "\x85"], len(picks), p=[0.7, 0.05, 0.05, 0.05, 0.03, 0.04, 0.02, 0.02, 0.02, 0.02])
        text = "".join(words[p] + g for p, g in zip(picks.tolist(), gaps.tolist(), strict=True))
        out.append((["en", "de", None, "und"][k % 4], text + " new york city hall" * (k % 3)))
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*x, 1) for x in rows], "lang string, text string, n int").repartition(5)
    return sorted(map(tuple, c.mine(df, **more).collect()))


def test_small_sizes_against_brute_force(spark):
    rows = corpus() + [("en", None), ("en", ""), ("en", " . ,"), (None, "one")]
    rows += [("en", "deep " * 3000 + ". New York City " * 500), ("de", "ab cd ef\tgh " * 900)]  # longer than a run; no break at all
    want = brute(rows, 3)
    assert len(want) > 200 and max(x[1] for x in want) > 50
    assert mined(spark, rows, least=3, sizes=c.Sizes(run=997, cell=1, shard=20, resident=2)) == want
    assert mined(spark, rows, least=3, sizes=c.Sizes(cell=1 << 30)) == want  # the filter drops next to nothing
    assert mined(spark, rows, least=3, top=5) == [x for x in want if x[1] <= 5]


def test_query_against_brute_force(spark):
    from sparkloom.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.queries()["op12_collocations"](spark, d).collect())) == brute(rows)


def test_more_shards_than_a_task_holds(spark):
    rows = corpus()
    assert mined(spark, rows, least=3, sizes=c.Sizes(run=997, cell=1, shard=20, resident=2, gathered=1, most_gathered=500, together=7)) == brute(rows, 3)


def test_a_shard_is_read_once_for_many_keys():
    r, loads = np.random.default_rng(2), []
    k1, k2 = r.integers(0, 2**64, (2, 2000), dtype=np.uint64)
    hashes = {shard: c.PerfectHash(k1[at], k2[at]) for shard, at in c._by_shard(k1, 8)}
    load = lambda s: loads.append(s) or hashes[s]
    keys = [(k1[at], k2[at]) for at in (r.integers(0, 2000, 50) for _ in range(100))]
    total = {s: np.zeros(len(h.k1), np.int64) for s, h in hashes.items()}
    for shard, counts in c.slot_counts(iter(keys), load, 8, c.Sizes(run=50, resident=2)):
        total[shard] += counts
    want = np.bincount(np.searchsorted(np.sort(k1), np.concatenate([x[0] for x in keys])), minlength=2000)
    found = {int(k): n for s, h in hashes.items() for k, n in zip(h.k1.tolist(), total[s].tolist(), strict=True)}
    assert [found[k] for k in np.sort(k1).tolist()] == want.tolist()
    assert len(loads) <= 16  # one for the keys, one for a slot's array; 100 runs once loaded 800


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", "a b"), (None, None)]) == []


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        k1, k2 = r.integers(0, 2**64, (2, n), dtype=np.uint64)
        k1[: n // 3] = k1[:1]  # told apart by the second key alone
        h = c.PerfectHash(k1, k2)
        assert sorted(h.slots(k1, k2).tolist()) == list(range(n))
        assert (h.slots(k1, k2 + np.uint64(1)) == -1).all()
        assert (h.slots(*r.integers(0, 2**64, (2, 5000), dtype=np.uint64)) == -1).all()
        assert len(h.words) * 64 <= 6 * n + 2048


def test_scores_past_64_bits():
    a = np.array([1 << 60, 7], np.int64)
    parts = np.array([(1 << 61) + 1, 15], np.int64)
    assert c.scores(a, parts).tolist() == [2_000_000 * (1 << 60) // ((1 << 61) + 1), 14_000_000 // 15]
    assert c.scores(a[1:], parts[1:]).tolist() == [933_333]
