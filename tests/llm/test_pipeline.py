from collections import Counter

import public_tokenizers
import zstandard
from test_jaccard import brute as classes_of
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import quality
from sparkloom.runtime import table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    compress, bands = zstandard.ZstdCompressor(level=3).compress, quality.Bands()

    one = corpus_pipeline.quality_rules(spark, docs, SF)
    good = set()
    for i, r in rows.items():
        n = quality.measure(r.text, r.text.encode())
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0] and bands.verdict(compress, r.text.encode()):
            good.add(i)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == good

    two = corpus_pipeline.near_copies(spark, one, SF)
    left = {c for _, c, _, _ in classes_of([(i, rows[i].text) for i in sorted(good)])}
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(left)

    three = corpus_pipeline.source_mix(spark, two, SF)
    times = Counter(r.doc_id for r in three.collect())
    size = {i: len(rows[i].text.encode().split()) for i in left}
    assert three.columns == docs.columns and set(times) <= left and max(times.values()) <= 2
    total = sum(size.values())
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * total) < 0.25 * total


def test_run(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) > 100
    for r in out:
        assert r.round_trip and r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeats, and columns that the stages use themselves."""
    words = "alder birch cedar daisy elder ferns grass hazel irises juniper kelp larch maple nettle oak pine quince reed spruce thyme".split()
    prose = lambda k, n=60: " ".join(words[(i * i * (k + 3) + i * k) % 20] + str((i * (k + 7)) % 97) for i in range(n))
    rows = [(1, prose(1), "a"), (2, prose(1), "b"), (2, prose(1), "b"), (None, prose(5), None), (4, None, "a"), (5, "", "a"), (6, prose(11, 20_000), "b"), (7, prose(12), None), (8, "x " * 400, "a"), (9, prose(1) + " end", "a")]
    names = ["kept", "size", "target", "_row", "r1", "_s", "n_words", "class_id", "taken"]
    docs = spark.createDataFrame([(i, t, "en", s, 0, *range(len(names))) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in names))
    one = corpus_pipeline.quality_rules(spark, docs, SF)
    assert one.columns == docs.columns and not {4, 5, 8} & {r.doc_id for r in one.collect()}
    two = corpus_pipeline.near_copies(spark, one, SF)
    left = {r.doc_id for r in two.collect()}
    assert two.columns == docs.columns and 1 in left and not {2, 9} & left and {None, 7} <= left
    three = corpus_pipeline.source_mix(spark, two, SF)
    got = three.collect()
    assert three.columns == docs.columns and {r.doc_id for r in got} <= left
    assert {tuple(r[n] for n in names) for r in got} == {tuple(range(len(names)))}
    four = corpus_pipeline.token_ids(spark, three, SF)
    assert four.count() == len(got) and all(r.round_trip for r in four.collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
