from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import bm25

TEXTS = ["HTTPServer fooBarBaz x1Y getURLs", "Ünï ÄÖüÜb ΣΑΣ ΣΑΣ'Α İxA", "line\nNew A\nBc aB\r\nCd", "", None, "--- ...", "flies running a1B2 ABCd ABCD éÉé", "the a the the"]


def by_word(text, boundary):
    """The rules a word at a time, as they are stated."""
    return F.flatten(F.transform(tx.words(text), lambda w: F.transform(F.split(w, boundary), F.lower)))


def test_one_pass_cuts_as_word_by_word(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for boundary in (tx.CAMEL_PLAIN, tx.CAMEL_CODE):
        want = d.select(F.filter(by_word(F.col("t"), boundary), lambda p: p != "")).collect()
        assert want == d.select(F.transform(tx._camel_words(F.col("t"), boundary), F.lower)).collect()


def test_tokens_are_cut_once_and_counted_in_place(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(bm25.document_terms(d)).count("regexp_replace") == 1
    posts = bm25.postings(d)
    assert plan(posts).count("regexp_replace") == 1 and "Aggregate" not in plan(posts)
    got = {(r.doc_id, r.term): (r.tf, r.dl) for r in posts.collect()}
    assert got[7, "the"] == (6.0, 7.0) and got[7, "a"] == (1.0, 7.0) and {k[0] for k in got} == {0, 1, 2, 6, 7}
    assert sorted(got) == sorted(map(tuple, bm25.document_terms(d).collect()))
