import math
import random
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkloom.operators import bm25
from sparkloom.operators import projection as pj

WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def texts(n=40):
    rnd = random.Random(5)
    return [(i, " ".join(rnd.choice(WORDS[(i % 4) * 40:(i % 4) * 40 + 140]) for _ in range(60))) for i in range(n)]


def number(term, dim, seed):
    def uniform(k):
        h = xxhash.xxh64_intdigest(term.encode(), 42)
        for part in (dim // 2 * 2 + k, seed):
            h = xxhash.xxh64_intdigest(struct.pack("<i", part), h)
        return (h >> 11) / 2.0**53

    return math.sqrt(-2 * math.log(max(uniform(0), 1e-10))) * (math.sin if dim % 2 else math.cos)(2 * math.pi * uniform(1))


def exact(docs, spark):
    """Postings of the shared tokenizer, weighed in plain Python."""
    rows = bm25.postings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    df: dict = {}
    for r in rows:
        df[r.term] = df.get(r.term, 0) + 1
    out: dict = {d: {} for d, _ in docs}
    for r in rows:
        out[r.doc_id][r.term] = (1 + math.log(r.tf)) * math.log(len(docs) / df[r.term])
    return out


def test_equals_plain_computation_and_empty_texts(spark):
    docs = texts(9) + [(100, None), (101, ""), (102, "wordaa wordaa")]
    got = {r.doc_id: r.vector for r in pj.tfidf_vectors(spark.createDataFrame(docs, "doc_id long, text string"), dims=10, seed=7).collect()}
    for d, terms in exact(docs, spark).items():
        v = np.array([sum(w * number(t, j, 7) for t, w in terms.items()) for j in range(10)])
        want = v / np.linalg.norm(v) if np.any(v) else v
        assert np.allclose(got[d], want, atol=1e-9), d
    assert got[100] == got[101] == [0.0] * 10
    assert pj.tfidf_vectors(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cosine_error_is_bounded(spark):
    docs = texts()
    weights = exact(docs, spark)
    got = {r.doc_id: np.array(r.vector) for r in pj.tfidf_vectors(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    errors, norm = [], {d: math.sqrt(sum(w * w for w in t.values())) for d, t in weights.items()}
    for a in weights:
        assert abs(np.linalg.norm(got[a]) - 1) < 1e-9
        for b in weights:
            if a < b:
                cos = sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items()) / norm[a] / norm[b]
                errors.append(abs(cos - got[a] @ got[b]))
    # the standard error of a cosine is at most 1 / sqrt(128) = 0.088, its mean deviation 0.071
    assert np.mean(errors) < 0.085 and max(errors) < 0.45, (np.mean(errors), max(errors))


def test_queries_use_the_terms_of_the_corpus(spark):
    docs = spark.createDataFrame(texts(12), "doc_id long, text string")
    asked = spark.createDataFrame([(1, texts(12)[3][1]), (2, "unheard zzzunknown")], "doc_id long, text string")
    own = {r.doc_id: r.vector for r in pj.tfidf_vectors(docs, dims=16).collect()}
    got = {r.doc_id: r.vector for r in pj.tfidf_vectors(asked, dims=16, model_of=docs).collect()}
    assert np.allclose(got[1], own[3]) and got[2] == [0.0] * 16


def test_numbers_are_standard_normal(spark):
    rows = spark.range(4000).select(*[pj.gaussian(F.concat(F.lit("t"), "id"), j).alias(f"g{j}") for j in range(4)]).toPandas()
    assert (rows.mean().abs() < 0.06).all() and ((rows.std() - 1).abs() < 0.05).all()
    assert (rows.corr().to_numpy()[~np.eye(4, dtype=bool)].__abs__() < 0.06).all()


def test_numbers_of_a_term_are_those_of_the_column_and_made_once(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in ["a", "Ünder", "漢字", "x" * 40]], "term string")
    rows = words.select(F.xxhash64("term").alias("h"), *[pj.gaussian(F.col("term"), j, 7).alias(f"_{j}") for j in range(5)]).collect()
    assert np.allclose(pj.gaussians(np.array([r.h for r in rows]), 5, 7), [list(r)[1:] for r in rows], atol=1e-12)
    made, make = [], pj.gaussians
    monkeypatch.setattr(pj, "gaussians", lambda terms, *a: made.extend(terms) or make(terms, *a))
    monkeypatch.setattr(pj, "SUMMED_ROWS", 3)  # documents go on in the next rows
    ids, terms, weights = [1] * 5 + [2] * 2 + [None] * 4, [5, 6, 7, 5, -6, 5, 6, 7, 7, 5, 5], [float(i) for i in range(11)]
    batches = iter([pj.pa.record_batch({"doc_id": ids, "h": terms, "weight": weights})])
    got = {r["doc_id"]: r["vector"] for b in pj._projected(batches, 4, 7) for r in b.to_pylist()}
    assert len(made) == len(set(made)) == 4 and list(got) == [1, 2, None]
    for d in got:
        v = sum(w * make(np.array([t]), 4, 7)[0] for i, t, w in zip(ids, terms, weights, strict=True) if i == d)
        assert np.allclose(got[d], v / np.linalg.norm(v))
