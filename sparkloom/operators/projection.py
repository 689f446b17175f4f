"""TF-IDF vectors of fixed length by a seeded random projection.

The Gaussian number of a term and a dimension comes from a hash of both, so no
matrix is stored, sent or joined, and a term has the same row in every run and
corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sparkloom.operators import bm25
from sparkloom.operators.skew import join_counted
from sparkloom.runtime import materialize, ship

C = F.col
#: The usual length of a vector and seed.
DIMS, SEED = 128, 42
#: Numbers of terms that a task keeps, and rows that are summed together.
CACHED, SUMMED_ROWS = 1 << 22, 4096


def gaussian(term: Column, dim: int, seed: int = SEED) -> Column:
    """A standard normal number for (term, dim): two dimensions share two uniform numbers."""
    uniform = lambda k: F.shiftrightunsigned(F.xxhash64(term, F.lit(dim // 2 * 2 + k), F.lit(seed)), 11) / float(2**53)
    turn = F.cos if dim % 2 == 0 else F.sin
    return F.sqrt(-2.0 * F.log(F.greatest(uniform(0), F.lit(1e-10)))) * turn(2.0 * math.pi * uniform(1))


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed_on(number: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64`` makes of an int that follows columns with the hash ``seed``."""
    h = (seed + _P5 + np.uint64(4)) ^ (number.astype(np.uint32).astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def gaussians(terms: np.ndarray, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """:func:`gaussian` of all dimensions for each of ``terms``, given as ``F.xxhash64(term)``."""
    pairs = -(-dims // 2)
    h = _hashed_on(np.arange(2 * pairs), terms.view(np.uint64)[:, None])
    uniform = (_hashed_on(np.array([seed]), h) >> np.uint64(11)) / 2.0**53
    size, turn = np.sqrt(-2.0 * np.log(np.maximum(uniform[:, 0::2], 1e-10))), 2.0 * math.pi * uniform[:, 1::2]
    out = np.empty((len(terms), 2 * pairs))
    out[:, 0::2], out[:, 1::2] = size * np.cos(turn), size * np.sin(turn)
    return out[:, :dims]


def _projected(batches: Iterator[pa.RecordBatch], dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, vector) of rows (doc_id, hash of a term, weight) that come by document."""
    cells = 1 << max(0, (CACHED // dims).bit_length() - 1)
    names, numbers, filled = np.zeros(cells, np.int64), np.zeros((cells, dims)), np.zeros(cells, bool)
    last, total = None, np.zeros(dims)

    def vectors(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
        ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dims)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], names=["doc_id", "vector"])

    for whole in batches:
        for at in range(0, whole.num_rows, SUMMED_ROWS):
            batch = whole.slice(at, SUMMED_ROWS)
            terms, inverse = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            place = terms & (cells - 1)
            new = np.flatnonzero(~(filled[place] & (names[place] == terms)))
            rows = numbers[place]
            rows[new] = made = gaussians(terms[new], dims, seed)
            names[place[new]], numbers[place[new]], filled[place[new]] = terms[new], made, True
            code = batch.column(0).dictionary_encode("encode").indices.to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
            sums = np.add.reduceat(batch.column(2).to_numpy()[:, None] * rows[inverse], first)
            ids = batch.column(0).take(pa.array(first))
            if last is not None:
                if last[0].equals(ids[0]) or not (last[0].is_valid or ids[0].is_valid):
                    sums[0] += total
                else:
                    yield vectors(last, total[None])
            last, total = ids[-1:], sums[-1]
            if len(ids) > 1:
                yield vectors(ids[:-1], sums[:-1])
    if last is not None:
        yield vectors(last, total[None])


def project(weights: DataFrame, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(doc_id, vector) of ``weights(doc_id, term, weight)``, normalised to length 1; all zero if the sum is.

    Rows of a document meet before they are widened, so what is shuffled is one
    weight a term and not ``dims`` numbers a task and document.  The numbers of
    a term are made once for many of its rows, not for each.
    """
    ship(weights.sparkSession)
    met = weights.select("doc_id", F.xxhash64("term").alias("_h"), C("weight").cast("double")).repartition("doc_id").sortWithinPartitions("doc_id")
    out = StructType([StructField("doc_id", weights.schema["doc_id"].dataType), StructField("vector", ArrayType(DoubleType()))])
    return met.mapInArrow(lambda batches: _projected(batches, dims, seed), out)


def frequencies(posts: DataFrame, least: int = 1) -> DataFrame:
    """(term, n): the documents of each term that has ``least`` of them."""
    return posts.groupBy("term").agg(F.count("*").alias("n")).where(C("n") >= least)


def term_weights(posts: DataFrame, dfs: DataFrame, n_docs: int, total: int, zeros: bool = False) -> DataFrame:
    """(doc_id, term, weight): (1 + ln tf) * ln(N / df); terms of all documents weigh 0 and are left out unless ``zeros``.

    ``total`` bounds the rows of ``posts``; those of a frequent term stay spread.
    """
    met = join_counted(posts.select("doc_id", "term", "tf"), dfs if zeros else dfs.where(C("n") < n_docs), ["term"], total)
    return met.select("doc_id", "term", ((1 + F.log("tf")) * F.log(n_docs / C("n"))).alias("weight"))


def tfidf_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dims: int = DIMS, seed: int = SEED, least: int = 1, model_of: DataFrame | None = None) -> DataFrame:
    """(doc_id, vector) for each row of ``docs``, whose ``doc_id`` is a key.

    ``least`` is the number of documents a term needs.  ``model_of`` gives the
    documents that terms are counted in, ``docs`` itself by default; terms
    outside of it weigh nothing.  A null or empty text has a vector of zeros.
    """
    posts = materialize(bm25.postings(docs, doc_id, text), "projection-postings")
    basis = docs if model_of is None else model_of
    known = posts if model_of is None else materialize(bm25.postings(model_of, doc_id, text), "projection-model")
    dfs = materialize(frequencies(known, least), "projection-terms")
    total = max(posts.count(), dfs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    vectors = project(term_weights(posts, dfs, basis.count(), total), dims, seed)
    zeros = F.array_repeat(F.lit(0.0), dims)
    every = docs.select(C(doc_id).alias("doc_id"))
    return every.join(vectors, "doc_id", "left").select("doc_id", F.coalesce("vector", zeros).alias("vector"))
