"""Fusion, vector search, packing, path rules and retrieval metrics."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import holds_any
from sparkloom.operators.packing import Rules, fold
from sparkloom.runtime import materialize

C = F.col
NOISE = "test|benchmark|example"


def ranked(scores: DataFrame, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """0-based ``rank`` by score, ties to the smaller key."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key)) - 1)


def top_k(scores: DataFrame, k: int, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    return ranked(scores, by, key).where(C("rank") < k)


def rrf(rankers: list[DataFrame], k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) with 0-based ranks."""
    out = rankers[0].select("query_id", "doc_id", "rank")
    for r in rankers[1:]:
        out = out.unionByName(r.select("query_id", "doc_id", "rank"))
    return out.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + C("rank"))).alias("score"))


def min_max(scores: DataFrame, by: str = "query_id", flat: float = 1.0) -> DataFrame:
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("norm", F.when(high > low, (C("score") - low) / (high - low)).otherwise(flat))


def noise_path(path: Column) -> Column:
    """Tests, benchmarks and examples, for the rankers."""
    return F.lower(path).rlike(NOISE)


def hybrid(primary: DataFrame, other: DataFrame, path: Column | None = None) -> DataFrame:
    """Greater of both normalised scores; what only the other found counts half the weakest primary score.

    Weakest is the least normalised score above 0.01, and 0.3 at most.  Noise
    paths keep a tenth.  ``path`` is an expression over doc_id.
    """
    p = min_max(primary).select("query_id", "doc_id", C("norm").alias("p"))
    o = min_max(other).select("query_id", "doc_id", C("norm").alias("o"))
    both = p.join(o, ["query_id", "doc_id"], "full_outer")
    weakest = F.least(F.min(F.when(C("p") > 0.01, C("p"))).over(Window.partitionBy("query_id")), F.lit(0.3))
    theirs = F.coalesce("o", F.lit(0.0))
    score = F.when(C("p") > 0, F.greatest("p", theirs)).otherwise(theirs * C("_w") * 0.5)
    share = F.lit(1.0) if path is None else F.when(noise_path(path), 0.1).otherwise(1.0)
    return both.withColumn("_w", weakest).select("query_id", "doc_id", (score * share).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def scan(queries: DataFrame, vectors: DataFrame, k: int, block: int = 64) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest of ``vectors(doc_id, e)`` to each of ``queries(query_id, qe)`` by cosine.

    All vectors are read once for each ``block`` queries, which travel to them
    as one row; a task hands on its k best of a query.
    """
    numbered = queries.withColumn("_b", F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / block))
    blocks = numbered.groupBy("_b").agg(F.collect_list(F.struct("query_id", "qe")).alias("_q")).drop("_b")
    near = lambda q: F.struct(q["query_id"].alias("query_id"), cosine(q["qe"], C("e")).alias("score"))
    scored = vectors.join(F.broadcast(blocks)).select("doc_id", F.inline(F.transform("_q", near)))  # the stated queries
    return top_k(scored, k)


def feedback_scan(queries: DataFrame, vectors: DataFrame, k: int, sure: float = 1.3, share: float = 0.3) -> DataFrame:
    """Like :func:`scan`; a query whose best hit is ``sure`` times as near as the second is asked again, moved towards it.

    The greater of both scores counts.  The k best of both passes hold the k
    best of all: whatever lies above a document in one pass does so in the end.
    """
    first = materialize(scan(queries, vectors, max(k, 2)), "scan-first")
    best = first.where("rank = 0").select("query_id", C("doc_id").alias("_id"), C("score").alias("_s1"))
    second = first.where("rank = 1").select("query_id", C("score").alias("_s2"))
    lead = best.join(second, "query_id").where(C("_s1") > C("_s2") * sure).join(vectors.select(C("doc_id").alias("_id"), C("e").alias("_e")), "_id")
    mixed = F.zip_with("qe", "_e", lambda q, d: q.cast("double") * (1 - share) + d.cast("double") * share)
    again = queries.join(lead, "query_id").select("query_id", mixed.alias("qe"))
    both = first.select("query_id", "doc_id", "score").union(scan(again, vectors, k).select("query_id", "doc_id", "score"))
    return top_k(both.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score")), k)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


#: Borders and levels of the two-bit quantiser.
BORDERS, LEVELS = (-0.9816, 0.0, 0.9816), (-1.51, -0.4528, 0.4528, 1.51)


def rotation(dims: int, seed: int = 42) -> tuple[list[int], list[int]]:
    """(source, sign) of each place after a seeded permutation and sign flips."""
    r = np.random.default_rng(seed)
    return r.permutation(dims).tolist(), r.choice([-1, 1], dims).tolist()


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def rotated(v: Column, dims: int, seed: int = 42) -> Column:
    source, sign = rotation(dims, seed)
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in zip(source, sign, strict=True)])
    return F.transform(places, lambda p: F.get(v, p["i"]) * p["s"])


def _scaled(v: Column, norm: Column) -> Column:
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def quantise(v: Column, dims: int, seed: int = 42) -> Column:
    """Struct (data, norm): two-bit levels of the rotated unit vector, four to a byte."""
    level = lambda x: F.when(x < BORDERS[0], 0).when(x < BORDERS[1], 1).when(x < BORDERS[2], 2).otherwise(3)
    at = lambda levels, b, k: F.shiftleft(F.coalesce(F.get(levels, b * 4 + k), F.lit(0)), 2 * k)
    data = lambda levels: F.transform(F.sequence(F.lit(0), F.lit((dims - 1) // 4)), lambda b: at(levels, b, 0) + at(levels, b, 1) + at(levels, b, 2) + at(levels, b, 3))
    coded = lambda n: F.struct(_let(F.transform(_let(_scaled(v, n), lambda u: rotated(u, dims, seed)), level), data).alias("data"), n.alias("norm"))
    return _let(F.sqrt(dot(v, v)), coded)


def quantised_product(query: Column, coded: Column, dims: int, seed: int = 42) -> Column:
    """The inner product of a full query with a quantised vector, nearly."""
    levels = F.array(*map(F.lit, LEVELS))
    bits = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.floor(F.get(coded["data"], F.floor(i / 4).cast("int")) / F.pow(F.lit(4), i % 4)).cast("int").bitwiseAND(3))
    total = lambda turned: F.aggregate(F.zip_with(turned, bits, lambda q, b: q * F.get(levels, b)), F.lit(0.0), lambda s, x: s + x)
    product = lambda n: F.when((n == 0) | (coded["norm"] == 0), 0.0).otherwise(_let(_let(_scaled(query, n), lambda u: rotated(u, dims, seed)), total) * n * coded["norm"])
    return _let(F.sqrt(dot(query, query)), product)


def pack_stop(items: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """Items in rank order until the first that does not fit."""
    upto = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("_sum", F.sum("tokens").over(upto)).where(C("_sum") <= budget).drop("_sum")


def pack_skip(items: DataFrame, budget: int, by: str = "query_id", most: int | None = None) -> DataFrame:
    """Items in rank order, those that do not fit left out; lists of any length."""
    return fold(items, [by], [C("rank").asc()], budget, Rules(most=most)).select(by, "rank", "tokens", "doc_id")


#: Parts and ends of the paths of tests, fixtures, and configuration or build files.
TEST_PARTS = ("/test", "_test.", ".test.", "_spec.", ".spec.", "/tests/", "/__tests__/")
FIXTURE_PARTS = ("/fixture", "/mock", "/factory", "/fake", "/stub", "conftest", "test_helper", "test_util")
CONFIG_ENDS = ("cargo.toml", "package.json", "tsconfig.json", "pyproject.toml", "setup.py", "setup.cfg", "makefile", ".lock", ".yml", ".yaml")
#: A candidate this close to a better one of its folder is redundant; at most this share of a list goes.
REDUNDANT_RATIO, MOST_REMOVED = 0.95, 0.40


def is_test_path(path: Column) -> Column:
    return holds_any(F.lower(path), TEST_PARTS)


def is_fixture_path(path: Column) -> Column:
    return holds_any(F.lower(path), FIXTURE_PARTS)


def is_config_path(path: Column) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(re.escape(e) for e in CONFIG_ENDS) + ")$")


def file_stem(path: Column) -> Column:
    """The file's name without its last ending."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def harm_filter(candidates: DataFrame, by: str = "query_id", tested: DataFrame | None = None) -> DataFrame:
    """``candidates(path, score, rank)``, the few best of a query, with a reason and whether it removes them.

    In rank order: tests whose definer is a candidate too (by ``tested(path,
    target)`` or by name), fixtures, configuration, and near equals of a better
    candidate whose folder's path is as long.  Once ``MOST_REMOVED`` of a list
    are gone the rest stay.
    """
    path = C("path")
    plain = ~is_test_path(path) & ~is_fixture_path(path) & ~is_config_path(path)
    stem = file_stem(path)
    for end in (r"(?:_test)+$", r"(?:_spec)+$", r"(?:\.test)+$", r"(?:\.spec)+$"):
        stem = F.regexp_replace(stem, end, "")
    tests = candidates.where(is_test_path(path)).select(by, "path", stem.alias("_stem"))
    definers = candidates.where(plain).select(by, C("path").alias("_definer"), file_stem(path).alias("_name"))
    met = tests.join(definers, by).where((C("_stem") != "") & F.contains(C("_name"), C("_stem"))).select(by, "path")
    if tested is not None:
        known = tests.join(tested.select("path", C("target").alias("_definer")), "path").join(definers, [by, "_definer"]).select(by, "path")
        met = met.union(known)
    marked = candidates.join(met.distinct().withColumn("_met", F.lit(True)), [by, "path"], "left")
    better = Window.partitionBy(by, F.length(F.regexp_extract(path, "^(.*)/[^/]*$", 1))).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    near = (C("score") > 0) & (C("score") >= REDUNDANT_RATIO * F.min(F.when(C("score") > 0, C("score"))).over(better))
    reason = F.when(C("_met"), "test").when(is_fixture_path(path), "fixture").when(is_config_path(path), "config").when(near, "redundant")
    flagged = marked.withColumn("reason", reason).withColumn("_most", F.ceil(F.count("*").over(Window.partitionBy(by)) * MOST_REMOVED))
    upto = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(C("reason").isNotNull().cast("int")).over(upto)
    return flagged.withColumn("removed", C("reason").isNotNull() & (n <= C("_most"))).drop("_most", "_met")


def ir_metrics(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """recall, precision, hit, mrr, ndcg and ap at k for each query of ``qrels(query_id, doc_id)``.

    ``results`` has 1-based ranks.  A query without results scores 0.
    """
    size = qrels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hit = results.where(C("rank") <= k).join(qrels, ["query_id", "doc_id"], "left_semi")
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_n", F.count("*").over(upto))
    g = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(C("rank") + 1)).alias("dcg"), F.sum(C("_n") / C("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    j = size.join(g, "query_id", "left").fillna(0, ["hits"]).fillna(0.0, ["dcg", "ap"])
    return j.select("query_id", (C("hits") / C("relevant")).alias("recall"), (C("hits") / k).alias("precision"), (C("hits") > 0).cast("double").alias("hit"), F.coalesce(1.0 / C("first"), F.lit(0.0)).alias("mrr"), (C("dcg") / ideal).alias("ndcg"), (C("ap") / C("relevant")).alias("ap"))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
