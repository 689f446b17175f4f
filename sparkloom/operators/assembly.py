"""Field-weighted retrieval, scorers, re-ranking and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as tx
from sparkloom.operators import bm25, ranking
from sparkloom.operators.communities import louvain as louvain

C = F.col
#: Field boosts.
FIELDS = {"filename": 5.0, "path": 3.0, "symbol": 3.0, "signature": 1.0, "doc": 1.0}


def weighted_postings(fields: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl) from ``fields(doc_id, text, boost)``; term counts weigh by field."""
    t = tx.tokens(fields.select(F.struct("doc_id", "boost").alias("k"), "text"), "k", "text")
    g = t.groupBy(C("doc_id.doc_id").alias("doc_id"), "term").agg(F.sum("doc_id.boost").alias("tf"))
    return g.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id")))


def score_postings(posts: DataFrame, query: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of postings for ``query(query_id, query)``."""
    q = tx.tokens(query, "query_id", "query").withColumnRenamed("doc_id", "query_id").groupBy("query_id", "term").agg(F.count("*").alias("q_n"))
    stats = posts.select("doc_id", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    dfs = posts.groupBy("term").agg(F.count("*").alias("df"))
    s = posts.join(q, "term").join(dfs, "term").join(F.broadcast(stats))  # one row
    part = bm25.term_score(C("tf"), C("df"), C("n"), C("dl"), C("avgdl")) * C("q_n")
    return s.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25f(fields: DataFrame, query: DataFrame) -> DataFrame:
    return score_postings(weighted_postings(fields), query)


def multi_field(fields: DataFrame, query: DataFrame) -> DataFrame:
    """Scores of each field on its own, boosted and summed; ``fields`` also names its field."""
    out = None
    for name, boost in FIELDS.items():
        one = score_postings(weighted_postings(fields.where(C("field") == name).withColumn("boost", F.lit(1.0))), query).withColumn("score", C("score") * boost)
        out = one if out is None else out.union(one)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def with_feedback(first: DataFrame, expansion: DataFrame, share: float = 0.3, lead: float = 2.0) -> DataFrame:
    """First scores plus a share of the expansion's, for queries whose best is far ahead.

    ``expansion`` has the scores of the terms drawn from the best document; a
    query without a clear lead keeps its first scores.
    """
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    tops = first.withColumn("_r", F.row_number().over(by)).where("_r <= 2").groupBy("query_id").agg(F.max(F.when(C("_r") == 1, C("score"))).alias("a"), F.max(F.when(C("_r") == 2, C("score"))).alias("b"))
    clear = tops.where(C("a") > lead * C("b")).select("query_id")
    extra = expansion.join(clear, "query_id", "left_semi").select("query_id", "doc_id", (C("score") * share).alias("score"))
    return first.select("query_id", "doc_id", "score").union(extra).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def community_scores(bm: DataFrame, boost: DataFrame, rank: DataFrame, recency: DataFrame) -> DataFrame:
    """Four signals of a community, each scaled to 0..1: .55 text, .30 files, .05 rank, .10 recency."""
    scaled = lambda d, n: ranking.min_max(d, flat=0.0).select("query_id", "doc_id", C("norm").alias(n))
    j = scaled(bm, "t").join(scaled(boost, "f"), ["query_id", "doc_id"], "full_outer").join(rank, "doc_id", "left").join(recency, "doc_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query_id", "doc_id", (0.55 * z("t") + 0.30 * z("f") + 0.05 * z("rank") + 0.10 * z("recency")).alias("score"))


#: Weights of the features of a candidate file, and of its penalties.
CONTENT, PATH, SYMBOL, PROXIMITY, SEEN, REDUNDANT = 0.40, 0.20, 0.15, 0.10, 0.15, 0.10


def rerank(candidates: DataFrame) -> DataFrame:
    """Candidates with their score: content, path, symbol and proximity, less if seen or redundant; never below 0.

    A file that only its community brought in is half redundant.
    """
    redundant = F.when(C("from_community") & (C("content") == 0), 0.5).otherwise(0.0)
    score = CONTENT * C("content") + PATH * C("path") + SYMBOL * C("symbol") + PROXIMITY * C("proximity") - SEEN * C("seen").cast("double") - REDUNDANT * redundant
    return candidates.withColumn("score", F.greatest(F.lit(0.0), score))


def symbol_rank(hits: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, score): name matches, signatures at half, functions up a fifth, half of callers up to three times."""
    own = (C("name_score") + 0.5 * C("signature_score")) * F.when(C("kind") == "Function", 1.2).otherwise(1.0)
    s = hits.withColumn("score", own)
    busy = calls.groupBy("callee").agg(F.count("*").alias("n")).where("n <= 50").select("callee")
    raised = calls.join(busy, "callee", "left_semi").join(s.select(C("symbol").alias("callee"), "score"), "callee").groupBy("caller_file").agg((0.5 * F.sum("score")).alias("x"), F.max("score").alias("top"))
    extra = raised.select(C("caller_file").alias("file"), F.least("x", 3 * C("top")).alias("score"))
    return s.select("file", "score").union(extra).groupBy("file").agg(F.sum("score").alias("score"))


def related(primary: DataFrame, edges: DataFrame, tests: DataFrame, most: int = 15, most_tests: int = 5) -> DataFrame:
    """(query_id, file, role): the primary files, their neighbours, then their tests."""
    near = primary.join(edges, C("file") == C("src")).select("query_id", C("dst").alias("file")).distinct().join(primary.select("query_id", "file"), ["query_id", "file"], "left_anti")
    by = Window.partitionBy("query_id").orderBy("file")
    near = near.withColumn("_n", F.row_number().over(by)).where(C("_n") <= most).select("query_id", "file", F.lit("related").alias("role"))
    tested = primary.join(tests, "file").select("query_id", C("test").alias("file")).distinct().withColumn("_n", F.row_number().over(by)).where(C("_n") <= most_tests).select("query_id", "file", F.lit("test").alias("role"))
    return primary.select("query_id", "file", F.lit("primary").alias("role")).union(near).union(tested)


def code_view(rank: Column, symbols: Column, files: Column) -> Column:
    """Full source for the best two, compressed for the next two if large, signatures below."""
    large = (symbols > 100) | (files > 10)
    return F.when(rank <= 1, "full").when(rank <= 3, F.when(large, "compressed").otherwise("full")).otherwise("signatures")


def impact(reached: DataFrame, communities: DataFrame, tests: DataFrame, cochanged: DataFrame) -> DataFrame:
    """(communities, tests, cochanged) of everything a change reaches, one row."""
    r = reached.join(communities, "node", "left").join(tests, "node", "left").join(cochanged, "node", "left")
    return r.agg(F.count_distinct("community").alias("communities"), F.count("test").alias("tests"), F.count_if(C("weight") >= 0.1).alias("cochanged"))


def rerank_model(candidates: DataFrame, score=None) -> DataFrame:
    """Scores candidates by a plug-in model over Arrow batches; without one the order stays."""
    if score is None:
        return candidates

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=score(f))

    return candidates.mapInPandas(run, candidates.schema)
