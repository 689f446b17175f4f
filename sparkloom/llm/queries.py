"""Named queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bitslice, bpe, collocations, cosine, fill_middle, html, jaccard, licenses, mixing, oracles, quality, token_files, urls, warc
from sparkloom.runtime import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = materialize(mixing.measure(docs).drop("text"), "mix-measured")
    mixed = mixing.apply_cuts(measured, mixing.source_cuts(measured))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "class_id", "n_links", "n_text_links")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op3_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitslice.top_k(vectors, F.col("vec_id") % 20 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_ids(token_files.write_ids(docs, path or public_tokenizers.path("byte_bpe_50k.json")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(pages), with_payload=False).drop("payload")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_rules(docs).drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = docs.select("doc_id", bpe.encode_and_decode(F.col("text"), path).alias("_b")).select("doc_id", "_b.ids", "_b.decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "html"))


def op11_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("form"), F.col("output"))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


_ALL = (op1_jaccard, op2_url_filter, op3_bitslice, op4_token_files, op5_licenses, op6_warc, op7_quality, op8_bpe, op9_mixing, op10_html, op11_cosine, op12_collocations, op13_fill_middle)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
