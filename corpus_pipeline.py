"""The corpus pipeline: quality rules, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes every stage's rows to the shared folder and reads them
again, so a lost executor repeats one stage at most.

Defined cases: null and empty texts fail the quality rules, as do texts under
ten words; a null doc_id or source is a value like others; rows that agree in
doc_id and text are copies, of which one stays; texts of any length are worked
on whole; an empty table stays empty.  The first three stages return the
columns of their input as they are, whatever their names: a row travels as one
struct beside the columns that a stage reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, jaccard, mixing, quality
from sparkloom.llm.rows import packed, passengers
from sparkloom.runtime import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their compression band go."""
    judged = quality.apply_rules(packed(docs, "text")).where("kept")
    return judged.select(*passengers(judged))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays."""
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    mixed = mixing.repeat_taken(mixing.mix(packed(docs, "doc_id", "text", "source")))
    return mixed.select(*passengers(mixed))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = texts.withColumn("_b", bpe.encode_and_decode(F.col("text"), path))
    checked = coded.select("doc_id", "lang", "source", "_b.ids", (F.col("_b.decoded") == F.col("text")).alias("round_trip"))
    return checked.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("source mix", source_mix), ("token ids", token_ids)]

#: zstandard ratios, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
