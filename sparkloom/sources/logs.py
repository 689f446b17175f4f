"""Append-only logs that survive a torn tail.

A line is ``<crc32 of the body, 8 hex digits> <bytes of the body> <body>``; the
body is JSON with writer, attempt, seq and payload, so it has no line end.
Appends add files and change none.  What a crash leaves half-written fails its
length or checksum, is counted, and hides no other line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
RECORD = "writer string, attempt int, seq long, payload string"


def _crc(body: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(body.cast("binary")))), 8, "0")


def encoded(rows: DataFrame, attempt: int) -> DataFrame:
    """(value): a line for each of ``rows(writer, seq, payload)``; nulls are kept."""
    body = F.to_json(F.struct(C("writer").cast("string").alias("writer"), F.lit(attempt).alias("attempt"), C("seq").cast("long").alias("seq"), C("payload").cast("string").alias("payload")))
    return rows.select(body.alias("_b")).select(F.concat_ws(" ", _crc(C("_b")), F.octet_length("_b").cast("string"), "_b").alias("value"))


def append(rows: DataFrame, path: str, attempt: int = 0) -> None:
    """Adds ``rows(writer, seq, payload)``; a repeated append takes a higher attempt and counts once."""
    encoded(rows, attempt).write.mode("append").text(path)


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` and two columns: ``record``, null unless length and checksum hold, and ``valid``.

    ``valid`` is null for a blank or null line, which counts as neither.
    """
    part = F.split(C(line), " ", 3)
    body = part[2]
    good = (F.size(part) == 3) & (part[1] == F.octet_length(body).cast("string")) & (part[0] == _crc(body))
    valid = F.when(F.trim(C(line)) != "", F.coalesce(good, F.lit(False)))
    return lines.withColumn("valid", valid).withColumn("record", F.when(C("valid"), F.from_json(body, RECORD)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def recover(found: DataFrame) -> DataFrame:
    """(writer, attempt, seq, payload) of ``found`` from :func:`parsed`: the last attempt of each (writer, seq)."""
    r = found.where("valid").select("record.*")
    best = r.groupBy("writer", "seq").agg(F.max(F.struct(F.coalesce("attempt", F.lit(-1)).alias("attempt"), C("payload").alias("payload"))).alias("m"))
    return best.select("writer", "m.attempt", "seq", "m.payload")


def validation(found: DataFrame) -> DataFrame:
    """(valid, corrupt): the lines of either kind, one row."""
    return found.agg(F.count_if("valid").alias("valid"), F.count_if(~C("valid")).alias("corrupt"))


def gaps(records: DataFrame) -> DataFrame:
    """(writer, records, first_seq, last_seq, missing) of recovered records; a null seq is no record here."""
    span = records.where("seq is not null").groupBy("writer").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return span.withColumn("missing", C("last_seq") - C("first_seq") + 1 - C("records"))
