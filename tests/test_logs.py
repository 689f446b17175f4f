from pyspark.sql import functions as F

from sparkloom.sources import logs

ROWS = "writer string, seq long, payload string"
RECORDS = [("w", 1, "plain"), ("w", 2, "line\nend \t \\n"), ("v", 1, "größe \U0001f600 " * 3), (None, 5, None), ("w", 4, "")]


def test_a_cut_at_every_byte(spark):
    written = [r.value.encode() for r in logs.encoded(spark.createDataFrame(RECORDS, ROWS).coalesce(1), 0).collect()]
    whole, ends, at = b"".join(w + b"\n" for w in written), [], 0
    for w in written:
        ends.append(at + len(w))
        at += len(w) + 1
    cuts = [(k, piece.decode(errors="replace")) for k in range(len(whole) + 1) for piece in whole[:k].split(b"\n")]
    found = logs.parsed(spark.createDataFrame(cuts, "cut int, value string"))
    got = {r.cut: (r.v, r.c) for r in found.groupBy("cut").agg(F.count_if("valid").alias("v"), F.count_if(~F.col("valid")).alias("c")).collect()}
    for k in range(len(whole) + 1):
        complete = sum(e <= k for e in ends)
        partial = whole[:k].split(b"\n")[-1] != b"" and k not in ends
        assert got[k] == (complete, int(partial)), k


def test_attempts_gaps_and_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame(RECORDS, ROWS)
    logs.append(rows, path, 1)
    logs.append(rows.where("writer = 'w' and seq < 3").withColumn("payload", F.lit("again")), path, 2)
    (tmp_path / "log" / "torn.txt").write_bytes(b"0000000a 12 {\"writer\":\"w\"\n\n  \nffffffff 3 abc\n")
    found = logs.parsed(logs.lines(spark, path))
    assert tuple(logs.validation(found).first()) == (7, 2)
    got = {(r.writer, r.seq): r.payload for r in logs.recover(found).collect()}
    assert got == {("w", 1): "again", ("w", 2): "again", ("w", 4): "", ("v", 1): RECORDS[2][2], (None, 5): None}
    spans = {r.writer: tuple(r)[1:] for r in logs.gaps(logs.recover(found)).collect()}
    assert spans == {"w": (3, 1, 4, 1), "v": (1, 1, 1, 0), None: (1, 5, 5, 0)}
    empty = logs.parsed(spark.createDataFrame([], "value string"))
    assert tuple(logs.validation(empty).first()) == (0, 0) and logs.gaps(logs.recover(empty)).count() == 0
