import __spark_entry__ as entry


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_code_tokens_of_all_documents(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "parseHTTPHeader fn searchable", "a", 29), (2, None, "a", 0)])
    got = {r.term: r.n for r in entry.queries()["code_tokens"](spark, d).collect()}
    assert got == {"parsehttpheader": 1, "parse": 1, "http": 1, "head": 1, "searchable": 1, "search": 1}


def test_fusion_ranks_every_source(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "a", "src1", 1), (2, "b", "src3", 1), (3, "c", None, 1), (4, "dd", None, 2)])
    got = {(r.query_id, r.doc_id): r.score for r in entry.queries()["fusion_rrf"](spark, d).collect()}
    assert got == {("src1", 1): 0.15, ("src3", 2): 0.15, (None, 3): round(3 / 21, 9), (None, 4): 0.15}
