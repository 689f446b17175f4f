import gzip
import hashlib
import io

import pytest

from sparkloom.llm import queries, warc


def brute(rows, least=1000):
    best = {}
    for page_id, html in rows:
        b = (html or "").encode()
        if len(b) >= least and page_id is not None:
            best[b] = max(best.get(b, page_id), page_id)
    out = []
    for page_id, html in rows:
        b = (html or "").encode()
        old = best.get(b) is not None and best[b] != page_id
        out.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if old else "response", best[b] if old else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    got = queries.queries()["op6_warc"](spark, d)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)


def test_edges(spark):
    big = "<p>é" * 400
    rows = [(1, None), (2, ""), (3, big), (9, big), (None, big), (5, big), (6, "x" * 2_000_000), (6, "x" * 2_000_000), (7, "small"), (8, "small")]
    df = spark.createDataFrame([(i, "http://a\nb", h, 0) for i, h in rows], "page_id long, url string, html string, payload int")
    got = warc.read_archives(warc.write_archives(df)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert {r.payload for r in got if r.page_id == 9} == {big.encode()}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_a_payload_that_very_many_pages_share(spark):
    rows = [(i, "k" * 1000) for i in range(1500)] + [(2000, "m" * 1000), (2001, "m" * 1000), (None, "k" * 1000), (2002, "n" * 1000)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_members_and_damage():
    one, two = warc.page_record(1, "u", b"a" * 3000, None, False), warc.page_record(2, None, b"b\r\n\r\nb", None, False)
    assert gzip.decompress(one + two).count(b"WARC/1.1") == 2
    for piece in (1, 7, 100000):
        pages = [warc.parse_page(*r) for r in warc.read_records(io.BytesIO(one + two), piece)]
        assert [p["payload"] for p in pages] == [b"a" * 3000, b"b\r\n\r\nb"]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO((one + two)[:-5])))
    wrong = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:AAAA")], b"x")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(wrong)))
    heads = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\n\xff: 1\r\n\r\n", b"WARC/1.1\r\nContent-Length: -4\r\n\r\n"]
    for head in heads:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(head))))
    with pytest.raises(warc.WarcError):
        [warc.parse_page(*r) for r in warc.read_records(io.BytesIO(warc.record([("WARC-Type", "response")], b"x")))]
    big = warc.page_record(3, "u", b"0" * 30_000_000, None, False)
    assert len(big) < 40_000 and warc.parse_page(*next(warc.read_records(io.BytesIO(big))))["payload_bytes"] == 30_000_000
