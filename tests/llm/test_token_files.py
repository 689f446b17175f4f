import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import queries, rangecoder, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_rangecoder_round_trip():
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 65536, n).astype(np.uint32) for n in (0, 1, 2, 700)]
    blocks += [np.zeros(900, np.uint32), np.tile(np.arange(50, dtype=np.uint32), 30), (r.zipf(1.3, 800) % 50257).astype(np.uint32)]
    coded = rangecoder.encode_blocks(blocks)
    for a, b in zip(blocks, rangecoder.decode_blocks(coded, [len(b) for b in blocks]), strict=True):
        assert (a == b).all()
    assert len(coded[4]) < 60 and len(coded[5]) < 900
    alone = rangecoder.decode_blocks([coded[3]], [700])[0]
    assert (alone == blocks[3]).all()


def test_wide_ids():
    r = np.random.default_rng(2)
    for most in (65_536, 131_072, 1 << 20, (1 << 28) - 1):
        ids = r.integers(0, most + 1, 3000).astype(np.uint32)
        ids[[0, -1]] = most
        out = io.BytesIO()
        out.write(token_files.MAGIC)
        token_files.write_group(out, np.array([[1, 0, 3000, 0]]), ids)
        assert (next(token_files.read_groups(io.BytesIO(out.getvalue())))[1] == ids).all()
    out = io.BytesIO()
    with pytest.raises(ValueError, match="ids must lie"):
        token_files.write_group(out, np.array([[1, 0, 2, 0]]), np.array([1 << 28, 0], np.uint32))
    with pytest.raises(ValueError, match="does not fit"):
        rangecoder.encode_blocks([np.array([70_000], np.uint32)])
    assert out.getvalue() == b""


def test_fewer_bits_than_raw_and_order_0(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(500).collect()]
    ids = np.concatenate([[*e.ids, 0] for e in lib.encode_batch(texts, add_special_tokens=False)]).astype(np.uint32)
    share = np.bincount(ids) / len(ids)
    order0 = -(share[share > 0] * np.log2(share[share > 0])).sum()
    out = io.BytesIO()
    token_files.write_group(out, np.array([[1, 0, len(ids), 0]]), ids)
    bits = 8 * len(out.getvalue()) / len(ids)
    assert len(ids) > token_files.rangecoder.PRIOR_IDS and bits < 0.55 * 16 and bits < 1.02 * order0


def test_damage_is_found():
    out = io.BytesIO()
    out.write(token_files.MAGIC)
    ids = np.arange(5000, dtype=np.uint32) % 777
    token_files.write_group(out, np.array([[5, 0, 5000, 0]]), ids)
    good = out.getvalue()
    table, back = next(token_files.read_groups(io.BytesIO(good)))
    assert table.tolist() == [[5, 0, 5000, 0]] and (back == ids).all()
    for at in (9, 30, 60, len(good) - 9):
        bad = bytearray(good)
        bad[at] ^= 64
        with pytest.raises((token_files.TokenFileError, zlib.error, MemoryError, ValueError)):
            list(token_files.read_groups(io.BytesIO(bytes(bad))))
    with pytest.raises(token_files.TokenFileError):
        list(token_files.read_groups(io.BytesIO(good[:-3])))


def want(rows):
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_library(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = queries.queries()["op4_token_files"](spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want(rows)


def test_edges_and_long_documents(spark, monkeypatch):
    rows = [(None, "n"), (1, None), (2, ""), (3, "!!! " * 40000), (4, "x"), (4, "x")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int").coalesce(1)
    got = token_files.read_ids(token_files.write_ids(df, PATH)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want(rows), key=str)
    assert token_files.read_ids(token_files.write_ids(df.limit(0), PATH)).count() == 0


def test_documents_cross_groups(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_IDS", 1000)
    monkeypatch.setattr(token_files, "FILE_IDS", 2500)
    w = token_files._Writer(f"file://{tmp_path}", 0)
    docs = [np.arange(n, dtype=np.uint32) for n in (10, 3500, 990, 1, 1000, 0)]
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    seen, part = {}, []
    for _, _, uri, _ in w.done:
        for table, ids in token_files.read_groups(token_files.storage.read(uri)):
            at = 0
            for doc, _, n, goes_on in table.tolist():
                part.append(ids[at : at + n])
                at += n
                if not goes_on:
                    seen[doc], part = np.concatenate(part), []
    assert len(w.done) > 1 and all((seen[i] == d).all() for i, d in enumerate(docs))
