import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids(encoded):
    return [int.from_bytes(encoded[i : i + 4], "little") for i in range(0, len(encoded), 4)]


def check(texts):
    for encoder in (bpe.TrieEncoder(PATH), bpe.LibraryEncoder(PATH)):
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert ids(got) == LIB.encode(text, add_special_tokens=False).ids, repr(text)[:200]


ODD = ["", " ", "  ", "\n", " \n ", "a  b", "a \n b", "a\n\n b", "x <|endoftext|> y", "x\n <|endoftext|>", "<|endoftext|>", "it's we'll  I'M", "naïve 你好 \U0001f600\U0001f600", "՘a ႔0", "a" * 3000, "ab" * 2000, "\x00\x1c \x1d", "tab\t tab", " lead", "trail ", "  x", "1234567 89", "\U00010940 \U00010941x", "=-" * 300, "  " * 50 + "x"]


def test_odd_texts():
    check(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abeinrst \n\t'.<|>éñ你\U0001f600SLD0123"), max_size=60), max_size=6))
def test_random_texts(texts):
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_unicode(texts):
    check(texts)


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    check([r.text for r in docs])


def test_columns(spark):
    rows = [(i, t, 5) for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = df.select("doc_id", "text", bpe.encode(F.col("text"), PATH).alias("t")).select("doc_id", "text", "t", bpe.decode(F.col("t"), PATH).alias("back")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.t == LIB.encode(r.text or "").ids
        assert r.back == LIB.decode(r.t, skip_special_tokens=False) == (r.text or "")


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, decoded string")
    both = df.select("*", bpe.encode_and_decode(F.col("decoded"), PATH).alias("ids"))
    assert [(r.decoded, r.ids.decoded) for r in both.collect()] == [("a b", "a b")] * 2 + [(None, "")]
    assert both.limit(0).count() == 0 and both.where("doc_id = 2").count() == 0


def test_decode_broken_bytes(spark):
    pieces = [[128, 200], [50256, 262], [187], list(range(150, 260))]
    df = spark.createDataFrame([(p,) for p in pieces], "t array<int>")
    for p, r in zip(pieces, df.select(bpe.decode(F.col("t"), PATH).alias("s")).collect(), strict=True):
        assert r.s == LIB.decode(p, skip_special_tokens=False)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    from sparkloom.llm import queries

    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.queries()["op8_bpe"](spark, d).collect():
        want = LIB.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()
