import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import fill_middle, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u, v = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), sha(out), sha(text))


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from(list("ab <PSM>\t\n\x0b\x0c\r\x1f\x85 é漢😀")), max_size=60), st.integers(1, 9), st.integers(1, 7))
def test_cuts_at_every_unit(text, window, stride):
    data, units = text.encode(), UNIT.findall(text)
    index = fill_middle.Checkpoints(data, stride, window)
    assert index.n == len(units)
    assert len(index.units) == len(units) // stride + 1
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.cut(k) == (len(before.encode()), len(before))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    want = {brute(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.queries()["op13_fill_middle"](spark, d).collect()
    assert len(got) == 200 and {tuple(r) for r in got} == want


def test_edges(spark):
    texts = [None, "", " ", "\n\t ", "one", " one two ", "a <P> b", "x <S", "<M", "< P>", "ends with <", "é漢 😀 " * 3000, "w" * 500_000, "a b c d e f g"]
    rows = [(i, t, "old", i) for i, t in enumerate(texts * 8)] + [(None, "null id words here", "old", 1)] * 3 + [(5, "a b c", "old", 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, _c int")
    for stride in (1, 3, 64):
        out = fill_middle.transform(df, stride=stride)
        assert out.columns == ["doc_id", "text", "_c", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = out.withColumn("back", fill_middle.restore(F.col("form"), F.col("output"))).collect()
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.back)) for r in got), key=repr) == sorted((brute(i, t) for i, t, _, _ in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_rates(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    for rates, forms in ((fill_middle.Rates(0), {"plain"}), (fill_middle.Rates(100, 100), {"spm"}), (fill_middle.Rates(100, 0), {"psm"})):
        assert {r.form for r in fill_middle.transform(df, rates).select("form").distinct().collect()} == forms
