import random
import re

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x1c é#<"), max_size=200))
def test_counts(text):
    assert quality.measure(text, text.encode()) == brute(text)


def prose(n, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("etaoinshrdlucm") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    return " ".join(r.choice(vocab) for _ in range(n))


def test_verdicts():
    bands, compress = quality.Bands(), zstandard.ZstdCompressor(level=3).compress
    ok = lambda t: bands.verdict(compress, t.encode())
    r = random.Random(3)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9000))
    for n in (30, 100, 400, 2000, 20000):
        assert ok(prose(n)), n
    assert not ok("buy now cheap " * 200)
    assert not ok(noise)
    assert not ok(prose(800) + noise)  # only the chunks show it
    assert ok("short text") and ok("")


def test_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "x" * 300000, 9), (4, prose(50), 9), (4, prose(50), 9), (None, "a b c d e " * 40, 9), (7, prose(60000), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = {(r.doc_id, r.n_words): r for r in quality.apply_rules(df).collect()}
    assert out[1, 0].base_failed and not out[1, 0].kept
    assert out[4, 50].kept and out[7, 60000].kept
    assert out[None, 200].base_failed
    assert not out[3, 1].kept
    assert quality.apply_rules(df.limit(0)).count() == 0
    for r in quality.apply_rules(df).collect():
        if r.n_words < 1000:
            assert tuple(r[c] for c in quality.COUNTS) == brute(r.text)


def ratio(data):
    return len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)


def in_band(data, bands=None):
    """The verdict byte by byte: a byte is bad if a chunk over it leaves the band."""
    bands = bands or quality.Bands()
    band = None
    for least, low, high in bands.whole:
        if len(data) >= least:
            band = (low, high)
    if band is None:
        return True
    if not band[0] <= ratio(data) <= band[1]:
        return False
    rows = [(least, size, low, high) for least, size, low, high in (*bands.short, (2 * bands.chunk_bytes, bands.chunk_bytes, bands.chunk_low, bands.chunk_high)) if len(data) >= least]
    if not rows:
        return True
    _, size, low, high = max(rows)
    bad, starts = set(), set(range(0, len(data) - size, size // 4)) | {len(data) - size}
    for at in starts:
        if not low <= ratio(data[at : at + size]) <= high:
            bad |= set(range(at, at + size))
    return len(bad) <= bands.bad_chunks * len(data)


def test_any_names(spark):
    names = ["N_words", "kept", "_q", "_row", "base_failed", "in_band"]
    df = spark.createDataFrame([(prose(60), *range(6))] * 2, "text string, " + ", ".join(f"`{n}` int" for n in names))
    out = quality.apply_rules(df)
    assert out.columns == ["text", "_q", "_row", "in_band", *quality.ADDED]
    assert [(r["_q"], r["_row"], r.n_words, r.kept) for r in out.collect()] == [(2, 3, 60, True)] * 2


def test_query_against_brute_force(spark):
    from sparkloom.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.queries()["op7_quality"](spark, d).collect()
    assert len(rows) == len(texts)
    good = 0
    for r in rows:
        want = brute(texts[r.doc_id])
        kept = not r.base_failed and in_band(texts[r.doc_id].encode())
        assert r.kept == kept, r.doc_id
        good += kept
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_bad_tails_and_halves():
    bands, compress = quality.Bands(), zstandard.ZstdCompressor(level=3).compress
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n))
    ok = lambda t: bands.verdict(compress, t.encode())
    text = prose(3000)
    assert not ok(text[:4096] + noise(2004)) and not ok(noise(2048) + text[:4052])
    for n in (300, 600, 900, 1300, 1800, 2500, 3900, 4100):
        assert ok(text[:n]), n
        assert not ok(text[: n // 2] + noise(n - n // 2)) and not ok(noise(n // 2) + text[: n - n // 2]), n
    for n in range(4096, 9000, 97):
        assert ok(text[:n]), n
