"""Quality rules: counts of words, symbols and repeats, then compression bands.

Repetitive text compresses far better than prose and noise far worse.  The
zstandard ratio (compressed bytes over UTF-8 bytes) of the whole text has to
lie in a band that depends on its length, since short texts compress badly.
The same test on overlapping chunks, the last of which ends with the text,
finds texts of which only a part is bad: a text goes when the chunks that
leave their band cover more than a stated share of its bytes.  Shorter texts
have shorter chunks with bands of their own.

Defined cases: a null text counts as empty; texts under the shortest band are
judged by the base rules alone, those under the shortest chunks' length also
by the whole-text band; any length is measured whole; each row is judged by
itself, so repeated rows and ties agree; an empty table gives an empty one;
further columns pass through, and one of an output column's name gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.rows import packed, passengers
from sparkloom.runtime import ship

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio), by rising length."""

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.30, 1.10),
        (256, 0.35, 0.95),
        (512, 0.38, 0.80),
        (1024, 0.38, 0.72),
        (2048, 0.36, 0.68),
        (4096, 0.34, 0.65),
        (8192, 0.32, 0.63),
        (16384, 0.28, 0.62),
    )
    chunk_bytes: int = 2048
    chunk_low: float = 0.30
    chunk_high: float = 0.75
    #: For texts too short for two chunks of ``chunk_bytes``: (least bytes of text, chunk bytes, lowest ratio, highest ratio).
    short: tuple[tuple[int, int, float, float], ...] = (
        (256, 128, 0.30, 1.00),
        (512, 256, 0.35, 0.88),
        (1024, 512, 0.38, 0.77),
        (2048, 1024, 0.38, 0.70),
    )
    bad_chunks: float = 0.25
    level: int = 3

    def chunk_band(self, n: int) -> tuple[int, float, float] | None:
        if n >= 2 * self.chunk_bytes:
            return self.chunk_bytes, self.chunk_low, self.chunk_high
        return next((b[1:] for b in reversed(self.short) if n >= b[0]), None)

    def verdict(self, compress, data: bytes) -> bool:
        limits = [b for b in self.whole if len(data) >= b[0]]
        if not limits:
            return True
        _, low, high = limits[-1]
        if not low <= len(compress(data)) / len(data) <= high:
            return False
        band = self.chunk_band(len(data))
        if band is None:
            return True
        size, low, high = band
        last, covered, upto = len(data) - size, 0, 0
        for at in (*range(0, last, size // 4), last):
            if not low <= len(compress(data[at : at + size])) / size <= high:
                covered += at + size - max(at, upto)
                upto = at + size
        return covered <= self.bad_chunks * len(data)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:n] * _ODD[0]
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) + h[k : k + n] * _ODD[k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    suspects = np.zeros(n, bool)
    suspects[order[1:][same]] = suspects[order[:-1][same]] = True
    at = np.flatnonzero(suspects).tolist()
    count: dict[tuple, int] = {}
    for i in at:  # equal hashes only suggest equal windows
        key = tuple(words[i : i + width])
        count[key] = count.get(key, 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if count[tuple(words[i : i + width])] > 1:
            cover[i] += 1
            cover[i + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "kept")


def judge(text: Column, bands: Bands | None = None) -> Column:
    """Struct of the counts and ``in_band``, the compression verdict."""
    ship()
    bands = bands or Bands()

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS) + ", in_band boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                data = (text or "").encode()
                rows.append((*measure(text or "", data), bands.verdict(compress, data)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_())], names=[*COUNTS, "in_band"])

    return judged(text)


def apply_rules(docs: DataFrame, bands: Bands | None = None, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """``docs(text, ...)`` with the counts, base_failed and kept."""
    rows = packed(docs, "text").withColumn("_q", judge(F.col("text"), bands))
    failed = (F.col("_q.n_words") < least_words) | (100 * F.col("_q.n_repeat_words") > repeat_percent * F.col("_q.n_words"))
    counts = [F.col(f"_q.{c}").alias(c) for c in COUNTS]
    return rows.select(*passengers(rows, ADDED), *counts, failed.alias("base_failed"), (~failed & F.col("_q.in_band")).alias("kept"))
