"""Fill-in-the-middle transformation over a sparse checkpoint index.

A text is a row of units, each a word with the white space before it (white
space at the end is a unit of its own).  Counting the units walks over the
bytes in windows and records the byte and code-point offset of every
``STRIDE``-th unit's end, so the index of a text is a small share of it.  A cut
after unit u is found by binary search for the last checkpoint at or before u
and a rescan of less than ``STRIDE`` units from there.

The cuts come back as offsets; the text is cut and put together again by column
expressions, so no text returns from Python.  :func:`transform` gives the texts
as a training job takes them, :func:`restore` rebuilds a text from its form and
its output alone.

Defined cases: a null text counts as empty, and an empty text is plain; so is
one that contains a sentinel.  A null doc_id draws as one without digits.  Each
row is drawn by itself, so repeated rows and ties agree; white space alone is
one unit; texts of any length are counted whole, a window at a time; an empty
table gives an empty one; further columns pass through, and one of an output
column's name gives way.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.rows import packed, passengers
from sparkloom.runtime import ship

#: Units between two checkpoints, and bytes that are looked at together.
STRIDE, WINDOW = 64, 1 << 18
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Rates:
    """Percent of the texts that are changed, and of those, that start with the suffix."""

    changed: int = 50
    suffix_first: int = 80
    seed: int = 42


class Checkpoints:
    """The number of units of a text and the offsets of every ``stride``-th unit's end."""

    def __init__(self, data: bytes, stride: int = STRIDE, window: int = WINDOW):
        self.data, self.n = data, 0
        self.units, self.bytes, self.chars = [0], [0], [0]
        chars = 0
        for at in range(0, len(data), window):
            b = np.frombuffer(data, np.uint8, min(window + 1, len(data) - at), at)  # with the byte after the window
            space = (b == 32) | ((b >= 9) & (b <= 13))
            size = min(window, len(b))
            ends = ~space[:size]
            ends[: len(b) - 1] &= space[1 : size + 1]
            if at + size == len(data) and space[-1]:
                ends[-1] = True
            stop = np.flatnonzero(ends) + 1
            starts = np.cumsum((b[:size] & 0xC0) != 0x80)
            marked = stop[(stride - 1 - self.n) % stride :: stride]
            first = self.n + (stride - 1 - self.n) % stride + 1
            self.units += range(first, first + stride * len(marked), stride)
            self.bytes += (marked + at).tolist()
            self.chars += (starts[marked - 1] + chars).tolist()
            self.n += len(stop)
            chars += int(starts[-1])

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which the first ``unit`` units end."""
        k = bisect_right(self.units, unit) - 1
        start = end = self.bytes[k]
        left = unit - self.units[k]
        for found in _UNIT.finditer(self.data, start) if left else ():
            left -= 1
            if not left:
                end = found.end()
                break
        return end, self.chars[k] + sum(1 for x in self.data[start:end] if x & 0xC0 != 0x80)


_CUTS = "n long, a int, b int"


def _cuts(stride: int):
    @F.arrow_udf(_CUTS)
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            out = []
            for text, h1, h2 in zip(texts, first, second, strict=True):
                index = Checkpoints(text.as_py(), stride)
                u, v = sorted((h1.as_py() % (index.n + 1), h2.as_py() % (index.n + 1)))
                out.append((index.n, index.cut(u)[1], index.cut(v)[1]))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["n", "a", "b"])

    return cuts


def _draw(doc_id: Column, seed: int, group: int) -> Column:
    """The ``group``-th (from 1) 32 bits of the row's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rates: Rates = Rates(), stride: int = STRIDE) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n, form, prefix_chars, middle_chars and output.

    ``form`` is plain, spm (suffix first) or psm (prefix first).
    """
    ship(docs.sparkSession)
    rows = packed(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    h = [_draw(F.col("doc_id"), rates.seed, k) for k in (1, 2, 3, 4)]
    cut = rows.select("_row", text.alias("_t"), h[2].alias("_h3"), h[3].alias("_h4"), _cuts(stride)(F.encode(text, "utf-8"), h[0], h[1]).alias("_c"))
    t, c = F.col("_t"), F.col("_c")
    plain = (t == "") | F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE)) | (F.col("_h3") % 100 >= rates.changed)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < rates.suffix_first, "spm").otherwise("psm")
    formed = cut.withColumn("_f", form)
    before, middle, after = F.substring(t, F.lit(1), c["a"]), F.substring(t, c["a"] + 1, c["b"] - c["a"]), F.substring(t, c["b"] + 1, F.lit(2**31 - 1))
    first = F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle)
    second = F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle)
    kind = F.col("_f")
    cut_up = kind != "plain"
    return formed.select(
        *passengers(formed, ADDED),
        c["n"].alias("n"),
        kind.alias("form"),
        F.when(cut_up, c["a"].cast("long")).alias("prefix_chars"),
        F.when(cut_up, (c["b"] - c["a"]).cast("long")).alias("middle_chars"),
        F.when(kind == "plain", t).when(kind == "psm", first).otherwise(second).alias("output"),
    )


def restore(form: Column, output: Column) -> Column:
    """The text of an output.

    No sentinel overlaps with another, so each is found where it was put.
    """
    parts = F.split(F.substring(output, 4, 2**31 - 1), "<[SPM]>", -1)
    psm = F.concat(parts[0], parts[2], parts[1])
    spm = F.concat(parts[1], parts[2], parts[0])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN s < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS z FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
