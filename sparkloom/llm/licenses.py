"""License scans: lines against licence templates by the Dice coefficient.

Lines and templates are normalised (lower case, runs of other than letters and
digits to one space) and compared as sets of word bigrams.  Dice >= t needs
sizes within a factor of (2 - t) / t, so a template is only tried on lines
whose size lies in its bounds.  A match must also hold one of the template's
long words, so most texts and lines stop at a search for those.  A text of
several lines is also compared as a whole, as line 0, for templates that run
over lines.  Everything is array expressions: no shuffle, no join.

Notices wrapped over lines of a longer text, or within a longer line, are
found by word windows.  A window starts at a bigram of the template; it has
as many bigrams as the template (fewer only at the end of the text), or more
up to the greatest size, then ending at a bigram of the template.  The best
windows stand, none overlapping another, and those add a row, with the line
they start on, that do not lie in lines with a row of their own.  Windows are
also tried against ``NOTICES``, paragraphs that whole licence texts hold.

Defined cases: null and empty texts have no lines with two words and give no
row; each row of a repeated document is scanned; ties of two templates go to
the name that sorts first; lines of any length are compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2-clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Whole paragraphs, for windows only.
NOTICES = {
    "agpl-3.0-notice": _GNU.format("Affero"),
    "bsd-2-clause-conditions": _BSD,
    "bsd-3-clause-conditions": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-notice": _GNU.format("Lesser"),
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
THRESHOLD = 0.8
#: Words that mark no licence, as any text may hold them.
COMMON = frozenset("a and any are at be by for in is it not of or the this to under with work you".split())


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(m: int, t: float) -> tuple[int, int]:
    """The least and greatest set size whose Dice with ``m`` bigrams can reach ``t``."""
    fits = [n for n in range(1, int(m * (2 - t) / t) + 2) if 2 * min(n, m) >= t * (n + m) - 1e-9]
    return min(fits), max(fits)


def least_shared(m: int, t: float) -> int:
    """The fewest bigrams that a match at ``t`` shares with a template of ``m``."""
    low, high = size_bounds(m, t)
    return int(min(-(-t * (n + m) // 2) for n in range(low, high + 1)))


def keywords(grams: list[str], t: float) -> list[str]:
    """Long words, one of which every line that reaches ``t`` must hold.

    A match shares so many bigrams with the template that those without any of
    these words are too few.
    """
    shared = least_shared(len(grams), t)
    chosen: list[str] = []
    for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in COMMON, -len(w), w)):
        if sum(not set(g.split(" ")) & set(chosen) for g in grams) < shared:
            break
        chosen.append(word)
    return chosen


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def _dice(g: Column, grams: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(g, grams)) / (F.size(g) + F.size(grams))


def _templates(templates: dict[str, str], threshold: float) -> tuple[list[tuple], Column]:
    rows = []
    for name, text in sorted(templates.items()):
        grams = template_bigrams(text)
        low, high = size_bounds(len(grams), threshold)
        span = len(re.findall("[a-z0-9]+", text.lower())) - 1
        rows.append((name, grams, low, high, span, max(high, span), least_shared(len(grams), threshold)))
    fields = ("name", "grams", "low", "high", "span", "most", "shared")
    return rows, F.array(*[F.struct(*[(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)).alias(k) for k, x in zip(fields, r, strict=True)]) for r in rows])


def _marked(rows: list[tuple], threshold: float):
    words = {w for r in rows for w in keywords(r[1], threshold)}
    # A word that holds another one adds nothing.
    marks = sorted(w for w in words if not any(v != w and v in w for v in words))
    # Bound once, or lower() would be computed again for each mark.
    return lambda c: F.exists(F.array(c), lambda x: reduce(or_, [F.contains(x, F.lit(w)) for w in marks]))


def windows(texts: DataFrame, templates: dict[str, str], lines_have: Callable[[Column], Column], threshold: float) -> DataFrame:
    """``texts(text, ...)`` in lower case: the best windows that do not lie in lines with a row."""
    rows, listed = _templates(templates, threshold)
    others = [c for c in texts.columns if c != "text"]
    C, none = F.col, lambda x: F.filter(x, lambda _: F.lit(False))
    lined = texts.where(_marked(rows, threshold)(C("text"))).select(*others, "text", F.split("text", "\n").alias("_lines"))
    worded = lined.select("*", F.transform("_lines", lambda x: F.filter(F.split(normalised(x), " "), lambda w: w != "")).alias("_lw"))
    flat = worded.select(*others, "text", "_lines", F.flatten("_lw").alias("_w"), F.flatten(F.transform("_lw", lambda x, i: F.array_repeat(i + 1, F.size(x)))).alias("_no"))
    n = F.size("_w") - 1
    pairs = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = flat.select(*others, "text", "_lines", "_no", F.when(n > 0, pairs).otherwise(F.array().cast("array<string>")).alias("_g"))
    tried = grams.select("*", _let(F.array_distinct("_g"), lambda g: F.filter(listed, lambda t: F.size(F.array_intersect(g, t["grams"])) >= t["shared"])).alias("_ts"))

    def best_from(t: Column, hits: Column, a: Column) -> Column:
        near = F.filter(hits, lambda b: (b >= a) & (b < a + t["most"]))
        ends = F.array_union(F.array(F.least(a + t["span"] - 1, F.size("_g"))), F.filter(near, lambda b: b >= a + t["span"]))
        scored = F.transform(ends, lambda b: _let(F.array_distinct(F.slice("_g", a, b - a + 1)), lambda g: F.struct((-_dice(g, t["grams"])).alias("d"), (a - b).alias("n"), a.alias("a"), b.alias("b"), t["name"].alias("name"))))
        return F.when(F.size(near) >= t["shared"], F.array_min(scored))

    at = F.when(F.size("_g") > 0, F.sequence(F.lit(1), F.size("_g")))
    hits = lambda t: F.filter(at, lambda i: F.array_contains(t["grams"], F.element_at("_g", i)))
    found = F.flatten(F.transform("_ts", lambda t: _let(hits(t), lambda h: F.transform(h, lambda a: best_from(t, h, a)))))
    sound = F.array_sort(F.filter(found, lambda x: x["d"] <= -threshold + 1e-9))
    scored = tried.select(*others, "text", "_lines", "_no", sound.alias("_s"))
    apart = F.aggregate("_s", none(C("_s")), lambda kept, x: F.when(F.exists(kept, lambda k: (k["a"] <= x["b"] + 1) & (x["a"] <= k["b"] + 1)), kept).otherwise(F.concat(kept, F.array(x))))
    kept = scored.select(*others, "text", "_lines", "_no", apart.alias("_k"))

    def new(x: Column) -> Column:
        first, last = F.element_at("_no", x["a"]), F.element_at("_no", x["b"] + 1)
        return ~(F.forall(F.slice("_lines", first, last - first + 1), lambda c: lines_have(c) | (normalised(c) == "")) | (F.contains(C("text"), F.lit("\n")) & lines_have(C("text"))))

    out = kept.select(*others, "_no", F.explode_outer(F.filter("_k", new)).alias("_m")).where("_m is not null")
    return out.select(*others, F.element_at("_no", C("_m.a")).alias("line_no"), C("_m.name").alias("license"), F.round(-C("_m.d"), 6).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(text, ...)``: a row for each matching line or window, with line_no, license and dice."""
    rows, listed = _templates(templates or TEMPLATES, threshold)
    least, most, marked = min(r[2] for r in rows), max(r[3] for r in rows), _marked(rows, threshold)

    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("line_no", "license", "dice", "_line", "_lines", "_lw", "_w", "_no", "_g", "_ts", "_s", "_k", "_m", "_best")])
    others = [c for c in kept.columns if c != "text"]
    # Texts, then lines, without any of the marks go before they are cut up.
    lowered = kept.select(*others, F.lower("text").alias("text"))
    texts = lowered.where(marked(F.col("text")))
    lines = F.split("text", "\n")
    units = F.when(F.contains(F.col("text"), F.lit("\n")), F.concat(F.array("text"), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    spread = texts.select(*others, F.posexplode(units).alias("line_no", "_line")).where(marked(F.col("_line")))
    worded = spread.select(*others, "line_no", F.split(normalised(F.col("_line")), " ").alias("_w")).where(F.size("_w") > least)
    sized = worded.select(*others, "line_no", bigrams(F.col("_w")).alias("_g")).where(F.size("_g").between(least, most))

    tried = F.filter(listed, lambda t: (F.size("_g") >= t["low"]) & (F.size("_g") <= t["high"]))
    scored = F.transform(tried, lambda t: F.struct((-_dice(F.col("_g"), t["grams"])).alias("d"), t["name"].alias("name")))
    best = sized.select(*others, "line_no", F.array_min(scored).alias("_best")).where(F.col("_best.d") <= -threshold + 1e-9)
    by_line = best.select(*others, "line_no", F.col("_best.name").alias("license"), F.round(-F.col("_best.d"), 6).alias("dice"))

    def has_row(line: Column) -> Column:
        words = F.split(normalised(line), " ")
        return _let(words, lambda w: F.when(F.size(w) > 1, _let(bigrams(w), lambda g: F.exists(listed, lambda t: _dice(g, t["grams"]) >= threshold - 1e-9))).otherwise(False))

    return by_line.unionByName(windows(lowered, templates or TEMPLATES | NOTICES, has_row, threshold))


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def oracle_sql() -> str:
    values = ", ".join(f"('{n}', {_sql_list(template_bigrams(t))})" for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH templates(license, grams) AS (VALUES {values}),
lines AS (
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
words AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM lines),
grams AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scored AS (SELECT doc_id, line_no, license, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams JOIN templates ON len(g) BETWEEN 1 AND 200 AND list_has_any(g, templates.grams)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) AS r FROM scored WHERE dice >= {THRESHOLD} - 1e-9)
SELECT doc_id, line_no::INTEGER AS line_no, license, round(dice, 6)::DOUBLE AS dice FROM ranked WHERE r = 1"""
