import re

from sparkloom.llm import licenses


def brute(text):
    if text is None:
        return []
    lines = text.split("\n")
    units = list(enumerate(lines, 1)) + ([(0, text)] if len(lines) > 1 else [])
    out = []
    for no, line in units:
        w = re.sub(r"[\W_]+", " ", line.lower()).strip().split(" ")
        g = set(zip(w, w[1:], strict=False))
        best = []
        for name, t in licenses.TEMPLATES.items():
            b = {tuple(x.split(" ")) for x in licenses.template_bigrams(t)}
            d = 2 * len(g & b) / (len(g) + len(b)) if g else 0
            if d >= licenses.THRESHOLD - 1e-9:
                best.append((-d, name))
        if best:
            d, name = min(best)
            out.append((no, name, round(-d, 6)))
    return sorted(out)


CASES = [None, "", "one", "Released under the MIT License.", "x\nreleased UNDER the *MIT* license!!\ny z", "Released under the\nMIT License", "Released under the the MIT License", "Licensed under CC BY-SA 4.0.", "long " * 50000 + "\nLicensed under the Apache License, Version 2.0", "\n".join(licenses.TEMPLATES.values())]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(CASES)] + [(3, CASES[3], 3)], "doc_id long, text string, dice int")
    got = sorted((r.doc_id, r.line_no, r.license, r.dice) for r in licenses.scan(df).collect())
    want = sorted((i, *x) for i, t in [*enumerate(CASES), (3, CASES[3])] for x in brute(t))
    assert got == want and len(want) > 15
    assert licenses.scan(df.limit(0)).count() == 0


def test_bounds():
    for m in (1, 4, 30):
        low, high = licenses.size_bounds(m, 0.8)
        assert 2 * min(low, m) / (low + m) >= 0.8 - 1e-9 > 2 * min(low - 1, m) / (low - 1 + m) - 1e-8
        assert 2 * m / (high + m) >= 0.8 - 1e-9 and 2 * m / (high + 1 + m) < 0.8


def test_notices_within_longer_texts(spark):
    fill = "\n".join(f"filler line {i} of some longer file" for i in range(40))
    wrap = lambda t, k=9, mark="# ": "\n".join(mark + " ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    lines = lambda t, k: -(-len(t.split()) // k)
    t = licenses.TEMPLATES | licenses.NOTICES
    cases = {
        1: (t["mit-grant"], [(1, "mit-grant", 1.0)]),
        2: (fill + "\n" + wrap(t["gpl-3.0-notice"]) + "\n" + fill, [(41, "gpl-3.0-notice", 1.0)]),
        3: (fill + "\n" + wrap(t["bsd-3-clause-conditions"], 7, " * ") + "\n" + fill, [(41, "bsd-3-clause-conditions", 1.0)]),
        4: ("Photo set of the old harbour, taken in spring. Released under the MIT License.", [(1, "mit", 1.0)]),
        5: ("Photo set. Released under the the MIT License. More to come on the next page of this set.", [(1, "mit", 0.888889)]),
        6: (fill + "\nCopyright X\n\n" + wrap(t["mit-grant"], 11, "") + "\n\n" + fill + " released under the mit license ok then", [(43, "mit-grant", 1.0), (42 + lines(t["mit-grant"], 11) + 1 + 40, "mit", 1.0)]),
        7: ("This old module was once licensed under the Apache License, Version 1.1 by its first authors.", []),
        8: (fill + "\nReleased under the MIT License.\n" + fill, [(41, "mit", 1.0)]),
        9: (fill + "\n" + wrap(t["lgpl-3.0-notice"]), [(41, "lgpl-3.0-notice", 1.0)]),
    }
    df = spark.createDataFrame([(i, x) for i, (x, _) in cases.items()], "doc_id long, text string")
    got = {i: [] for i in cases}
    for r in licenses.scan(df).collect():
        got[r.doc_id].append((r.line_no, r.license, r.dice))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, (_, x) in cases.items()}
