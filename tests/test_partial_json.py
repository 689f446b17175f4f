import json

import numpy as np

from sparkloom.functions import text as tx


def brute(text):
    text = text.strip()
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    if not text or text[0] not in '{["':
        return None
    stack, inside, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not inside and c in "}]" and stack:
            stack.pop()
    done = (text[:-1] if escaped else text) + ('"' if inside else "") + "".join(reversed(stack))
    try:
        json.loads(done)
        return done
    except ValueError:
        return None


def made(r, depth=0):
    kind = int(r.integers(0, 6 if depth < 3 else 4))
    if kind == 4:
        return [made(r, depth + 1) for _ in range(r.integers(0, 4))]
    if kind == 5:
        return {f"k{i}": made(r, depth + 1) for i in range(r.integers(0, 4))}
    return [1.5, True, 'a "quoted" \\ back\nline {[', "é漢 ]}"][kind]


def test_every_prefix(spark):
    r = np.random.default_rng(6)
    whole = [json.dumps([made(r) for _ in range(2)], ensure_ascii=bool(i % 2)) for i in range(60)]
    texts = [w[:k] for w in whole for k in range(len(w) + 1)] + ["  ", "not json", "tru", '"abc', "{}}", "]", ' {"a": [1, {"b": "c', "[" * 200, '"' + "x\\n" * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", tx.partial_json(df["t"]).alias("c")).collect())
    wrong = [(t, got[i], brute(t)) for i, t in enumerate(texts) if got[i] != brute(t)]
    assert not wrong, wrong[:3]
    assert sum(v is not None for v in got.values()) > len(texts) / 3
