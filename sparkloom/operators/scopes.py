"""Declarations with their scopes, bases and fields: comments and strings are blanked, nesting is a stack.

Files are dealt to tasks; within one, a pass over the text blanks comments and
strings and a second one keeps the open scopes, so the work is linear and what
a task holds is one file.  Python and Ruby nest by indentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.extraction import references
from sparkloom.runtime import ship

C = F.col
SCHEMA = "path string, language string, kind string, name string, line int, scope string, bases array<string>, fields array<struct<name:string,type:string>>"

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"?'
_APOSTROPHE = r"'(?:[^'\\\n]|\\.)*'?"
_BACKTICK = r"`(?:[^`\\]|\\.)*`?"
#: What is blanked, by language.
HIDDEN = {
    "python": r'#[^\n]*|"""(?:[^\\]|\\.)*?(?:"""|\Z)|' + r"'''(?:[^\\]|\\.)*?(?:'''|\Z)|" + f"{_QUOTED}|{_APOSTROPHE}",
    "ruby": rf"(?:^=begin\b.*?(?:^=end\b|\Z))|#[^\n]*|{_QUOTED}|{_APOSTROPHE}",
    "rust": _C_LIKE + r'|r(#*)".*?(?:"\1|\Z)|"(?:[^"\\]|\\.)*"?|' + r"'(?:\\[^']*|[^'\\])'",
    "go": rf"{_C_LIKE}|`[^`]*`?|{_QUOTED}|{_APOSTROPHE}",
    "typescript": rf"{_C_LIKE}|{_QUOTED}|{_APOSTROPHE}|{_BACKTICK}",
    "java": rf'{_C_LIKE}|""".*?(?:"""|\Z)|{_QUOTED}|{_APOSTROPHE}',
    "php": rf"{_C_LIKE}|#(?!\[)[^\n]*|" + r'"(?:[^"\\]|\\.)*"?|' + r"'(?:[^'\\]|\\.)*'?",
}
#: A head that opens a scope: kind, name, and the texts that name its bases.
HEADS = {
    "rust": [(k, rf"\b{k}\s+(\w+)") for k in ("struct", "enum")] + [("trait", r"\btrait\s+(\w+)(?:<[^{]*?>)?\s*(?::\s*([^{]*?))?(?:\bwhere\b.*)?$"), ("impl", r"^\s*(?:unsafe\s+)?impl\b(?:\s*<.*?>(?=\s))?\s+(?:([\w:]+)(?:<.*>)?\s+for\s+)?([\w:]+)"), ("function", r"\bfn\s+(\w+)"), ("module", r"\bmod\s+(\w+)")],
    "go": [("function", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"\btype\s+(\w+)(?:\[[^]]*\])?\s+struct\b"), ("interface", r"\btype\s+(\w+)(?:\[[^]]*\])?\s+interface\b")],
    "typescript": [("class", r"\bclass\s+(\w+)(?:<.*?>)?\s*(?:extends\s+(.*?))?\s*(?:\bimplements\s+(.*))?$"), ("interface", r"\binterface\s+(\w+)(?:<.*?>)?\s*(?:extends\s+(.*))?$"), ("enum", r"\benum\s+(\w+)"), ("function", r"\bfunction\s*\*?\s*(\w+)"), ("method", r"(?:^|\n)[ \t]*(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*(?!(?:if|for|while|switch|catch|with|return|function)\b)(\w+)\s*(?:<[^(]*>)?\([^()]*\)\s*(?::[^=]*)?$")],
    "java": [("class", r"\b(?:class|record)\s+(\w+)(?:<.*?>)?\s*(?:\(.*\)\s*)?(?:extends\s+(.*?))?\s*(?:\bimplements\s+(.*))?$"), ("interface", r"\binterface\s+(\w+)(?:<.*?>)?\s*(?:extends\s+(.*))?$"), ("enum", r"\benum\s+(\w+)(?:\s+implements\s+(.*))?"), ("method", r"^(?!\s*(?:return|new|else|throw)\b)[\w<>\[\], ?.@\s]*[\w>\]]\s+(?!(?:if|for|while|switch|catch|synchronized)\b)(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?$")],
    "php": [("class", r"\bclass\s+(\w+)\s*(?:extends\s+([\w\\]+))?\s*(?:implements\s+(.*))?$"), ("interface", r"\binterface\s+(\w+)\s*(?:extends\s+(.*))?$"), ("trait", r"\btrait\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("function", r"\bfunction\s+&?(\w+)")],
    "python": [("class", r"^\s*class\s+(\w+)\s*(?:\[[^]]*\])?\s*(?:\((.*)\))?\s*:"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+(?!<<)([\w:]+)\s*(?:<\s*([\w:]+))?"), ("module", r"^\s*module\s+([\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?([\w?!]+)")],
}
#: A field among the statements of a type: name and type, in named groups.
FIELDS = {
    "rust": r"^(?:#\[.*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[^:].*)$",
    "go": r"^(?P<name>\w+)\s+(?P<type>[\w.*\[\]{}<-].*?)\s*$",
    "typescript": r"^(?:(?:public|private|protected|static|readonly|declare)\s+)*(?P<name>\w+)[?!]?\s*:\s*(?P<type>[^=]+?)\s*(?:=.*)?$",
    "java": r"^(?:@\w+\s+)*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*(?!(?:return|package|import|throw|new)\b)(?P<type>[\w.]+(?:<.*>)?(?:\[\])*)\s+(?P<name>\w+)\s*(?:=.*)?$",
    "php": r"^(?:(?:public|private|protected|static|readonly|var)\s+)+(?P<type>[?\w\\|]*)\s*\$(?P<name>\w+)\s*(?:=.*)?$",
    "python": r"^(?P<name>[A-Za-z_]\w*)\s*:\s*(?P<type>[^=]+?)\s*(?:=.*)?$",
}
#: A brace's head is looked for in so many characters before it, so that text without braces costs no more than its length.
HEAD_CHARS = 8192
TYPES = ("class", "struct", "interface", "trait", "enum", "module")
HEADS["javascript"], FIELDS["javascript"], HIDDEN["javascript"] = HEADS["typescript"], FIELDS["typescript"], HIDDEN["typescript"]
_HIDDEN = {k: re.compile(v, re.S | re.M) for k, v in HIDDEN.items()}
_HEADS = {k: [(kind, re.compile(r, re.S)) for kind, r in v] for k, v in HEADS.items()}
_FIELDS = {k: re.compile(v, re.S) for k, v in FIELDS.items()}


def blank(text: str, language: str) -> str:
    """The text with comments and strings as blanks of the same length; line ends stay."""
    clear = lambda m: re.sub(r"[^\n]", " ", m.group(0)) if m.group(0)[0] in "/#=" else '"' + re.sub(r"[^\n]", " ", m.group(0)[1:])
    return _HIDDEN[language].sub(clear, text)


def split_top(text: str, marks: str) -> list[str]:
    """``text`` cut at ``marks`` outside of brackets."""
    parts, depth, start = [], 0, 0
    for m in re.finditer(rf"->|=>|[()<>\[\]{{}}{re.escape(marks)}]", text):
        c = m.group(0)
        if c in "(<[{":
            depth += 1
        elif c in ")>]}":
            depth = max(0, depth - 1)
        elif depth == 0 and c in marks:
            parts.append(text[start:m.start()])
            start = m.end()
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def base_names(listed: str | None, marks: str = ",") -> list[str]:
    """The names in a list of bases, without type arguments and keyword arguments."""
    names = (re.match(r"[\w.:\\]+", p) for p in split_top(listed or "", marks) if not re.match(r"\w+\s*=", p))
    return [n.group(0).replace("\\", ".").strip(".:") for n in names if n]


def _head(text: str, language: str) -> tuple | None:
    for kind, rule in _HEADS[language]:
        m = rule.search(text)
        if m:
            if kind == "impl":
                return kind, m.group(2), base_names(m.group(1)), m.start(2)
            listed = [b for g in m.groups()[1:] for b in base_names(g, "+," if language == "rust" else ",")]
            return kind, m.group(1), listed, m.start(1)
    return None


def _fields(own: str, language: str, kind: str) -> tuple[list, list]:
    """(fields, embedded bases) from the text that lies directly in a type."""
    if language not in FIELDS or kind in ("enum", "module") or (language == "go" and kind != "struct"):
        return [], []
    pieces = split_top(own, {"rust": ",;", "java": ";", "php": ";"}.get(language, ";\n"))
    found = [(m.group("name"), " ".join(m.group("type").split())) for p in pieces if (m := _FIELDS[language].match(p))]
    embedded = [p.lstrip("*") for p in pieces if language == "go" and re.fullmatch(r"\*?[\w.]+", p)]
    return found, embedded


def _braces(text: str, language: str) -> Iterator[tuple]:
    stack: list = []  # open scopes: [head or None, line, text directly within]
    start, line, counted, parens = 0, 1, 0, 0

    def told(head: tuple, at: int, own: str) -> tuple:
        fields, embedded = _fields(own, language, head[0])
        return head[0], head[1], at, ".".join(s[0][1] for s in stack if s[0]), head[2] + embedded, fields

    for m in re.finditer(r"[{};()]", text):
        c = m.group(0)
        if c in "()":
            parens = max(0, parens + (1 if c == "(" else -1))
            continue
        if c == ";" and parens:  # the head of a loop
            continue
        piece = text[start:m.start()]
        if len(piece) > HEAD_CHARS:
            text_before, piece = piece[:-HEAD_CHARS], piece[-HEAD_CHARS:]
            start = m.start() - HEAD_CHARS
            if stack:
                stack[-1][2].append(text_before)
        head = None if c == "}" else _head(piece, language)
        if head and c == ";" and head[0] in ("method", "function") and not (stack and stack[-1][0] and stack[-1][0][0] in TYPES):
            head = None  # a call
        if head:
            line += text.count("\n", counted, start + head[3])
            counted = start + head[3]
            piece = piece[:piece.rfind("\n", 0, head[3]) + 1]
        if stack:
            stack[-1][2] += [piece, c if c == ";" else "{}" if c == "{" and language == "go" else ";" if c == "{" else ""]
        if c == "{":
            stack.append([head, line, []])
            parens = 0
        elif c == ";" and head and head[0] != "impl":
            yield told(head, line, "")
        elif c == "}" and stack:
            head, at, own = stack.pop()
            if head:
                yield told(head, at, "".join(own))
        start = m.end()
    while stack:  # a file that breaks off
        head, at, own = stack.pop()
        if head:
            yield told(head, at, "".join(own))


def _indented(text: str, language: str) -> Iterator[tuple]:
    stack: list = []  # [indent, head, line, lines directly within]

    def close() -> tuple:
        _, head, at, own = stack.pop()
        found, more = ([], []) if head[0] != "class" else _fields("\n".join(own), language, head[0])
        if language == "ruby":
            found = [(n, "") for o in own if o.startswith("attr_") for n in re.findall(r":(\w+)", o)]
            more = [n for o in own for n in re.findall(r"^include\s+([\w:]+)", o)]
        return head[0], head[1], at, ".".join(s[1][1] for s in stack), head[2] + more, found

    parts, depth, at = [], 0, 0
    for number, row in enumerate(text.split("\n"), 1):
        if depth and re.match(r"(?:async\s+)?(?:def|class|module)\b", row):
            depth = 0  # a bracket that is never closed hides no declaration behind it
        if depth:
            parts.append(row.strip())
        else:
            parts, at = [row], number
        depth = max(0, depth + sum(row.count(c) for c in "([{") - sum(row.count(c) for c in ")]}"))
        held = "" if depth else " ".join(parts)
        if not held.strip():
            continue
        indent = len(held) - len(held.lstrip())
        while stack and stack[-1][0] >= indent:
            yield close()
        head = _head(held, language)
        if stack and not head:
            stack[-1][3].append(held.strip())
        if head:
            stack.append([indent, head, at, []])
    while stack:
        yield close()


def scan(text: str | None, language: str | None) -> list[tuple]:
    """(kind, name, line, scope, bases, fields) of each declaration, by line."""
    if not text or language not in HEADS:
        return []
    found = (_indented if language in ("python", "ruby") else _braces)(blank(text, language), language)
    return sorted(found, key=lambda d: (d[2], d[3], d[1]))


def declarations(files: DataFrame) -> DataFrame:
    """Declarations of ``files(path, text, language)``; a null text or an unknown language has none.

    Columns: path, language, kind, name, line, scope (names of the enclosing
    declarations, dotted), bases, fields.  ``impl`` rows are the blocks of a
    type, with the trait as base.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "language", "kind", "name", "line", "scope", "bases", "fields"]
        for f in frames:
            rows = [(p, lang, kind, name, line, scope, bases, [{"name": n, "type": t} for n, t in fields]) for p, t, lang in f.itertuples(index=False) for kind, name, line, scope, bases, fields in scan(t, lang)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text", "language").mapInPandas(run, SCHEMA)


def inheritance(found: DataFrame) -> DataFrame:
    """(source, target, edge_type, weight): a type and its base, wherever the base's name resolves to one."""
    types = found.where(C("kind").isin(*TYPES))
    asked = found.where(C("kind").isin(*TYPES, "impl")).select("path", "line", "name", F.explode("bases").alias("_base"))
    calls = asked.select("path", "line", F.regexp_extract("_base", r"(\w+)$", 1).alias("callee"), "name").distinct()
    targets = references(calls.select("path", "line", "callee").distinct(), types.select("path", "name")).where("target is not null and confidence > 0.4")
    met = calls.join(targets, ["path", "line", "callee"])
    return met.select(F.concat_ws(":", F.lit("sym"), "path", "name").alias("source"), F.concat_ws(":", F.lit("sym"), "target", "callee").alias("target"), F.lit("Inherits").alias("edge_type"), "confidence").withColumnRenamed("confidence", "weight").distinct()
