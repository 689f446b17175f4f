"""Identifier-aware tokenizers and stemmers as column expressions.

All limits count UTF-8 bytes (``octet_length``), and every rule is an ordered
``CASE`` so that the first match wins.  No Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries between camel parts: plain and code tokenizer.
CAMEL_PLAIN = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
CAMEL_CODE = r"(?<=.)(?=\p{Lu})(?:(?<!\p{Lu})|(?=\p{Lu}\p{Ll}))"
NON_ALNUM = r"[^\p{L}\p{N}]+"
#: Stop words of the code tokenizer, that is keywords, common types and file extensions.
CODE_STOP_WORDS = tuple("abstract and arc as async await bool box break chan class clone const continue cpp crate css def default defer dyn else enum err export extends extern f32 f64 false final fn for from func function go hpp html i32 i64 if impl implements import in instanceof interface into isize java js json jsx kt lambda let loop map match md mod move mut new none not null ok option package pass php private protected pub public py range rb ref require result return rs self some static str string struct super that the this throws toml trait true ts tsx type typeof u16 u32 u64 u8 undefined unsafe use usize var vec void where while with yaml yield".split())


def words(text: Column) -> Column:
    """Runs of letters and digits; no empty strings, [] for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NON_ALNUM), lambda w: w != "")


def _drop(w: Column, k: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - k)


def stem(w: Column) -> Column:
    """Suffix rules of the plain tokenizer on a lower-case word."""
    n = F.octet_length(w)
    return (
        F.when(n < 4, w)
        .when(w.endswith("ies"), F.concat(_drop(w, 3), F.lit("y")))
        .when(w.endswith("ing") & (n > 5), _drop(w, 3))
        .when(w.endswith("tion"), _drop(w, 3))
        .when(w.endswith("ment") & (n > 6), _drop(w, 4))
        .when(w.endswith("es") & (n > 4), _drop(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _drop(w, 1))
        .otherwise(w)
    )


def code_stem(w: Column) -> Column:
    """Suffix rules of the code tokenizer on a lower-case word."""
    n = F.octet_length(w)
    return (
        F.when(n <= 4, w)
        .when(w.endswith("ing") & (n > 5), _drop(w, 3))
        .when(w.endswith("tion") & (n > 6), _drop(w, 3))
        .when(w.endswith("ment") & (n > 6), _drop(w, 4))
        .when((w.endswith("able") | w.endswith("ible")) & (n > 6), _drop(w, 4))
        .when(w.endswith("er"), _drop(w, 2))
        .when(w.endswith("ed"), _drop(w, 2))
        .otherwise(w)
    )


def _camel_words(text: Column, boundary: str) -> Column:
    """:func:`words`, cut at the boundaries too: these lie between letters, so one pass over the text finds those of all its words."""
    return words(F.regexp_replace(text, boundary, " "))


def tokenize(text: Column) -> Column:
    """Whole lower-case words of three bytes or more, then stemmed camel parts."""
    whole = F.filter(F.transform(words(text), F.lower), lambda w: F.octet_length(w) >= 3)
    parts = F.transform(F.transform(_camel_words(text, CAMEL_PLAIN), F.lower), stem)  # in turn, as the rules name a word often
    return F.concat(whole, F.filter(parts, lambda p: p != ""))


def tokenize_code(text: Column, stop_words: list[str]) -> Column:
    """Like :func:`tokenize` with stop words and the code splitter and stems."""
    held = lambda w: w.isin(*stop_words) if stop_words else F.lit(False)
    whole = F.filter(F.transform(words(text), F.lower), lambda w: (F.octet_length(w) >= 3) & ~held(w))
    kept = F.filter(F.transform(_camel_words(text, CAMEL_CODE), F.lower), lambda p: (F.octet_length(p) >= 2) & ~held(p))
    stemmed = F.filter(F.transform(kept, code_stem), lambda p: ~held(p))
    return F.concat(whole, stemmed)


def keywords(text: Column) -> Column:
    """Lower-case letter and digit runs of two bytes or more."""
    return F.filter(F.transform(words(text), F.lower), lambda w: F.octet_length(w) >= 2)


def tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term): :func:`tokenize` as rows, with the rules in generated code."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.split(text, NON_ALNUM)).alias("_w")).where("_w <> ''")
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("_w").alias("t")))
    cut = F.when(F.col("_w").rlike(CAMEL_PLAIN), F.split("_w", CAMEL_PLAIN)).otherwise(F.array("_w"))  # few words have a boundary, and a split compiles its pattern
    parts = F.transform(cut, lambda p: F.struct(F.lit(False).alias("whole"), p.alias("t")))
    pieces = rows.select("doc_id", F.explode(F.concat(whole, parts)).alias("_p")).select("doc_id", "_p.whole", F.lower("_p.t").alias("_t"))
    kept = pieces.where(F.when(F.col("whole"), F.octet_length("_t") >= 3).otherwise(F.col("_t") != ""))
    return kept.select("doc_id", F.when(F.col("whole"), F.col("_t")).otherwise(stem(F.col("_t"))).alias("term"))


def normalize_lesson(text: Column) -> Column:
    """Lower-case letters and digits; punctuation vanishes, spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def slugify(text: Column) -> Column:
    """Lower-case letters and digits of any script, and dashes; one pass joins double dashes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}-]", "-"), "--", "-"), F.lit("-"))


def normalize_error(text: Column) -> Column:
    """Without positions such as ``:12:5:``, up to the first colon that no digit follows."""
    numbered = F.regexp_extract(text, r"^((?:[^:]|:\d[\d:]*+)*+)(?s:.*)$", 1)
    rest = F.substring(text, F.length(numbered) + 1, F.length(text))
    return F.regexp_replace(F.concat(F.regexp_replace(numbered, r":\d[\d:]*", ""), rest), r"^\s+|\s+$", "")


def valid_slug(slug: Column) -> Column:
    return slug.rlike("^[a-z0-9][a-z0-9_-]*$")


def estimate_tokens(text: Column) -> Column:
    """The greater of a quarter of the bytes and 1.3 times the words."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.greatest(F.floor(F.octet_length(text) / 4), F.floor(words * 1.3)).cast("long")


#: Query classes in order; the first with a phrase in the query wins.
QUERY_CLASSES = (
    ("api_lookup", ("fn ", "struct ", "trait ", "impl ", "pub fn", "function", "method", "verify", "parse", "token", "handler", "client", "config", "registry", "search", "index", "cache", "embed")),
    ("call_flow", ("flow", "call chain", "how does", "lifecycle", "pipeline", "request path", "execution", "calls", "invokes")),
    ("architecture", ("architecture", "bounded context", "layer", "structure", "organized", "design", "system diagram", "dependency direction")),
    ("concept", ("what is", "what are", "what modules", "which modules", "which crates", "what components", "role of", "purpose of", "concept")),
    ("onboarding", ("get started", "getting started", "how to build", "how to run", "where to start", "entry point", "overview", "tech stack")),
)


def holds_any(text: Column, needles) -> Column:
    """Whether a text holds one of some plain strings."""
    return text.rlike("|".join(re.escape(n) for n in needles))


def query_class(query: Column) -> Column:
    low, out = F.lower(query), F.lit("unknown")
    for name, needles in reversed(QUERY_CLASSES):
        out = F.when(holds_any(low, needles), name).otherwise(out)
    return out


def closed_json(text: Column) -> Column:
    """``text`` with the quote and brackets that it lacks at its end; null unless it begins with one.

    Escaped characters and whole strings are taken out first, so what is folded
    over a stack is the brackets alone; a closing one takes back the last that
    is open, and a lone backslash at the end of an open string goes.
    """
    bare = F.regexp_replace(text, r"(?s)\\.", "")
    outside = F.regexp_replace(bare, '"[^"]*"', "")
    open_string = F.contains(outside, F.lit('"'))
    brackets = F.regexp_replace(F.regexp_replace(outside, r'(?s)".*$', ""), r"[^{}\[\]]", "")
    step = lambda stack, c: F.when(c == "{", F.concat(F.lit("}"), stack)).when(c == "[", F.concat(F.lit("]"), stack)).when(c == "", stack).otherwise(F.substring(stack, 2, 2**31 - 1))
    stack = F.aggregate(F.split(brackets, ""), F.lit(""), step)
    kept = F.when(open_string & bare.endswith("\\"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text.rlike(r'^[{\["]'), F.concat(kept, F.when(open_string, '"').otherwise(""), stack))


def partial_json(text: Column) -> Column:
    """A JSON text that may break off, completed: itself if it is whole, closed if that makes it whole, else null."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    closed = closed_json(trimmed)
    # The parser stops after a value: within a list no bracket may follow it, within an object no further value.
    within = lambda t, a, b: F.try_parse_json(F.concat(F.lit(a), t, F.lit(b))).isNotNull()
    whole = lambda t: within(t, "[", "]") & within(t, '{"a":', "}")
    return F.when(whole(trimmed), trimmed).when(whole(closed), closed)
