"""URL filter: block and allow rules, then a character language-model ratio.

Rules come first: a rule ``host/path`` fits its host and all subdomains if the
URL's path starts with the rule's path, and the longest rule wins.  The other
URLs are judged by two smoothed variable-order Markov models, one of accepted
and one of rejected URLs.  A context that a model has seen little of leans on
the next shorter one (orders 2, 1, 0, uniform), so each model is one number
for each of 32**3 grams: a table whose size does not depend on the data.  The
score is the difference of the log-likelihoods over the length.  Its limit is
calibrated on a tenth of the URLs, kept out of the training (on all of them if
a class is missing there): the middle of the gap with the fewest errors of both
classes, each weighed by its size.  The model carries both error rates at it.

Training labels come from ``reject_terms``: a host is rejected if one of its
words, that is runs of letters, is one of them, so ``alphabets`` is not
``bets``.  The models see the letters of all URLs, so they also judge names that
hold none of the words.  All of it is DataFrame code.

Defined cases: a null or empty url, or one without ``://``, gives an empty host
and path and is allowed (there is nothing to score); with no rejected or no
accepted URL to learn from everything is allowed; a URL of any length is scored
whole; repeated rows are judged alike, so ties need no order; an empty table
gives an empty one; further columns pass through, and one of an output column's
name gives way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.rows import packed, passengers

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
REJECT_TERMS = ("adult", "ads", "bets", "casino", "escort", "jackpot", "loan", "pills", "porn", "spam", "track", "tracker", "viagra")
ADDED = ("host", "path", "rule", "verdict", "score")
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/"
START, SYMBOLS = 31, 32
STRENGTH = 2.0
BIN = 200
#: Log-ratios from -SHIFT to SHIFT, in steps of 1 / STEPS.
SHIFT, STEPS = 16, 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Codes of the grams of host and path: two symbols of context, one that follows."""
    text = F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0")
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code)
    padded = F.concat(F.array(F.lit(START), F.lit(START)), codes)
    n = F.size(padded) - 2
    head = F.zip_with(F.slice(padded, F.lit(1), n), F.slice(padded, F.lit(2), n), lambda a, b: a * (SYMBOLS * SYMBOLS) + b * SYMBOLS)
    return F.zip_with(head, codes, lambda ab, c: ab + c)


def ratio_table(labelled: DataFrame) -> DataFrame:
    """(g, r, n0, n1): the log-ratio of each of the 32**3 grams and its counts."""
    spark = labelled.sparkSession
    counted = labelled.select("rejected", F.explode("grams").alias("g")).groupBy("g").agg(F.count_if(~F.col("rejected")).alias("n0"), F.count_if("rejected").alias("n1"))
    grid = spark.range(0, SYMBOLS**3, 1, 1).withColumnRenamed("id", "g").join(counted, "g", "left").fillna(0, ["n0", "n1"])
    last, middle = F.col("g") % SYMBOLS, F.floor(F.col("g") / SYMBOLS) % SYMBOLS
    head = F.floor(F.col("g") / SYMBOLS)
    grid = grid.withColumn("c", last).withColumn("b", middle).withColumn("ab", head)
    over = lambda n, *by: F.sum(n).over(Window.partitionBy(*by)).cast("double")
    logs = []
    for n in ("n0", "n1"):
        every = F.sum(n).over(Window.partitionBy(F.lit(1))).cast("double")
        p0 = (over(n, "c") + 1.0) / (every + SYMBOLS)
        p1 = (over(n, "b", "c") + STRENGTH * p0) / (over(n, "b") + STRENGTH)
        p2 = (F.col(n) + STRENGTH * p1) / (over(n, "ab") + STRENGTH)
        logs.append(F.log(p2))
    return grid.select("g", (logs[0] - logs[1]).alias("r"), "n0", "n1")


@dataclass(frozen=True)
class UrlModel:
    """Log-ratios as 16-bit numbers, gram by gram, and the limit of the score."""

    packed: bytes | None
    limit: float = float("-inf")
    #: Shares of the held-out accepted URLs that are blocked and of the rejected ones that are allowed.
    wrong_blocked: float | None = None
    wrong_allowed: float | None = None

    def score(self, grams_: Column) -> Column:
        """Length-normalised difference; null for no grams or no model."""
        if self.packed is None:
            return F.lit(None).cast("double")
        table = F.lit(bytearray(self.packed))
        step = lambda g: F.conv(F.hex(F.substring(table, (g * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
        total = F.aggregate(grams_, F.lit(0).cast("long"), lambda s, g: s + step(g))
        return F.when(F.size(grams_) > 0, total / (F.size(grams_) * F.lit(float(STEPS))) - SHIFT)


def _limit(scored: DataFrame) -> tuple[float, float, float] | None:
    """(limit, wrong_blocked, wrong_allowed) with the fewest errors on (rejected, score); none if a class is missing."""
    bins = scored.where("score is not null").groupBy(F.floor(F.greatest(F.least(F.col("score"), F.lit(20.0)), F.lit(-20.0)) * BIN).alias("bin"))
    bins = bins.agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r"))
    upto, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(1))
    blocked, allowed = F.try_divide(F.sum("a").over(upto), F.sum("a").over(every)), 1 - F.try_divide(F.sum("r").over(upto), F.sum("r").over(every))
    following = F.coalesce(F.lead("bin").over(Window.orderBy("bin")), F.col("bin") + 1)
    sums = bins.select(blocked.alias("blocked"), allowed.alias("allowed"), "bin", following.alias("next")).where("blocked is not null and allowed is not null")
    best = sums.agg(F.min(F.struct((F.col("blocked") + F.col("allowed")).alias("wrong"), "bin", "next", "blocked", "allowed")).alias("b")).first().b
    if best is None:
        return None
    if best.wrong >= 1:  # no limit is better than none
        return float("-inf"), 0.0, 1.0
    return (best.bin + 1 + best.next) / 2 / BIN, best.blocked, best.allowed


def rejected_host(host: Column, terms: tuple[str, ...] = REJECT_TERMS) -> Column:
    """Whether one of the host's words is a term or its plural."""
    return host.rlike(rf"(?<![a-z])(?:{'|'.join(terms)})s?(?![a-z])")


def fit(pages: DataFrame, reject_terms: tuple[str, ...] = REJECT_TERMS) -> UrlModel:
    """Counts the grams of all URLs.  The driver gets 32**3 numbers, however many URLs there are."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select(host.alias("host"), grams(host, path).alias("grams"))
    seen = seen.withColumn("rejected", rejected_host(F.col("host"), reject_terms)).withColumn("kept_out", F.pmod(F.xxhash64("grams"), F.lit(10)) == 0)
    rows = ratio_table(seen.where(~F.col("kept_out"))).collect()
    if not sum(r.n0 for r in rows) or not sum(r.n1 for r in rows):
        return UrlModel(None)
    ratios = {r.g: r.r for r in rows}
    steps = [round((max(-SHIFT, min(SHIFT, ratios[g])) + SHIFT) * STEPS) for g in range(SYMBOLS**3)]
    model = UrlModel(b"".join(x.to_bytes(2, "big") for x in steps))
    scored = seen.select("rejected", "kept_out", model.score(F.col("grams")).alias("score"))
    found = _limit(scored.where("kept_out")) or _limit(scored)
    return UrlModel(model.packed, *found) if found else UrlModel(None)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, reject_terms: tuple[str, ...] = REJECT_TERMS, model: UrlModel | None = None) -> DataFrame:
    """``pages(url, ...)`` with host, path, rule, verdict and score."""
    model = model or fit(pages, reject_terms)
    rows = packed(pages, "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", model.score(grams(F.col("host"), F.col("path"))))
    low = F.coalesce(F.col("score") < F.lit(model.limit), F.lit(False))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(low, "block").otherwise("allow"))
    return judged.select(*passengers(judged, ADDED), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
