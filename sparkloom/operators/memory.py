"""Memory, wiki and session lifecycle rules as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import holds_any

C = F.col


#: Hours after which a tier is old, the usefulness below which it is of none, hits that keep it warm.
ACTIVE_HOURS, COOLING_HOURS, ACTIVE_FLOOR, COOLING_FLOOR, WARM_HITS = 2, 168, 0.30, 0.10, 1


def decay_tier(tier: Column, age_hours: Column, usefulness: Column, hits: Column) -> Column:
    """Active -> Cooling -> Archived; a tier never warms up again.

    An active memory cools when it is of no use, or old and not warm; a cooling
    one is archived when it is old, or of no use and not warm.
    """
    warm = hits >= WARM_HITS
    cools = ((age_hours >= ACTIVE_HOURS) & ~warm) | (usefulness < ACTIVE_FLOOR)
    ends = (age_hours >= COOLING_HOURS) | ((usefulness < COOLING_FLOOR) & ~warm)
    return F.when((tier == "Active") & cools, "Cooling").when((tier == "Cooling") & ends, "Archived").otherwise(tier)


def lesson_gate(confidence: Column, evidence: Column, text: Column, duplicate: Column, contradicts: Column) -> Column:
    """The first gate that stops a lesson, or quarantine for those that pass."""
    return (
        F.when(confidence >= 0.95, "too_certain")
        .when(confidence < 0.60, "too_weak")
        .when(evidence < 2, "thin_evidence")
        .when(F.trim(text) == "", "empty")
        .when(duplicate, "duplicate")
        .when(contradicts, "contradiction")
        .otherwise("quarantine")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two word lists; two empty lists are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def promotable(hits: Column, age_days: Column) -> Column:
    return (hits >= 1) & (age_days >= 7)


def hypothesis(events: DataFrame) -> DataFrame:
    """(hypothesis, confidence, stale) from ``events(hypothesis, supports)``."""
    g = events.groupBy("hypothesis").agg(F.count_if("supports").alias("for"), F.count_if(~C("supports")).alias("against"))
    total = C("for") + C("against")
    return g.withColumn("confidence", (C("for") + 1) / (total + 2)).withColumn("stale", (total >= 3) & (C("against") > 2 * C("for")))


def ema(values: DataFrame, by: str, order: list[str], alpha: float = 0.3, prior: float = 0.5) -> DataFrame:
    """(by, ema): the fold of an ordered series, in closed form."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy(*order))
    part = alpha * F.pow(F.lit(1 - alpha), n - i) * C("x")
    return values.withColumn("_p", part).withColumn("_n", n).groupBy(by).agg((F.sum("_p") + F.pow(F.lit(1 - alpha), F.max("_n")) * prior).alias("ema"))


def source_threshold(source_type: Column) -> Column:
    return F.when(source_type == "Code", 0.35).when(source_type == "Wiki", 0.50).when(source_type == "Reflection", 0.60).otherwise(0.50)


def compaction_level(occupancy: Column) -> Column:
    return F.when(occupancy >= 0.99, "Compact").when(occupancy >= 0.90, "Aggressive").when(occupancy >= 0.85, "Prune").when(occupancy >= 0.80, "Mask").when(occupancy >= 0.70, "Warn").otherwise("None")


def recent(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(C("_n") <= n).drop("_n")


def budget_violation(seconds: Column, tokens: Column, iterations: Column, calls: Column, limits: tuple[float, float, float, float]) -> Column:
    """The first limit that is passed: time, tokens, iterations, tool calls."""
    return F.when(seconds > limits[0], "time").when(tokens > limits[1], "tokens").when(iterations > limits[2], "iterations").when(calls > limits[3], "tool_calls")


def invalid_transitions(states: DataFrame, allowed: DataFrame) -> DataFrame:
    """Changes of ``states(entity, at, state)`` that ``allowed(from_state, to_state)`` lacks."""
    before = F.lag("state").over(Window.partitionBy("entity").orderBy("at"))
    moves = states.withColumn("from_state", before).where(C("from_state").isNotNull() & (C("from_state") != C("state")))
    return moves.withColumnRenamed("state", "to_state").join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")  # a state machine's table


#: Cyrillic letters and the Latin ones they pass for.
LOOKALIKES = ("аАеЕоОрРсСуУхХВНКМТіІ", "aAeEoOpPcCyYxXBHKMTiI")
#: Phrases of an injected instruction, by reason, in order.
INJECTIONS = (
    ("ignore_instructions", ("ignore previous instructions", "ignore all previous", "disregard prior", "forget the above")),
    ("prompt_override", ("your new instructions are", "you are now a", "you are henceforth")),
    ("shell_escape", ("; rm -rf", "&& rm -rf", "$(curl ", "`curl ")),
    ("credential_exfiltration", ("$api_key", "${api_key}", "cat /etc/passwd", ".ssh/id_rsa")),
    ("role_spoof", ("<|im_start|>system", '"role": "system"', "<<sys>>")),
)
#: Names of personal data, and of what checks a caller.
PERSONAL = ("email", "password", "passwd", "secret", "ssn", "social_security", "credit_card", "creditcard", "card_number", "cardnumber", "phone", "address", "date_of_birth", "dateofbirth", "dob", "token", "api_key", "apikey")
CHECKS = ("auth", "jwt", "protect", "verify", "guard", "login")


def injection_risk(text: Column) -> Column:
    """Zero-width characters first, then Latin beside Cyrillic letters, then known phrases behind look-alikes."""
    out = F.when(text.rlike("[\u200b\u200c\u200d\ufeff]"), "zero_width").when(text.rlike("[A-Za-z]") & text.rlike("[\u0400-\u04ff]"), "mixed_script")
    low = F.lower(F.translate(text, *LOOKALIKES))
    for reason, phrases in INJECTIONS:
        out = out.when(holds_any(low, phrases), reason)
    return out


def pii_flag(text: Column) -> Column:
    return holds_any(F.lower(text), PERSONAL)


def auth_flag(name: Column) -> Column:
    return holds_any(F.lower(name), CHECKS)


def community_hash(members: DataFrame) -> DataFrame:
    """(community, hash) over the sorted hashes of the members."""
    hashed = members.withColumn("_h", F.substring(F.sha2(C("member").cast("string"), 256), 1, 16))
    return hashed.groupBy("community").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256), 1, 16).alias("hash"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target): distinct link targets of ``pages(page_id, html)``."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    return pages.select("page_id", F.explode(found).alias("target"))


def wiki_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, label): the ``[[target|label]]`` links of ``pages(page_id, text)``; a label may be absent."""
    inner = F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]]+)\]\]"), 1)).alias("_l")
    found = pages.select("page_id", inner)
    return found.select("page_id", F.trim(F.substring_index("_l", "|", 1)).alias("target"), F.when(F.contains(C("_l"), F.lit("|")), F.trim(F.regexp_extract("_l", r"\|(.*)$", 1))).alias("label"))


def orphans(pages: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    return pages.join(linked.select(C("target").alias(key)), key, "left_anti")


def strip_html(html: Column) -> Column:
    """A page's text: scripts, styles and tags go, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def grep(docs: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """(doc_id, line_no, line): the first ``most`` matching lines of each document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(C("line").rlike(pattern))
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where(C("_n") <= most).drop("_n")


#: How much a page's origin counts.
TIER_WEIGHTS = (("Deterministic", 1.0), ("Enriched", 0.95), ("PromotedCache", 0.75), ("RawCache", 0.5), ("EpisodicCache", 0.4))
#: The confidence that a class of queries asks for.
CLASS_CONFIDENCE = (("api_lookup", 5.0), ("onboarding", 7.0), ("architecture", 9.0), ("concept", 9.0), ("call_flow", 10.0), ("unknown", 12.0))


def _case(value: Column, rows, default: float) -> Column:
    out = F.lit(default)
    for name, number in rows:
        out = F.when(value == name, number).otherwise(out)
    return out


def tier_weight(tier: Column) -> Column:
    return _case(tier, TIER_WEIGHTS, 0.5)


def wiki_score(score: Column, tier: Column, title: Column, stale: Column) -> Column:
    """A page's rank: its text score by its tier, more for a title match, less when stale."""
    return F.greatest(F.lit(0.0), score * tier_weight(tier) + F.when(title, 0.15).otherwise(0.0) - F.when(stale, 0.3).otherwise(0.0))


def wiki_confidence(best: Column, second: Column, title: Column, tier: Column, stale: Column) -> Column:
    """How sure the best page is, on the scale of raw text scores."""
    raw = 0.5 * best + 0.3 * (best - second) + 0.1 * F.when(title, 0.15).otherwise(0.0) + 0.1 * tier_weight(tier)
    return F.greatest(F.lit(0.0), raw - F.when(stale, 0.3).otherwise(0.0))


def wiki_gate(best: Column, confidence: Column, query_class: Column, floor: float = 12.0) -> Column:
    """Why a page may or may not answer a query by itself."""
    enough = confidence >= _case(query_class, CLASS_CONFIDENCE, 12.0)
    return F.when(best.isNull(), "no_results").when(best < floor, "below_floor").when(enough, "passed").otherwise("below_class_threshold")


def suppress_write(confidence: Column, tokens: Column, new_tokens: Column, sources: Column, new_sources: Column) -> Column:
    """Whether two of three signs say that a page repeats another: query, tokens, sources.  An empty side shares nothing."""
    share = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    signs = ((confidence >= 0.7), (share(tokens, new_tokens) >= 0.3), (share(sources, new_sources) >= 0.5))
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs), F.lit(0)) >= 2
