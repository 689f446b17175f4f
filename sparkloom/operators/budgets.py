"""Token budgets, context priorities, rates, time-outs and gates: small rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import holds_any, keywords, normalize_error

C = F.col
#: Shares of a token budget, for maps, cards, code, history and reserve, and for a running task.
SHARES = {"repo_map": 0.15, "module_cards": 0.25, "real_code": 0.40, "task_history": 0.15, "reserve": 0.05}
#: Parts of the paths that assembly plays down to a tenth, and ends of hub files.
PLAYED_DOWN = ("/tests/", "/test_", "_test.", ".test.", "_spec.", ".spec.", "/examples/", "/benchmark", "benchmark.", "/benches/", "eval_")
HUB_ENDS = ("/lib.rs", "/mod.rs", "/main.rs")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def adaptive_budget(files: Column) -> Column:
    """500 tokens times the root of the number of files, between 4,000 and 32,000."""
    return F.greatest(F.lit(4000), F.least(F.lit(32000), F.floor(500.0 * F.sqrt(files)))).cast("long")


def budget_split(total: Column) -> Column:
    """Struct of the five shares of a budget, each rounded down."""
    return F.struct(*[F.floor(total * share).cast("long").alias(name) for name, share in SHARES.items()])


def task_split(total: Column) -> Column:
    """Struct: 15 % overhead, 25 % execution, the rest for structure."""
    overhead, execution = F.floor(total * 0.15).cast("long"), F.floor(total * 0.25).cast("long")
    return F.struct(overhead.alias("task_overhead"), execution.alias("execution_context"), (total - overhead - execution).cast("long").alias("structural"))


def block_priority(score: Column, feedback: Column, assembled: Column, positive: Column) -> Column:
    """A block's score raised by feedback, lowered for repeats to half at least, with a fading bonus after a positive signal."""
    repeats = F.greatest(1.0 - 0.1 * assembled, F.lit(0.5))
    bonus = F.when(positive, 0.15 * F.pow(F.lit(0.7), F.least(assembled, F.lit(10)))).otherwise(0.0)
    return score * (1.0 + feedback) * repeats + bonus


def fusion_weights(*weights: Column, default: tuple[float, ...] = (0.55, 0.30, 0.05, 0.10)) -> Column:
    """Weights scaled to a sum of 1; the default if they add up to 0."""
    total = sum(weights[1:], weights[0])
    return F.array(*[F.when(total == 0, d).otherwise(w / total) for w, d in zip(weights, default, strict=True)])


def retry_delay(attempt: Column, base_ms: int = 1000, most_ms: int = 30000, jitter: Column | None = None) -> Column:
    """base times 2^attempt milliseconds, at most ``most_ms``, times a jitter below 1."""
    delay = F.least(base_ms * F.pow(F.lit(2.0), F.least(attempt, F.lit(63))), F.lit(float(most_ms)))
    return F.floor(delay if jitter is None else delay * jitter).cast("long")


def recency(age_ms: Column) -> Column:
    """Halves every 24 hours; 1 for what is not past."""
    return F.pow(F.lit(2.0), -F.greatest(age_ms, F.lit(0)) / (24 * 3600 * 1000.0))


def rank_episodes(episodes: DataFrame, query: str, now_ms: Column) -> DataFrame:
    """``episodes(text, created_at_ms, ...)`` that share a word with the query, with their score: .6 shared words, .4 recency."""
    asked = F.array_distinct(keywords(F.lit(query)))
    hits = F.size(F.array_intersect(asked, keywords(C("text"))))
    score = 0.6 * hits / F.size(asked) + 0.4 * recency(now_ms - C("created_at_ms"))
    return episodes.withColumn("score", score).where(hits > 0)


def assembly_penalty(path: Column) -> Column:
    """A tenth for tests, examples, benchmarks and evaluations, 1 for other files."""
    low = F.lower(path)
    return F.when(holds_any(low, PLAYED_DOWN) | low.startswith("tests/"), 0.1).otherwise(1.0)


def is_hub_file(path: Column) -> Column:
    found = F.lit(False)
    for end in HUB_ENDS:
        found = found | path.endswith(end)
    return found


def without_ghosts(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates whose path is a file of the graph."""
    return candidates.join(files.select("path"), "path", "left_semi")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, doc_id, a, b): the scores of two rankers side by side, 0 where one has none."""
    a, b = (d.select("query_id", "doc_id", C("score").alias(n)) for d, n in ((first, "a"), (second, "b")))
    return a.join(b, ["query_id", "doc_id"], "full_outer").fillna(0.0, ["a", "b"])


def community_scores(scores: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, community, best, total): the greatest and the sum of the scores of a community's files."""
    placed = scores.join(members.select("doc_id", "community"), "doc_id")
    return placed.groupBy("query_id", "community").agg(F.max("score").alias("best"), F.sum("score").alias("total"))


def reverse_boost(scores: DataFrame, calls: DataFrame, seeds: int = 3, each: float = 0.20, most: float = 0.60) -> DataFrame:
    """(query_id, path, score): files that call functions of a query's best files rise by 0.2 a call, 0.6 at most.

    ``calls(path, caller)`` has a row for each call of a function of ``path``; hubs and the seed itself do not rise.
    """
    best = scores.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))).where(C("_n") <= seeds)
    risen = best.join(calls, "path").where((C("caller") != C("path")) & ~is_hub_file(C("caller"))).groupBy("query_id", C("caller").alias("path")).agg(F.least(F.count("*") * each, F.lit(most)).alias("score"))
    return scores.select("query_id", "path", "score").union(risen).groupBy("query_id", "path").agg(F.sum("score").alias("score"))


def symbol_scores(symbols: DataFrame, query: str, in_degree: DataFrame) -> DataFrame:
    """(path, symbol, score), the best symbol of each file: 2 for a word that is its name, 1 for one within it, 0.1 for each of up to 5 callers."""
    words = [w for w in query.lower().split() if w]
    name, hits = F.lower("symbol"), F.lit(0.0)
    for w in words:
        hits = hits + F.when(name == w, 2.0).when(F.contains(name, F.lit(w)), 1.0).otherwise(0.0)
    scored = symbols.where(C("path") != "").withColumn("_hits", hits).where(C("_hits") > 0).join(in_degree, "symbol", "left")
    scored = scored.withColumn("score", C("_hits") + 0.1 * F.least(F.coalesce("callers", F.lit(0)), F.lit(5)))
    return scored.groupBy("path").agg(F.max_by("symbol", F.struct("score", "symbol")).alias("symbol"), F.max("score").alias("score"))


def token_metrics(usage: DataFrame, *by: str) -> DataFrame:
    """Sums of ``usage(input, output, cache_read, cache_write, reasoning, edits)``, the cache's share, tokens for each successful edit."""
    kinds = ("input", "output", "cache_read", "cache_write", "reasoning")
    g = usage.groupBy(*by).agg(*[F.sum(k).alias(k) for k in (*kinds, "edits")])
    total = sum((C(k) for k in kinds[1:]), C(kinds[0]))
    return g.withColumn("cache_hit_rate", safe_ratio(C("cache_read"), C("input") + C("cache_read"))).withColumn("tokens_per_edit", safe_ratio(total, C("edits")))


def causal_usefulness(links: DataFrame) -> DataFrame:
    """(community, usefulness): the share of assemblies that were used."""
    return links.groupBy("community").agg(F.avg((C("outcome") == "Used").cast("double")).alias("usefulness"))


def failure_constraints(errors: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, pattern, seen): messages of a run that came back ``least`` times, in lower case without positions."""
    g = errors.groupBy("run_id", F.lower(normalize_error(C("message"))).alias("pattern")).agg(F.count("*").alias("seen"))
    return g.where(C("seen") >= least)


def retention(constraints: DataFrame) -> DataFrame:
    """(run_id, ttl, kind) by the widest scope of a run's constraints."""
    g = constraints.groupBy("run_id").agg(F.bool_or(C("scope") == "workspace-local").alias("w"), F.bool_or(C("scope") == "task-local").alias("t"))
    ttl = F.when(C("w"), "Permanent").when(C("t"), "TimeScoped").otherwise("RunScoped")
    kind = F.when(C("w"), "Canonical").when(C("t"), "Reusable").otherwise("Episodic")
    return g.select("run_id", ttl.alias("ttl"), kind.alias("kind"))


def open_hypotheses(formed: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Hypotheses whose event no later event takes back."""
    return formed.join(invalidated.select(C("prior_event_id").alias("event_id")), "event_id", "left_anti")


def consolidation_gate(exists: Column, locked: Column, cooled: Column, files: Column, least: int = 5) -> Column:
    return F.when(~exists, "no_memory_dir").when(locked, "lock_held").when(~cooled, "cooldown").when(files < least, "insufficient_files").otherwise("go")


def promotion(communities: Column, workspace: Column) -> Column:
    """Whether an episode outlives its run: its constraints hold for the workspace, or a tool used one of its communities."""
    return F.when(workspace | (F.size(communities) > 0), "promoted").otherwise("evicted")


def health(used: Column, limit: Column) -> Column:
    """Struct (share, warns): above 80 % of a limit a store warns."""
    share = F.when(limit > 0, used / limit).otherwise(0.0)
    return F.struct(share.alias("share"), (share > 0.8).alias("warns"))


def scenario_report(results: DataFrame) -> DataFrame:
    """(category, total, passed, iterations, score): 40 for the pass rate, and up to 10 for few iterations."""
    g = results.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.sum("iterations").alias("iterations"))
    mean = C("iterations") / C("total")
    bonus = F.when(mean > 0, F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 * (1 - (mean - 5) / 15)))).otherwise(0.0)
    return g.withColumn("score", 40 * C("passed") / C("total") + bonus)


def seed_folder(node: Column) -> Column:
    """The folder that names a node's group: that below crates, apps or src, else the first telling one."""
    path = F.regexp_replace(F.substring_index(node, "::", 1), "^(?:file:|sym:|test:|import:|type:)+", "")
    parts = F.split(path, "/")
    telling = F.filter(parts, lambda p: ~p.isin("src", "lib", ".", "") & ~F.contains(p, F.lit(".")))
    below = F.get(parts, F.lit(0)).isin("crates", "apps", "src")
    return F.when(F.size(parts) < 2, "root").when(below, F.get(parts, F.lit(1))).otherwise(F.coalesce(F.get(telling, F.lit(0)), F.get(parts, F.lit(0))))


def source_ranges(symbols: DataFrame) -> DataFrame:
    """Symbols of which file, first and last line are all known."""
    return symbols.where("path is not null and line_start is not null and line_end is not null")
