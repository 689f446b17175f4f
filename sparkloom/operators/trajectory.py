"""Trajectory analytics over a frame of steps.

Steps: run_id, sequence, event_type, timestamp (ms), entity_id,
payload_summary, duration_ms, tool_name, outcome (Success, Failure, Timeout,
Skipped or null) and retryable.  Order within a run is (timestamp, sequence).
All windows are per run, so runs spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col
#: Tools that change a file.
EDIT_TOOLS = ("edit_file", "write_file")
#: Tool pairs that belong together and reset the loop detector.
EXPECTED_PAIRS = (("write_file", "read_file"), ("edit_file", "bash"), ("edit_file", "read_file"), ("bash", "read_file"), ("grep", "read_file"))


def in_run():
    """The window of a run in time order."""
    return Window.partitionBy("run_id").orderBy("timestamp", "sequence")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def completed() -> Column:
    return C("event_type") == "ToolCallCompleted"


def is_edit() -> Column:
    return F.coalesce(C("tool_name").isin(*EDIT_TOOLS), F.lit(False))


def read_envelopes(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of JSON to envelopes; a bad line keeps its text in ``corrupt``."""
    shape = "v int, seq bigint, ts bigint, run_id string, kind string, event_type string, event_kind string, entity_id string, payload string, dropped_since_last bigint, corrupt string"
    parsed = lines.select(F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("e"))
    return parsed.select("e.*")


def project(envelopes: DataFrame) -> DataFrame:
    """Steps of event envelopes; a call lasts from its first start since the last completion."""
    events = envelopes.where((C("kind") == "event") & C("corrupt").isNull())
    tool = F.coalesce(F.get_json_object("payload", "$.tool_name"), F.get_json_object("payload", "$.tool"))
    status = F.lower(F.coalesce(F.get_json_object("payload", "$.status"), F.get_json_object("payload", "$.outcome")))
    outcome = F.when(C("event_type") != "ToolCallCompleted", None).when(F.get_json_object("payload", "$.success") == "false", "Failure").when(status.contains("timeout"), "Timeout").when(status.contains("skip"), "Skipped").when(status.contains("fail"), "Failure").otherwise("Success")
    steps = events.select("run_id", C("seq").alias("sequence"), "event_type", "event_kind", C("ts").alias("timestamp"), F.coalesce("entity_id", F.lit("")).alias("entity_id"), F.substring("payload", 1, 500).alias("payload_summary"), tool.alias("tool_name"), outcome.alias("outcome"), (F.get_json_object("payload", "$.retryable") == "true").alias("retryable"))
    return pair_durations(steps)


def pair_durations(steps: DataFrame) -> DataFrame:
    by_entity = Window.partitionBy("run_id", "entity_id").orderBy("timestamp", "sequence")
    turn = F.coalesce(F.sum(completed().cast("int")).over(by_entity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = F.when(C("event_type").isin("ToolCallQueued", "ToolCallDispatched"), C("timestamp"))
    first = F.min(started).over(Window.partitionBy("run_id", "entity_id", "_turn"))
    out = steps.withColumn("_turn", turn).withColumn("_start", first)
    return out.withColumn("duration_ms", F.when(completed(), F.greatest(C("timestamp") - C("_start"), F.lit(0)))).drop("_turn", "_start")


def integrity(envelopes: DataFrame) -> DataFrame:
    """run_id, expected, received, confidence."""
    g = envelopes.groupBy("run_id").agg((F.max("seq") + 1).alias("expected"), F.count("*").alias("received"))
    return g.withColumn("confidence", F.least(F.lit(1.0), ratio(C("received"), C("expected"))))


def missing_ranges(envelopes: DataFrame) -> DataFrame:
    """Half-open gaps of the sequence numbers, a leading gap included."""
    before = F.lag("seq", 1, -1).over(Window.partitionBy("run_id").orderBy("seq"))
    gaps = envelopes.select("run_id", "seq").distinct().withColumn("before", before)
    return gaps.where(C("seq") > C("before") + 1).select("run_id", (C("before") + 1).alias("gap_start"), C("seq").alias("gap_end"))


def tool_breakdown(steps: DataFrame, *by: str) -> DataFrame:
    calls = steps.where(completed() & C("tool_name").isNotNull())
    good, bad = C("outcome") == "Success", C("outcome").isin("Failure", "Timeout", "Skipped")
    g = calls.groupBy(*by, "tool_name").agg(
        F.count("*").alias("call_count"),
        F.count_if(good).alias("success_count"),
        F.count_if(bad).alias("failure_count"),
        F.count_if((C("outcome") == "Failure") & C("retryable")).alias("retry_count"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_latency_ms"),
    )
    return g.withColumn("success_rate", ratio(C("success_count"), C("call_count")))


def doom_loop_frequency(steps: DataFrame, window: int = 10) -> DataFrame:
    """Share of calls that repeat one of the ``window - 1`` calls before them."""
    calls = steps.where(completed() & C("tool_name").isNotNull()).withColumn("_n", F.row_number().over(in_run()))
    same = Window.partitionBy("run_id", "tool_name", "payload_summary").orderBy("_n")
    again = F.coalesce(C("_n") - F.lag("_n").over(same) <= window - 1, F.lit(False))
    g = calls.withColumn("_again", again).groupBy("run_id").agg(F.count_if("_again").alias("numerator"), F.count("*").alias("denominator"))
    return g.withColumn("value", ratio(C("numerator"), C("denominator")))


def loop_verdicts(calls: DataFrame) -> DataFrame:
    """Consecutive identical calls: Ok, Warning (2), Correct (3, 4), HardStop (5 and up)."""
    before = F.lag("tool_name").over(in_run())
    pair = F.concat_ws(">", before, "tool_name").isin(*[f"{a}>{b}" for a, b in EXPECTED_PAIRS])
    print_ = F.struct("tool_name", "payload_summary")
    c = calls.withColumn("_white", F.coalesce(pair, F.lit(False)))
    fresh = C("_white") | F.coalesce(F.lag("_white").over(in_run()), F.lit(True)) | ~print_.eqNullSafe(F.lag(print_).over(in_run()))
    c = c.withColumn("_island", F.sum(fresh.cast("int")).over(in_run().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("run_id", "_island").orderBy("timestamp", "sequence"))
    c = c.withColumn("consecutive", F.when(C("_white"), 0).otherwise(n))
    verdict = F.when(C("consecutive") <= 1, "Ok").when(C("consecutive") == 2, "Warning").when(C("consecutive") <= 4, "Correct").otherwise("HardStop")
    return c.withColumn("verdict", verdict).drop("_white", "_island")


def doom_tracker(calls: DataFrame, n: int = 3) -> DataFrame:
    """``hit``: the last n calls are equal; ``abort``: the call before was a hit too."""
    recent = in_run().rowsBetween(-(n - 1), 0)
    key = F.concat_ws("|", "tool_name", "payload_summary")
    hit = (F.count("*").over(recent) == n) & (F.min(key).over(recent) == F.max(key).over(recent))
    c = calls.withColumn("hit", hit)
    return c.withColumn("abort", C("hit") & F.coalesce(F.lag("hit").over(in_run()), F.lit(False)))


def weak_verification(steps: DataFrame, within: int = 3) -> DataFrame:
    """Runs with a successful edit that nothing verifies in the next steps."""
    verifies = F.coalesce(C("tool_name") == "bash", F.lit(False)) | (C("event_type") == "SensorExecuted")
    seen = F.coalesce(F.max(verifies.cast("int")).over(in_run().rowsBetween(1, within)), F.lit(0))
    weak = completed() & is_edit() & (C("outcome") == "Success") & (C("_seen") == 0)
    return steps.withColumn("_seen", seen).groupBy("run_id").agg(F.coalesce(F.bool_or(weak), F.lit(False)).alias("weak_verification"))


def task_derailment(steps: DataFrame, mentions: Column, limit: int = 5) -> DataFrame:
    """``limit`` calls in a row without a context file, before any overflow recovery."""
    overflow = C("event_type") == "ContextOverflowRecovery"
    upto = in_run().rowsBetween(Window.unboundedPreceding, 0)
    s = steps.where(overflow | completed()).withColumn("_m", F.coalesce(mentions, F.lit(False)))
    s = s.withColumn("_over", F.max(overflow.cast("int")).over(upto)).withColumn("_island", F.sum((overflow | C("_m")).cast("int")).over(upto))
    miss = (~overflow & ~C("_m")).cast("int")
    s = s.withColumn("_run", F.sum(miss).over(Window.partitionBy("run_id", "_island").orderBy("timestamp", "sequence").rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("run_id").agg(F.bool_or((miss == 1) & (C("_run") >= limit) & (C("_over") == 0)).alias("task_derailment"))


def history_loss(steps: DataFrame, hot: Column, within: int = 3) -> DataFrame:
    """A hot file is read again within a few steps of an overflow recovery."""
    after = F.max((C("event_type") == "ContextOverflowRecovery").cast("int")).over(in_run().rowsBetween(-within, -1))
    lost = completed() & (C("tool_name") == "read_file") & hot & (C("_after") == 1)
    return steps.withColumn("_after", after).groupBy("run_id").agg(F.coalesce(F.bool_or(lost), F.lit(False)).alias("history_loss"))


def premature_termination(steps: DataFrame) -> DataFrame:
    done = F.bool_or((C("event_type") == "RunStateChanged") & F.lower("payload_summary").contains("converged"))
    edits = F.count_if(completed() & is_edit() & (C("outcome") == "Success"))
    calls = F.count_if(C("event_type") == "LlmCallStart")
    spent = F.bool_or(C("event_type") == "BudgetExceeded")
    return steps.groupBy("run_id").agg((F.coalesce(done, F.lit(False)) & (edits == 0) & (calls >= 2) & ~spent).alias("premature_termination"))


def derived_metrics(steps: DataFrame, confidence: Column | None = None) -> DataFrame:
    """The metric bundle of each run, scaled by the confidence of its integrity."""
    count = lambda t: F.count_if(C("event_type") == t)
    ok_tool = F.when(completed() & (C("outcome") == "Success"), C("tool_name"))
    at = lambda t: F.min(F.when(C("event_type") == t, C("timestamp")))
    g = steps.groupBy("run_id").agg(
        F.count_distinct(ok_tool).alias("_ok"),
        count("LlmCallStart").alias("_llm"),
        count("ContextOverflowRecovery").alias("_over"),
        count("HypothesisFormed").alias("_formed"),
        count("HypothesisInvalidated").alias("_gone"),
        at("RunInitialized").alias("_init"),
        at("ToolCallDispatched").alias("_first"),
        F.max("timestamp").alias("_last"),
    )
    trust = F.lit(1.0) if confidence is None else confidence
    return g.select(
        "run_id",
        (ratio(C("_ok"), C("_llm")) * trust).alias("llm_efficiency"),
        (ratio(C("_over"), C("_llm")) * trust).alias("context_waste_ratio"),
        (ratio(C("_gone"), C("_formed")) * trust).alias("hypothesis_churn_rate"),
        F.coalesce(F.greatest(F.coalesce("_first", "_last") - C("_init"), F.lit(0)).cast("double") * trust, F.lit(0.0)).alias("time_to_first_tool"),
    )


def phase_distribution(steps: DataFrame, converged: Column) -> DataFrame:
    """One row for each run and phase, empty phases kept."""
    g = steps.groupBy("run_id").agg(
        F.count_if(C("event_type") == "LlmCallStart").alias("total"),
        F.count_if(C("event_type") == "RetrievalExecuted").alias("Explore"),
        F.count_if(completed() & C("tool_name").isin("edit_file", "write_file")).alias("Edit"),
        F.count_if(C("event_type") == "SensorExecuted").alias("Verify"),
        F.max(converged.cast("int")).cast("long").alias("Done"),
    )
    long = g.unpivot(["run_id", "total"], ["Explore", "Edit", "Verify", "Done"], "phase", "iterations")
    return long.withColumn("pct", C("iterations") / F.greatest("total", F.lit(1)))


def payload_number(key: str) -> Column:
    """A number scanned from a summary that may be cut JSON."""
    digits = F.regexp_extract("payload_summary", rf'"{key}"\s*:\s*(\d+)', 1)
    return F.when(digits != "", digits.cast("long"))


def context_health(steps: DataFrame) -> DataFrame:
    size = F.when(C("event_type") == "LlmCallEnd", payload_number("context_tokens"))
    s = steps.withColumn("_size", size).withColumn("_at", F.struct("timestamp", "sequence"))
    held = F.when(C("_size").isNotNull(), C("_at"))
    before, after = payload_number("tokens_before"), payload_number("tokens_after")
    saved = F.when((C("event_type") == "ContextOverflowRecovery") & (before > 0), 1.0 - after / before)
    n = F.count("_size")
    growth = F.when(n >= 2, (F.max_by("_size", held) - F.min_by("_size", held)) / n).otherwise(0.0)
    return s.groupBy("run_id").agg(
        F.coalesce(F.avg("_size"), F.lit(0.0)).alias("avg_context_tokens"),
        F.coalesce(F.max("_size"), F.lit(0)).alias("max_context_tokens"),
        growth.alias("growth_rate"),
        F.count_if(C("event_type") == "ContextOverflowRecovery").alias("compactions"),
        F.coalesce(F.avg(saved), F.lit(0.0)).alias("savings_ratio"),
    )


def error_class() -> Column:
    """The first class whose words the error holds."""
    p = F.lower("payload_summary")
    has = lambda *w: p.rlike("|".join(w))
    return (
        F.when(C("event_type") == "BudgetExceeded", "budget")
        .when(has("failure_mode"), "failure_mode")
        .when(has("network", "timeout", "connection"), "network")
        .when(has("sandbox", "seccomp", "landlock"), "sandbox")
        .when(has("invalid", "validation", "schema"), "validation")
        .when(has("tool"), "tool")
        .when(has("llm", "api", "rate"), "llm")
        .otherwise("other")
    )


def error_taxonomy(steps: DataFrame, *by: str) -> DataFrame:
    return steps.where(C("event_type").isin("Error", "BudgetExceeded")).groupBy(*by, error_class().alias("error_class")).agg(F.count("*").alias("errors"))


def memory_metrics(steps: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(C("event_type") == t)
    g = steps.groupBy("run_id").agg(count("HypothesisFormed").alias("formed"), count("HypothesisInvalidated").alias("invalidated"), count("ConstraintLearned").alias("constraints_learned"))
    return g.withColumn("active", F.greatest(C("formed") - C("invalidated"), F.lit(0)))


def subagent_metrics(steps: DataFrame, tools: tuple[str, ...] = ("subagent", "subagent_parallel")) -> DataFrame:
    g = steps.where(completed() & C("tool_name").isin(*tools)).groupBy("run_id").agg(
        F.count("*").alias("spawned"),
        F.count_if(C("outcome") == "Success").alias("succeeded"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_duration_ms"),
    )
    return g.withColumn("failed", C("spawned") - C("succeeded")).withColumn("success_rate", ratio(C("succeeded"), C("spawned")))


def repetition_rates(calls: DataFrame) -> DataFrame:
    """Share of calls that repeat an earlier equal one: sum of (n - 1) over sum of n."""
    g = calls.groupBy("run_id", "tool_name", "payload_summary").agg(F.count("*").alias("n"))
    r = g.groupBy("run_id").agg(F.sum(C("n") - 1).alias("repeats"), F.sum("n").alias("calls"), F.count_if(C("n") > 1).alias("repeated_actions"))
    return r.withColumn("rate", ratio(C("repeats"), C("calls")))


def failure_constraints(failures: DataFrame, ring: int = 50, least: int = 3) -> DataFrame:
    """Failures seen ``least`` times among the newest ``ring`` of a run."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("timestamp"), F.desc("sequence"))
    kept = failures.withColumn("_n", F.row_number().over(newest)).where(C("_n") <= ring)
    return kept.groupBy("run_id", "payload_summary").agg(F.count("*").alias("seen")).where(C("seen") >= least)


def run_list(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.count("*").alias("steps"), F.count_if(completed()).alias("tool_calls"), F.count_if(C("event_type") == "Error").alias("errors"), F.count_if(C("event_type") == "LlmCallStart").alias("llm_calls"))


def compare_runs(runs: DataFrame, a: int, b: int) -> DataFrame:
    """The run list's numbers of two runs side by side, with their difference."""
    long = runs.withColumn("duration", C("ended") - C("started")).unpivot(["run_id"], ["duration", "steps", "tool_calls", "errors", "llm_calls"], "metric", "value")
    g = long.where(C("run_id").isin(a, b)).groupBy("metric").agg(F.max(F.when(C("run_id") == a, C("value"))).alias("a"), F.max(F.when(C("run_id") == b, C("value"))).alias("b"))
    return g.withColumn("difference", C("b") - C("a"))


def fleet_stats(runs: DataFrame) -> DataFrame:
    """Averages over the runs that have the thing at all."""
    over = lambda c: F.coalesce(F.avg(F.when(C(c) > 0, C(c))), F.lit(0.0))
    return runs.agg(F.count("*").alias("runs"), F.sum("tool_calls").alias("tool_calls"), F.sum("errors").alias("errors"), over("llm_calls").alias("avg_llm_calls"), over("errors").alias("avg_errors"), F.avg(C("ended") - C("started")).alias("avg_duration_ms"))
