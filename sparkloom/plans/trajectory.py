"""Trajectory queries; the events table plays the runs of an agent.

A user is a run; clicks, views and purchases are the tools read_file,
edit_file and bash, a sign-up is a model call, an error an error.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import trajectory as tr
from sparkloom.plans.catalog import register
from sparkloom.runtime import table

C = F.col

STEPS_SQL = """
WITH steps AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence,
    (epoch_us(ts) // 1000) AS timestamp, k, value, event_id,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'ContextOverflowRecovery' WHEN k % 4 = 1 THEN 'LlmCallEnd' ELSE 'LlmCallStart' END ELSE 'ToolCallCompleted' END AS event_type,
    CASE event_type WHEN 'click' THEN 'read_file' WHEN 'view' THEN 'edit_file' WHEN 'purchase' THEN 'bash' END AS tool_name,
    CASE WHEN event_type IN ('error', 'signup') THEN NULL WHEN value < 3 THEN 'Failure' ELSE 'Success' END AS outcome,
    k % 2 = 0 AS retryable, round(value * 100)::BIGINT AS duration_ms,
    CASE event_type WHEN 'error' THEN CASE k % 5 WHEN 0 THEN 'network down' WHEN 1 THEN 'invalid schema' WHEN 2 THEN 'tool broke' WHEN 3 THEN 'API rate' ELSE 'odd ' || (k % 3) END
      WHEN 'signup' THEN '{"context_tokens": ' || k * 10 || ', "tokens_before": ' || k * 20 || ', "tokens_after": ' || k * 5
      ELSE 'file' || (k % 4) END AS payload_summary
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""


def steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind, k = C("event_type"), C("k")
    called = F.when(k % 4 == 0, "ContextOverflowRecovery").when(k % 4 == 1, "LlmCallEnd").otherwise("LlmCallStart")
    failed = F.when(k % 5 == 0, "network down").when(k % 5 == 1, "invalid schema").when(k % 5 == 2, "tool broke").when(k % 5 == 3, "API rate").otherwise(F.concat(F.lit("odd "), k % 3))
    sized = F.concat(F.lit('{"context_tokens": '), k * 10, F.lit(', "tokens_before": '), k * 20, F.lit(', "tokens_after": '), k * 5)
    return e.select(
        C("user_id").alias("run_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("sequence"),
        F.unix_millis(C("ts").cast("timestamp")).alias("timestamp"),
        "k",
        "value",
        "event_id",
        F.when(kind == "error", "Error").when(kind == "signup", called).otherwise("ToolCallCompleted").alias("event_type"),
        F.when(kind == "click", "read_file").when(kind == "view", "edit_file").when(kind == "purchase", "bash").alias("tool_name"),
        F.when(kind.isin("error", "signup"), None).when(C("value") < 3, "Failure").otherwise("Success").alias("outcome"),
        (k % 2 == 0).alias("retryable"),
        F.round(C("value") * 100).cast("long").alias("duration_ms"),
        F.when(kind == "error", failed).when(kind == "signup", sized).otherwise(F.concat(F.lit("file"), k % 4)).alias("payload_summary"),
    )


def calls(spark, sf_dir):
    return steps(spark, sf_dir).where(tr.completed())


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("trajectory_tool_breakdown", STEPS_SQL + """
SELECT run_id, tool_name, count(*) AS call_count, count(*) FILTER (outcome = 'Success') AS success_count, count(*) FILTER (outcome = 'Failure') AS failure_count,
  count(*) FILTER (outcome = 'Failure' AND retryable) AS retry_count, round(avg(duration_ms), 6) AS avg_latency_ms, max(duration_ms) AS max_latency_ms,
  round(count(*) FILTER (outcome = 'Success') / count(*), 6) AS success_rate
FROM steps WHERE event_type = 'ToolCallCompleted' GROUP BY ALL""")
def tool_breakdown(spark, sf_dir):
    return _r(tr.tool_breakdown(steps(spark, sf_dir), "run_id"), "avg_latency_ms", "success_rate")


@register("trajectory_integrity", """
SELECT user_id AS run_id, max(event_id) + 1 AS expected, count(*) AS received, round(least(1.0, count(*) / (max(event_id) + 1)), 9) AS confidence FROM events GROUP BY 1""")
def integrity(spark, sf_dir):
    return _envelopes(spark, sf_dir).transform(tr.integrity).withColumn("confidence", F.round("confidence", 9))


def _envelopes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(C("user_id").alias("run_id"), C("event_id").alias("seq"))


@register("trajectory_missing_ranges", """
SELECT run_id, before + 1 AS gap_start, seq AS gap_end FROM
  (SELECT user_id AS run_id, event_id AS seq, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE seq > before + 1""")
def missing_ranges(spark, sf_dir):
    return tr.missing_ranges(_envelopes(spark, sf_dir))


@register("trajectory_doom_loop", STEPS_SQL + """,
c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp, sequence) AS n FROM steps WHERE event_type = 'ToolCallCompleted'),
r AS (SELECT a.run_id, a.n, EXISTS (SELECT 1 FROM c b WHERE b.run_id = a.run_id AND b.tool_name = a.tool_name AND b.payload_summary = a.payload_summary AND b.n < a.n AND b.n >= a.n - 9) AS again FROM c a)
SELECT run_id, count(*) FILTER (again) AS numerator, count(*) AS denominator, round(count(*) FILTER (again) / count(*), 6) AS value FROM r GROUP BY 1""")
def doom_loop(spark, sf_dir):
    return _r(tr.doom_loop_frequency(steps(spark, sf_dir)), "value")


@register("trajectory_loop_verdicts", STEPS_SQL + """,
c AS (SELECT *, coalesce((lag(tool_name) OVER w, tool_name) IN (('write_file', 'read_file'), ('edit_file', 'bash'), ('edit_file', 'read_file'), ('bash', 'read_file'), ('grep', 'read_file')), false) AS white,
  tool_name || '|' || payload_summary AS fp FROM steps WHERE event_type = 'ToolCallCompleted' WINDOW w AS (PARTITION BY run_id ORDER BY timestamp, sequence)),
d AS (SELECT *, CASE WHEN white OR coalesce(lag(white) OVER w, true) OR fp IS DISTINCT FROM lag(fp) OVER w THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY run_id ORDER BY timestamp, sequence)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY timestamp, sequence ROWS UNBOUNDED PRECEDING) AS island FROM d),
f AS (SELECT *, CASE WHEN white THEN 0 ELSE row_number() OVER (PARTITION BY run_id, island ORDER BY timestamp, sequence) END AS consecutive FROM e)
SELECT run_id, sequence, consecutive::INTEGER AS consecutive, CASE WHEN consecutive <= 1 THEN 'Ok' WHEN consecutive = 2 THEN 'Warning' WHEN consecutive <= 4 THEN 'Correct' ELSE 'HardStop' END AS verdict FROM f""")
def loop_verdicts(spark, sf_dir):
    return tr.loop_verdicts(calls(spark, sf_dir)).select("run_id", "sequence", "consecutive", "verdict")


@register("trajectory_doom_tracker", STEPS_SQL + """,
c AS (SELECT *, tool_name || '|' || payload_summary AS fp FROM steps WHERE event_type = 'ToolCallCompleted'),
d AS (SELECT *, coalesce(fp = lag(fp) OVER w AND fp = lag(fp, 2) OVER w, false) AS hit FROM c WINDOW w AS (PARTITION BY run_id ORDER BY timestamp, sequence))
SELECT run_id, sequence, hit, hit AND coalesce(lag(hit) OVER (PARTITION BY run_id ORDER BY timestamp, sequence), false) AS abort FROM d""")
def doom_tracker(spark, sf_dir):
    return tr.doom_tracker(calls(spark, sf_dir)).select("run_id", "sequence", "hit", "abort")


@register("trajectory_weak_verification", STEPS_SQL + """,
v AS (SELECT *, max(CASE WHEN tool_name = 'bash' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY timestamp, sequence ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS seen FROM steps)
SELECT run_id, coalesce(bool_or(tool_name = 'edit_file' AND outcome = 'Success' AND coalesce(seen, 0) = 0), false) AS weak_verification FROM v GROUP BY 1""")
def weak_verification(spark, sf_dir):
    return tr.weak_verification(steps(spark, sf_dir))


@register("trajectory_task_derailment", STEPS_SQL + """,
s AS (SELECT *, event_type = 'ContextOverflowRecovery' AS over_, event_type = 'ToolCallCompleted' AND payload_summary LIKE '%file0%' AS m FROM steps WHERE event_type IN ('ContextOverflowRecovery', 'ToolCallCompleted')),
i AS (SELECT *, max(over_::INT) OVER w AS had, sum((over_ OR m)::INT) OVER w AS island FROM s WINDOW w AS (PARTITION BY run_id ORDER BY timestamp, sequence ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, sum((NOT over_ AND NOT m)::INT) OVER (PARTITION BY run_id, island ORDER BY timestamp, sequence ROWS UNBOUNDED PRECEDING) AS r FROM i)
SELECT run_id, bool_or(NOT over_ AND NOT m AND r >= 5 AND had = 0) AS task_derailment FROM n GROUP BY 1""")
def task_derailment(spark, sf_dir):
    return tr.task_derailment(steps(spark, sf_dir), tr.completed() & C("payload_summary").contains("file0"))


@register("trajectory_history_loss", STEPS_SQL + """,
a AS (SELECT *, max((event_type = 'ContextOverflowRecovery')::INT) OVER (PARTITION BY run_id ORDER BY timestamp, sequence ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS aft FROM steps)
SELECT run_id, coalesce(bool_or(tool_name = 'read_file' AND payload_summary LIKE '%file1%' AND aft = 1), false) AS history_loss FROM a GROUP BY 1""")
def history_loss(spark, sf_dir):
    return tr.history_loss(steps(spark, sf_dir), C("payload_summary").contains("file1"))


_STATES = """, s2 AS (SELECT run_id, CASE WHEN event_type = 'Error' AND k % 5 = 0 THEN 'RunStateChanged' WHEN event_type = 'Error' AND k % 17 = 1 THEN 'BudgetExceeded' ELSE event_type END AS event_type,
  CASE WHEN event_type = 'Error' AND k % 5 = 0 THEN 'now Converged' ELSE payload_summary END AS payload_summary, CASE WHEN tool_name = 'edit_file' AND run_id % 3 <> 0 THEN 'apply_patch' ELSE tool_name END AS tool_name, outcome, timestamp, sequence FROM steps)"""


def _states(spark, sf_dir):
    # A patch is no edit to the sensors, so these runs have none.
    patched = F.when((C("tool_name") == "edit_file") & (C("run_id") % 3 != 0), "apply_patch").otherwise(C("tool_name"))
    s = steps(spark, sf_dir).withColumn("tool_name", patched)
    error = C("event_type") == "Error"
    done = error & (C("k") % 5 == 0)
    kind = F.when(done, "RunStateChanged").when(error & (C("k") % 17 == 1), "BudgetExceeded").otherwise(C("event_type"))
    return s.withColumns({"payload_summary": F.when(done, "now Converged").otherwise(C("payload_summary")), "event_type": kind})


@register("trajectory_premature_termination", STEPS_SQL + _STATES + """
SELECT run_id, coalesce(bool_or(event_type = 'RunStateChanged' AND lower(payload_summary) LIKE '%converged%'), false) AND count(*) FILTER (tool_name = 'edit_file' AND outcome = 'Success') = 0
  AND count(*) FILTER (event_type = 'LlmCallStart') >= 2 AND NOT bool_or(event_type = 'BudgetExceeded') AS premature_termination FROM s2 GROUP BY 1""")
def premature_termination(spark, sf_dir):
    return tr.premature_termination(_states(spark, sf_dir))


@register("trajectory_error_taxonomy", STEPS_SQL + _STATES + """
SELECT run_id, CASE WHEN event_type = 'BudgetExceeded' THEN 'budget' WHEN p LIKE '%network%' THEN 'network' WHEN p LIKE '%invalid%' THEN 'validation' WHEN p LIKE '%tool%' THEN 'tool' WHEN p LIKE '%api%' THEN 'llm' ELSE 'other' END AS error_class, count(*) AS errors
FROM (SELECT *, lower(payload_summary) AS p FROM s2) WHERE event_type IN ('Error', 'BudgetExceeded') GROUP BY ALL""")
def error_taxonomy(spark, sf_dir):
    return tr.error_taxonomy(_states(spark, sf_dir), "run_id")


_MEMORY = """, m AS (SELECT run_id, timestamp, sequence, tool_name, outcome, CASE WHEN event_type = 'Error' THEN CASE k % 3 WHEN 0 THEN 'HypothesisFormed' WHEN 1 THEN 'HypothesisInvalidated' ELSE 'ConstraintLearned' END
  WHEN tool_name = 'bash' AND k % 7 = 0 THEN 'ToolCallDispatched' WHEN tool_name = 'bash' AND k % 7 = 1 THEN 'RunInitialized' ELSE event_type END AS event_type FROM steps)"""


def _memory(spark, sf_dir):
    k, bash = C("k"), F.coalesce(C("tool_name") == "bash", F.lit(False))
    kind = F.when(C("event_type") == "Error", F.when(k % 3 == 0, "HypothesisFormed").when(k % 3 == 1, "HypothesisInvalidated").otherwise("ConstraintLearned"))
    kind = F.coalesce(kind, F.when(bash & (k % 7 == 0), "ToolCallDispatched").when(bash & (k % 7 == 1), "RunInitialized"), C("event_type"))
    return steps(spark, sf_dir).withColumn("event_type", kind)


@register("trajectory_derived_metrics", STEPS_SQL + _MEMORY + """,
g AS (SELECT run_id, count(DISTINCT CASE WHEN event_type = 'ToolCallCompleted' AND outcome = 'Success' THEN tool_name END) AS ok, count(*) FILTER (event_type = 'LlmCallStart') AS llm, count(*) FILTER (event_type = 'ContextOverflowRecovery') AS ov,
  count(*) FILTER (event_type = 'HypothesisFormed') AS f, count(*) FILTER (event_type = 'HypothesisInvalidated') AS i, min(CASE WHEN event_type = 'RunInitialized' THEN timestamp END) AS init,
  min(CASE WHEN event_type = 'ToolCallDispatched' THEN timestamp END) AS first, max(timestamp) AS last FROM m GROUP BY 1)
SELECT run_id, round(CASE WHEN llm > 0 THEN ok / llm ELSE 0 END * 0.5, 6) AS llm_efficiency, round(CASE WHEN llm > 0 THEN ov / llm ELSE 0 END * 0.5, 6) AS context_waste_ratio,
  round(CASE WHEN f > 0 THEN i / f ELSE 0 END * 0.5, 6) AS hypothesis_churn_rate, coalesce(greatest(coalesce(first, last) - init, 0)::DOUBLE * 0.5, 0) AS time_to_first_tool FROM g""")
def derived_metrics(spark, sf_dir):
    return _r(tr.derived_metrics(_memory(spark, sf_dir), F.lit(0.5)), "llm_efficiency", "context_waste_ratio", "hypothesis_churn_rate")


@register("trajectory_memory_metrics", STEPS_SQL + _MEMORY + """
SELECT run_id, count(*) FILTER (event_type = 'HypothesisFormed') AS formed, count(*) FILTER (event_type = 'HypothesisInvalidated') AS invalidated, count(*) FILTER (event_type = 'ConstraintLearned') AS constraints_learned,
  greatest(count(*) FILTER (event_type = 'HypothesisFormed') - count(*) FILTER (event_type = 'HypothesisInvalidated'), 0) AS active FROM m GROUP BY 1""")
def memory_metrics(spark, sf_dir):
    return tr.memory_metrics(_memory(spark, sf_dir))


@register("trajectory_subagents", STEPS_SQL + """
SELECT run_id, count(*) AS spawned, count(*) FILTER (outcome = 'Success') AS succeeded, count(*) FILTER (outcome <> 'Success') AS failed, round(avg(duration_ms), 6) AS avg_duration_ms, max(duration_ms) AS max_duration_ms,
  round(count(*) FILTER (outcome = 'Success') / count(*), 6) AS success_rate FROM steps WHERE tool_name = 'bash' GROUP BY 1""")
def subagents(spark, sf_dir):
    return _r(tr.subagent_metrics(steps(spark, sf_dir), ("bash",)), "avg_duration_ms", "success_rate")


@register("trajectory_phases", STEPS_SQL + """,
g AS (SELECT run_id, count(*) FILTER (event_type = 'LlmCallStart') AS total, 0 AS Explore, count(*) FILTER (tool_name = 'edit_file') AS Edit, 0 AS Verify, max((event_type = 'LlmCallEnd')::INT) AS Done FROM steps GROUP BY 1)
SELECT run_id, total, phase, iterations::BIGINT AS iterations, round(iterations / greatest(total, 1), 6) AS pct FROM (SELECT run_id, total, unnest(['Explore', 'Edit', 'Verify', 'Done']) AS phase, unnest([Explore, Edit, Verify, Done]) AS iterations FROM g)""")
def phases(spark, sf_dir):
    return _r(tr.phase_distribution(steps(spark, sf_dir), C("event_type") == "LlmCallEnd"), "pct")


@register("trajectory_context_health", STEPS_SQL + """,
z AS (SELECT *, CASE WHEN event_type = 'LlmCallEnd' THEN k * 10 END AS size FROM steps)
SELECT run_id, round(coalesce(avg(size), 0), 6) AS avg_context_tokens, coalesce(max(size), 0) AS max_context_tokens,
  round(CASE WHEN count(size) >= 2 THEN (arg_max(size, sequence) FILTER (size IS NOT NULL) - arg_min(size, sequence) FILTER (size IS NOT NULL)) / count(size) ELSE 0 END, 6) AS growth_rate,
  count(*) FILTER (event_type = 'ContextOverflowRecovery') AS compactions,
  round(coalesce(avg(CASE WHEN event_type = 'ContextOverflowRecovery' AND k > 0 THEN 0.75 END), 0), 6) AS savings_ratio FROM z GROUP BY 1""")
def context_health(spark, sf_dir):
    return _r(tr.context_health(steps(spark, sf_dir)), "avg_context_tokens", "growth_rate", "savings_ratio")


@register("trajectory_repetition", STEPS_SQL + """,
g AS (SELECT run_id, tool_name, payload_summary, count(*) AS n FROM steps WHERE event_type = 'ToolCallCompleted' GROUP BY ALL)
SELECT run_id, sum(n - 1)::BIGINT AS repeats, sum(n)::BIGINT AS calls, count(*) FILTER (n > 1) AS repeated_actions, round(sum(n - 1) / sum(n), 6) AS rate FROM g GROUP BY 1""")
def repetition(spark, sf_dir):
    return _r(tr.repetition_rates(calls(spark, sf_dir)), "rate")


@register("trajectory_failure_constraints", STEPS_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp DESC, sequence DESC) AS n FROM steps WHERE event_type = 'Error')
SELECT run_id, payload_summary, count(*) AS seen FROM r WHERE n <= 50 GROUP BY ALL HAVING count(*) >= 3""")
def failure_constraints(spark, sf_dir):
    return tr.failure_constraints(steps(spark, sf_dir).where(C("event_type") == "Error"))


_RUNS = """, runs AS (SELECT run_id, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS steps, count(*) FILTER (event_type = 'ToolCallCompleted') AS tool_calls, count(*) FILTER (event_type = 'Error') AS errors, count(*) FILTER (event_type = 'LlmCallStart') AS llm_calls FROM steps GROUP BY 1)"""


@register("trajectory_run_list", STEPS_SQL + _RUNS + " SELECT * FROM runs")
def run_list(spark, sf_dir):
    return tr.run_list(steps(spark, sf_dir))


@register("trajectory_fleet_stats", STEPS_SQL + _RUNS + """
SELECT count(*) AS runs, sum(tool_calls)::BIGINT AS tool_calls, sum(errors)::BIGINT AS errors, round(coalesce(avg(CASE WHEN llm_calls > 0 THEN llm_calls END), 0), 6) AS avg_llm_calls,
  round(coalesce(avg(CASE WHEN errors > 0 THEN errors END), 0), 6) AS avg_errors, round(avg(ended - started), 3) AS avg_duration_ms FROM runs""")
def fleet_stats(spark, sf_dir):
    return _r(tr.fleet_stats(tr.run_list(steps(spark, sf_dir))), "avg_llm_calls", "avg_errors").withColumn("avg_duration_ms", F.round("avg_duration_ms", 3))


@register("trajectory_compare_runs", STEPS_SQL + _RUNS + """,
l AS (SELECT run_id, unnest(['duration', 'steps', 'tool_calls', 'errors', 'llm_calls']) AS metric, unnest([ended - started, steps, tool_calls, errors, llm_calls]) AS value FROM runs)
SELECT metric, max(CASE WHEN run_id = 1 THEN value END) AS a, max(CASE WHEN run_id = 2 THEN value END) AS b, max(CASE WHEN run_id = 2 THEN value END) - max(CASE WHEN run_id = 1 THEN value END) AS difference FROM l WHERE run_id IN (1, 2) GROUP BY 1""")
def compare_runs(spark, sf_dir):
    return tr.compare_runs(tr.run_list(steps(spark, sf_dir)), 1, 2)


@register("trajectory_durations", """
WITH s AS (SELECT user_id AS run_id, event_id AS sequence, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'signup' THEN 's' WHEN 'view' THEN 's' WHEN 'purchase' THEN 'c' END AS e FROM events),
g AS (SELECT *, coalesce(sum((e = 'c')::INT) OVER (PARTITION BY run_id ORDER BY t, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM s WHERE e IS NOT NULL)
SELECT run_id, sequence, duration_ms FROM (SELECT *, greatest(t - min(CASE WHEN e = 's' THEN t END) OVER (PARTITION BY run_id, turn), 0) AS duration_ms FROM g) WHERE e = 'c'""")
def durations(spark, sf_dir):
    kind = F.when(C("event_type") == "signup", "ToolCallQueued").when(C("event_type") == "view", "ToolCallDispatched").when(C("event_type") == "purchase", "ToolCallCompleted")
    e = table(spark, sf_dir, "events").select(C("user_id").alias("run_id"), C("event_id").alias("sequence"), F.unix_millis(C("ts").cast("timestamp")).alias("timestamp"), kind.alias("event_type"), F.lit("").alias("entity_id"))
    paired = tr.pair_durations(e.where(C("event_type").isNotNull()))
    return paired.where(tr.completed()).select("run_id", "sequence", "duration_ms")


@register("trajectory_envelopes", """
SELECT user_id::VARCHAR AS run_id, count(*) FILTER (event_id % 7 <> 0) AS good, count(*) FILTER (event_id % 7 = 0) AS bad FROM events GROUP BY 1""")
def envelopes(spark, sf_dir):
    """JSON lines, a seventh of them cut short, read back without losing a line."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.lit(1).alias("v"), C("event_id").alias("seq"), F.unix_millis(C("ts").cast("timestamp")).alias("ts"), C("user_id").cast("string").alias("run_id"), F.lit("event").alias("kind"), C("event_type"), C("props").alias("payload")))
    cut = F.when(C("event_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(C("line"))
    lines = e.select("user_id", line.alias("line")).select("user_id", "line", F.lit(1).alias("_")).withColumn("event_id", F.get_json_object("line", "$.seq").cast("long")).select("user_id", cut.alias("value"))
    parsed = lines.select("user_id", F.from_json("value", "v int, seq bigint, kind string, corrupt string", {"columnNameOfCorruptRecord": "corrupt"}).alias("e"))
    return parsed.groupBy(C("user_id").cast("string").alias("run_id")).agg(F.count_if(C("e.corrupt").isNull()).alias("good"), F.count_if(C("e.corrupt").isNotNull()).alias("bad"))
