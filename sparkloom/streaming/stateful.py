"""Stateful operators on event streams.

The batch forms live in :mod:`sparkloom.operators.trajectory`; these keep the
same rules while events arrive.  State is keyed by run, so it spreads over the
cluster, and a run's state is two values or a few sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.trajectory import EXPECTED_PAIRS

VERDICTS = {0: "Ok", 1: "Ok", 2: "Warning", 3: "Correct", 4: "Correct"}


def step(state: tuple[str, str, int], tool: str, payload: str) -> tuple[str, str, int]:
    """(last tool, last fingerprint, consecutive) after one more call."""
    last_tool, last_print, n = state
    mark = f"{tool}|{payload}"
    if (last_tool, tool) in EXPECTED_PAIRS:
        return tool, "", 0
    return tool, mark, n + 1 if mark == last_print else 1


def loop_detector(calls: DataFrame) -> DataFrame:
    """(run_id, sequence, consecutive, verdict) of a stream of calls(run_id, sequence, tool_name, payload_summary)."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("", "", 0)
        rows = pd.concat(list(frames)).sort_values("sequence")
        out = []
        for r in rows.itertuples():
            now = step(now, r.tool_name, r.payload_summary)
            out.append((r.run_id, r.sequence, now[2], VERDICTS.get(now[2], "HardStop")))
        state.update(now)
        yield pd.DataFrame(out, columns=["run_id", "sequence", "consecutive", "verdict"])

    return calls.groupBy("run_id").applyInPandasWithState(watch, "run_id long, sequence long, consecutive int, verdict string", "tool string, mark string, n int", "append", GroupStateTimeout.NoTimeout)


def failure_suggestions(failures: DataFrame, least: int = 3) -> DataFrame:
    """(pattern, seen) once per pattern, when it has been seen ``least`` times."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told = state.get if state.exists else (0, False)
        seen += sum(len(f) for f in frames)
        fire = seen >= least and not told
        state.update((seen, told or fire))
        yield pd.DataFrame({"pattern": [key[0]], "seen": [seen]} if fire else {"pattern": pd.Series([], dtype=str), "seen": pd.Series([], dtype="int64")})

    return failures.groupBy("pattern").applyInPandasWithState(watch, "pattern string, seen long", "seen long, told boolean", "append", GroupStateTimeout.NoTimeout)


def running_budget(events: DataFrame) -> DataFrame:
    """Sums per run in update mode: calls, tokens and errors so far."""
    return events.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count_if("failed").alias("errors"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """An extension: event-time windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """An extension: session windows per user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def without_streaming_kinds(envelopes: DataFrame) -> DataFrame:
    """What a listener keeps: everything but token-stream chatter."""
    return envelopes.where("event_kind is null or event_kind <> 'Streaming'")
