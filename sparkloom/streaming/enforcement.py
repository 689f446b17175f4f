"""Budgets enforced on a stream, with expiry, and a side output for what can't be read.

Both survive a restart from their checkpoint: a violation is told once, and a
batch that is run again replaces what its first run left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.runtime import ship

C = F.col
KINDS = ("time", "tokens", "iterations", "tool_calls")
VIOLATION = "run_id long, kind string, used long, allowed long"
#: The state store that keeps timers and typed state; to be set on the session before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Enforcer(StatefulProcessor):
    """One run: first and last second, three sums, and the kinds that were told."""

    def __init__(self, limits: dict[str, int], idle_seconds: int):
        self.limits, self.idle = limits, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.usage = handle.getValueState("usage", "first long, last long, tokens long, iterations long, tool_calls long, told string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, tokens, iterations, calls, told = self.usage.get() if self.usage.exists() else (None, None, 0, 0, 0, "")
        for f in rows:
            seconds = f["ts"].astype("datetime64[us]").astype("int64") // 1_000_000
            low, high = int(seconds.min()), int(seconds.max())
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
            tokens += int(f["tokens"].fillna(0).sum())
            iterations += int((f["kind"] == "iteration").sum())
            calls += int((f["kind"] == "tool_call").sum())
        used = dict(zip(KINDS, (last - first, tokens, iterations, calls)))
        new = [k for k in KINDS if k in self.limits and used[k] > self.limits[k] and k not in told.split(",")]
        self.usage.update((first, last, tokens, iterations, calls, ",".join(filter(None, [told, *new]))))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) * 1000)
        yield pd.DataFrame({"run_id": [key[0]] * len(new), "kind": new, "used": [used[k] for k in new], "allowed": [self.limits[k] for k in new]}).astype({"run_id": "int64", "kind": "object", "used": "int64", "allowed": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.usage.clear()
        yield pd.DataFrame({"run_id": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype="object"), "used": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def enforce(events: DataFrame, limits: dict[str, int], idle_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(run_id, kind, used, allowed), once for each run and kind of ``KINDS`` that passes its limit.

    ``events(run_id, ts, kind, tokens)``; a limit that is not given does not
    bind.  Rows without a run or time are left out, null tokens count 0.  A run
    is forgotten once the watermark is ``idle_seconds`` past its last event, so
    state does not grow with the runs that ended; rows over ``late`` are dropped.
    The session needs the store of ``STORE``.
    """
    ship(events.sparkSession)
    good = events.where("run_id is not null and ts is not null").select(C("run_id").cast("long").alias("run_id"), "ts", "kind", C("tokens").cast("long").alias("tokens"))
    return good.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(statefulProcessor=Enforcer(dict(limits), idle_seconds), outputStructType=VIOLATION, outputMode="Append", timeMode="EventTime")


def dead_letter_sink(schema: str, good: str, dead: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over ``value`` strings: records of ``schema`` to ``good``, the rest to ``dead``.

    Both are Parquet folders, a subfolder a batch; a batch that is run again
    overwrites its own.  Dead letters keep their text and the reason.  Blank
    and null lines are dead too, so every row is in one of the folders.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
        parsed = parsed.withColumn("ok", F.coalesce(C("r").isNotNull() & C("r._corrupt").isNull() & (F.trim("value") != ""), F.lit(False))).persist()
        names = [n for n in parsed.select("r.*").columns if n != "_corrupt"]
        parsed.where("ok").select(*[C(f"r.{n}").alias(n) for n in names]).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        reason = F.when(C("value").isNull() | (F.trim("value") == ""), "empty").otherwise("malformed")
        parsed.where("not ok").select("value", reason.alias("reason")).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        parsed.unpersist()

    return put
