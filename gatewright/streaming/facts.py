"""Live facts, a map entry a fact, and calls that get no outcome in time.

`live_facts` keeps when each session first saw each fact in map state, so that a call writes
only the facts that it adds, not the whole set. It can begin from the fold of an older
log, and a session that falls silent is dropped by a timer on event time. What it holds
can be read back as a table from its checkpoint. The state store must be RocksDB
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "call_id long, session_id long, ts timestamp, tool_id string, state array<string>"


class _Facts(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "fact string", "ts long, call_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.micros, r.call_id))
        seen = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        for r in rows:
            at = (r.micros, r.call_id)
            if r.tool_id is not None and (r.tool_id not in seen or at < seen[r.tool_id]):
                seen[r.tool_id] = at
                self.seen.updateValue((r.tool_id,), at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(rows[-1].micros // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        for r in rows:
            before = sorted(f for f, first in seen.items() if first < (r.micros, r.call_id))
            yield Row(call_id=r.call_id, session_id=key[0], ts=r.ts, tool_id=r.tool_id, state=before)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.seen.updateValue((initialState.fact,), (initialState.micros, initialState.call_id))
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(initialState.micros // 1000 + self.idle_ms)

    def close(self) -> None:
        pass


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def first_seen(log: DataFrame) -> DataFrame:
    """(session_id, fact, micros, call_id): where each session first saw each fact; what live_facts can begin from. Rows without a tool say nothing."""
    first = log.where("tool_id IS NOT NULL").groupBy("session_id", F.col("tool_id").alias("fact")).agg(F.min(F.struct(_micros("ts").alias("micros"), "call_id")).alias("first"))
    return first.select("session_id", "fact", "first.micros", "first.call_id")


def live_facts(calls: DataFrame, begin: DataFrame | None = None, watermark: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """A stream of calls (call_id, session_id, ts, tool_id) with the sorted facts that their session saw before each. begin: first_seen of an older log. Calls that come twice within the watermark count once."""
    once = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["call_id"])
    rows = once.select("call_id", "session_id", "ts", "tool_id", _micros("ts").alias("micros"))
    # a session's older facts, one row each
    older = None if begin is None else begin.select("session_id", "fact", "micros", "call_id").groupBy("session_id")
    return rows.groupBy("session_id").transformWithState(_Facts(idle_seconds * 1000), _OUT, "Append", "EventTime", initialState=older)


def held_facts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, facts): what a query of live_facts with this checkpoint holds, read from its state."""
    held = spark.read.format("statestore").option("stateVarName", "seen").option("operatorId", 0).load(checkpoint)
    return held.select(F.col("key.session_id").alias("session_id"), F.col("user_map_key.fact").alias("fact")).groupBy("session_id").agg(F.sort_array(F.collect_list("fact")).alias("facts"))


def unanswered(calls: DataFrame, outcomes: DataFrame, within: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """(call_id, ts, outcome, answered): calls (call_id, ts) and their outcomes (call_id, ts, outcome) that came within a time after them; null where none did, said once the watermarks of both streams have passed. An outcome that comes earlier than its call, later than `within`, or later than the watermark, is none. Works on tables as well."""
    asked = calls.select("call_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    said = outcomes.select(F.col("call_id").alias("of"), F.col("ts").cast("timestamp").alias("answered"), "outcome").withWatermark("answered", watermark)
    near = (F.col("of") == F.col("call_id")) & (F.col("answered") >= F.col("ts")) & (F.col("answered") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return asked.join(said, near, "left").select("call_id", "ts", "outcome", "answered")
