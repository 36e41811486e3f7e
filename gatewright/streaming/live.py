"""Live forms: state, checks and recovery on streams.

State is one set a session or request and is dropped when event time has passed it
by `idle`. It keeps when each fact was first seen, so a call that comes late, but
within the watermark, is judged on what was known at its own time; facts that come
late in turn do not change verdicts that were given. Calls that come twice within the
watermark count once; calls without a session share one, calls without a time are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.policy import check
from ..operators.rank import OFFERED

_OUT = "call_id long, session_id long, ts timestamp, tool_id string, args_json string, state array<string>"
_SEEN = "fact array<string>, at array<long>, call array<long>"


def _keep(state: GroupState, values: tuple, last: pd.Timestamp, idle_ms: int) -> None:
    """Store values, to be dropped once the watermark is `idle_ms` beyond the last row."""
    state.update(values)
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)


def _batches(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order. A key's batch is what a trigger admits of it; maxFilesPerTrigger or maxOffsetsPerTrigger bounds it."""
    return pd.concat(list(parts)).sort_values(order)


def _with_state(idle_ms: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = {f: (t, c) for f, t, c in zip(*state.get, strict=True)} if state.exists else {}
        rows = _batches(parts, ["ts", "call_id"])
        steps = list(zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["call_id"].tolist(), strict=True))
        for tool, at in zip(rows["tool_id"], steps, strict=True):
            if isinstance(tool, str) and (tool not in seen or at < seen[tool]):
                seen[tool] = at
        before = [sorted(f for f, first in seen.items() if first < at) for at in steps]
        _keep(state, ([*seen], [t for t, _ in seen.values()], [c for _, c in seen.values()]), rows["ts"].max(), idle_ms)
        yield rows.assign(state=before)[["call_id", "session_id", "ts", "tool_id", "args_json", "state"]]

    return step


def live_state(calls: DataFrame, watermark: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """A stream of calls with the state before each. ts is cast to a timestamp, as a watermark needs; a session that is silent for `idle_seconds` beyond the watermark begins anew."""
    once = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["call_id"])
    once = once.select("call_id", "session_id", "ts", "tool_id", "args_json")
    stated = once.groupBy("session_id").applyInPandasWithState(_with_state(idle_seconds * 1000), _OUT, _SEEN, "append", GroupStateTimeout.EventTimeTimeout)
    # an expression right behind it: rows as the stateful operator gives them cannot be shuffled
    return stated.withColumn("state", F.array_sort("state"))


def live_check(calls: DataFrame, registry: DataFrame, legal: DataFrame, allowed: list[str], watermark: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """Verdicts on a stream of calls; registry and legal are static tables."""
    stated = live_state(calls, watermark, idle_seconds).withColumn("allowed", F.array(*map(F.lit, allowed)).cast("array<string>"))
    return check(stated, registry, legal)


def _recover(k: int, threshold: float, idle_ms: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        declined = set(state.get[0]) if state.exists else set()
        rows, out = _batches(parts, ["ts", "event_id"]), []
        for row in rows.itertuples(index=False):
            if row.declined is not None:
                declined |= {t for t in row.declined if t is not None}
            open_ = sorted(((-c["score"], c["tool_id"]) for c in (row.candidates if row.candidates is not None else []) if c["score"] is not None and c["tool_id"] not in declined))
            best = -open_[0][0] if open_ else None
            outcome = "no_tool" if best is None else "low_confidence" if best < threshold else "offer"
            out.append((row.event_id, row.request_id, row.ts, outcome, [t for _, t in open_[:k]] if outcome == "offer" else []))
        _keep(state, (sorted(declined),), rows["ts"].max(), idle_ms)
        yield pd.DataFrame(out, columns=["event_id", "request_id", "ts", "outcome", "offered"])

    return step


def live_recover(asks: DataFrame, k: int = OFFERED, threshold: float = 0.0, watermark: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """Fresh candidates, or abstention, for a stream of asks: event_id, request_id, ts, declined (tools refused since the last ask, null for none), candidates (array of tool_id and score under the state of now).

    Gives event_id, request_id, ts, outcome (offer, no_tool or low_confidence) and offered: the k best that the
    request has not declined, now or before; of equal scores the lesser tool_id.
    """
    once = asks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    once = once.select("event_id", "request_id", "ts", "declined", "candidates")
    out = "event_id long, request_id long, ts timestamp, outcome string, offered array<string>"
    found = once.groupBy("request_id").applyInPandasWithState(_recover(k, threshold, idle_seconds * 1000), out, "declined array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("offered", F.slice("offered", 1, k))
