"""Checks of proposed calls, in a fixed order: unknown, illegal, arguments, prerequisites, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arguments import argument_faults
from ..sources.tables import small

OUT = ("accepted", "reason", "reasons", "faults", "missing", "disallowed", "repair")
REASONS = ("unknown", "illegal", "arguments", "prerequisites", "effects")


def check(calls: DataFrame, registry: DataFrame, legal: DataFrame) -> DataFrame:
    """calls with accepted, reason (the first), reasons (all), faults, missing, disallowed, repair.

    calls: session_id, tool_id, args_json, state, allowed; registry: tool_id,
    prereqs, effects, args; legal: session_id, tool_id. Null arrays are empty. For
    an unknown tool only that is said, as there is no contract to check against.
    Columns of calls named like the result's give way to them; an empty table gives none.
    repair: JSON of what a call that would be accepted needs; null for an accepted call.
    """
    kept = [F.col(f"`{c}`") for c in calls.columns if c not in OUT]
    calls = calls.select(F.struct(*kept).alias("call"), "session_id", "tool_id", "args_json", "state", "allowed")
    none = F.array().cast("array<string>")
    empty = lambda c: F.coalesce(F.col(c), none)
    known = registry.select("tool_id", F.struct("prereqs", "effects", "args").alias("_contract"))
    allowed = legal.select("session_id", "tool_id").distinct().withColumn("_legal", F.lit(True))
    found = calls.join(small(known), "tool_id", "left").join(allowed, ["session_id", "tool_id"], "left")
    found = found.withColumns({"_known": F.col("_contract").isNotNull(), "_prereqs": F.col("_contract.prereqs"), "_effects": F.col("_contract.effects")})
    found = found.withColumns(
        {
            "faults": F.when(F.col("_known"), argument_faults(F.col("args_json"), F.col("_contract.args"))).otherwise(none),
            "missing": F.when(F.col("_known"), F.sort_array(F.array_except(empty("_prereqs"), empty("state")))).otherwise(none),
            "disallowed": F.when(F.col("_known"), F.sort_array(F.array_except(empty("_effects"), empty("allowed")))).otherwise(none),
        }
    )
    failed = [~F.col("_known"), F.col("_known") & F.col("_legal").isNull(), F.size("faults") > 0, F.size("missing") > 0, F.size("disallowed") > 0]
    reasons = F.filter(F.array(*[F.when(c, r) for c, r in zip(failed, REASONS, strict=True)]), lambda x: x.isNotNull())
    found = found.withColumn("reasons", reasons).withColumn("reason", F.get("reasons", F.lit(0)))
    shape = F.to_json(F.struct(F.col("reason"), F.col("missing"), F.col("faults"), F.col("disallowed"), F.col("_contract.args").alias("args")), {"ignoreNullFields": "false"})
    out = found.withColumns({"accepted": F.col("reason").isNull(), "repair": F.when(F.col("reason").isNotNull(), shape)})
    return out.select("call.*", *OUT)


def frozen(calls: DataFrame, freezes: DataFrame, ts: str = "ts", bucket_seconds: int = 86_400) -> DataFrame:
    """Calls made while their tool was frozen, with freeze_id, a row for each freeze. freezes: freeze_id, tool_id, since, until (not included).

    A range join by equality: a freeze is one row for each bucket of time that it
    touches between the first and the last call, so one without an end makes no more; calls meet
    it in theirs, and the bounds are checked there. Null times or bounds match nothing; a column
    of calls named freeze_id gives way; an empty table gives none.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_seconds)
    first, last = (calls.agg(f(bucket(ts))).scalar() for f in (F.min, F.max))
    spans = freezes.where("since < until").select("freeze_id", "tool_id", "since", "until", F.greatest(bucket("since"), first).alias("a"), F.least(bucket("until"), last).alias("b"))
    spans = spans.where("a <= b").select("freeze_id", "tool_id", "since", "until", F.explode(F.sequence("a", "b")).alias("bucket"))
    packed = calls.select(F.struct(*[F.col(f"`{c}`") for c in calls.columns if c != "freeze_id"]).alias("call"), "tool_id", F.col(ts).alias("at"), bucket(ts).alias("bucket"))
    met = packed.join(spans, ["tool_id", "bucket"])
    return met.where((F.col("at") >= F.col("since")) & (F.col("at") < F.col("until"))).select("call.*", "freeze_id")
