"""Tables by name, and stand-ins for the domain tables.

The driver's tables hold no tool calls, so requests, registries and calls are
read from others: embeddings ask for the tool of a label, user turns for an item
of the benchmark, and events are a log of calls with their JSON arguments.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARG = "struct<name:string,type:string,required:boolean,min:double,max:double>"
CONTRACT = f"tool_id: string, prereqs: array<string>, effects: array<string>, args: array<{ARG}>"

#: The stand-in contracts: what each tool of the event log needs and does; k is an integer under 90.
_K = [("k", "int", True, None, 89.0)]
CONTRACTS = [
    ("view", [], [], _K),
    ("click", ["view"], ["track"], _K),
    ("purchase", ["view", "click"], ["charge"], _K),
    ("signup", [], ["write"], _K),
]
LEGAL_TOOLS = ["view", "click", "purchase", "error"]
ALLOWED_EFFECTS = ["track", "write"]
#: A registry is broadcast only if Spark's estimate of its size is at most this.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer knows that it is small, without running it; else as it is: Spark then goes by the size it measures. Of rows that a generator makes (explode, inline) the optimizer knows nothing, so they get no hint; write such a table first, and its files tell."""
    plan = df._jdf.queryExecution().optimizedPlan()
    made = any(line.lstrip("+-:! ").startswith(("Generate", "Expand")) for line in plan.toString().splitlines())
    return F.broadcast(df) if not made and plan.stats().sizeInBytes() <= most else df


def contracts(spark: SparkSession) -> DataFrame:
    # from a literal, whose size the optimizer knows
    rows = [dict(zip(("tool_id", "prereqs", "effects", "args"), (t, p, e, [dict(zip(("name", "type", "required", "min", "max"), a, strict=True)) for a in args]), strict=True)) for t, p, e, args in CONTRACTS]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{CONTRACT}>>")))


def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, level, objective_vec): each embedding asks for tools."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), F.col("label").alias("level"), F.col("embedding").alias("objective_vec"))


def label_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tool_id, tool_vec): a tool for each label, at the mean of its vectors."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("label").alias("tool_id"), F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("tool_id", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("tool_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c.x).alias("tool_vec"))


def unlocked(requests: DataFrame) -> DataFrame:
    """(request_id, tool_id): a request of some level may use the tools of the levels below, so one of level 0 none."""
    return requests.where("level > 0").select("request_id", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("tool_id"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, session_id, ts, tool_id, args_json): the event log."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("tool_id"), F.col("props").alias("args_json"))


def union_logs(**logs: DataFrame) -> DataFrame:
    """One log of several: call_id and session_id as text after the name of their log, so that equal numbers of two logs stay apart; ts, tool_id and args_json as they are, null where a log has none."""
    parts = []
    for name, log in logs.items():
        have = {c: F.col(c) for c in log.columns}
        named = [F.concat(F.lit(f"{name}-"), have[c].cast("string")).alias(c) for c in ("call_id", "session_id")]
        rest = [have.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("ts", "timestamp_ntz"), ("tool_id", "string"), ("args_json", "string"))]
        parts.append(log.select(F.lit(name).alias("log"), *named, *rest))
    return functools.reduce(DataFrame.unionByName, parts)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, session_id, tool_id): turns of conversations as a second log; the role stands in for the tool."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("conv_id").alias("session_id"), F.col("role").alias("tool_id"))


def rich_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, tool_id, args_json): calls whose arguments are made up from the event's number, with faults of every kind."""
    k = "CASE WHEN event_id % 13 = 0 THEN '\"7\"' WHEN event_id % 17 = 0 THEN '2.5' ELSE CAST(event_id % 100 AS STRING) END"
    amount = "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(', \"amount\": ', event_id % 400) END"
    note = "CASE event_id % 3 WHEN 0 THEN ', \"note\": true' WHEN 1 THEN ', \"note\": \"n\"' ELSE '' END"
    other = "CASE WHEN event_id % 7 = 0 THEN ', \"other\": 1' ELSE '' END"
    args = f"CASE WHEN event_id % 101 = 0 THEN '{{' ELSE concat('{{\"k\": ', {k}, {amount}, {note}, {other}, '}}') END"
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool_id"), F.expr(args).alias("args_json"))


def session_legal(log: DataFrame) -> DataFrame:
    """(session_id, tool_id): what each session may call."""
    return log.select("session_id").distinct().select("session_id", F.explode(F.array(*map(F.lit, LEGAL_TOOLS))).alias("tool_id"))
