"""Stand-ins over the driver's tables for what they do not hold: a registry whose tools need each other, calls of its tools, and calls that follow an objective."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from . import tables

SCOPES = 4
#: Tools are numbered below this where calls are made up; numbers that no item of the benchmark has are unknown tools.
NUMBERS = 43


def tool_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tool_id, prereqs): item k of the benchmark needs the items k div 2 and k div 3, and, where k % 13 is 5, also the next, which needs it in turn: a cycle."""
    k = F.col("item_id")
    halves = F.when(k > 0, F.array(F.floor(k / 2), F.floor(k / 3))).otherwise(F.array().cast("array<long>"))
    circle = F.when(k % 13 == 5, F.array(k + 1)).when(k % 13 == 6, F.array(k - 1)).otherwise(F.array().cast("array<long>"))
    return tables.table(spark, sf_dir, "benchmark").select(k.cast("string").alias("tool_id"), F.array_distinct(F.concat(halves, circle)).cast("array<string>").alias("prereqs"))


def graph_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, session_id, turn, scope, tool_id, state): user turns as calls of the graph's tools; state: those that the conversation called before."""
    turns = tables.table(spark, sf_dir, "conversations").where("role = 'user'")
    log = turns.select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("conv_id").alias("session_id"), "turn", (F.col("turn") % SCOPES).alias("scope"), ((F.col("conv_id") * 7 + F.col("turn") * 11) % NUMBERS).cast("string").alias("tool_id"))
    return state.before(log, ts="turn", tie="turn")


def graph_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, tool_id): all items but those that, with the scope, make a multiple of 9."""
    items = tables.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(SCOPES - 1))).alias("scope"))
    return items.where((F.col("item_id") + F.col("scope")) % 9 != 0).select("scope", F.col("item_id").cast("string").alias("tool_id"))


def guided_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, session_id, ts, objective, objective_vec, facts, chosen): each event asks for a tool. Its session's objective is the embedding of its number, with the label as its kind; six in ten choose the tool that the kind and the number of known facts point to, the others what the event says."""
    log = state.before(tables.calls(spark, sf_dir))
    kinds = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("session_id"), F.col("label").alias("objective"), F.col("embedding").alias("objective_vec"))
    legal = F.array(*map(F.lit, tables.LEGAL_TOOLS))
    follows = F.crc32(F.col("call_id").cast("string").cast("binary")) % 10 < 6
    chosen = F.when(follows, F.get(legal, ((F.col("objective") + F.size("state")) % len(tables.LEGAL_TOOLS)).cast("int"))).otherwise(F.col("tool_id"))
    return log.join(kinds, "session_id").select(F.col("call_id").alias("request_id"), "session_id", "ts", "objective", "objective_vec", F.col("state").alias("facts"), chosen.alias("chosen"))


def schema_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, args_json): nested arguments made up from the number of a turn, 8 * conversation + turn, with faults of every kind."""
    items = """concat('[', array_join(transform(filter(sequence(0, 4), i -> i < n % 5), i -> concat('{"id": ', IF((n + i) % 7 = 0, '"x"', CAST(i AS STRING)), IF((n + i) % 11 = 0, ', "tag": "A1"', ', "tag": "a-1"'), '}')), ', '), ']')"""
    to = """CASE n % 4 WHEN 0 THEN ', "to": {"email": "u@h"}' WHEN 1 THEN ', "to": {"phone": 5}' WHEN 2 THEN ', "to": {"phone": "5"}' ELSE '' END"""
    k = "CASE WHEN n % 13 = 0 THEN '\"7\"' ELSE CAST(n % 100 AS STRING) END"
    mode = "CASE n % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' ELSE 'odd' END"
    args = f"CASE WHEN n % 101 = 0 THEN '{{' ELSE concat('{{\"k\": ', {k}, ', \"mode\": \"', {mode}, '\", \"items\": ', {items}, {to}, IF(n % 17 = 0, ', \"z\": 1', ''), '}}') END"
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), (F.col("conv_id") * 8 + F.col("turn")).alias("n"))
    return turns.select("call_id", F.expr(args).alias("args_json"))
