"""What to call, and in which order, until a refused call is ready.

A tool is ready once all its prerequisites are facts; a call of a tool makes it a
fact. Which tools a refused call needs, and in which step each can be called, is the
least fixpoint over that AND graph: first from the call towards what it lacks, then
from the tools that lack nothing back to the call. Both go in semi-naive rounds, as
many as the longest chain of prerequisites is long, in which only what the last round
found is joined; each round is a written table. Calls that ask for the same tool
with the same facts under the same scope are planned once.

What never becomes ready is blocked: tools on a cycle that no fact breaks, unknown
ones, those that the scope may not call, and all that need one of these.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written

OUT = ("reachable", "steps", "blocked")
_KEYS = "array<string>"


def _facts(c: str) -> Column:
    """Sorted distinct facts; none for null."""
    return F.sort_array(F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast(_KEYS)), lambda x: x.isNotNull())))


def repair_plans(calls: DataFrame, registry: DataFrame, legal: DataFrame | None = None, *, scope: str | None = None) -> DataFrame:
    """calls with reachable, steps and blocked.

    calls: tool_id, state and, if legal is given, the column named by scope; registry:
    tool_id, prereqs; legal: that column and tool_id. steps: tools to call first, by step, in a
    step by name; empty where the call is ready as it is, null where it cannot become so. blocked:
    the tools that stand in the way, sorted, the called one left out; null for a reachable call.

    Null arrays are empty; a null or unknown tool is unreachable, with nothing that blocks it;
    repeated rows are planned once and returned each; columns of calls named like the
    result's give way to them; an empty table gives none. A registry that lists a tool twice
    asks for the prerequisites of both rows.
    """
    calls = calls.select(*[c for c in calls.columns if c not in OUT])
    group = ("_scope", "_tool", "_state")
    packed = calls.select(F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("call"), (F.col(scope).cast("string") if legal is not None else F.lit("")).alias("_scope"), F.col("tool_id").alias("_tool"), _facts("state").alias("_state"))
    # one row a question
    asked = packed.select(*group).distinct().withColumn("q", F.monotonically_increasing_id())
    asked = written(asked, "repair-asked")
    edges = written(registry.select("tool_id", F.explode(_facts("prereqs")).alias("need")).distinct(), "repair-edges")
    known = asked.select("q", F.explode("_state").alias("need"))

    # towards what is lacking
    front, found = asked.where("_tool IS NOT NULL").select("q", F.col("_tool").alias("tool_id")), []
    while not found or not front.isEmpty():
        found.append(front)
        reached = functools.reduce(DataFrame.unionByName, found)
        lacking = front.join(edges, "tool_id").select("q", "need").distinct().join(known, ["q", "need"], "left_anti")
        front = written(lacking.withColumnRenamed("need", "tool_id").join(reached, ["q", "tool_id"], "left_anti"), "repair-front")
    reached = functools.reduce(DataFrame.unionByName, found)
    arcs = written(reached.join(edges, "tool_id").join(known, ["q", "need"], "left_anti"), "repair-arcs")

    # and back: what lacks nothing, then what lacks only that
    usable = reached.join(registry.select("tool_id").distinct(), "tool_id", "left_semi")
    if legal is not None:
        pairs = legal.select(F.col(scope).cast("string").alias("_scope"), "tool_id").distinct()
        usable = usable.join(asked.select("q", "_scope"), "q").join(pairs, ["_scope", "tool_id"], "left_semi").drop("_scope")
    left = arcs.groupBy("q", "tool_id").agg(F.count("*").alias("left"))
    open_ = written(usable.join(left, ["q", "tool_id"], "left").select("q", "tool_id", F.coalesce("left", F.lit(0)).alias("left")), "repair-open")
    ready, steps = open_.where(F.col("left") == 0).select("q", "tool_id"), []
    open_ = open_.where(F.col("left") > 0)
    while not steps or not ready.isEmpty():
        steps.append(ready.withColumn("step", F.lit(len(steps))))
        met = arcs.join(ready.withColumnRenamed("tool_id", "need"), ["q", "need"]).groupBy("q", "tool_id").agg(F.count("*").alias("met"))
        open_ = written(open_.join(met, ["q", "tool_id"], "left").select("q", "tool_id", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "repair-open")
        ready, open_ = open_.where(F.col("left") == 0).select("q", "tool_id"), open_.where(F.col("left") > 0)
    placed = functools.reduce(DataFrame.unionByName, steps)

    each = reached.join(placed, ["q", "tool_id"], "left").join(asked.select("q", "_tool"), "q")
    own = F.col("tool_id") == F.col("_tool")
    at = F.when(~own & F.col("step").isNotNull(), F.struct("step", "tool_id"))
    plans = each.groupBy("q").agg(
        F.max(own & F.col("step").isNotNull()).alias("reachable"),
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x.tool_id).alias("steps"),
        F.sort_array(F.collect_list(F.when(~own & F.col("step").isNull(), F.col("tool_id")))).alias("blocked"),
    )
    plans = asked.join(plans, "q", "left").select(*[F.col(c).alias(f"p{c}") for c in group], F.coalesce("reachable", F.lit(False)).alias("reachable"), "steps", "blocked")
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"p{c}")) for c in group])
    out = packed.join(plans, same)
    return out.select("call.*", "reachable", F.when(F.col("reachable"), F.col("steps")).alias("steps"), F.when(~F.col("reachable"), F.coalesce("blocked", F.array().cast(_KEYS))).alias("blocked"))
