"""What a session knew at each of its steps.

Facts are never removed, so a step's state follows from when each fact was first
seen: one row a session and fact, found by a partial aggregate, and one array a
session, joined to its steps. No window runs over a session's steps, so a session
that holds a third of all rows is split like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame, key: str = "session_id", fact: str = "tool_id") -> DataFrame:
    """(session_id, facts): all facts of each session, sorted."""
    return log.where(F.col(fact).isNotNull()).select(key, fact).distinct().groupBy(key).agg(F.sort_array(F.collect_list(fact)).alias("facts"))


def before(log: DataFrame, key: str = "session_id", fact: str = "tool_id", ts: str = "ts", tie: str = "call_id") -> DataFrame:
    """log with state: the sorted facts that its session saw at an earlier (ts, tie). Rows of a null session have none; a column named state gives way."""
    seen = log.where(F.col(fact).isNotNull()).groupBy(key, fact).agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))).alias("first"))
    seen = seen.groupBy(key).agg(F.collect_list(F.struct(F.col(fact).alias("fact"), "first")).alias("_seen"))
    earlier = F.filter("_seen", lambda s: s.first < F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie")))
    state = F.sort_array(F.transform(F.coalesce(earlier, F.array()), lambda s: s.fact))
    return log.drop("state").join(seen, key, "left").withColumn("state", F.coalesce(state, F.array().cast("array<string>"))).drop("_seen")


def as_of(log: DataFrame, value: str, out: str, key: str = "session_id", ts: str = "ts", tie: str = "call_id", bucket: str = "day") -> DataFrame:
    """log with `out`: the last value that is not null at an earlier (ts, tie) of the session; null where there is none. Rows of a null session have none, a column named `out` gives way, an empty log gives none.

    A session's steps are cut by `bucket` of time; what a bucket hands on is its
    last value, one row a session and bucket, so only those go over a session's whole time.
    """
    log = log.drop(*({out} - {key, value, ts, tie})).withColumn("_bucket", F.date_trunc(bucket, ts))
    when = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    last = log.groupBy(key, "_bucket").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(when.alias("at"), F.col(value).alias("v")))).alias("_last"))
    over = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_bucket", F.last("_last", ignorenulls=True).over(over).getField("v").alias("_carried"))
    within = Window.partitionBy(key, "_bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = log.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    return local.join(carried, [key, "_bucket"], "left").withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce("_local", "_carried"))).drop("_bucket", "_local", "_carried")
