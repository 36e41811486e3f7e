"""Distinct counts that merge: sketches stored a day, and any span from them.

One scan of the log gives a row a tool and day with a sketch of its sessions, of a
bounded size whatever the number of sessions. The sketches of any span of days are merged
without the log, and so are differences: sessions that called one tool in the
span and not another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a sketch, as a power of two; a count is within some 2 / sqrt(2^LOG) of exact, 19 times in 20.
LOG = 12
#: Standard deviations within which an estimate is held to a wanted error.
SIGMAS = 5


def log_for(error: float) -> int:
    """The size, as LOG, at which a count of sessions comes within a relative error."""
    return math.ceil(math.log2((SIGMAS / error) ** 2))


def tells(difference: Column, one: Column, two: Column, error: float, log2: int = LOG) -> Column:
    """Whether sketches of this size tell a difference within an error: both sides fit in as they are, or it is no small part of the larger, whose share of entries it is estimated from."""
    larger = F.greatest(one, F.coalesce(two, F.lit(0)))
    return (larger <= 2**log2) | (difference * 2**log2 >= larger * (SIGMAS / error) ** 2)


def daily_sketches(log: DataFrame, key: str = "session_id", tool: str = "tool_id", ts: str = "ts", log2: int = LOG) -> DataFrame:
    """(tool_id, day, sketch): to be stored. Rows with a null key count nothing; those without a time or tool are left out; an empty log gives none."""
    rows = log.where(F.col(ts).isNotNull() & F.col(tool).isNotNull() & F.col(key).isNotNull())
    return rows.groupBy(F.col(tool).alias("tool_id"), F.to_date(ts).alias("day")).agg(F.theta_sketch_agg(F.col(key), log2).alias("sketch"))


def of_spans(sketches: DataFrame, spans: DataFrame, log2: int = LOG) -> DataFrame:
    """(span_id, tool_id, sketch): merged over the days of each span (span_id, first, last: dates, both included). A span without a row of a tool has none of it; one that ends before it begins is empty."""
    # a span is a row a day that it touches, so the join is by equality
    days = spans.where("first <= last").select("span_id", F.explode(F.sequence("first", "last")).alias("day"))
    return sketches.join(days, "day").groupBy("span_id", "tool_id").agg(F.theta_union_agg("sketch", log2).alias("sketch"))


def sessions(merged: DataFrame) -> DataFrame:
    """(span_id, tool_id, sessions): the estimates."""
    return merged.select("span_id", "tool_id", F.theta_sketch_estimate("sketch").alias("sessions"))


def without(merged: DataFrame, tool: str, other: str, error: float | None = None, log2: int = LOG) -> DataFrame:
    """(span_id, sessions): an estimate of the sessions that called one tool in the span, but not the other; all of them where the other has no row. With an error also `told`: whether the sketches tell it within that; if not, count it in the log."""
    one = merged.where(F.col("tool_id") == tool).select("span_id", F.col("sketch").alias("one"))
    two = merged.where(F.col("tool_id") == other).select("span_id", F.col("sketch").alias("two"))
    left = F.when(F.col("two").isNull(), F.theta_sketch_estimate("one")).otherwise(F.theta_sketch_estimate(F.theta_difference("one", "two")))
    told = [] if error is None else [tells(left, F.theta_sketch_estimate("one"), F.theta_sketch_estimate("two"), error, log2).alias("told")]
    return one.join(two, "span_id", "left").select("span_id", left.alias("sessions"), *told)
