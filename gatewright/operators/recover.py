"""New candidates after refusals, and abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import OFFERED, rank


def recover(scored: DataFrame, declined: DataFrame, k: int = OFFERED) -> DataFrame:
    """The k best without tools that the request has declined. scored: under the updated state."""
    return rank(scored.join(declined.select("request_id", "tool_id"), ["request_id", "tool_id"], "left_anti"), k)


def outcome(requests: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """(request_id, outcome): offer; or no_tool, if nothing was ranked; or low_confidence, if the best score is under the threshold."""
    best = ranked.groupBy("request_id").agg(F.max("score").alias("best"))
    said = F.when(F.col("best").isNull(), "no_tool").when(F.col("best") < threshold, "low_confidence").otherwise("offer")
    return requests.select("request_id").join(best, "request_id", "left").select("request_id", said.alias("outcome"), "best")
