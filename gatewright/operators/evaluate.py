"""Measures of rankings and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import OFFERED, rank


def next_tools(log: DataFrame, key: str = "session_id", tool: str = "tool_id", ts: str = "ts", tie: str = "call_id", bucket: str = "day", keep: tuple[str, ...] = ()) -> DataFrame:
    """(current, next), with the columns in keep: each step's tool and that of the session's next step, if it has one. Rows of a null session follow each other; an empty log gives none.

    As in state.as_of, a session's steps are cut by `bucket` of time: within one the
    next row is looked at, and a bucket's last step takes the first tool of the session's next bucket.
    """
    log = log.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_none"), F.col(tool).alias("current"), F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.date_trunc(bucket, ts).alias("_bucket"), F.struct(F.lit(0).alias("_"), *keep).alias("_kept"))
    own = ("_key", "_none")
    first = log.groupBy(*own, "_bucket").agg(F.min_by(F.struct("current"), F.struct("_ts", "_tie")).alias("_first"))
    after = first.select(*own, "_bucket", F.lead("_first").over(Window.partitionBy(*own).orderBy("_bucket")).getField("current").alias("_after"))
    within = log.withColumn("_next", F.lead(F.struct("current")).over(Window.partitionBy(*own, "_bucket").orderBy("_ts", "_tie")))
    both = within.join(after.withColumnsRenamed({"_bucket": "_b", "_key": "_k", "_none": "_n"}), (F.col("_k") == F.col("_key")) & (F.col("_n") == F.col("_none")) & F.col("_b").eqNullSafe(F.col("_bucket")))
    return both.select("current", F.when(F.col("_next").isNull(), F.col("_after")).otherwise(F.col("_next.current")).alias("next"), *[F.col(f"_kept.{c}").alias(c) for c in keep]).where("next IS NOT NULL")


def recall_later(pairs: DataFrame, later: Column, by: str | None = None, k: int = OFFERED) -> DataFrame:
    """(by, pairs, recall, mrr): as recall_and_mrr, but successors are counted on the pairs where `later` does not hold and tested on those where it does; in one row, or a row for each value of a column. A tool that was not seen before has no successors; a null `later` counts as earlier; without later pairs there are no rows, or one of nulls."""
    held = F.coalesce(later, F.lit(False))
    counts = pairs.where(~held).groupBy("current", "next").agg(F.count("*").cast("double").alias("score"))
    places = rank(counts.select(F.col("current").alias("request_id"), F.col("next").alias("tool_id"), "score"), k).select(F.col("request_id").alias("current"), F.col("tool_id").alias("next"), "rk")
    tested = pairs.where(held).groupBy(*([by] if by else []), "current", "next").agg(F.count("*").alias("n")).join(places, ["current", "next"], "left")
    total = F.sum("n")
    measures = [total.alias("pairs"), F.round(F.sum(F.when(F.col("rk").isNotNull(), F.col("n")).otherwise(0)) / total, 6).alias("recall"), F.round(F.sum(F.coalesce(F.col("n") / F.col("rk"), F.lit(0.0))) / total, 6).alias("mrr")]
    return tested.groupBy(by).agg(*measures) if by else tested.agg(*measures)


def recall_and_mrr(pairs: DataFrame, k: int = OFFERED) -> DataFrame:
    """One row: how often the k most frequent successors of a tool hold the next one, and the mean of 1 / its rank among them; nulls for no pairs."""
    counts = pairs.groupBy("current", "next").agg(F.count("*").alias("n"))
    scored = counts.select(F.col("current").alias("request_id"), F.col("next").alias("tool_id"), F.col("n").cast("double").alias("score"))
    places = rank(scored, k).select(F.col("request_id").alias("current"), F.col("tool_id").alias("next"), "rk")
    hits = counts.join(places, ["current", "next"], "left")
    total = F.sum("n")
    return hits.agg(
        total.alias("pairs"),
        F.round(F.sum(F.when(F.col("rk").isNotNull(), F.col("n")).otherwise(0)).cast("double") / total, 6).alias("recall"),
        F.round(F.sum(F.coalesce(F.col("n") / F.col("rk").cast("double"), F.lit(0.0))) / total, 6).alias("mrr"),
    )


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Calls by tool and first reason, by tool, and in all; a null tool or reason at the higher levels is 'all'."""
    grouped = verdicts.select("tool_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).rollup("tool_id", "reason")
    counted = grouped.agg(F.count("*").alias("n"), F.grouping("tool_id").alias("g1"), F.grouping("reason").alias("g2"))
    return counted.select(F.when(F.col("g1") == 1, "all").otherwise(F.col("tool_id")).alias("tool_id"), F.when(F.col("g2") == 1, "all").otherwise(F.col("reason")).alias("reason"), "n")


def verdict_cube(verdicts: DataFrame) -> DataFrame:
    """Calls by every combination of tool and acceptance; 'all' where one is left out."""
    counted = verdicts.select("tool_id", F.col("accepted").cast("string").alias("accepted")).cube("tool_id", "accepted").agg(F.count("*").alias("n"), F.grouping("tool_id").alias("g1"), F.grouping("accepted").alias("g2"))
    return counted.select(F.when(F.col("g1") == 1, "all").otherwise(F.col("tool_id")).alias("tool_id"), F.when(F.col("g2") == 1, "all").otherwise(F.col("accepted")).alias("accepted"), "n")


def verdicts_by_window(verdicts: DataFrame, width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """(start, reason, n): verdicts by first reason in windows of time, tumbling or, with a slide, overlapping. Rows without a time count in none. Works on streams with a watermark as well."""
    grouped = verdicts.groupBy(F.window(ts, width, slide).alias("w"), F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "reason", "n")


def visits(log: DataFrame, gap: str, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """(session_id, first, last, n): steps of a session that follow each other within a gap."""
    grouped = log.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return grouped.select(key, *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c) for c in ("first", "last")], "n")


def tool_places(log: DataFrame, key: str = "session_id", tool: str = "tool_id") -> DataFrame:
    """How often each session calls each tool, with its rank, dense rank and half among the session's tools. Counts come first, so a window holds a row a tool."""
    n = log.groupBy(key, tool).agg(F.count("*").alias("n"))
    most = Window.partitionBy(key).orderBy(F.desc("n"))
    return n.select(key, tool, "n", F.rank().over(most).alias("place"), F.dense_rank().over(most).alias("dense_place"), F.ntile(2).over(Window.partitionBy(key).orderBy(F.desc("n"), tool)).alias("half"))


def sessions_of_tools(log: DataFrame, key: str = "session_id", tool: str = "tool_id") -> DataFrame:
    """(tool_id, sessions, near): sessions that call each tool, exactly, and whether a sketch of a fixed size comes within a tenth."""
    # each pair once before it is counted: beside a distinct count, Spark would carry a sketch a tool and session
    counted = log.select(tool, key).distinct().groupBy(tool).agg(F.count(key).alias("sessions"), F.approx_count_distinct(key, 0.02).alias("sketch"))
    return counted.select(tool, "sessions", (F.abs(F.col("sketch") - F.col("sessions")) <= 0.1 * F.col("sessions")).alias("near"))


def mean_reciprocal_rank(ranked: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """(by, mrr): the mean of 1 / rank of the wanted tool over the requests of each group; 0 where it was not offered. Repeated wanted rows count each; an empty table gives none; a null group is a group."""
    both = wanted.join(ranked.select("request_id", "tool_id", F.col("rk").cast("double").alias("rk")), ["request_id", "tool_id"], "left")
    return both.groupBy(by).agg(F.round(F.avg(F.coalesce(1 / F.col("rk"), F.lit(0.0))), 6).alias("mrr"))
