"""Candidates, scores and the short list of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.tables import small

OFFERED = 3


def candidates(requests: DataFrame, registry: DataFrame, legal: DataFrame) -> DataFrame:
    """A row for each request and tool that is legal for it and in the registry.

    Legal pairs are the large side, whatever an estimate says of them: both sides are sorted by
    request, which the short list's window then needs no more. In as many parts as the session shuffles to,
    since scores cost far more than the bytes by which Spark would merge small parts.
    """
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(parts, "request_id").join(legal.hint("merge"), "request_id").join(small(registry), "tool_id")


def score_vectors(found: DataFrame) -> DataFrame:
    """candidates with the dot product of objective_vec and tool_vec as score; pairs without two vectors of one length are none, a null component makes a null score."""
    # asked of the inputs: a filter on the score would be pushed down and make it twice
    found = found.where(F.size("objective_vec") == F.size("tool_vec"))
    return found.withColumn("score", scoring.dot(F.col("objective_vec"), F.col("tool_vec")))


def score_words(requests: DataFrame, registry: DataFrame, legal: DataFrame, request_text: str, tool_text: str) -> DataFrame:
    """(request_id, tool_id, score): Jaccard similarity of tokens, for legal pairs that share one. Each text is split once and pairs compare sets, so a token that many texts share makes no more pairs. Null texts have no tokens."""
    asked = requests.select("request_id", scoring.tokens(F.col(request_text)).alias("a"))
    tools = registry.select("tool_id", scoring.tokens(F.col(tool_text)).alias("b"))
    both = candidates(asked, tools, legal).select("request_id", "tool_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    return both.where("both > 0").select("request_id", "tool_id", scoring.jaccard(F.col("both"), F.col("n_a"), F.col("n_b")).alias("score"))


def score_state(found: DataFrame) -> DataFrame:
    """candidates (with facts and prereqs) with score and ready: the share of prerequisites that are known facts, less half for a tool that the facts already hold; so the order follows what a session has seen. Null arrays are empty."""
    none = F.array().cast("array<string>")
    facts, needs = F.coalesce("facts", none), F.array_distinct(F.coalesce("prereqs", none))
    met = F.when(F.size(needs) == 0, 1.0).otherwise(F.size(F.array_intersect(needs, facts)).cast("double") / F.greatest(F.size(needs), F.lit(1)))
    score = F.round(met - F.when(F.array_contains(facts, F.col("tool_id")), 0.5).otherwise(0.0), scoring.PLACES)
    return found.withColumns({"score": score, "ready": scoring.readiness(F.col("facts"), F.col("prereqs"))})


def with_any(requests: DataFrame, legal: DataFrame) -> DataFrame:
    """The requests that have a legal tool at all, each once."""
    return requests.join(legal, "request_id", "left_semi")


def rank(scored: DataFrame, k: int = OFFERED, order: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, rk, tool_id, score) of the k best, with the columns in keep; of equal scores the lesser tool_id. Rows without a score are no candidates; an empty table gives none."""
    best = Window.partitionBy("request_id").orderBy(F.desc("score") if order is None else order, F.asc("tool_id"))
    if order is not None:
        scored = scored.where(F.col("score").isNotNull())
    # nulls stand last in a descending order, so they take nothing from the first k
    return scored.withColumn("rk", F.row_number().over(best)).where((F.col("rk") <= k) & F.col("score").isNotNull()).select("request_id", "rk", "tool_id", "score", *keep)


def menu_reduction(ranked: DataFrame, registry: DataFrame, text: str) -> DataFrame:
    """One row: characters of all offered descriptions, of the whole registry for as many requests, and their share; null where nothing is offered or no tool is described. Null descriptions are empty."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    tools = registry.select("tool_id", size.alias("chars"))
    whole = tools.agg(F.sum("chars").alias("registry_chars"))
    offered = ranked.join(small(tools), "tool_id").groupBy("request_id").agg(F.sum("chars").alias("chars"))
    used = offered.agg(F.sum("chars").alias("menu_chars"), F.count("*").alias("requests"))
    both = used.withColumn("registry_chars", whole.scalar() * F.col("requests"))
    return both.select("requests", "menu_chars", "registry_chars", F.round(F.try_divide(F.col("menu_chars").cast("double"), F.col("registry_chars")), scoring.PLACES).alias("share"))
