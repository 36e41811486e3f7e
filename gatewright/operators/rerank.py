"""Short lists that follow new facts without ranking everything again.

Each request has a short list of its best tools, a few more than are offered, and a
floor: no pair outside the list stands before it. A new fact changes the scores of the tools
that need it and of the tool that it names, so only pairs of a changed request and such
a tool are scored again. Those that now stand before the floor join the list, those
of the list that fell behind it leave it. A list that is left with fewer tools than are
offered, though others are legal, has run dry, and that request alone is ranked anew.

Which joins broadcast goes by rows, not by bytes of files: a pair takes a byte or two in a file
and a hundred in memory.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.steps import written
from ..sources.tables import small
from . import rank

RESERVE = 5
#: A table of at most so many rows is broadcast.
FEW = 100_000


class Lists(NamedTuple):
    """entries: request_id, tool_id, score; floors: request_id, floor_score, floor_tool (null: nothing is outside); facts: request_id, facts; touched: pairs that were scored."""

    entries: DataFrame
    floors: DataFrame
    facts: DataFrame
    touched: int


def _few(table: DataFrame) -> DataFrame:
    """A written table, whose files know its rows, with the hint that these call for."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def _ahead(score: Column, tool: Column) -> Column:
    """Whether a pair stands before its request's floor."""
    return F.col("floor_tool").isNull() | (score > F.col("floor_score")) | ((score == F.col("floor_score")) & (tool <= F.col("floor_tool")))


def _cut(pairs: DataFrame, keep: int, floors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, floors) of the first `keep` pairs of each request; a request of which none was cut keeps its floor."""
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "tool_id")
    placed = pairs.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= keep + 1)
    placed = written(placed, "rerank-placed")
    last = F.when(F.col("rk") == keep, F.struct("score", "tool_id"))
    lows = placed.groupBy("request_id").agg(F.max("rk").alias("n"), F.max(last).alias("last"))
    cut = F.col("n") > keep
    if floors is not None:
        lows = floors.join(lows.hint("merge"), "request_id", "left")
        cut = F.coalesce(cut, F.lit(False))
    old = (F.col("floor_score"), F.col("floor_tool")) if floors is not None else (F.lit(None), F.lit(None))
    out = lows.select("request_id", F.when(cut, F.col("last.score")).otherwise(old[0]).alias("floor_score"), F.when(cut, F.col("last.tool_id")).otherwise(old[1]).alias("floor_tool"))
    return placed.where(F.col("rk") <= keep).drop("rk"), out


def _scored(pairs: DataFrame, facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(request_id, tool_id, score) of pairs under these facts; tools that are not in the registry fall out."""
    found = pairs.join(facts.hint("merge"), "request_id", "left").join(small(registry.select("tool_id", "prereqs")), "tool_id")
    return rank.score_state(found).select("request_id", "tool_id", "score")


def begin(requests: DataFrame, registry: DataFrame, legal: DataFrame, k: int = rank.OFFERED, reserve: int = RESERVE) -> Lists:
    """Lists of all requests (request_id, facts) over their legal pairs (request_id, tool_id), ranked in full. Null facts are none, repeated pairs count once."""
    facts = written(requests.select("request_id", F.coalesce("facts", F.array().cast("array<string>")).alias("facts")), "rerank-facts")
    scored = _scored(legal.select("request_id", "tool_id").distinct(), facts, registry)
    entries, floors = _cut(scored, k + reserve)
    floors = facts.select("request_id").join(floors.hint("merge"), "request_id", "left")
    return Lists(written(entries, "rerank-entries"), written(floors, "rerank-floors"), facts, scored.count())


def follow(lists: Lists, news: DataFrame, registry: DataFrame, legal: DataFrame, k: int = rank.OFFERED, reserve: int = RESERVE) -> Lists:
    """The lists after news (request_id, fact). Facts that are known already, null ones, and those of unknown requests change nothing."""
    keep = k + reserve
    known = lists.facts.select("request_id", F.explode("facts").alias("fact"))
    new = news.select("request_id", "fact").where("fact IS NOT NULL").distinct().join(known.hint("merge"), ["request_id", "fact"], "left_anti")
    new = written(new.join(lists.facts.select("request_id").hint("merge"), "request_id", "left_semi"), "rerank-news")
    added = new.groupBy("request_id").agg(F.collect_set("fact").alias("more"))
    facts = lists.facts.join(added.hint("merge"), "request_id", "left").select("request_id", F.when(F.col("more").isNull(), F.col("facts")).otherwise(F.array_union("facts", F.coalesce("more", F.array()))).alias("facts"))
    facts = written(facts, "rerank-facts")

    needs = registry.select("tool_id", F.explode("prereqs").alias("fact")).unionByName(registry.select("tool_id", F.col("tool_id").alias("fact"))).distinct()
    needs = small(written(needs, "rerank-needs"))
    pairs = new.join(needs, "fact").select("request_id", "tool_id").distinct().join(legal.select("request_id", "tool_id").hint("merge"), ["request_id", "tool_id"], "left_semi")
    changed = written(_scored(pairs, facts, registry), "rerank-changed")
    asked = _few(written(changed.select("request_id").distinct(), "rerank-asked"))
    floors = lists.floors.join(asked, "request_id", "left_semi")
    stay = lists.entries.join(asked, "request_id", "left_semi").join(changed.select("request_id", "tool_id").hint("merge"), ["request_id", "tool_id"], "left_anti")
    rise = changed.join(floors.hint("merge"), "request_id").where(_ahead(F.col("score"), F.col("tool_id"))).select("request_id", "tool_id", "score")
    entries, lows = _cut(stay.unionByName(rise), keep, floors)

    # fewer than are offered, and others outside
    sizes = entries.groupBy("request_id").agg(F.count("*").alias("n"))
    dry = lows.join(sizes.hint("merge"), "request_id", "left").where(F.col("floor_tool").isNotNull() & (F.coalesce("n", F.lit(0)) < k)).select("request_id")
    dry = _few(written(dry, "rerank-dry"))
    again = written(_scored(legal.select("request_id", "tool_id").join(dry, "request_id", "left_semi").distinct(), facts, registry), "rerank-again")
    fresh, fresh_lows = _cut(again, keep)
    without = lambda df, others: df.join(others, "request_id", "left_anti")
    entries = without(lists.entries, asked).unionByName(without(entries, dry)).unionByName(fresh)
    floors = without(lists.floors, asked).unionByName(without(lows, dry)).unionByName(fresh_lows)
    return Lists(written(entries, "rerank-entries"), written(floors, "rerank-floors"), facts, changed.count() + again.count())


def store(lists: Lists, path: str) -> None:
    """Write lists to a folder, in place of what is there."""
    for name in ("entries", "floors", "facts"):
        getattr(lists, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Lists:
    """Lists of a folder; `touched` is not kept."""
    return Lists(*(spark.read.parquet(f"{path}/{name}") for name in ("entries", "floors", "facts")), 0)


def offers(lists: Lists, k: int = rank.OFFERED) -> DataFrame:
    """(request_id, rk, tool_id, score): what is offered now."""
    return rank.rank(lists.entries, k)
