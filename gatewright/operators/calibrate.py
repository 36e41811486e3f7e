"""What scores mean: the share of right offers by score, and the threshold that follows.

The share is fitted as the non-decreasing function nearest to the outcomes (isotonic
regression) by pooling neighbours that violate the order. Outcomes with equal scores,
to six places, are first summed; ranges of scores are pooled each by itself, and the blocks
of FAN neighbouring ranges are pooled again until one range is left. That gives the blocks of
the whole, as pooling may begin anywhere. Blocks carry whole counts, so comparisons
are exact and the result does not depend on the split. What meets in the last range is a row a
block, at most one a distinct score: two million for scores from -1 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.steps import written

FAN = 16
_BLOCK = "lo double, hi double, n long, rights long"


def pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of neighbours, in order, whose shares rise strictly."""
    out: list[list] = []
    for lo, hi, n, rights in rows.sort_values("lo")[["lo", "hi", "n", "rights"]].itertuples(index=False):
        out.append([lo, hi, n, rights])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, rights = out.pop()
            out[-1][1:] = [hi, out[-1][2] + n, out[-1][3] + rights]
    return pd.DataFrame(out, columns=["lo", "hi", "n", "rights"])


def calibrate(outcomes: DataFrame, parts: int | None = None) -> DataFrame:
    """(lo, hi, n, rights, share): blocks of scores, ascending, with strictly rising shares of right offers. outcomes: score, right (boolean); rows with a null in either say nothing; an empty table gives none. parts: ranges to begin with."""
    spark = outcomes.sparkSession
    score = F.round(F.col("score").cast("double"), scoring.PLACES)
    points = outcomes.where("score IS NOT NULL AND right IS NOT NULL").groupBy(score.alias("lo")).agg(F.count("*").alias("n"), F.sum(F.col("right").cast("long")).alias("rights"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if rows:
            yield pool(pd.concat(rows))

    ranged = points.select("lo", F.col("lo").alias("hi"), "n", "rights").repartitionByRange(parts, "lo")
    blocks = written(ranged.mapInPandas(each, _BLOCK).withColumn("part", F.spark_partition_id()), "calibrate-0")
    while parts > 1:
        parts = -(-parts // FAN)
        merged = blocks.groupBy((F.col("part") / FAN).cast("int").alias("part")).applyInPandas(lambda key, rows: pool(rows).assign(part=int(key[0])), f"{_BLOCK}, part int")
        blocks = written(merged, "calibrate")
    return blocks.select("lo", "hi", "n", "rights", (F.col("rights") / F.col("n")).alias("share"))


def threshold(blocks: DataFrame, errors: float) -> float | None:
    """The least score from which on at most a share `errors` of the outcomes is wrong, as calibrated; None if there is none."""
    down = Window.orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.select("lo", F.sum("n").over(down).alias("n"), F.sum("rights").over(down).alias("rights"))
    return sums.where(F.col("n") - F.col("rights") <= F.lit(float(errors)) * F.col("n")).agg(F.min("lo")).first()[0]


def confidence(scored: DataFrame, blocks: DataFrame) -> DataFrame:
    """scored (with score) with confidence: the share of the last block that begins at or under the score, or of the first; null for a null score, or without blocks. Scores meet blocks as distinct values, in order, and rows by equality."""
    scored = scored.drop("confidence")
    own = F.round(F.col("score").cast("double"), scoring.PLACES)
    values = scored.where("score IS NOT NULL").select(own.alias("at")).distinct().select("at", F.lit(None).cast("double").alias("share"))
    both = values.withColumn("ask", F.lit(1)).unionByName(blocks.select(F.col("lo").alias("at"), "share", F.lit(0).alias("ask")))
    order = Window.orderBy("at", "ask")
    held = F.coalesce(F.last("share", ignorenulls=True).over(order), F.first("share", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    found = both.select("at", "ask", held.alias("confidence")).where("ask = 1").select(F.col("at").alias("_at"), "confidence")
    return scored.join(found, own == F.col("_at"), "left").drop("_at")
