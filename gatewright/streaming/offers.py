"""Offers that follow a stream of facts.

Each micro-batch of news re-scores only the pairs that it concerns (operators.rerank). Its
lists are written under its number and begin from those of the number before, so a batch
that is repeated after a failure gives the same and replaces itself; the lists of two
batches are kept. Offers of the requests that a batch changed go to a folder of that batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rerank
from ..operators.rank import OFFERED


def _delete(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def live_offers(news: DataFrame, lists: rerank.Lists, registry: DataFrame, legal: DataFrame, path: str, checkpoint: str, k: int = OFFERED, reserve: int = rerank.RESERVE, once: bool = False) -> StreamingQuery:
    """A running query over news (request_id, fact). lists: those to begin with. Offers (request_id, rk, tool_id, score) come under path/offers/batch=<number>, lists under path/lists/<number>. Requests that are not in the lists, null facts and facts known already change nothing."""

    def step(batch: DataFrame, number: int) -> None:
        before = lists if number == 0 else rerank.load(batch.sparkSession, f"{path}/lists/{number - 1}")
        after = rerank.follow(before, batch, registry, legal, k, reserve)
        rerank.store(after, f"{path}/lists/{number}")
        changed = rerank.load(batch.sparkSession, f"{path}/lists/{number}").entries.join(batch.select(F.col("request_id")).distinct(), "request_id", "left_semi")
        rerank.rank.rank(changed, k).write.mode("overwrite").parquet(f"{path}/offers/batch={number}")
        _delete(batch, f"{path}/lists/{number - 2}")

    writer = news.select("request_id", "fact").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
