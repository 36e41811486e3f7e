"""Call logs in and verdicts out, with Spark's own file formats.

A log is read with a fixed schema, so nothing is inferred and a scan reads only the
columns that are used; rows that do not fit it are kept, with their text in `corrupt`
(JSON and CSV). Verdicts are written by reason, so that a reader of one reason reads
its folder only; a stream's micro-batch is written to a folder of its own, so a batch
that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "call_id long, session_id long, ts timestamp, tool_id string, args_json string"


def read_log(spark: SparkSession, path: str, kind: str = "parquet", stream: bool = False, **options: str) -> DataFrame:
    """Calls from Parquet, ORC, JSON lines or CSV, as a table or as a stream of new files."""
    reader = (spark.readStream if stream else spark.read).format(kind).options(**options)
    if kind in ("json", "csv"):
        return reader.option("columnNameOfCorruptRecord", "corrupt").schema(f"{LOG}, corrupt string").load(path)
    return reader.schema(LOG).load(path)


def by_reason(verdicts: DataFrame) -> DataFrame:
    """verdicts with `outcome`: the first reason, or accepted."""
    return verdicts.withColumn("outcome", F.coalesce("reason", F.lit("accepted")))


def write_verdicts(verdicts: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Verdicts in one folder for each outcome."""
    by_reason(verdicts).write.format(kind).mode(mode).partitionBy("outcome").save(path)


def stream_verdicts(verdicts: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = False) -> StreamingQuery:
    """A running query that writes each micro-batch of verdicts under path/batch=<number>/outcome=<reason>."""

    def write(batch: DataFrame, number: int) -> None:
        write_verdicts(batch, f"{path}/batch={number}", kind)

    writer = verdicts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
