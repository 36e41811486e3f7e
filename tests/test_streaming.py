"""Live forms against batch forms; late calls, silence, and recovery."""

import datetime as dt

from pyspark.sql import functions as F

from gatewright.operators import policy, state
from gatewright.sources import tables
from gatewright.streaming.live import live_check, live_recover, live_state

SCHEMA = "call_id long, session_id long, ts timestamp, tool_id string, args_json string"


def test_live_equals_batch(spark, tmp_path):
    log = tables.calls(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = log.select(F.percentile_approx("ts", F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0))))).first()[0]
    low = None
    for i, cut in enumerate(cuts):
        part = log.where((F.col("ts") <= cut) & (F.lit(True) if low is None else F.col("ts") > low))
        if i == 1:  # a duplicate of a call in the same batch
            part = part.unionByName(part.limit(1))
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        low = cut
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    legal, registry = tables.session_legal(log).cache(), tables.contracts(spark)
    query = live_check(stream, registry, legal, tables.ALLOWED_EFFECTS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    live = spark.read.parquet(str(tmp_path / "out"))
    batch = policy.check(state.before(log).withColumn("allowed", F.array(*map(F.lit, tables.ALLOWED_EFFECTS))), registry, legal)
    columns = ["call_id", "accepted", "reason", "reasons", "state"]
    assert live.count() == log.count()
    assert live.select(columns).exceptAll(batch.select(columns)).count() == 0


def run(spark, tmp_path, schema, batches, transform):
    """The rows of a stream that reads these batches one after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b/{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b/*"))
    query = transform(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "o")).collect()


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_late_calls_and_silent_sessions(spark, tmp_path):
    """A late call sees what was known at its time; after a long silence a session begins anew."""
    batches = [
        [(1, 1, at(10), "a", "{}"), (2, 1, at(30), "b", "{}")],
        [(3, 1, at(20), "c", "{}"), (3, 1, at(20), "c", "{}")],  # late, and twice
        [(4, 1, at(40), "d", "{}")],
        [(5, 2, at(4000), "x", "{}")],
        [(6, 2, at(4001), "x", "{}")],
        [(7, 1, at(4002), "a", "{}")],
    ]
    got = {r.call_id: r.state for r in run(spark, tmp_path, SCHEMA, batches, lambda s: live_state(s, "1 hour", 3600))}
    assert got == {1: [], 2: ["a"], 3: ["a"], 4: ["a", "b", "c"], 5: [], 6: ["x"], 7: []}


def test_live_recovery(spark, tmp_path):
    """No declined tool returns, in later batches either; nothing left, or only weak candidates, is abstention."""
    found = [("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", None)]
    schema = "event_id long, request_id long, ts timestamp, declined array<string>, candidates array<struct<tool_id:string,score:double>>"
    batches = [
        [(1, 1, at(1), None, found), (2, 2, at(1), ["a"], [("a", 0.9)]), (3, 3, at(1), None, [("z", 0.05)]), (8, 4, at(1), None, None)],
        [(4, 1, at(2), ["a"], found), (5, 3, at(2), [None], [("z", 0.1), ("y", 0.2)])],
        [(6, 1, at(3), ["b", "never offered"], found)],
        [(7, 1, at(4), ["c"], found)],
    ]
    got = {r.event_id: (r.outcome, r.offered) for r in run(spark, tmp_path, schema, batches, lambda s: live_recover(s, 2, 0.1))}
    assert got == {1: ("offer", ["a", "b"]), 2: ("no_tool", []), 3: ("low_confidence", []), 4: ("offer", ["b", "c"]), 5: ("offer", ["y", "z"]), 6: ("offer", ["c"]), 7: ("no_tool", []), 8: ("no_tool", [])}
