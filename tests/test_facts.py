"""Map state, initial state, the state as a table, and outcomes that do not come."""

import datetime

import pytest
from pyspark.sql import functions as F

from gatewright.operators import state
from gatewright.streaming import facts

CALLS = "call_id long, session_id long, ts timestamp, tool_id string"


def at(minutes):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, facts.ROCKS)
    yield spark
    spark.conf.set(key, before)


def streamed(spark, path, batches, build):
    """Rows of a stream over batches, given one after the other."""
    for rows in batches:
        spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(CALLS).parquet(f"{path}/in")
        query = build(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


LOG = [(1, 1, at(0), "a"), (2, 1, at(5), "b"), (3, 2, at(6), "a"), (4, 1, at(7), None), (5, 1, at(20), "a"), (6, 2, at(21), "c"), (7, 1, at(30), "c"), (8, 3, at(31), "b"), (9, 1, at(32), "b")]


def expected(spark, log):
    return {(r.call_id, tuple(r.state)) for r in state.before(spark.createDataFrame(log, CALLS)).collect()}


def test_stream_is_batch_and_its_state_is_the_fold(rocks, tmp_path):
    got = streamed(rocks, str(tmp_path), [LOG[:3], LOG[3:6], LOG[6:]], facts.live_facts)
    assert {(r.call_id, tuple(r.state)) for r in got} == expected(rocks, LOG)
    held = {r.session_id: r.facts for r in facts.held_facts(rocks, f"{tmp_path}/at").collect()}
    assert held == {r.session_id: r.facts for r in state.fold(rocks.createDataFrame(LOG, CALLS)).collect()}


def test_begins_from_a_batch_fold(rocks, tmp_path):
    older = facts.first_seen(rocks.createDataFrame(LOG[:4], CALLS))
    got = streamed(rocks, str(tmp_path), [LOG[4:7], LOG[7:]], lambda s: facts.live_facts(s, older))
    assert {(r.call_id, tuple(r.state)) for r in got} == {x for x in expected(rocks, LOG) if x[0] > 4}


def test_silent_sessions_are_dropped_and_late_calls_judged_at_their_time(rocks, tmp_path):
    build = lambda s: facts.live_facts(s, watermark="10 minutes", idle_seconds=600)
    batches = [[(1, 1, at(0), "a"), (2, 2, at(0), "a")], [(3, 2, at(100), "b"), (4, 2, at(95), "c")], [(5, 1, at(101), "b"), (6, 2, at(94), "d")], [(5, 1, at(101), "b")]]
    got = {r.call_id: r.state for r in streamed(rocks, str(tmp_path), batches, build)}
    assert got[1] == got[2] == [] and got[5] == []  # session 1 was silent for 100 minutes
    assert got[3] == ["c"] or got[3] == ["a", "c"]
    assert got[6] in ([], ["a"]) and len(got) == 6


OUT = "call_id long, ts timestamp, outcome string"


def test_calls_without_an_outcome_in_time(spark, tmp_path):
    calls = [(1, at(0)), (2, at(1)), (3, at(2)), (4, at(3)), (5, at(200))]
    said = [(1, at(5), "done"), (2, at(20), "late"), (4, at(1), "before"), (4, at(4), "done"), (4, at(6), "again"), (9, at(1), "of nothing"), (None, at(1), "x")]
    # as tables: what the stream must have said when both watermarks have passed
    batch = facts.unanswered(spark.createDataFrame(calls, "call_id long, ts timestamp"), spark.createDataFrame(said, "call_id long, ts timestamp, outcome string"))
    table = {(r.call_id, r.outcome) for r in batch.collect()}
    assert table == {(1, "done"), (2, None), (3, None), (4, "done"), (4, "again"), (5, None)}
    missing = {i for i, o in table if o is None}
    answered = spark.createDataFrame(said, OUT).select("call_id", F.col("ts").alias("t"))
    asked = spark.createDataFrame(calls, "call_id long, ts timestamp")
    anti = asked.join(answered, (asked.call_id == answered.call_id) & F.col("t").between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 10 minutes")), "left_anti")
    assert {r.call_id for r in anti.collect()} == missing

    def give(rows, schema, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("calls", "call_id long, ts timestamp"), ("said", OUT))]
        query = facts.unanswered(*streams, watermark="10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r.call_id, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    give(calls[:4], "call_id long, ts timestamp", "calls")
    give(said, OUT, "said")
    got = run()
    assert {x for x in got if x[1]} == {x for x in table if x[1]}
    # both streams go on; then the first calls are closed, and said once
    give([calls[4]], "call_id long, ts timestamp", "calls")
    give([(77, at(200), "other")], OUT, "said")
    run()
    give([(6, at(400))], "call_id long, ts timestamp", "calls")
    give([(78, at(400), "other"), (2, at(3), "beyond the watermark")], OUT, "said")
    assert run() == table
