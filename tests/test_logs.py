"""Logs in each format, and verdicts by reason from tables and streams."""

import os

import pytest
from pyspark.sql import functions as F

from gatewright.operators import policy, state
from gatewright.sources import logs, tables
from gatewright.streaming.live import live_check


@pytest.fixture(scope="module")
def log(spark):
    return tables.calls(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, log, tmp_path, kind):
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"} if kind in ("csv", "json") else {}
    options |= {"escape": '"'} if kind == "csv" else {}
    log.write.format(kind).options(**options).save(str(tmp_path / kind))
    got = logs.read_log(spark, str(tmp_path / kind), kind, **options)
    assert got.select(log.columns).exceptAll(log).count() == 0 and got.count() == log.count()
    if kind == "json":
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad/x.json").write_text('{"call_id": 1}\nnot json\n')
        assert [(r.call_id, r.corrupt) for r in logs.read_log(spark, str(tmp_path / "bad"), "json").collect()] == [(1, None), (None, "not json")]


def test_verdicts_by_reason(spark, log, tmp_path):
    legal, registry = tables.session_legal(log), tables.contracts(spark)
    verdicts = policy.check(state.before(log).withColumn("allowed", F.array(*map(F.lit, tables.ALLOWED_EFFECTS))), registry, legal)
    logs.write_verdicts(verdicts, str(tmp_path / "v"))
    one = spark.read.parquet(str(tmp_path / "v")).where("outcome = 'unknown'")
    assert one.count() == verdicts.where("reason = 'unknown'").count() > 0 and (tmp_path / "v/outcome=unknown").is_dir()
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live_check(logs.read_log(spark, str(tmp_path / "in"), stream=True), registry, legal, tables.ALLOWED_EFFECTS)
    query = logs.stream_verdicts(stream, str(tmp_path / "s"), str(tmp_path / "c"), once=True)
    query.awaitTermination(300)
    live = spark.read.option("basePath", str(tmp_path / "s")).parquet(*[str(tmp_path / "s" / d) for d in os.listdir(tmp_path / "s")])
    same = ["call_id", "accepted", "reason"]
    assert live.select(same).exceptAll(verdicts.select(same)).count() == 0 and live.count() == log.count()
